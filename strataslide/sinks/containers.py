"""Small containers as bytes: what a reader of the same format finds again.

Index containers carry tile records only; tiles are (level, col, row_no, offset, length).
Plane containers carry whole planes of channels.
"""

from __future__ import annotations

import base64
import io
import struct
import zipfile
import zlib

import numpy as np

_JPEG = b"\xff\xd8\xff\xe0"


def tmap07(tiles, side: int = 16, levels: int = 3) -> bytes:
    """Levels of side x side cells of 256 pixels."""
    data = bytearray(1200 + 40 * side * side * levels)
    data[:6] = b"TMAP07"
    data[8:13] = bytes([1, 90, 1, 2 ** (levels - 1), 240])
    struct.pack_into("<fiiiq", data, 16, 0.00025, 0, levels, len(tiles), 0)
    for k in range(levels):
        struct.pack_into("<ifiiiiii", data, 560 + 32 * k, k, 1.0, side * 256 >> k, side * 256 >> k, side, side, 1200 + 40 * side * side * k, 0)
    for level, col, row, offset, length in tiles:
        struct.pack_into("<iiiiiiqii", data, 1200 + 40 * (side * side * level + row * side + col), level, 0, 0, 0, 256, 256, offset, length, 0)
    return bytes(data)


def dyj(tiles, tile: int = 1280, z: int = 8) -> bytes:
    """Records at the fixed place; all point at one JPEG, so offsets are not the tiles' own."""
    data = bytearray(0x150)
    data[:8] = b"DPTWSI\x02\x00"
    struct.pack_into("<HH", data, 0x0C, 4096, tile)
    struct.pack_into("<f", data, 0x10, 0.5)
    data[0x120 : 0x120 + len(_JPEG)] = _JPEG
    for level, col, row, _, length in tiles:
        data += struct.pack("<BIIBiq", level, col * tile, row * tile, z, length, 0x120)
    return bytes(data)


def zyp(tiles) -> bytes:
    words = ["Version", "2.01", "MicrometersPerPixel", "0.25"]
    for level, col, row, offset, length in tiles:
        words += [f"0,0,{level},{col},{row}", "StartPosition", str(offset), "DataLength", str(length)]
    return b"tiles" + b"".join(b"\xff\xfe\xff" + bytes([len(w)]) + w.encode("utf-16le") for w in words)


def tron(tiles) -> bytes:
    """A member of `length` bytes for each tile; where it lies is the archive's matter."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for level, col, row, _, length in tiles:
            z.writestr(f"{level}/1/{col}_{row}.jpg", bytes(length))
    return out.getvalue()


def mdsx(tiles, side: int = 16) -> bytes:
    """One layer of side x side cells."""
    xml = f'<?xml version="1.0"?><R><ImageMatrix value=""><Width value="{side * 256}"/><Height value="{side * 256}"/><LayerCount value="1"/><CellWidth value="256"/><Layer0><Rows value="{side}"/><Cols value="{side}"/></Layer0></ImageMatrix></R>'
    packed, table = base64.b64encode(xml.encode("utf-16le")), 2000
    end = table + 4 + 10 * side * side
    data = bytearray(end) + packed
    data[:4] = b"BKIO"
    struct.pack_into("<IIII", data, 84, 0x64, 0, 1000, 0x64)
    for k, place in enumerate(((end, len(packed)), (0, 0), (0, 0), (0, 0))):
        struct.pack_into("<II", data, 1020 + 14 * k, *place)
    struct.pack_into("<IIII", data, 164, 0, 0, table, 4 + 10 * side * side)
    for level, col, row, offset, length in tiles:
        struct.pack_into("<HII", data, table + 4 + 10 * (row * side + col), 0, offset, length)
    return bytes(data)



def tiff_pages(pages, compress=False):
    """pages: (pixels height x width [x samples], description, page name, software) as a little-endian TIFF; strips of 7 rows."""
    body, link = bytearray(b"II*\0\0\0\0\0"), 4
    for pixels, description, name, software in pages:
        h, w = pixels.shape[:2]
        samples = pixels.shape[2] if pixels.ndim == 3 else 1
        strips = [np.ascontiguousarray(pixels[y : y + 7]).tobytes() for y in range(0, h, 7)]
        strips = [zlib.compress(s) if compress else s for s in strips]
        places = []
        for s in strips:
            places.append(len(body))
            body += s + bytes(len(s) % 2)
        texts = {270: description, 285: name, 305: software}
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [pixels.dtype.itemsize * 8]), (259, 3, [8 if compress else 1]), (273, 4, places), (277, 3, [samples]), (278, 4, [7]), (279, 4, [len(s) for s in strips]), (339, 3, [3 if pixels.dtype.kind == "f" else 1])]
        tags += [(t, 2, v.encode() + b"\0") for t, v in texts.items() if v]
        entries = b""
        for tag, kind, value in sorted(tags):
            raw = value if kind == 2 else struct.pack(f"<{len(value)}{'H' if kind == 3 else 'I'}", *value)
            if len(raw) > 4:
                at = len(body)
                body += raw + bytes(len(raw) % 2)
                raw = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(value)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", body, link, len(body))
        body += struct.pack("<H", len(tags)) + entries
        link = len(body)
        body += bytes(4)
    return bytes(body)


def ome(names, unit="nm", size=500):
    channels = "".join(f'<Channel ID="c:{k}"{f" Name={chr(34)}{n}{chr(34)}" if n else ""}/>' for k, n in enumerate(names))
    return f'<?xml version="1.0"?><OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Image><Pixels SizeC="{len(names)}" PhysicalSizeX="{size}" PhysicalSizeXUnit="{unit}">{channels}</Pixels></Image></OME>'


def czi(planes, xml, origin=(100, -50), tile=8):
    """planes: channels x height x width of 16 bits, cut into tiles, with one tile of a pyramid level that is none of level 0's."""
    body = bytearray(b"ZISRAWFILE".ljust(16, b"\0") + struct.pack("<qq", 512, 512) + bytes(512))

    def entry(c, x, y, w, h, stored, at):
        dims = [(b"X", x, w, stored[0]), (b"Y", y, h, stored[1]), (b"C", c, 1, 1)]
        return b"DV" + struct.pack("<iqiiB5xi", 1, at, 0, 0, 0, len(dims)) + b"".join(struct.pack("<4siifi", n, s, z, 0.0, k) for n, s, z, k in dims)

    entries = []
    for c, plane in enumerate(planes):
        h, w = plane.shape
        cuts = [(x, y, plane[y : y + tile, x : x + tile], 1) for y in range(0, h, tile) for x in range(0, w, tile)] + [(0, 0, plane[:tile:2, :tile:2], 2)]
        for x, y, part, factor in cuts:
            at, raw = len(body), np.ascontiguousarray(part).tobytes()
            e = entry(c, origin[0] + x, origin[1] + y, part.shape[1] * factor, part.shape[0] * factor, (part.shape[1], part.shape[0]), at)
            entries.append(e)
            meta = b"<M/>"
            body += b"ZISRAWSUBBLOCK".ljust(16, b"\0") + struct.pack("<qq", 0, 0) + (struct.pack("<iiq", len(meta), 0, len(raw)) + e).ljust(256, b"\0") + meta + raw
    directory = len(body)
    body += b"ZISRAWDIRECTORY".ljust(16, b"\0") + struct.pack("<qq", 0, 0) + struct.pack("<i", len(entries)).ljust(128, b"\0") + b"".join(entries)
    metadata = len(body)
    body += b"ZISRAWMETADATA".ljust(16, b"\0") + struct.pack("<qq", 0, 0) + struct.pack("<ii", len(xml), 0).ljust(256, b"\0") + xml.encode()
    struct.pack_into("<iiqqqiqq", body, 32, 1, 0, 0, 0, 0, 0, 0, 0)
    struct.pack_into("<q", body, 32 + 52, directory)
    struct.pack_into("<q", body, 32 + 60, metadata)
    return bytes(body)


def mcd(acquisitions):
    """acquisitions: id -> {channel name: (label, plane)}."""
    body, xml = bytearray(b"head" * 8), "<MCDSchema xmlns='x'><Slide><ID>1</ID></Slide><Slide><ID>2</ID></Slide><Panorama><ID>1</ID><SlideID>1</SlideID></Panorama><Panorama><ID>2</ID><SlideID>2</SlideID></Panorama><AcquisitionROI><ID>1</ID><PanoramaID>1</PanoramaID></AcquisitionROI><AcquisitionROI><ID>2</ID><PanoramaID>2</PanoramaID></AcquisitionROI>"
    for k, channels in acquisitions.items():
        h, w = next(iter(channels.values()))[1].shape
        y, x = np.mgrid[:h, :w]
        every = [x, y, np.zeros((h, w))] + [p for _, p in channels.values()]
        start = len(body)
        body += np.stack(every, axis=-1).astype("<f4").tobytes()
        roi = 2 if k >= 90 else 1
        xml += f"<Acquisition><ID>{k}</ID><Description>a{k}</Description><AcquisitionROIID>{roi}</AcquisitionROIID><MaxX>{w}</MaxX><MaxY>{h}</MaxY><DataStartOffset>{start}</DataStartOffset><DataEndOffset>{len(body)}</DataEndOffset><ValueBytes>4</ValueBytes></Acquisition>"
        for n, (name, label) in enumerate([("X", ""), ("Y", ""), ("Z", ""), *((c, v[0]) for c, v in channels.items())]):
            xml += f"<AcquisitionChannel><ID>{n}</ID><ChannelName>{name}</ChannelName><ChannelLabel>{label}</ChannelLabel><OrderNumber>{n}</OrderNumber><AcquisitionID>{k}</AcquisitionID></AcquisitionChannel>"
    return bytes(body) + (xml + "</MCDSchema>").encode("utf-16-le")
