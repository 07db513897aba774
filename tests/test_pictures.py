"""Pictures in containers that also hold channels: CZI of several scenes, H&E QPTIFF, plain TIFF; bytes are laid out here, not by the package."""

import struct
import zlib

import numpy as np
import pytest
import zstandard

from strataslide.api import SlideSet
from strataslide.functions import raster
from strataslide.sources import czi as Z
from strataslide.sources.blob import Blob

RNG = np.random.default_rng(21)
ASK = "request_id long, path string, x long, y long, level int, w int, h int"


def segment(name, body):
    return name.ljust(16, b"\0") + struct.pack("<qq", len(body), len(body)) + body


def czi(parts, xml="<ImageDocument/>"):
    """parts: (scene, mosaic number, x, y, pixel type, compression, h x w x samples in the file's order, bytes)."""
    out, entries = bytearray(segment(b"ZISRAWFILE", bytes(512))), []
    for scene, m, x, y, kind, packing, pixels, data in parts:
        h, w = pixels.shape[:2]
        dims = [(b"X", x, w), (b"Y", y, h), (b"C", 0, 1), (b"S", scene, 1), (b"M", m, 1)]
        e = b"DV" + struct.pack("<iqii", kind, len(out), 0, packing) + bytes(6) + struct.pack("<i", len(dims)) + b"".join(struct.pack("<4siifi", n, s, z, 0, z) for n, s, z in dims)
        entries.append(e)
        out += segment(b"ZISRAWSUBBLOCK", (struct.pack("<iiq", 5, 0, len(data)) + e).ljust(256, b"\0") + b"<M/> " + data)
    struct.pack_into("<q", out, 32 + 52, len(out))
    out += segment(b"ZISRAWDIRECTORY", struct.pack("<i", len(entries)).ljust(128, b"\0") + b"".join(entries))
    struct.pack_into("<q", out, 32 + 60, len(out))
    return bytes(out + segment(b"ZISRAWMETADATA", struct.pack("<ii", len(xml), 0).ljust(256, b"\0") + xml.encode()))


def bgr(h, w):
    return RNG.integers(0, 256, (h, w, 3), dtype=np.uint8)


#: scene, mosaic number, x, y, pixels; scene 1 lies over scene 0 and has an empty corner; the file has them out of order.
SCENES = [(1, 1, 130, 70, bgr(20, 30)), (0, 0, 100, 50, bgr(30, 40)), (1, 0, 120, 60, bgr(20, 30)), (0, 1, 135, 50, bgr(30, 40))]


def painted(scenes, w, h):
    """The rule, pixel by pixel: scenes in order, each its whole rectangle first, then its subblocks in order."""
    out = np.zeros((h, w, 3), np.uint8)
    x0, y0 = min(s[2] for s in scenes), min(s[3] for s in scenes)
    for scene in sorted({s[0] for s in scenes}):
        mine = sorted((s for s in scenes if s[0] == scene), key=lambda s: s[1])
        left, top = min(s[2] for s in mine), min(s[3] for s in mine)
        right, low = max(s[2] + s[4].shape[1] for s in mine), max(s[3] + s[4].shape[0] for s in mine)
        out[top - y0 : low - y0, left - x0 : right - x0] = 0
        for s in mine:
            out[s[3] - y0 : s[3] - y0 + s[4].shape[0], s[2] - x0 : s[2] - x0 + s[4].shape[1]] = s[4][:, :, ::-1]
    return out


def test_the_canvas_of_a_czi_picture(spark, tmp_path):
    (tmp_path / "many.czi").write_bytes(czi([(s, m, x, y, 3, 0, p, p.tobytes()) for s, m, x, y, p in SCENES]))
    deep = RNG.integers(0, 1 << 16, (9, 11, 3)).astype("<u2")
    halves = deep.view(np.uint8).reshape(-1, 2).T.tobytes()  # all low bytes, then all high ones
    (tmp_path / "one.czi").write_bytes(czi([(0, 0, -5, 3, 4, 6, deep, b"\x03\x01\x01" + zstandard.compress(halves))], '<OME><Image><Pixels SizeC="1" Type="bgr24"><Channel IlluminationType="Transmitted"/></Pixels></Image></OME>'))
    slides = SlideSet(spark, str(tmp_path))
    meta = {r["path"].rpartition("/")[2]: r for r in slides.metadata.collect()}
    many, one = meta["many.czi"], meta["one.czi"]
    assert (many["width"], many["height"], many["properties"]["slide.family"], many["properties"]["czi.scene-count"]) == (75, 40, "brightfield", "2")
    assert (one["width"], one["height"], one["error"]) == (11, 9, None)
    whole = painted(SCENES, 75, 40)
    asked = [(1, many["path"], 0, 0, 0, 75, 40), (2, many["path"], 18, 8, 0, 25, 17), (3, many["path"], -4, 30, 0, 20, 20), (4, one["path"], 0, 0, 0, 11, 9), (5, many["path"], 0, 0, 1, 4, 4), (6, many["path"], 500, 500, 0, 3, 2)]
    got = {r["request_id"]: r for r in slides.read_region(spark.createDataFrame(asked, ASK)).collect()}
    image = lambda k: np.frombuffer(got[k]["data"], np.uint8).reshape(got[k]["height"], got[k]["width"], 4)
    assert (image(1)[:, :, :3] == whole).all() and (image(1)[:, :, 3] == 255).all()
    assert (image(2)[:, :, :3] == whole[8:25, 18:43]).all()
    moved = np.zeros((20, 20, 3), np.uint8)
    moved[:10, 4:] = whole[30:40, :16]
    assert (image(3)[:, :, :3] == moved).all()
    assert (image(4)[:, :, :3] == (deep >> 8)[:, :, ::-1]).all()
    assert got[5]["error"]["class"] == "ValueError" and (image(6)[:, :, :3] == 0).all()
    thumbs = {r["path"].rpartition("/")[2]: r for r in slides.thumbnails(25, 25).collect()}
    small = np.frombuffer(thumbs["many.czi"]["data"], np.uint8).reshape(thumbs["many.czi"]["height"], thumbs["many.czi"]["width"], 4)
    assert (small[:, :, :3] == raster.thumbnail(whole, 25, 25)).all()
    with_scenes = slides.tiles(paths=[many["path"]]).select("row_no", "col", "x0", "y0").orderBy("row_no", "col").collect()
    assert [tuple(r) for r in with_scenes] == [(0, 1, 0, 0), (0, 2, 35, 0), (1, 3, 20, 10), (1, 4, 30, 20)]
    slides.close()


def test_a_subblock_of_an_unread_kind_stays_empty(spark, tmp_path):
    p = bgr(6, 7)
    (tmp_path / "a.czi").write_bytes(czi([(0, 0, 0, 0, 3, 0, p, p.tobytes()), (0, 1, 7, 0, 3, 4, p, p.tobytes()), (0, 2, 14, 0, 3, 1, p, raster.png(p))]))
    slides = SlideSet(spark, str(tmp_path))
    r = slides.read_region(spark.createDataFrame([(1, slides.metadata.first()["path"], 0, 0, 0, 21, 6)], ASK)).first()
    image = np.frombuffer(r["data"], np.uint8).reshape(6, 21, 4)
    assert (image[:, :7, :3] == p[:, :, ::-1]).all() and (image[:, 7:14] == (0, 0, 0, 255)).all() and (image[:, 14:, :3] == p).all()  # what is compressed goes to the decoder
    with pytest.raises(ValueError, match="compression 4"):
        Z.colors(Blob(str(tmp_path / "a.czi")), Z.directory(Blob(str(tmp_path / "a.czi")))[1])
    slides.close()


def page(data, plane, tile=None, packing=1, photometric=2, description="", apart=False, tables=b"", parts=None):
    """Appends the pixels of a page and gives its tags; tile: (w, h), else strips of 4 rows."""
    h, w, c = plane.shape
    tw, th = tile or (w, 4)
    pieces = parts
    if parts is None:
        pieces = []
        for k in range(c if apart else 1):
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    cut = plane[y : y + th, x : x + tw, k : k + 1] if apart else plane[y : y + th, x : x + tw]
                    if tile:
                        cut = np.pad(cut, ((0, th - cut.shape[0]), (0, tw - cut.shape[1]), (0, 0)))
                    raw = np.ascontiguousarray(cut).tobytes()
                    pieces.append(zlib.compress(raw) if packing == 8 else raw)
    places = []
    for p in pieces:
        places.append(len(data))
        data += p

    def held(values, code):
        at = len(data)
        data.extend(struct.pack(f"<{len(values)}{code}", *values))
        return at if len(values) * struct.calcsize(code) > 4 else struct.unpack("<I", bytes(data[at:]).ljust(4, b"\0"))[0]

    bits = plane.dtype.itemsize * 8
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, c, held([bits] * c, "H")), (259, 3, 1, packing), (262, 3, 1, photometric), (277, 3, 1, c), (284, 3, 1, 2 if apart else 1)]
    tags += [(322, 4, 1, tw), (323, 4, 1, th)] if tile else [(278, 4, 1, th)]
    tags += [(324 if tile else 273, 4, len(places), held(places, "I")), (325 if tile else 279, 4, len(places), held([len(p) for p in pieces], "I"))]
    for tag, kind, value in ((270, 2, description.encode()), (347, 7, tables)):
        if value:
            tags.append((tag, kind, len(value), held(value.ljust(5, b"\0"), "B")))
    return sorted(tags)


def tiff(pages):
    data, at = bytearray(b"II*\0\0\0\0\0"), 4
    for make in pages:
        tags = page(data, **make)
        data += b"\0" * (len(data) % 2)
        struct.pack_into("<I", data, at, len(data))
        data += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        at = len(data)
        data += b"\0" * 4
    return bytes(data)


def qpi(kind, name):
    return f"<PerkinElmer-QPI-ImageDescription><ImageType>{kind}</ImageType><Biomarker>{name}</Biomarker></PerkinElmer-QPI-ImageDescription>"


def test_pixels_of_tiff_pictures(spark, tmp_path):
    rgb = RNG.integers(0, 256, (37, 45, 3), dtype=np.uint8)
    grey = RNG.integers(0, 1 << 16, (37, 45, 1)).astype("<u2")
    half = rgb[::2, ::2]
    coded = raster.png(rgb[:16, :16])  # stands for a tile's JPEG: what matters is which bytes reach the decoder
    files = {
        "he.qptiff": tiff([dict(plane=rgb, tile=(16, 16), description=qpi("FullResolution", "H&E")), dict(plane=half[:4, :4], description=qpi("Thumbnail", "H&E")), dict(plane=half, tile=(16, 16), packing=8, description=qpi("ReducedResolution", "H&E"))]),
        "strips.tif": tiff([dict(plane=rgb, packing=8)]),
        "apart.tif": tiff([dict(plane=rgb, tile=(16, 32), apart=True)]),
        "deep.tif": tiff([dict(plane=grey, tile=(16, 16), photometric=0)]),
        "shared.tif": tiff([dict(plane=rgb[:16, :16], tile=(16, 16), packing=7, tables=b"\xff\xd8TABLES\xff\xd9", parts=[b"\xff\xd8" + coded])]),
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)

    def decoder(data):
        head = b"\xff\xd8TABLES"
        return raster.rgba(raster.from_png(data[len(head) :])) if data.startswith(head) else None

    slides = SlideSet(spark, str(tmp_path), decoder=decoder)
    path = {r["path"].rpartition("/")[2]: r["path"] for r in slides.metadata.collect()}
    asked = [(1, "he.qptiff", 0, 0, 0, 45, 37), (2, "he.qptiff", 10, 6, 1, 12, 9), (3, "strips.tif", 3, 5, 0, 40, 30), (4, "apart.tif", 7, 9, 0, 38, 28), (5, "deep.tif", 0, 0, 0, 45, 37), (6, "shared.tif", 2, 3, 0, 9, 8), (7, "strips.tif", 40, 30, 0, 10, 10)]
    got = {r["request_id"]: r for r in slides.read_region(spark.createDataFrame([(k, path[n], *rest) for k, n, *rest in asked], ASK)).collect()}
    image = lambda k: np.frombuffer(got[k]["data"], np.uint8).reshape(got[k]["height"], got[k]["width"], 4)
    assert all(r["error"] is None for r in got.values()) and len(got) == 7
    assert (image(1)[:, :, :3] == rgb).all() and (image(2)[:, :, :3] == half[3:12, 5:17]).all()
    assert (image(3)[:, :, :3] == rgb[5:35, 3:43]).all() and (image(4)[:, :, :3] == rgb[9:37, 7:45]).all()
    assert (image(5)[:, :, :3] == 255 - (grey >> 8)).all() and (image(6)[:, :, :3] == rgb[3:11, 2:11]).all()
    assert (image(7)[:7, :5, :3] == rgb[30:, 40:]).all() and (image(7)[7:] == (255, 255, 255, 0)).all()
    slides.close()


def test_a_format_from_outside(spark, tmp_path):
    from strataslide.catalog import catalog, register
    from strataslide.catalog.formats import SCHEMA

    parts = [RNG.integers(0, 256, (20, 20, 3), dtype=np.uint8) for _ in range(4)]
    coded = [raster.png(p) for p in parts]
    (tmp_path / "a.strip").write_bytes(struct.pack("<6I", 20, 4, *map(len, coded)) + b"".join(coded))
    row = ("strip", [".strip"], 0, "brightfield", False, True, False, False, False, False, "white", "single", "single")
    formats = register(catalog(spark), spark.createDataFrame([row], SCHEMA))
    slides = SlideSet(spark, str(tmp_path), formats=formats, readers={".strip": "tests.plugged_reader:parse"})
    meta = slides.metadata.first()
    assert (meta["format_id"], meta["width"], meta["height"], meta["error"]) == ("strip", 80, 20, None)
    found = slides.resolved().first()
    assert (found["format_id"], found["slide_family"], found["error"]) == ("strip", "brightfield", None)
    whole = np.hstack(parts)
    got = slides.read_region(spark.createDataFrame([(1, meta["path"], 13, 2, 0, 60, 25)], ASK)).first()
    image = np.frombuffer(got["data"], np.uint8).reshape(25, 60, 4)
    assert (image[:18, :, :3] == whole[2:, 13:73]).all() and (image[18:] == 255).all()
    top = slides.deepzoom(32, 0).agg({"dz_level": "max"}).first()[0]
    tile = slides.deepzoom_tiles(spark.createDataFrame([(1, meta["path"], top, 1, 0)], "request_id long, path string, dz_level int, col long, row_no long"), 32, 0).first()
    assert (np.frombuffer(tile["data"], np.uint8).reshape(20, 32, 3) == whole[:, 32:64]).all()
    slides.close()
    plain = SlideSet(spark, str(tmp_path))  # without it, the file is an error's row
    assert plain.errors().first()["error"]["class"] == "ValueError"
    plain.close()
    broken = SlideSet(spark, str(tmp_path), readers={"strip": "tests.plugged_reader:nothing"})
    assert broken.errors().first()["error"]["class"] == "AttributeError"
    broken.close()
