"""Container parsers: from a blob to levels, a tile index, properties and stored images.

Each gives a Parsed; pixel data stays where it is, tiles carry (offset, length). Layouts are
little-endian records, stated as numpy types.
"""

from __future__ import annotations

import base64
import importlib
import io
import re
import sqlite3
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

from ..functions.raster import image_size, xml_properties
from .blob import Blob
from . import czi
from .planes import is_ome_candidate, open_planes
from .tiff import samples, text, tiff_pages

# Sides of tiles where the file doesn't tell.
MDS_TILE, TRON_TILE = 512, 1024
TILE = np.dtype([("level", "i4"), ("z", "i4"), ("channel", "i4"), ("col", "i4"), ("row_no", "i4"), ("x0", "i8"), ("y0", "i8"), ("cov_w", "i4"), ("cov_h", "i4"), ("file_id", "i4"), ("offset", "i8"), ("length", "i8")])


@dataclass
class Parsed:
    format_id: str
    width: int = 0
    height: int = 0
    levels: list[tuple[int, int, float]] = field(default_factory=list)  # width, height, downsample
    mpp: float | None = None
    properties: dict[str, str] = field(default_factory=dict)
    stored: dict[str, tuple[int, int]] = field(default_factory=dict)  # name -> offset, length
    tiles: np.ndarray = field(default_factory=lambda: np.zeros(0, TILE))
    channels: list[str] = field(default_factory=list)
    data: dict[int, bytes] = field(default_factory=dict)  # tile number -> bytes, where a range of the file won't do

    def stated(self, vendor: str) -> Parsed:
        self.properties.setdefault("openslide.vendor", vendor)
        if self.mpp:
            self.properties.setdefault("openslide.mpp-x", repr(self.mpp))
            self.properties.setdefault("openslide.mpp-y", repr(self.mpp))
            self.properties.setdefault("openslide.objective-power", str(int(10 / self.mpp)))
        return self


def _tiles(n: int, **columns) -> np.ndarray:
    out = np.zeros(n, TILE)
    for name, values in columns.items():
        out[name] = values
    return out


def _halved(w: int, h: int, step: int, n: int, least: int = 1) -> list[tuple[int, int, float]]:
    return [(max(least, w // step**k), max(least, h // step**k), float(step**k)) for k in range(n)]


# --- tmap ---------------------------------------------------------------------

_TMAP06_HEAD = np.dtype([("focus", "u1"), ("format", "u1"), ("files", "u1"), ("layers", "u1"), ("color", "u1"), ("check", "u1"), ("step", "u1"), ("max_layer", "u1"), ("slide_type", "u1"), ("background", "u1"), ("pixel_mm", "<f4"), ("blocks", "<i4"), ("scale", "<i2"), ("img_col", "<i2"), ("img_row", "<i2"), ("img_w", "<i2"), ("img_h", "<i2"), ("tile_w", "<i2"), ("tile_h", "<i2"), ("air", "<i2", 2), ("minor", "u1"), ("save_scale", "u1"), ("shrunk", "<i4"), ("width", "<i4"), ("height", "<i4"), ("air_offset", "<i4")])
_TMAP06_EXT = np.dtype([("sizes", "<i4", 3), ("kind", "<i4", 8), ("offset", "<i4", 8), ("length", "<i4", 8), ("rest", "V24")])
_TMAP06_TILE = np.dtype([("layer", "u1"), ("col", "u1"), ("row", "u1"), ("pad", "u1"), ("offset", "<i4"), ("length", "<i4")])
_TMAP06_BLOCK = np.dtype([("file", "u1"), ("layer", "u1"), ("pad", "V2"), ("shift", "u1", 4), ("col", "<i2"), ("row", "<i2"), ("x", "<i4"), ("y", "<i4"), ("tiles", _TMAP06_TILE, 24)])
_TMAP06_SHRUNK = np.dtype([("file", "u1"), ("layer", "u1"), ("pad", "V2"), ("x", "<i4"), ("y", "<i4"), ("offset", "<i4"), ("length", "<i4")])


def tmap06(blob: Blob) -> Parsed:
    head = blob.record(6, _TMAP06_HEAD)
    at = 6 + _TMAP06_HEAD.itemsize
    ext = blob.record(at, _TMAP06_EXT)
    at += _TMAP06_EXT.itemsize
    blocks = blob.records(at, _TMAP06_BLOCK, int(head["blocks"]))
    shrunk = blob.records(at + _TMAP06_BLOCK.itemsize * int(head["blocks"]), _TMAP06_SHRUNK, int(head["shrunk"]))
    step = int(head["step"]) if 2 <= head["step"] <= 4 else 2
    pixel = float(head["pixel_mm"]) if head["pixel_mm"] >= 1e-8 else 1e-4
    out = Parsed("tmap", int(head["width"]), int(head["height"]), mpp=pixel * 1000)
    w, h, scale = out.width, out.height, int(head["scale"])
    while scale >= 1 and w > 0 and h > 0:
        out.levels.append((w, h, out.width / w))
        w, h, scale = -(-w // step), -(-h // step), scale // step
    names = {1: "macro_label", 2: "thumbnail"}
    for kind, offset, length in zip(ext["kind"].tolist(), ext["offset"].tolist(), ext["length"].tolist(), strict=True):
        if kind in names and offset > 0 and length > 0:
            out.stored[names[kind]] = (offset, length)
    t = blocks["tiles"]
    keep = (t["offset"] > 0) & (t["length"] > 0)
    wide = lambda c: np.broadcast_to(blocks[c][:, None], t.shape)[keep].astype(np.int64)
    factor = step ** t["layer"][keep].astype(np.int64)
    tw, th = int(head["tile_w"]), int(head["tile_h"])
    col, row = t["col"][keep].astype(np.int64), t["row"][keep].astype(np.int64)
    grid = _tiles(int(keep.sum()), level=t["layer"][keep], col=wide("col") * 8 + col, row_no=wide("row") * 8 + row, x0=wide("x") + col * tw * factor, y0=wide("y") + row * th * factor, cov_w=tw * factor, cov_h=th * factor, file_id=wide("file"), offset=t["offset"][keep], length=t["length"][keep])
    far = _tiles(len(shrunk), level=shrunk["layer"], z=-1, x0=shrunk["x"], y0=shrunk["y"], cov_w=tw * step ** shrunk["layer"].astype(np.int64), cov_h=th * step ** shrunk["layer"].astype(np.int64), file_id=shrunk["file"], offset=shrunk["offset"], length=shrunk["length"])
    out.tiles = np.concatenate([grid, far])
    out.properties |= {"tmap.scan-scale": str(head["scale"]), "tmap.background": str(head["background"]), "tmap.version": "06", "tmap.pixel-size": repr(pixel), "tmap.focus-layers": str(head["focus"]), "tmap.tile-count": "0"}  # of tiles this version states none
    return out.stated("tmap")


_TMAP07_A = np.dtype([("format", "u1"), ("quality", "u1"), ("focus", "u1"), ("scale", "u1"), ("background", "u1")])
_TMAP07_B = np.dtype([("pixel_mm", "<f4"), ("images", "<i4"), ("layers", "<i4"), ("tiles", "<i4"), ("ext", "<i8")])
_TMAP07_IMAGE = np.dtype([("w", "<i4"), ("h", "<i4"), ("depth", "<i4"), ("kind", "<i4"), ("offset", "<i8"), ("length", "<i4"), ("pad", "<i4")])
_TMAP07_LAYER = np.dtype([("id", "<i4"), ("scale", "<f4"), ("w", "<i4"), ("h", "<i4"), ("rows", "<i4"), ("cols", "<i4"), ("table", "<i4"), ("first", "<i4")])
_TMAP07_TILE = np.dtype([("layer", "<i4"), ("focus", "<i4"), ("x", "<i4"), ("y", "<i4"), ("w", "<i4"), ("h", "<i4"), ("offset", "<i8"), ("length", "<i4"), ("pad", "<i4")])


def tmap07(blob: Blob) -> Parsed:
    a, b = blob.record(8, _TMAP07_A), blob.record(16, _TMAP07_B)
    layers = blob.records(560, _TMAP07_LAYER, 16)
    layers = layers[(layers["w"] > 0) & (layers["h"] > 0)]
    out = Parsed("tmap", mpp=float(b["pixel_mm"]) * 1000)
    if len(layers):
        out.width, out.height = int(layers["w"][0]), int(layers["h"][0])
    w, h, scale = out.width, out.height, int(a["scale"])
    while scale >= 1 and w > 0 and h > 0:
        out.levels.append((w, h, out.width / w))
        w, h, scale = w // 2, h // 2, scale // 2
    focus = max(1, int(a["focus"]))
    parts = []
    for k, layer in enumerate(layers):
        rows, cols = int(layer["rows"]), int(layer["cols"])
        for z in range(focus):
            t = blob.records(int(layer["table"]) + z * rows * cols * _TMAP07_TILE.itemsize, _TMAP07_TILE, rows * cols)
            place = np.flatnonzero((t["offset"] > 0) & (t["length"] > 0))
            t = t[place]
            col, row, side = place % max(cols, 1), place // max(cols, 1), 256 * 2**k
            parts.append(_tiles(len(t), level=k, z=z, col=col, row_no=row, x0=col * side, y0=row * side, cov_w=side, cov_h=side, offset=t["offset"], length=t["length"]))
    out.tiles = np.concatenate(parts) if parts else out.tiles
    for k, image in enumerate(blob.records(304, _TMAP07_IMAGE, 8)[::-1]):
        if image["w"] > 0 and image["h"] > 0:
            out.stored[f"image-{int(image['kind'])}" if f"image-{int(image['kind'])}" not in out.stored else f"image-{int(image['kind'])}-{k}"] = (int(image["offset"]), int(image["length"]))
    out.properties |= {"tmap.scan-scale": str(a["scale"]), "tmap.background": str(a["background"]), "tmap.version": "07", "tmap.pixel-size": repr(float(b["pixel_mm"])), "tmap.focus-layers": str(focus), "tmap.tile-count": str(b["tiles"])}
    return out.stated("tmap")


# --- dyj ----------------------------------------------------------------------

_DYJ_RECORD = np.dtype([("layer", "u1"), ("x", "<u4"), ("y", "<u4"), ("z", "u1"), ("length", "<i4"), ("offset", "<i8")])


def _dyj_fields(r: np.ndarray) -> np.ndarray:
    return (r["layer"] <= 2) & (r["z"] < 16) & (r["length"] > 0) & (r["length"] <= 500_000) & (r["offset"] > 0)


def _dyj_jpeg(blob: Blob, r: np.ndarray) -> np.ndarray:
    return np.array([blob.read(at, 2) == b"\xff\xd8" for at in r["offset"].tolist()], bool)


def _dyj_starts(blob: Blob, at: int) -> bool:
    """Records begin at `at`: five whole ones with valid fields, three of which at least point at a JPEG."""
    r = blob.records(at, _DYJ_RECORD, 5)
    return len(r) == 5 and bool(_dyj_fields(r).all()) and int(_dyj_jpeg(blob, r).sum()) >= 3


def dyj(blob: Blob) -> Parsed:
    u = lambda at, n=4: int.from_bytes(blob.read(at, n), "little")
    stated, tile = u(0xB0), u(0x0E, 2)
    order = [stated, 0x150] if blob.read(0, 8) == b"DPTWSI\x01\x00" else [0x150, stated]
    start = next((at for at in order if at > 0 and _dyj_starts(blob, at)), 0x150)
    parts, at = [], start
    while True:  # records count up to the first that is not valid
        r = blob.records(at, _DYJ_RECORD, 4096)
        ok = _dyj_fields(r)
        n = len(r) if ok.all() else int(np.argmin(ok))
        ok = _dyj_jpeg(blob, r[:n])
        n = n if ok.all() else int(np.argmin(ok))
        parts.append(r[:n])
        at += n * _DYJ_RECORD.itemsize
        if n < 4096:
            break
    r = np.concatenate(parts)
    tile = tile or 1280
    mpp = struct.unpack("<f", blob.read(0x10, 4))[0]
    out = Parsed("dyj", mpp=mpp if 0.05 < mpp < 5.0 else 0.25)
    if len(r):
        out.width, out.height = int(r["x"].max()) + tile, int(r["y"].max()) + tile
    out.levels = [(out.width // s, out.height // s, float(s)) for s in (1, 4, 16)]
    _, last = np.unique(np.stack([r["layer"], r["x"], r["y"], r["z"]])[:, ::-1], axis=1, return_index=True)
    r = r[np.sort(len(r) - 1 - last)]  # of doubled keys the last holds
    out.tiles = _tiles(len(r), level=r["layer"], z=r["z"], x0=r["x"], y0=r["y"], col=r["x"] // tile, row_no=r["y"] // tile, cov_w=tile, cov_h=tile, offset=r["offset"], length=r["length"])
    for name, (a, b) in {"thumbnail": (0x20, 0x28), "label": (0x38, 0x40), "macro": (0x50, 0x58)}.items():
        if u(a) > 0 and u(b) > 0:
            out.stored[name] = (u(a), u(b))
    out.properties |= {"dyj.width": str(u(0x1A, 2)), "dyj.height": str(u(0x1C, 2)), "dyj.tile-size": str(tile)}
    return out.stated("dyj")


# --- zyp ----------------------------------------------------------------------

# Keys of the metadata tail that are followed by their value.
_ZYP_KEYS = ("Version", "ScanMode", "FlatNum", "LocationChannelId", "ROILeft", "ROITop", "SliceWidth", "SliceHeight", "LevelCount", "MicrometersPerPixel", "ScanZoom")
_ZYP_IMAGES = {"Preview": "thumbnail", "OriginalPreview": "macro", "Label": "label", "Barcode": "barcode"}
_SEGMENT = re.compile(rb"\xff\xfe\xff(.)", re.S)


def zyp_segments(tail: bytes) -> Iterator[str]:
    """UTF-16LE texts, each after FF FE FF and its length."""
    at = 0
    while m := _SEGMENT.search(tail, at):
        n = 2 * m.group(1)[0]
        at = m.end() + n
        if n and at <= len(tail):
            text = tail[m.end() : at]
            try:
                yield text.decode("utf-16le")
            except UnicodeDecodeError:
                continue
        else:
            at = m.end() + 1


def zyp(blob: Blob, window: int = 10 << 20) -> Parsed:
    start = max(0, blob.size - window)
    tail = blob.read(start, blob.size - start)
    t = list(zyp_segments(tail[max(0, tail.find(b"\xff\xfe\xff")) :]))
    out, meta, tiles, k = Parsed("zyp"), {}, {}, 0
    while k < len(t):
        if t[k] in _ZYP_KEYS and k + 1 < len(t):
            meta[t[k]] = t[k + 1]
            k += 2
        elif k + 4 < len(t) and t[k + 1] == "StartPosition" and t[k + 3] == "DataLength" and t[k + 2].isdigit() and t[k + 4].isdigit():
            place = (int(t[k + 2]), int(t[k + 4]))
            if t[k] in _ZYP_IMAGES:
                out.stored[_ZYP_IMAGES[t[k]]] = place
            elif re.fullmatch(r"(-?\d+,){3,4}-?\d+", t[k]):
                tiles[t[k]] = place
            k += 5
        else:
            k += 1
    at = np.array([[int(x) for x in c.split(",")[-3:]] for c in tiles], np.int64).reshape(-1, 3)
    place = np.array(list(tiles.values()), np.int64).reshape(-1, 2)
    if not len(at):
        raise ValueError("no tiles")
    side = 256
    base = at[at[:, 0] == 0]
    if len(base):
        out.width, out.height = int((base[:, 1].max() - base[:, 1].min() + 1) * side), int((base[:, 2].max() - base[:, 2].min() + 1) * side)
    if meta.get("SliceWidth", "").isdigit() and meta.get("SliceHeight", "").isdigit() and int(meta["SliceWidth"]) > 0 and int(meta["SliceHeight"]) > 0:
        out.width, out.height = int(meta["SliceWidth"]), int(meta["SliceHeight"])
    n = max(int(at[:, 0].max()) + 1, int(meta["LevelCount"]) if meta.get("LevelCount", "").isdigit() else 0)
    out.levels = _halved(out.width, out.height, 2, n)
    wide = side * 2 ** at[:, 0]
    off = np.zeros((n, 2), np.int64)  # each level's own least tile is its origin
    for level in np.unique(at[:, 0]).tolist():
        off[level] = at[at[:, 0] == level, 1:].min(axis=0)
    moved = at[:, 1:] - off[at[:, 0]]
    out.tiles = _tiles(len(at), level=at[:, 0], col=at[:, 1], row_no=at[:, 2], x0=moved[:, 0] * wide, y0=moved[:, 1] * wide, cov_w=wide, cov_h=wide, offset=place[:, 0], length=place[:, 1])
    try:
        out.mpp = float(meta.get("MicrometersPerPixel", ""))
    except ValueError:
        out.mpp = None
    out.properties |= {f"zyp.{re.sub('(?<=[a-z])(?=[A-Z])', '_', key).lower()}": v for key, v in meta.items()}
    return out.stated("zyp")


# --- mds ----------------------------------------------------------------------


def mdsx(blob: Blob) -> Parsed:
    block = np.dtype([("mark", "<u4"), ("unknown", "<u4"), ("offset", "<u4"), ("mark2", "<u4")])
    at = int(blob.record(84, block)["offset"]) + 20
    pair = np.dtype([("offset", "<u4"), ("length", "<u4")])
    places = [tuple(map(int, blob.record(at + 14 * k, pair))) for k in range(4)]  # 8 bytes each, 6 between
    out = Parsed("mds")
    raw = blob.read(*places[0])
    props = {}
    for data, packed in ((raw, True), (blob.read(*places[3]), True)):
        try:
            text = base64.b64decode(data, validate=True).decode("utf-16le") if packed else data.decode("utf-16le")
        except ValueError:
            text = data.decode("utf-16le", "ignore")
        text = re.sub(r"(?s)<ScanPath>.*?</ScanPath>", "", re.sub(r"^﻿?\s*<\?xml[^>]*\?>", "", text.rstrip("\0")))
        if text.strip().startswith("<"):
            props |= xml_properties(text)
    get = lambda key, d=0: int(props.get(f"ImageMatrix.{key}", props.get(key, d)))
    out.width, out.height, n, side = get("Width"), get("Height"), get("LayerCount"), get("CellWidth", 256)
    if not (out.width and out.height and n):
        raise ValueError("no slide dimensions")
    entry = np.dtype([("pad", "V2"), ("offset", "<u4"), ("length", "<u4")])
    parts = []
    for level in range(n):
        head = blob.record(164 + 16 * level, block)  # here: mark, unknown, table, its length
        t = blob.records(int(head["offset"]) + 4, entry, max(0, (int(head["mark2"]) - 4) // entry.itemsize))
        cols = max(1, get(f"Layer{level}.Cols"))
        place = np.arange(len(t))
        wide = side * 2**level
        parts.append(_tiles(len(t), level=level, col=place % cols, row_no=place // cols, x0=place % cols * wide, y0=place // cols * wide, cov_w=wide, cov_h=wide, offset=t["offset"], length=t["length"]))
    out.tiles = np.concatenate(parts)
    out.tiles = out.tiles[(out.tiles["offset"] > 0) & (out.tiles["length"] > 0)]
    out.levels = _halved(out.width, out.height, 2, n, least=0)
    for name, place in (("macro", places[1]), ("label", places[2])):
        if place[1]:
            out.stored[name] = place
    out.properties |= {f"motic.{k}": v for k, v in props.items()}
    return out.stated("motic")


def ole_streams(blob: Blob) -> dict[str, bytes]:
    """Streams of an OLE2 compound file by path."""
    head = blob.read(0, 512)
    if head[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("not an OLE2 file")
    shift, mini_shift = struct.unpack_from("<HH", head, 30)
    n_fat, first_dir = struct.unpack_from("<I", head, 44)[0], struct.unpack_from("<I", head, 48)[0]
    cutoff, first_mini = struct.unpack_from("<II", head, 56)
    first_difat = struct.unpack_from("<I", head, 68)[0]
    size, mini = 1 << shift, 1 << mini_shift
    sector = lambda k: blob.read((k + 1) * size, size)
    difat = list(struct.unpack_from("<109I", head, 76))
    while first_difat < 0xFFFFFFFC:
        more = struct.unpack(f"<{size // 4}I", sector(first_difat))
        difat += more[:-1]
        first_difat = more[-1]
    fat = np.frombuffer(b"".join(sector(k) for k in difat[:n_fat]), "<u4")

    def chain(k: int, table: np.ndarray) -> Iterator[int]:
        seen = 0
        while k < 0xFFFFFFFC and seen <= len(table):
            yield k
            k, seen = int(table[k]), seen + 1

    entries = b"".join(sector(k) for k in chain(first_dir, fat))
    rows = [entries[k : k + 128] for k in range(0, len(entries), 128)]
    fields = [(r[: max(0, struct.unpack_from("<H", r, 64)[0] - 2)].decode("utf-16le"), r[66], *struct.unpack_from("<III", r, 68), struct.unpack_from("<I", r, 116)[0], struct.unpack_from("<I", r, 120)[0]) for r in rows]
    mini_fat = np.frombuffer(b"".join(sector(k) for k in chain(first_mini, fat)), "<u4")
    short = b"".join(sector(k) for k in chain(fields[0][5], fat))
    out: dict[str, bytes] = {}

    def walk(k: int, at: str) -> None:
        if k >= len(fields):
            return
        name, kind, left, right, child, start, n = fields[k]
        walk(left, at)
        walk(right, at)
        path = f"{at}/{name}" if at else name
        if kind == 2:
            whole = b"".join(short[mini * s : mini * (s + 1)] for s in chain(start, mini_fat)) if n < cutoff else b"".join(sector(s) for s in chain(start, fat))
            out[path] = whole[:n]
        elif kind == 1:
            walk(child, path)

    walk(fields[0][4], "")
    return out


def mds(blob: Blob) -> Parsed:
    """Streams DSI0/<scale>/<rrrr_cccc>, levels by falling scale; the tiles' bytes come along, as streams are not ranges."""
    found: dict[float, dict[tuple[int, int], bytes]] = {}
    for path, data in ole_streams(blob).items():
        if m := re.fullmatch(r"DSI0/([0-9.]+)/(\d+)_(\d+)", path):
            found.setdefault(float(m[1]), {})[int(m[2]), int(m[3])] = data
    out, parts = Parsed("mds"), []
    scales = sorted(found, reverse=True)
    first = found[scales[0]] if scales else {}
    tw, th = (image_size(first[min(first)]) if first else None) or (MDS_TILE, MDS_TILE)  # all tiles are of the first one's size
    for level, scale in enumerate(scales):
        grid = found[scale]
        rc = np.array(sorted(grid), np.int64)
        factor = scales[0] / scale
        out.levels.append((int(rc[:, 1].max() + 1) * tw, int(rc[:, 0].max() + 1) * th, factor))
        base = sum(len(p) for p in parts)
        out.data |= {base + k: grid[int(r), int(c)] for k, (r, c) in enumerate(rc)}
        wide, high = int(tw * factor), int(th * factor)
        parts.append(_tiles(len(rc), level=level, col=rc[:, 1], row_no=rc[:, 0], x0=rc[:, 1] * wide, y0=rc[:, 0] * high, cov_w=wide, cov_h=high, length=[len(grid[int(r), int(c)]) for r, c in rc]))
    if not parts:
        raise ValueError("no tiles")
    out.tiles = np.concatenate(parts)
    out.width, out.height = out.levels[0][:2]
    return out.stated("motic")


# --- ibl ----------------------------------------------------------------------


def sqlite_of(blob: Blob) -> sqlite3.Connection:
    """A file of a local path is opened as it lies; one of another file system is held in memory."""
    if blob.name and "://" not in blob.name and not blob.name.startswith("file:"):
        con = sqlite3.connect(f"file:{blob.name}?mode=ro", uri=True)
    else:
        con = sqlite3.connect(":memory:")
        con.deserialize(blob.read(0, blob.size))
    con.row_factory = sqlite3.Row
    return con


def ibl(blob: Blob, with_data: bool = False) -> Parsed:
    """Tiles lie in SQLite rows: offset is the row's number; their bytes come along if asked for."""
    con = sqlite_of(blob)
    try:
        tables = {r["name"] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        base = con.execute("SELECT * FROM tbl_base_info LIMIT 1").fetchone()
        if base is None or base["magicNo"] != "ibl":
            raise ValueError("not an IBL file")
        pixel = float(base["pixel_size"] or 0.00025)
        step = int(base["ratio_step"])
        out = Parsed("ibl", int(base["total_img_width"]), int(base["total_img_height"]), mpp=pixel * 1000 if pixel > 0 else 0.25)
        tw, th = int(base["tile_width"]), int(base["tile_height"])
        data = ", data" if with_data else ", NULL AS data"
        second = "tbl_tileex_info" in tables and "tbl_img_info" not in tables
        if second:
            rows = con.execute(f"SELECT rowid AS place, layer, col, row, length(data) AS n{data} FROM tbl_tileex_info ORDER BY layer, row, col").fetchall()
            n = len({r["layer"] for r in rows})
            wide = lambda r, side: side * step ** r["layer"]
            found = [(r["layer"], r["col"], r["row"], r["col"] * wide(r, tw), r["row"] * wide(r, th), wide(r, tw), wide(r, th), r["place"], r["n"], r["data"]) for r in rows]
        else:
            n = int(base["layer_size"])
            rows = con.execute(f"SELECT t.rowid AS place, t.layer, i.col * 4 + t.col AS col, i.row * 4 + t.row AS row, i.nX + t.col * 612 AS x, i.nY + t.row * 512 AS y, length(t.data) AS n{data.replace('data', 't.data', 1) if with_data else data} FROM tbl_tile_info t JOIN tbl_img_info i ON t.id = i.id AND i.layer = 0 WHERE t.layer = 0 ORDER BY t.rowid").fetchall()
            found = [(r["layer"], r["col"], r["row"], r["x"], r["y"], 612, 512, r["place"], r["n"], r["data"]) for r in rows]
            if "tbl_shrink_info" in tables:
                for r in con.execute(f"SELECT rowid AS place, layerNo AS layer, x, y, length(data) AS n{data} FROM tbl_shrink_info ORDER BY rowid"):
                    wide = step ** r["layer"]
                    found.append((r["layer"], r["x"] // (tw * wide), r["y"] // (th * wide), r["x"], r["y"], tw * wide, th * wide, r["place"], r["n"], r["data"]))
        columns = list(zip(*found, strict=True)) if found else [[] for _ in range(10)]
        out.tiles = _tiles(len(found), **dict(zip(("level", "col", "row_no", "x0", "y0", "cov_w", "cov_h", "offset", "length"), columns, strict=False)))
        if with_data:
            out.data = dict(enumerate(columns[9]))
        out.levels = _halved(out.width, out.height, step, n)
        out.properties |= {"ibl.version": str(base["version"]), "ibl.layout": "2" if second else "1", "ibl.max-zoom": str(base["max_zoom_rate"])}
        return out.stated("ibl")
    finally:
        con.close()


def ibl_data(con: sqlite3.Connection, level: int, place: int) -> bytes | None:
    """One tile's bytes by its row, see ibl()."""
    tables = {r["name"] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    table = "tbl_tileex_info" if "tbl_tileex_info" in tables and "tbl_img_info" not in tables else "tbl_tile_info" if level == 0 else "tbl_shrink_info"
    row = con.execute(f"SELECT data FROM {table} WHERE rowid = ?", (place,)).fetchone()
    return None if row is None else row["data"]


# --- tron ---------------------------------------------------------------------


class _View(io.RawIOBase):
    """A blob as a seekable file."""

    def __init__(self, blob: Blob):
        self._blob, self._at = blob, 0

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = 0) -> int:
        self._at = offset + (0, self._at, self._blob.size)[whence]
        return self._at

    def read(self, n: int = -1) -> bytes:
        raw = self._blob.read(self._at, self._blob.size - self._at if n is None or n < 0 else n)
        self._at += len(raw)
        return raw


def tron(blob: Blob) -> Parsed:
    """ZIP members: <level>/1/<col>_<row>.jpg tiles, and stored images by name. Members are listed, nothing is unpacked.

    A level spans the tiles from its least to its greatest column and row.
    """
    out, rows = Parsed("tron"), []
    with zipfile.ZipFile(_View(blob)) as z:
        for m in z.infolist():
            stem = m.filename.rpartition("/")[2].rpartition(".")[0] or m.filename
            name, extra = struct.unpack("<HH", blob.read(m.header_offset + 26, 4))
            place = (m.header_offset + 30 + name + extra, m.compress_size)
            if t := re.fullmatch(r"(\d+)/\d+/(\d+)[_/](\d+)\.(?:jpg|jpeg|png)", m.filename):
                rows.append((int(t[1]), int(t[2]), int(t[3]), *place))
            elif stem.lower() in ("label", "macro", "thumbnail", "sample", "blank"):
                out.stored[stem.lower()] = place
    if rows:
        r = np.array(rows, np.int64)
        folders, level = np.unique(r[:, 0], return_inverse=True)
        least, most = (np.stack([f.reduceat(r[np.argsort(level, kind="stable"), c], np.searchsorted(np.sort(level), range(len(folders)))) for c in (1, 2)], 1) for f in (np.minimum, np.maximum))
        sides = (most - least + 1) * TRON_TILE
        out.width, out.height = map(int, sides[0])
        out.levels = [(int(w), int(h), out.width / int(w)) for w, h in sides]
        wide = (TRON_TILE * out.width / sides[level, 0]).astype(np.int64)
        place = (r[:, 1:3] - least[level]) * wide[:, None]
        out.tiles = _tiles(len(r), level=level, col=r[:, 1], row_no=r[:, 2], x0=place[:, 0], y0=place[:, 1], cov_w=wide, cov_h=wide, offset=r[:, 3], length=r[:, 4])
    return out.stated("tron")


# --- tiff -----------------------------------------------------------------------


def _page_tiles(page: dict, level: int, factor: float) -> np.ndarray:
    w, h = page[256][0], page[257][0]
    if 324 in page:
        tw, th, offsets, lengths = page[322][0], page[323][0], page[324], page[325]
    else:
        tw, th, offsets, lengths = w, min(h, page.get(278, (h,))[0]), page.get(273, ()), page.get(279, ())
    cols = max(1, -(-w // tw))
    n = cols * max(1, -(-h // max(1, th)))  # of samples in planes of their own the first plane's; the others are found by it
    offsets, lengths = offsets[:n], lengths[:n]
    place = np.arange(len(offsets))
    fx = lambda v: (np.asarray(v) * factor).astype(np.int64)
    return _tiles(len(offsets), level=level, col=place % cols, row_no=place // cols, x0=fx(place % cols * tw), y0=fx(place // cols * th), cov_w=int(tw * factor), cov_h=int(th * factor), offset=offsets, length=lengths)


def tiff(blob: Blob) -> Parsed:
    """Ventana pages by description, OME or page-named channels, else the first page."""
    pages = tiff_pages(blob)
    if not pages:
        raise ValueError("no pages")
    described = [text(p, 270) for p in pages]
    levels = [k for k, d in enumerate(described) if re.search(r"level=\d+", d)]
    levels_stated = bool(levels)
    out = Parsed("bif" if levels else "generic_tiff")
    if levels:
        levels.sort(key=lambda k: int(re.search(r"level=(\d+)", described[k])[1]))
        for k, d in enumerate(described):
            if "Label_Image" in d:
                for name in ("label", "macro"):
                    out.stored[name] = (pages[k].get(273, pages[k].get(324, (0,)))[0], sum(pages[k].get(279, pages[k].get(325, (0,)))))
    else:
        levels = [0]
    w0, h0 = pages[levels[0]][256][0], pages[levels[0]][257][0]
    out.width, out.height = w0, h0
    parts = []
    for n, k in enumerate(levels):
        w, h = pages[k][256][0], pages[k][257][0]
        out.levels.append((w, h, w0 / w if w else 1.0))
        parts.append(_page_tiles(pages[k], n, w0 / w if w else 1.0))
    out.tiles = np.concatenate(parts)
    xml = next((x for x in (text(p, 700) for p in pages[:5]) if "iScan" in x), "")
    scan = re.search(r"<iScan\b([^>]*)", xml)
    if scan:
        attributes = dict(re.findall(r'(\w+)="([^"]*)"', scan[1]))
        out.properties |= {f"ventana.{k}": v for k, v in attributes.items()}
        out.mpp = float(attributes["ScanRes"]) if re.fullmatch(r"[0-9.]+", attributes.get("ScanRes", "")) else None
    if not levels_stated and (blob.name.lower().endswith(".qptiff") or "PerkinElmer-QPI" in described[0] or is_ome_candidate(pages)):
        many = open_planes(blob)
        out.format_id, out.channels, out.mpp, out.levels = many.format_id, many.names, many.mpp, many.levels
        out.properties |= many.properties
        if many.pages:
            out.tiles = np.concatenate([_page_tiles(page, n, many.levels[n][2]) for n, page in enumerate(many.pages)])
        if many.format_id == "ome_tiff":
            out.properties |= {"ome.sibling-label": text(pages[0], 285) or blob.name.rpartition("/")[2].rpartition(".")[0], "tiff.dtype": samples(pages[0])[0].str}
    if out.mpp is None and 282 in pages[0]:
        num, den = pages[0][282][:2]
        unit = pages[0].get(296, (2,))[0]
        if num and den and unit in (2, 3):
            out.mpp = {2: 25400.0, 3: 10000.0}[unit] / (num / den)
    return out.stated(out.format_id)


# --- hdf5, ims, czi, mcd ---------------------------------------------------------------------


def multiplex(blob: Blob, acquisition_id: int | None = None) -> Parsed:
    """Planes of channels, which have no tiles, see the source slide_planes; a CZI picture's subblocks are tiles, row_no their scene and col their order."""
    found = open_planes(blob, acquisition_id)
    out = Parsed(found.format_id, *found.levels[0][:2], levels=found.levels, mpp=found.mpp, channels=found.names, properties=dict(found.properties))
    out.properties["slide.family"] = found.family
    rows = [(scene, k, z, x, y, w, h, b.position) for scene, k, z, x, y, w, h, b in czi.laid_out(found.blocks)]
    if rows:
        r = np.array(rows, np.int64)
        out.tiles = _tiles(len(r), row_no=r[:, 0], col=r[:, 1], z=r[:, 2], x0=r[:, 3], y0=r[:, 4], cov_w=r[:, 5], cov_h=r[:, 6], offset=r[:, 7], length=r[:, 5] * r[:, 6])
        out.properties["czi.scene-count"] = str(len(np.unique(r[:, 0])))
    return out.stated(found.format_id)


MAGIC = ((b"TMAP06", tmap06), (b"TMAP07", tmap07), (b"DPTWSI", dyj), (b"BKIO", mdsx), (b"\xd0\xcf\x11\xe0", mds), (b"SQLite format 3\0", ibl), (b"PK\x03\x04", tron), (b"II*\0", tiff), (b"MM\0*", tiff), (b"II+\0", tiff), (b"MM\0+", tiff), (b"\x89HDF\r\n\x1a\n", multiplex), (b"ZISRAWFILE", multiplex))


def plugged(name: str) -> Callable[[Blob], Parsed]:
    """The reader that `module:function` names; it has to be importable where tasks run."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def parse(blob: Blob, with_data: bool = False, acquisition_id: int | None = None, readers: dict[str, str] | None = None) -> Parsed:
    """By the file's first bytes; ZYP and MCD have none and are told by their names. readers: suffix -> module:function of readers from outside, which come first."""
    own = (readers or {}).get(blob.name.lower().rpartition(".")[2])
    if own is not None:
        return plugged(own)(blob)
    head = blob.read(0, 16)
    for magic, reader in MAGIC:
        if head.startswith(magic):
            return reader(blob, with_data) if reader is ibl else reader(blob)
    if blob.name.lower().endswith(".zyp"):
        return zyp(blob)
    if blob.name.lower().endswith(".mcd"):
        return multiplex(blob, acquisition_id)
    raise ValueError("unknown container")
