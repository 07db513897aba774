"""Containers built byte by byte, read back through the data sources."""

import base64
import sqlite3
import struct
import zipfile
import zlib

import numpy as np
import pytest

from strataslide.api import SlideSet
from strataslide.sources import containers as C
from strataslide.sources import tiff as T
from strataslide.sources import register_sources
from strataslide.sources.blob import Blob

JPEG = b"\xff\xd8\xff\xe0" + b"x" * 20


def make_tmap07():
    data = bytearray(4096)
    data[:6] = b"TMAP07"
    data[8:13] = bytes([1, 90, 1, 4, 240])
    struct.pack_into("<fiiiq", data, 16, 0.00025, 1, 1, 4, 0)
    struct.pack_into("<iiiiqii", data, 304, 10, 20, 3, 2, 3000, len(JPEG), 0)
    struct.pack_into("<ifiiiiii", data, 560, 0, 1.0, 500, 300, 2, 2, 2000, 0)
    for k in range(4):
        struct.pack_into("<iiiiiiqii", data, 2000 + 40 * k, 0, 0, 0, 0, 256, 256, 0 if k == 2 else 3000, len(JPEG), 0)
    data[3000 : 3000 + len(JPEG)] = JPEG
    return bytes(data)


def make_tmap06():
    head = b"TMAP06" + struct.pack("<10B", 1, 1, 0, 2, 24, 0, 2, 2, 0, 244) + struct.pack("<fi9h", 0.0005, 1, 4, 1, 1, 1024, 768, 256, 256, 0, 0) + struct.pack("<BB4i", 0, 4, 1, 1000, 700, 0)
    ext = struct.pack("<3i", 0, 0, 0) + struct.pack("<8i", 1, 2, *[0] * 6) + struct.pack("<8i", 5000, 5100, *[0] * 6) + struct.pack("<8i", 10, 20, *[0] * 6) + bytes(24)
    block = struct.pack("<BBxx4Bhhii", 0, 0, 0, 0, 0, 0, 0, 0, 64, 32)
    tiles = b"".join(struct.pack("<BBBxii", 0, k % 4, k // 4, 100 if k < 3 else 0, 50) for k in range(24))
    return head + ext + block + tiles + struct.pack("<BBxxiiii", 0, 1, 0, 0, 100, 50) + bytes(300)


def make_dyj():
    data = bytearray(2000)
    data[:8] = b"DPTWSI\x01\x00"
    struct.pack_into("<HH", data, 0x0C, 4096, 1280)
    struct.pack_into("<f", data, 0x10, 0.5)
    struct.pack_into("<HH", data, 0x1A, 9, 8)
    struct.pack_into("<I", data, 0x38, 1500)
    struct.pack_into("<I", data, 0x40, 24)
    struct.pack_into("<I", data, 0xB0, 0x200)
    data[1500 : 1500 + len(JPEG)] = JPEG
    rows = [(0, 0, 0, 8), (0, 1280, 0, 8), (0, 0, 1280, 8), (1, 0, 0, 8), (0, 0, 0, 8), (7, 0, 0, 0), (0, 2560, 0, 8)]
    for k, (layer, x, y, z) in enumerate(rows):
        struct.pack_into("<BIIBiq", data, 0x200 + 22 * k, layer, x, y, z, len(JPEG) + k, 1500)
    return bytes(data)


def make_zyp():
    seg = lambda s: b"\xff\xfe\xff" + bytes([len(s)]) + s.encode("utf-16le")
    words = ["Version", "2.01", "MicrometersPerPixel", "0.25", "SliceWidth", "700", "SliceHeight", "500", "LevelCount", "3", "0,0,0,2,1", "StartPosition", "10", "DataLength", "24", "0,0,1,1,0", "StartPosition", "40", "DataLength", "9", "Label", "StartPosition", "60", "DataLength", "5"]
    return b"tiles" * 30 + b"".join(map(seg, words))


def make_mdsx():
    xml = '<?xml version="1.0"?><R><ScanPath>secret</ScanPath><ImageMatrix value=""><Width value="600"/><Height value="400"/><LayerCount value="1"/><CellWidth value="256"/><Layer0><Rows value="2"/><Cols value="3"/></Layer0></ImageMatrix></R>'
    packed = base64.b64encode(xml.encode("utf-16le"))
    data = bytearray(4000 + len(packed))
    data[:4] = b"BKIO"
    struct.pack_into("<IIII", data, 84, 0x64, 0, 1000, 0x64)
    for k, place in enumerate(((4000, len(packed)), (3000, 5), (3100, 6), (3900, 0))):
        struct.pack_into("<II", data, 1020 + 14 * k, *place)
    data[4000:] = packed
    struct.pack_into("<IIII", data, 164, 0, 0, 2000, 4 + 6 * 10)
    for k in range(6):
        struct.pack_into("<HII", data, 2004 + 10 * k, 0, 0 if k == 4 else 3000 + k, 7)
    return bytes(data)


def make_ibl(path, second=True):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE tbl_base_info (magicNo, version, ratio_step, total_img_width, total_img_height, tile_width, tile_height, img_width, img_height, img_col, img_row, pixel_size, max_zoom_rate, layer_size)")
    con.execute("INSERT INTO tbl_base_info VALUES ('ibl', '2.0', 4, 1500, 900, 512, 512, 0, 0, 1, 1, 0.0005, 40, 3)")
    if second:
        con.execute("CREATE TABLE tbl_tileex_info (layer, col, row, data)")
        con.executemany("INSERT INTO tbl_tileex_info VALUES (?, ?, ?, ?)", [(0, c, r, JPEG) for c in range(3) for r in range(2)] + [(1, 0, 0, JPEG)])
    else:
        con.execute("CREATE TABLE tbl_img_info (id, layer, col, row, nX, nY)")
        con.execute("CREATE TABLE tbl_tile_info (layer, id, col, row, data)")
        con.execute("CREATE TABLE tbl_shrink_info (layerNo, x, y, data)")
        con.execute("INSERT INTO tbl_img_info VALUES (7, 0, 1, 0, 2448, 0)")
        con.execute("INSERT INTO tbl_tile_info VALUES (0, 7, 2, 1, ?)", (JPEG,))
        con.execute("INSERT INTO tbl_shrink_info VALUES (2, 0, 0, ?)", (JPEG,))
    con.commit()
    con.close()


def make_tiff(bif=False, packing=1):
    pixels = np.arange(20 * 30 * 3, dtype=np.uint8).reshape(20, 30, 3)
    raw = pixels.tobytes() if packing == 1 else zlib.compress(pixels.tobytes())
    text = b"level=0 mag=40\0" if bif else b"plain page\0"
    body = bytearray(b"II*\0" + struct.pack("<I", 8))
    tags = [(256, 3, 1, 30), (257, 3, 1, 20), (258, 3, 1, 8), (259, 3, 1, packing), (270, 2, len(text), 400), (273, 4, 1, 600), (277, 3, 1, 3), (278, 3, 1, 20), (279, 4, 1, len(raw)), (282, 5, 1, 450), (296, 3, 1, 3)]
    body += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    body += bytes(600 - len(body)) + raw
    body[400 : 400 + len(text)] = text
    struct.pack_into("<II", body, 450, 40000, 1)
    return bytes(body), pixels


def make_ole(streams):
    """A compound file of one storage chain DSI0/<scale> with small streams in the mini stream."""
    names = [("Root Entry", 5), ("DSI0", 1), ("1", 1)] + [(n, 2) for n in sorted(streams)]
    mini, mini_fat, starts = b"", [], []
    for n in sorted(streams):
        data = streams[n]
        k = -(-len(data) // 64)
        starts.append(len(mini_fat))
        mini_fat += [len(mini_fat) + i + 1 for i in range(k - 1)] + [0xFFFFFFFE]
        mini += data + bytes(64 * k - len(data))
    none = 0xFFFFFFFF
    entries = b""
    for i, (n, kind) in enumerate(names):
        label = n.encode("utf-16le") + b"\0\0"
        right = i + 1 if kind == 2 and i + 1 < len(names) else none
        child = {0: 1, 1: 2, 2: 3}.get(i, none)
        start, size = (2, len(mini)) if i == 0 else (starts[i - 3], len(streams[n])) if kind == 2 else (0, 0)
        entries += label.ljust(64, b"\0") + struct.pack("<HBB", len(label), kind, 1) + struct.pack("<III", none, right, child) + bytes(36) + struct.pack("<IQ", start, size)
    entries += bytes(-len(entries) % 512)
    n_dir, n_mini = len(entries) // 512, -(-len(mini) // 512)
    sectors = [b""] * 2  # 0: fat, 1: mini fat, then mini stream, then directory
    chain = lambda first, n: [first + i + 1 for i in range(n - 1)] + [0xFFFFFFFE]
    fat = [0xFFFFFFFD, 0xFFFFFFFE] + chain(2, n_mini) + chain(2 + n_mini, n_dir)
    sectors[0] = struct.pack("<128I", *(fat + [none] * (128 - len(fat))))
    sectors[1] = struct.pack("<128I", *(mini_fat + [none] * (128 - len(mini_fat))))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<III", 0, 1, 2 + n_mini) + bytes(4) + struct.pack("<IIIII", 4096, 1, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[none] * 108)
    return head + sectors[0] + sectors[1] + mini + bytes(512 * n_mini - len(mini)) + entries


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("slides")
    for name, data in {"a.tmap": make_tmap07(), "b.tmap": make_tmap06(), "c.dyj": make_dyj(), "d.zyp": make_zyp(), "e.mdsx": make_mdsx(), "f.tif": make_tiff()[0], "g.bif": make_tiff(bif=True)[0], "h.mds": make_ole({"0000_0000": JPEG, "0000_0001": JPEG * 4, "0002_0000": b"q"}), "z.txt": b"nothing"}.items():
        (at / name).write_bytes(data)
    make_ibl(at / "i.ibl")
    make_ibl(at / "j.ibl", second=False)
    with zipfile.ZipFile(at / "k.tron", "w") as z:
        z.writestr("label.jpg", JPEG)
        for r in range(2):
            z.writestr(f"0/1/{r}_0.jpg", JPEG)
        z.writestr("1/1/0_0.jpg", JPEG)
    return at


def test_metadata(spark, folder):
    register_sources(spark)
    got = {r["path"].rpartition("/")[2]: r for r in spark.read.format("slide_metadata").load(str(folder)).collect()}
    assert got["z.txt"]["error"]["class"] == "ValueError" and all(r["error"] is None for n, r in got.items() if n != "z.txt")
    size = {n: (r["format_id"], r["width"], r["height"], r["level_count"]) for n, r in got.items()}
    assert size["a.tmap"] == ("tmap", 500, 300, 3) and size["b.tmap"] == ("tmap", 1000, 700, 3)
    assert size["c.dyj"] == ("dyj", 2560, 2560, 3) and size["d.zyp"] == ("zyp", 700, 500, 3) and size["e.mdsx"] == ("mds", 600, 400, 1)
    assert size["f.tif"] == ("generic_tiff", 30, 20, 1) and size["g.bif"] == ("bif", 30, 20, 1) and size["h.mds"] == ("mds", 1024, 1536, 1)
    assert size["i.ibl"] == ("ibl", 1500, 900, 2) and size["j.ibl"] == ("ibl", 1500, 900, 3) and size["k.tron"] == ("tron", 2048, 1024, 2)
    assert got["d.zyp"]["mpp"] == 0.25 and got["d.zyp"]["properties"]["openslide.objective-power"] == "40" and got["f.tif"]["mpp"] == 0.25
    assert got["e.mdsx"]["properties"]["motic.ImageMatrix.Width"] == "600" and not any("ScanPath" in k for k in got["e.mdsx"]["properties"])
    assert got["d.zyp"]["stored"]["label"]["offset"] == 60 and set(got["b.tmap"]["stored"]) == {"macro_label", "thumbnail"} and "label" in got["k.tron"]["stored"]


def test_tiles(spark, folder):
    register_sources(spark)
    rows = spark.read.format("slide_tiles").option("data", "true").load(str(folder)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rpartition("/")[2], []).append(r)
    assert {n: len(x) for n, x in by.items()} == {"a.tmap": 3, "b.tmap": 4, "c.dyj": 4, "d.zyp": 2, "e.mdsx": 5, "f.tif": 1, "g.bif": 1, "h.mds": 3, "i.ibl": 7, "j.ibl": 2, "k.tron": 3}
    for n in ("a.tmap", "i.ibl", "j.ibl", "k.tron"):
        assert all(bytes(r["data"]) == JPEG for r in by[n])
    assert sorted(bytes(r["data"]) for r in by["h.mds"]) == sorted([JPEG, JPEG * 4, b"q"])
    assert {(r["col"], r["row_no"]) for r in by["a.tmap"]} == {(0, 0), (1, 0), (1, 1)}
    # of doubled keys the last holds, and records end at the first that is not valid
    assert sorted((r["level"], r["x0"], r["y0"], r["length"]) for r in by["c.dyj"]) == [(0, 0, 0, 28), (0, 0, 1280, 26), (0, 1280, 0, 25), (1, 0, 0, 27)]
    assert [(r["x0"], r["y0"]) for r in by["j.ibl"] if r["level"] == 0] == [(2448 + 2 * 612, 512)]


@pytest.mark.parametrize("packing", [1, 8])
def test_tiff_pixels(packing):
    data, pixels = make_tiff(packing=packing)
    blob = Blob(data)
    assert (T.tiff_page_pixels(blob, T.tiff_pages(blob)[0]) == pixels).all()


def test_dyj_start_needs_five_valid_records(tmp_path):
    """A place with three good records and a bad one among the first five is no start."""
    data = bytearray(make_dyj())
    for k, layer in enumerate((0, 0, 9, 0, 0, 0)):  # at the fixed place: the third record is not valid
        struct.pack_into("<BIIBiq", data, 0x150 + 22 * k, layer, 1280 * k, 0, 8, len(JPEG), 1500)
    data[:8] = b"DPTWSI\x02\x00"  # the fixed place is tried first
    assert len(C.dyj(Blob(bytes(data))).tiles) == 4
    data[6] = 1
    struct.pack_into("<I", data, 0xB0, 0x700)  # nothing there, nor at the fixed place, which then holds
    assert len(C.dyj(Blob(bytes(data))).tiles) == 2


def test_zyp_levels_have_their_own_origin():
    seg = lambda s: b"\xff\xfe\xff" + bytes([len(s)]) + s.encode("utf-16le")
    words = []
    for level, x, y in ((0, 5, 7), (0, 6, 7), (1, 3, 4), (1, 4, 4)):
        words += [f"0,{level},{x},{y}", "StartPosition", "10", "DataLength", "4"]
    t = C.zyp(Blob(b"".join(map(seg, words)))).tiles
    assert [(int(r["level"]), int(r["x0"]), int(r["y0"])) for r in t] == [(0, 0, 0), (0, 256, 0), (1, 0, 0), (1, 512, 0)]


def test_missing_side_file_and_broken_files(spark, tmp_path):
    """Tiles of a side file that is missing have no bytes; a broken file ends nothing."""
    data = bytearray(make_tmap06())
    at = data.index(struct.pack("<BBxx4Bhhii", 0, 0, 0, 0, 0, 0, 0, 0, 64, 32))
    data[at] = 2
    (tmp_path / "a.tmap").write_bytes(bytes(data))
    (tmp_path / "b.tmap").write_bytes(make_tmap06())
    (tmp_path / "bad.ibl").write_bytes(b"SQLite format 3\0" + b"rubbish" * 40)
    (tmp_path / "bad.tron").write_bytes(b"PK\x03\x04" + b"rubbish" * 40)
    (tmp_path / "bad.h5").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\xff" * 90)
    register_sources(spark)
    rows = spark.read.format("slide_tiles").option("data", "true").load(str(tmp_path)).collect()
    by = {n: [r["data"] for r in rows if r["path"].endswith(n)] for n in ("a.tmap", "b.tmap")}
    assert len(by["a.tmap"]) == 4 and by["a.tmap"].count(None) == 3 and None not in by["b.tmap"]
    errors = spark.read.format("slide_metadata").load(str(tmp_path)).filter("error is not null").count()
    assert errors == 3 and spark.read.format("slide_planes").load(str(tmp_path)).count() == 0


def test_side_files_of_ole_slides(spark, tmp_path):
    from strataslide.api import SlideSet
    from strataslide.functions.raster import png

    (tmp_path / "a.mds").write_bytes(make_ole({"0000_0000": JPEG}))
    (tmp_path / "info.xml").write_text('<?xml version="1.0" encoding="unicode"?><r><item rows="3" cols="4"/><item objective="20" other="x"/></r>')
    (tmp_path / "label.jpg").write_bytes(png(np.zeros((3, 4, 3), np.uint8)))
    slides = SlideSet(spark, str(tmp_path))
    p = slides.metadata.filter("format_id = 'mds'").first()["properties"]
    assert (p["mds.rows"], p["mds.cols"], p["mds.objective"]) == ("3", "4", "20") and "mds.other" not in p
    assert [(r["name"], r["height"], r["width"]) for r in slides.side_images().collect()] == [("label", 3, 4)]
    slides.close()


def test_what_tmap_headers_state(spark, tmp_path):
    for name, data in {"a.tmap": make_tmap07(), "b.tmap": make_tmap06(), "c.dyj": make_dyj()}.items():
        (tmp_path / name).write_bytes(data)
    slides = SlideSet(spark, str(tmp_path))
    got = {r["path"].rpartition("/")[2]: tuple(r)[1:] for r in slides.scans().collect()}
    assert got == {"a.tmap": (7, 4, pytest.approx(0.00025), 1, 4), "b.tmap": (6, 4, pytest.approx(0.0005), 1, 0)}
    slides.close()
