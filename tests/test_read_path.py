"""What a read opens, and canvases painted and shrunk by cell; bytes are laid out here, not by the package."""

import sqlite3
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from strataslide import api
from strataslide.api import SlideSet
from strataslide.functions import raster
from strataslide.operators import canvas
from strataslide.sources import containers as C
from strataslide.sources import datasource as D
from strataslide.sources.blob import Blob
from strataslide.sources.planes import channel_stride, open_planes

from .test_sources import make_ole

RNG = np.random.default_rng(8)


def tiff(planes, description="", name="", software=""):
    """A classic TIFF of uncompressed 16-bit pages, tags of the first page as given."""
    data, at = bytearray(b"II*\0\0\0\0\0"), 4
    for k, plane in enumerate(planes):
        raw = plane.astype("<u2").tobytes()
        pixels = len(data)
        data += raw
        texts = [(270, description), (285, name), (305, software)] if k == 0 else []
        tags = [(256, 3, 1, plane.shape[1]), (257, 3, 1, plane.shape[0]), (258, 3, 1, 16), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, pixels), (277, 3, 1, 1), (278, 3, 1, plane.shape[0]), (279, 4, 1, len(raw))]
        for tag, value in texts:
            if value:
                held = value.encode() + b"\0"
                held += b"\0" * max(0, 5 - len(held))
                tags.append((tag, 2, len(held), len(data)))
                data += held
        data += b"\0" * (len(data) % 2)
        struct.pack_into("<I", data, at, len(data))
        data += struct.pack("<H", len(tags))
        for tag, kind, count, value in sorted(tags):
            data += struct.pack("<HHII", tag, kind, count, value)
        at = len(data)
        data += bytes(4)
    return bytes(data)


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x10JFIF" + bytes(10) + b"\xff\xdb\x00\x04\0\0\xff\xc2\x00\x11\x08" + struct.pack(">HH", h, w) + bytes(12)


def test_image_sizes():
    assert raster.image_size(jpeg(300, 200)) == (300, 200)
    assert raster.image_size(raster.png(np.zeros((7, 9, 3), np.uint8))) == (9, 7)
    assert [raster.image_size(x) for x in (b"", b"\xff\xd8", b"\xff\xd8\xff\xe0\xff\xff", b"rubbish" * 9, jpeg(3, 2)[:30])] == [None] * 5


def test_tile_sides_of_mds_and_tron(tmp_path):
    p = C.parse(Blob(make_ole({"0000_0001": jpeg(300, 200), "0002_0000": b"q"})))
    assert p.levels == [(600, 600, 1.0)] and {(int(t["x0"]), int(t["y0"]), int(t["cov_w"]), int(t["cov_h"])) for t in p.tiles} == {(300, 0, 300, 200), (0, 400, 300, 200)}
    assert C.parse(Blob(make_ole({"0000_0000": b"none"}))).levels == [(512, 512, 1.0)]
    with zipfile.ZipFile(tmp_path / "a.tron", "w") as z:
        for name in ("3/1/5_2.jpg", "3/1/8_3.jpg", "4/1/2_1.jpg", "4/1/3_1.jpg", "thumbnail.jpg"):
            z.writestr(name, jpeg(1024, 1024))
    p = C.parse(Blob(str(tmp_path / "a.tron")))
    assert (p.width, p.height, p.levels) == (4096, 2048, [(4096, 2048, 1.0), (2048, 1024, 2.0)])
    assert [(int(t["level"]), int(t["col"]), int(t["row_no"]), int(t["x0"]), int(t["y0"]), int(t["cov_w"])) for t in p.tiles] == [(0, 5, 2, 0, 0, 1024), (0, 8, 3, 3072, 1024, 1024), (1, 2, 1, 0, 0, 2048), (1, 3, 1, 2048, 0, 2048)]


@pytest.mark.parametrize(("order", "pages", "stride"), [("XYZCT", [0, 3], 3), ("XYCZT", [0, 1], 1), ("XYZTC", [0, 6], 6), ("XYTCZ", [0, 2], 2)])
def test_planes_by_the_order_of_dimensions(order, pages, stride):
    planes = RNG.integers(0, 60_000, (12, 5, 7)).astype(np.uint16)
    told = f'<OME><Image><Pixels DimensionOrder="{order}" SizeX="7" SizeY="5" SizeC="2" SizeZ="3" SizeT="2" Type="uint16"><Channel Name="A"/><Channel Name="B"/></Pixels></Image></OME>'
    assert channel_stride(order, {"C": 2, "Z": 3, "T": 2}) == stride
    found = open_planes(Blob(tiff(planes, told)))
    assert found.names == ["A", "B"] and all((found.plane(k, 0) == planes[p]).all() for k, p in enumerate(pages))


def test_siblings_are_read(spark, tmp_path):
    """A file of one channel stands for all of its folder that have its size and type; of a label the first by path."""
    viewer, planes = "Fluidigm MCD viewer 1", RNG.integers(0, 60_000, (6, 6, 9)).astype(np.uint16)
    (tmp_path / "other").mkdir()
    for name, plane, label in (("a.tif", planes[0], "DNA"), ("b.tiff", planes[1], "CD3"), ("c.tif", planes[2], "CD3"), ("d.tif", planes[3][:, :5], "CD9"), ("other/e.tif", planes[4], "CD8")):
        (tmp_path / name).write_bytes(tiff([plane], name=label, software=viewer))
    (tmp_path / "f.tif").write_bytes(tiff([planes[5], planes[4]], '<OME><Image><Pixels SizeC="2"><Channel Name="p"/><Channel Name="q"/></Pixels></Image></OME>'))
    slides = SlideSet(spark, str(tmp_path))
    at = lambda n: f"{tmp_path}/{n}"
    assert {(r["path"], r["name"]) for r in slides.slides().select("path", api.F.explode("channels").alias("name")).collect()} == {(at(a), n) for a in ("a.tif", "b.tiff", "c.tif") for n in ("DNA", "CD3", "f")} | {(at("d.tif"), "CD9"), (at("other/e.tif"), "CD8"), (at("f.tif"), "p"), (at("f.tif"), "q")}
    asked = [(1, "a.tif", "CD3"), (2, "c.tif", "DNA"), (3, "c.tif", "CD3"), (4, "a.tif", "f"), (5, "d.tif", "DNA"), (6, "f.tif", "q"), (7, "a.tif", "CD8")]
    requests = spark.createDataFrame([(i, at(n), 1, 0, 0, 3, 4, b) for i, n, b in asked], "request_id long, path string, x long, y long, level int, w int, h int, biomarker string")
    got = {r["request_id"]: r for r in slides.read_biomarker_region(requests).collect()}
    for k, plane in ((1, planes[1]), (2, planes[0]), (3, planes[1]), (4, planes[5]), (6, planes[4])):
        image = np.frombuffer(got[k]["data"], np.uint8).reshape(4, 3, 4)
        assert (image[:, :, 0] == raster.to_uint8(plane[:4, 1:4], wide=np.float64)).all()
    assert {k: got[k]["error"]["class"] for k in (5, 7)} == {5: "UnknownBiomarkerError", 7: "UnknownBiomarkerError"}
    slides.close()


def slide(path, image, side, layers=1):
    """An IBL file whose tables say where every tile is."""
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE tbl_base_info (magicNo, version, ratio_step, total_img_width, total_img_height, tile_width, tile_height, img_width, img_height, img_col, img_row, pixel_size, max_zoom_rate, layer_size)")
    con.execute("INSERT INTO tbl_base_info VALUES ('ibl', '2.0', 2, ?, ?, ?, ?, 0, 0, 1, 1, 0.0005, 40, ?)", (image.shape[1], image.shape[0], side, side, layers))
    con.execute("CREATE TABLE tbl_tileex_info (layer, col, row, data)")
    for layer in range(layers):
        level = image[:: 2**layer, :: 2**layer]
        con.executemany("INSERT INTO tbl_tileex_info VALUES (?, ?, ?, ?)", [(layer, c, r, raster.png(level[side * r : side * r + side, side * c : side * c + side])) for c in range(-(-level.shape[1] // side)) for r in range(-(-level.shape[0] // side))])
    con.commit()
    con.close()


def test_only_files_that_are_asked_for_are_opened(monkeypatch, tmp_path):
    image = RNG.integers(0, 255, (40, 60, 3), dtype=np.uint8)
    for k in range(30):
        slide(tmp_path / f"{k}.ibl", image, 16, 2)
    opened = []
    monkeypatch.setattr(D, "Blob", lambda path: opened.append(path) or Blob(path))
    for kind, columns in ((D._TilesReader, (("path",), ("level",))), (D._MetadataReader, (("path",),))):
        opened.clear()
        reader, want = kind({"path": str(tmp_path)}), f"{tmp_path}/7.ibl"
        filters = [In(columns[0], (want, "gone")), GreaterThan(("col",), 0), *(EqualTo(c, 1) for c in columns[1:])]
        assert list(reader.pushFilters(filters)) == filters
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert opened == [want] and {r[0] for r in rows} == {want}
        assert kind is D._MetadataReader or {r[2] for r in rows} == {1}
    opened.clear()
    every = D._TilesReader({"path": str(tmp_path)})
    assert len(every.partitions()) == 1 and len([r for p in every.partitions() for r in every.read(p)]) == 30 * (12 + 4) and len(opened) == 30


def test_files_are_dealt_by_size():
    runs = D.dealt([(str(k), 1) for k in range(D.MOST_FILES + 1)] + [("large", D.MOST_BYTES), ("small", 1)], True)
    assert [len(r.paths) for r in runs] == [D.MOST_FILES, 1, 1, 1] and D.dealt([], True) == []
    assert len(D.dealt([("a", 1 << 40), ("b", 1 << 40)], False)) == 1


def test_filters_reach_the_source(spark, tmp_path):
    image = RNG.integers(0, 255, (20, 20, 3), dtype=np.uint8)
    for k in range(3):
        slide(tmp_path / f"{k}.ibl", image, 16)
    slides = SlideSet(spark, str(tmp_path))
    one = slides.tiles(paths=[f"{tmp_path}/1.ibl"])
    assert {r["path"] for r in one.collect()} == {f"{tmp_path}/1.ibl"} and one.count() == 4
    requests = spark.createDataFrame([(1, f"{tmp_path}/2.ibl", 2, 3, 0, 10, 9), (2, "gone", 0, 0, 0, 1, 1)], "request_id long, path string, x long, y long, level int, w int, h int")
    got = {r["request_id"]: r for r in slides.read_region(requests).collect()}
    assert (np.frombuffer(got[1]["data"], np.uint8).reshape(9, 10, 4)[:, :, :3] == image[3:12, 2:12]).all() and got[2]["error"]["message"] == "No such slide"
    assert slides._metadata is None  # the other files were not parsed


def test_weights_between_are_those_of_the_whole():
    for n, m in ((100, 7), (33, 33), (5, 1), (1000, 3), (64, 63), (10, 17)):
        for kernel in ("lanczos", "bilinear"):
            every = raster._weights(n, m, kernel)
            for a in range(0, n, max(1, n // 5)):
                b = min(n, a + max(1, n // 5))
                first, part = raster.weights_between(n, m, a, b, kernel)
                rest = every[:, a:b].copy()
                rest[first : first + len(part)] -= part
                assert abs(rest).max() < 1e-12


@pytest.mark.parametrize("flat", [None, (255, 250, 245)])
def test_canvases_by_cell_are_those_in_one_piece(spark, flat):
    """Overlapping pastes over several cells, shrunk and not, against one array."""
    cell, want, parts, asked = 16, {}, [], []
    for k, (w, h, out_w, out_h) in enumerate([(50, 37, 50, 37), (50, 37, 11, 8), (16, 16, 5, 16), (70, 3, 40, 1), (9, 9, 9, 9), (90, 90, 40, 33)]):
        whole = np.full((h, w, 4), (9, 8, 7, 200), np.uint8)
        for seq in RNG.permutation(8).tolist():
            x, y, tw, th = (int(v) for v in (RNG.integers(-9, w), RNG.integers(-9, h), RNG.integers(1, 40), RNG.integers(1, 40)))
            parts.append((k, x, y, seq, RNG.integers(0, 256, (th, tw, 4), dtype=np.uint8), w, h))
        for _, x, y, _, image, _, _ in sorted((p for p in parts if p[0] == k), key=lambda p: p[3]):
            a, b = max(0, x), max(0, y)
            cut = image[b - y :, a - x :]
            spot = whole[b : b + cut.shape[0], a : a + cut.shape[1]]
            spot[:] = cut[: spot.shape[0], : spot.shape[1]]
        whole = whole if flat is None else raster.on_background(whole, flat)
        want[k] = whole if (w, h) == (out_w, out_h) else raster.resize(whole, out_w, out_h)
        asked.append((k, w, h, out_w, out_h, [9, 8, 7, 200]))
    rows = [c for p in parts for c in canvas.crops(*p, cell=cell)]
    pastes = spark.createDataFrame(rows, canvas.CROP).repartition(5)
    canvases = spark.createDataFrame([*asked, (99, 0, 5, 0, 5, [0, 0, 0, 0])], "request_id long, w int, h int, out_w int, out_h int, background array<int>")
    channels = 4 if flat is None else 3
    cells = canvas.shrunk(canvas.painted(pastes, canvases, cell, flat), channels, cell, held=1)
    assert all(r["height"] <= cell and r["width"] <= cell for r in cells.collect())
    got = {r["request_id"]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], channels) for r in canvas.whole(cells, channels).collect()}
    assert got.keys() == want.keys()
    for k, image in want.items():
        assert got[k].shape == image.shape and abs(got[k].astype(int) - image).max() <= (0 if asked[k][1:3] == asked[k][3:5] else 1)


def test_thumbnail_of_a_large_single_level_slide(spark, tmp_path):
    """2,500 x 3,100 pixels of one level: nine and more cells, none of the slide's size."""
    image = np.kron(RNG.integers(0, 255, (25, 31, 3), dtype=np.uint8), np.ones((100, 100, 1), np.uint8))
    slide(tmp_path / "a.ibl", image, 500)
    slides = SlideSet(spark, str(tmp_path))
    r = slides.thumbnails(100, 100).first()
    got = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 4)[:, :, :3]
    want = raster.thumbnail(image, 100, 100)
    assert got.shape == want.shape == (81, 100, 3) and abs(got.astype(int) - want).max() <= 1
    path = slides.levels().first()["path"]
    top = slides.deepzoom_tiles(spark.createDataFrame([(1, path, 6, 0, 0)], "request_id long, path string, dz_level int, col long, row_no long"))
    t = top.first()
    made = np.frombuffer(t["data"], np.uint8).reshape(t["height"], t["width"], 3)
    assert abs(made.astype(int) - raster.thumbnail(image, t["width"], t["height"])).max() <= 1
    slides.close()


def test_regions_too_large_for_a_row_come_as_cells(spark, tmp_path, monkeypatch):
    image = RNG.integers(0, 255, (1100, 1200, 3), dtype=np.uint8)
    slide(tmp_path / "a.ibl", image, 400)
    slides = SlideSet(spark, str(tmp_path))
    monkeypatch.setattr(api, "MOST_RASTER", 1000)
    requests = spark.createDataFrame([(1, f"{tmp_path}/a.ibl", 0, 0, 0, 1200, 1100), (2, f"{tmp_path}/a.ibl", 0, 0, 9, 5, 5)], "request_id long, path string, x long, y long, level int, w int, h int")
    cells, errors = slides._cells(requests, most=1000)
    assert cells.count() == 0 and errors.filter("request_id = 1").first()["error"]["message"].startswith("a raster of 5280000 bytes")
    cells, errors = slides.read_region_cells(requests)
    made = np.zeros((1100, 1200, 4), np.uint8)
    for r in cells.collect():
        made[r["top"] : r["top"] + r["height"], r["left"] : r["left"] + r["width"]] = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 4)
    assert (made[:, :, :3] == image).all() and [r["request_id"] for r in errors.collect()] == [2]


def test_facts_of_czi_documents():
    from strataslide.sources import czi as Z

    told = Z.facts('<a x="1">t<b y="2"/>tail</a>')
    assert [(f.path, f.name, f.value) for f in told] == [("a", "x", "1"), ("a", "", "t"), ("a", "tail", "tail"), ("a/b", "y", "2")]
    two = '<OME xmlns="u"><Image><Pixels SizeC="1" Type="uint8"><Channel Name="first"/></Pixels></Image><Image><Pixels SizeC="9" Type="uint16"><Channel Name="second" Fluor="x"/></Pixels></Image></OME>'
    m = Z.described(two)
    assert (m.channel_count, m.pixel_type, m.channel_names, m.fluorophore_names) == (1, "uint8", ["first"], [])
    distance = lambda inner: Z.described(f"<ImageDocument><S>{inner}</S></ImageDocument>").physical_pixel_sizes
    assert distance('<Distance Id="X" value="2e-7">9</Distance><Distance Id="y">3e-7</Distance>') == [2e-7, 3e-7]
    assert distance('<Distance Id="X"><Value>1</Value></Distance><Distance Id="Y"><Value>2</Value></Distance>') == [1.0, 2.0]
    assert distance('<Distance Id="X">one</Distance><Distance Id="Y">2</Distance>') == distance('<Distance Id="X">1</Distance>') == []
    assert Z.family(Z.Metadata(illumination_types=["half transmitted", "Fluorescence"])) == "multiplex"
    with pytest.raises(ValueError, match="brightfield and multiplex"):
        Z.family(Z.Metadata(illumination_types=["transmitted light"], fluorophore_names=["x"]))
    with pytest.raises(LookupError):
        Z.family(Z.Metadata(pixel_type="bgr24", channel_count=4))


@pytest.mark.parametrize("size", [16, 23])
def test_deepzoom_of_mds_is_joint(spark, tmp_path, size):
    """Pixels of the full level against slices of the whole; the overlap before a tile is on both axes or on none."""
    whole = RNG.integers(0, 255, (40, 60, 3), dtype=np.uint8)
    (tmp_path / "a.mds").write_bytes(make_ole({f"{r:04d}_{c:04d}": raster.png(whole[20 * r : 20 * r + 20, 20 * c : 20 * c + 20]) for r in range(2) for c in range(3)}))
    slides, path = SlideSet(spark, str(tmp_path)), f"{tmp_path}/a.mds"
    cols, rows = -(-60 // size), -(-40 // size)
    asked = [(c * 10 + r, path, 6, c, r) for c in range(cols) for r in range(rows)]
    got = {r["request_id"]: r for r in slides.deepzoom_tiles(spark.createDataFrame(asked, "request_id long, path string, dz_level int, col long, row_no long"), size, 2).collect()}
    for _, _, _, c, r in asked:
        near, far = 2 * (c > 0 or r > 0), 2 * (c < cols - 1 or r < rows - 1)
        x, y = max(size * c - near, 0), max(size * r - near, 0)
        z = [min(size, n - size * k) + near + far for n, k in ((60, c), (40, r))]
        want = whole[y : y + min(z[1], 40 - y), x : x + min(z[0], 60 - x)]
        t = got[c * 10 + r]
        assert (np.frombuffer(t["data"], np.uint8).reshape(t["height"], t["width"], 3) == want).all()


def test_deepzoom_of_multiplex_qptiff_ends_at_a_tile(spark, tmp_path):
    """Levels down to one tile, overlap on both sides, white around what is smaller than a whole tile."""
    planes = RNG.integers(0, 60_000, (2, 50, 70)).astype(np.uint16)
    data = bytearray(tiff(planes[:1], "<PerkinElmer-QPI-ImageDescription><ImageType>FullResolution</ImageType><Biomarker>DAPI</Biomarker></PerkinElmer-QPI-ImageDescription>"))
    (tmp_path / "a.qptiff").write_bytes(bytes(data))
    slides, path = SlideSet(spark, str(tmp_path)), f"{tmp_path}/a.qptiff"
    levels = slides.deepzoom(20, 1).select("dz_level").distinct().count()
    assert levels == 3  # 70 pixels are four tiles of 20, two, one
    asked = spark.createDataFrame([(1, path, 2, 1, 1, "DAPI"), (2, path, 2, 3, 2, "DAPI"), (3, path, 3, 0, 0, "DAPI"), (4, path, 2, 0, 0, "no")], "request_id long, path string, dz_level int, col long, row_no long, biomarker string")
    got = {r["request_id"]: r for r in slides.deepzoom_tiles(asked, 20, 1).collect()}
    image = lambda k: np.frombuffer(got[k]["data"], np.uint8).reshape(22, 22, 3)
    grey = lambda part: np.repeat(raster.to_uint8(part, wide=np.float64)[:, :, None], 3, axis=2)
    assert (image(1) == grey(planes[0][19:41, 19:41])).all()
    want = np.full((22, 22, 3), 255, np.uint8)
    want[5:16, 5:16] = grey(planes[0][39:50, 59:70])
    assert (image(2) == want).all()
    assert got[3]["error"]["message"] == "Invalid level" and got[4]["error"]["class"] == "UnknownBiomarkerError"
    told = slides.tile_coordinates(asked.filter("request_id <> 4"), 20).collect()
    assert {r["request_id"]: (r["left"], r["top"], r["width"], r["height"]) for r in told} == {1: (20, 20, 20, 20), 2: (60, 40, 10, 10), 3: (None,) * 4}
    assert slides.descriptors(20, 1, "png").first()["dzi"].splitlines()[5].strip() == '<Size Width="70" Height="50"/>'
    slides.close()


def test_pyramids_by_format(spark):
    """All rules in one plan are the single ones; bounds move and shrink what may be cut."""
    from pyspark.sql import functions as F

    from strataslide.operators import deepzoom

    rows = [(f, fam, 1000 + 137 * k, 700 + 91 * k) for k, (f, fam) in enumerate([("tmap", "brightfield"), ("mds", "brightfield"), ("isyntax", "brightfield"), ("qptiff", "multiplex"), ("qptiff", "brightfield"), ("tron", "brightfield")])]
    slides = deepzoom.with_rules(spark.createDataFrame(rows, "format_id string, slide_family string, width long, height long"), spark)
    told = {(r["format_id"], r["slide_family"]): (r["pyramid"], r["lap"], r["cuts"], r["fit"]) for r in slides.collect()}
    assert told["qptiff", "brightfield"] == told["tmap", "brightfield"] == deepzoom.USUAL and told["tron", "brightfield"] == ("halving", "axis", True, "shrink")
    names = ["format_id", "slide_family", "dz_level", "col", "row_no", "z_w", "z_h", "l0_x", "l0_y", "l_w", "l_h"]
    lay = lambda df: df.withColumn("downsample", F.lit(1.0)).withColumn("level_w", F.col("width")).withColumn("level_h", F.col("height"))
    got = deepzoom.places(deepzoom.addresses(lay(deepzoom.levels(slides, 100, F.col("pyramid")))), 100, 2).select(*names).collect()
    for pyramid, lap, places in (("halving", "axis", deepzoom.tile_places), ("halving", "joint", lambda a, t, o: deepzoom.tile_places(a, t, o, joint=True)), ("floor", "before", deepzoom.floor_places), ("tiled", "both", deepzoom.tiled_places)):
        some = slides.filter((F.col("pyramid") == pyramid) & (F.col("lap") == lap))
        one = places(deepzoom.addresses(lay(deepzoom.levels(some, 100, pyramid))), 100, 2).select(*names).collect()
        assert one and sorted(one) == sorted(r for r in got if told[r["format_id"], r["slide_family"]][:2] == (pyramid, lap))


def test_files_are_written_all_or_none(spark, tmp_path):
    import pandas as pd

    from strataslide import sinks

    images = spark.createDataFrame([(k, f"{k}".encode() * k) for k in range(40)], "id long, data binary").repartition(5)
    told = sinks.write_blobs(images, str(tmp_path / "a"), "concat('tiles/', id % 3, '/', id, '.bin')")
    assert {r["name"]: r["bytes"] for r in told.collect()} == {f"tiles/{k % 3}/{k}.bin": len(f"{k}") * k for k in range(40)}
    assert {str(p.relative_to(tmp_path / "a")) for p in (tmp_path / "a" / "tiles").rglob("*") if p.is_file()} == {f"tiles/{k % 3}/{k}.bin" for k in range(40)}
    assert (tmp_path / "a/tiles/1/7.bin").read_bytes() == b"7777777"

    def fails(batches):
        for b in batches:
            if (b["id"] == 33).any():
                raise RuntimeError("no such luck")
            yield b

    with pytest.raises(Exception, match="no such luck"):
        sinks.write_blobs(images.mapInPandas(fails, "id long, data binary"), str(tmp_path / "b"), "concat(id, '.bin')")
    assert not [p for p in (tmp_path / "b").rglob("*") if p.is_file()]
    twice = sinks.write_blobs(spark.createDataFrame(pd.DataFrame({"data": [b"x", b"yy"]})).coalesce(1), str(tmp_path / "c"), "'one'")
    assert [tuple(r) for r in twice.collect()] == [("one", 2)] and (tmp_path / "c/one").read_bytes() == b"yy"
    empty = sinks.write_blobs(images.limit(0), str(tmp_path / "d"), "'none'")
    assert empty.count() == 0
    from strataslide.sources.blob import sized

    assert [p.rpartition("/")[2] for p, _ in sized(str(tmp_path / "c"))] == ["one"]


def test_thumbnails_of_mds(spark, tmp_path):
    """One level: its middle, a quarter of the lesser side but 256 at least, brought to the exact size."""
    whole = RNG.integers(0, 255, (40, 60, 3), dtype=np.uint8)
    (tmp_path / "a.mds").write_bytes(make_ole({f"{r:04d}_{c:04d}": raster.png(whole[20 * r : 20 * r + 20, 20 * c : 20 * c + 20]) for r in range(2) for c in range(3)}))
    r = SlideSet(spark, str(tmp_path)).thumbnails(50, 30).first()
    canvas_ = np.full((256, 256, 4), (240, 240, 240, 255), np.uint8)
    canvas_[:40, :60, :3] = whole
    got = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 4)
    want = raster.resize(canvas_, 50, 30)
    assert got.shape == want.shape and abs(got.astype(int) - want).max() <= 1


def test_availability_of_what_is_read_here(spark, tmp_path):
    plain = tiff([RNG.integers(0, 9, (4, 5))])
    tiled = bytearray(plain)
    at = tiled.index(struct.pack("<HH", 273, 4))  # strips become tiles
    struct.pack_into("<H", tiled, at, 324)
    for name, data in {"a.svs": bytes(tiled), "b.svs": plain, "c.ndpi": bytes(tiled), "d.svs": b"nothing"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: (r["format_id"], r["error"]) for r in SlideSet(spark, str(tmp_path)).resolved().collect()}
    assert got == {"a.svs": ("openslide", None), **{n: ("openslide", "Backend not available") for n in ("b.svs", "c.ndpi", "d.svs")}}
