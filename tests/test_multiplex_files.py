"""Multiplex containers read back: channels, planes, regions, gates; Deep Zoom tiles and thumbnails of a slide set."""

import sqlite3

import numpy as np
import pytest

from strataslide.api import SlideSet
from strataslide.functions import raster
from strataslide.sources import czi as Z
from strataslide.sources import mcd as M
from strataslide.sources.blob import Blob
from strataslide.sources.planes import accepted, open_planes

from . import makers

RNG = np.random.default_rng(3)
PLANES = RNG.integers(0, 60_000, (3, 20, 30)).astype(np.uint16)
DOCUMENT = '<ImageDocument><Metadata><Camera>Camera Pixel Type uint16</Camera><Dye>FluorescenceDye DAPI FITC</Dye><Scaling><Items><Distance Id="X"><Value>5e-7</Value></Distance><Distance Id="Y" value="5e-7"/></Items></Scaling></Metadata></ImageDocument>'


def qpi(kind, name=""):
    return f"<PerkinElmer-QPI-ImageDescription><ImageType>{kind}</ImageType><Biomarker>{name}</Biomarker></PerkinElmer-QPI-ImageDescription>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("multiplex")
    a, b, c = PLANES
    files = {
        "ome.tif": makers.tiff_pages([(a, makers.ome(["DNA", "", "CD3"]), "", ""), (b, "", "", ""), (c, "", "", "")]),
        "pages.tiff": makers.tiff_pages([(p, "", n, "Fluidigm MCD Viewer") for p, n in zip(PLANES, ("x", "Histone", "z"), strict=True)], compress=True),
        "one.tif": makers.tiff_pages([(a, "", "Ir191", "Fluidigm MCD viewer 1.0")]),
        "plain.tif": makers.tiff_pages([(a.astype(np.uint8), "nothing", "", "")]),
        "many.qptiff": makers.tiff_pages([(p, qpi("FullResolution", n), "", "") for p, n in zip(PLANES, ("CD4", "DAPI", "CD8"), strict=True)] + [(a.astype(np.uint8), qpi("Thumbnail"), "", "")] + [(p[::2, ::2], qpi("ReducedResolution"), "", "") for p in PLANES]),
        "he.qptiff": makers.tiff_pages([(a, qpi("FullResolution", "H&E"), "", "")]),
        "cells.czi": makers.czi(PLANES, DOCUMENT),
        "cells.mcd": makers.mcd({3: {"Ir(191)": ("DNA1", a), "Yb(176)": ("", b)}, 5: {"Pr(141)": ("CD9", c[:5, :6])}, 4: {"Nd(142)": ("HistoneH3", c[:5, :6])}, 99: {"Zz(1)": ("", RNG.random((40, 40)))}}),
        "broken.czi": b"ZISRAWFILE" + bytes(700),
    }
    for name, data in files.items():
        (at / name).write_bytes(data)
    return at


def opened(folder, name, **kw):
    return open_planes(Blob(str(folder / name)), **kw)


def test_channels_and_planes(folder):
    for name, kind, names in (("ome.tif", "ome_tiff", ["DNA", "Channel 1", "CD3"]), ("pages.tiff", "ome_tiff", ["x", "Histone", "z"]), ("many.qptiff", "qptiff", ["CD4", "DAPI", "CD8"]), ("cells.czi", "czi", ["DAPI", "FITC", "channel_0", "channel_1", "channel_2"])):
        p = opened(folder, name)
        assert (p.format_id, p.names, p.levels[0]) == (kind, names, (30, 20, 1.0))
        for k in range(2):
            assert (p.plane(k, 0) == PLANES[k]).all() and (p.read(k, 0, 3, 6, 20, 11) == PLANES[k][6:17, 3:23]).all()
    assert opened(folder, "ome.tif").mpp == 0.5 and opened(folder, "cells.czi").mpp == pytest.approx(0.5)
    q = opened(folder, "many.qptiff")
    assert q.levels[1] == (15, 10, 2.0) and (q.plane(2, 1) == PLANES[2][::2, ::2]).all() and q.family == "multiplex"
    assert opened(folder, "he.qptiff").family == "brightfield" and opened(folder, "one.tif").names == ["Ir191"]
    c = opened(folder, "cells.czi")
    assert (c.index("FITC"), c.index("channel_2"), c.index("none")) == (1, 2, None)
    with pytest.raises(LookupError):
        c.plane(7, 0)
    assert [accepted(Blob(str(folder / n))) for n in ("ome.tif", "one.tif", "plain.tif", "cells.czi", "broken.czi")] == [["ome_tiff"], ["ome_tiff"], [], [], []]


def test_mcd(folder):
    p = opened(folder, "cells.mcd")
    assert (p.names, p.levels) == (["DNA1", "Yb(176)"], [(30, 20, 1.0)]) and p.properties["mcd.selected-acquisition-id"] == "3"
    assert (p.plane(1, 0) == PLANES[1]).all() and p.properties["mcd.metals"] == "Ir,Yb" and p.properties["mcd.masses"] == "191,176"
    assert opened(folder, "cells.mcd", acquisition_id=5).names == ["CD9"]
    found = M.acquisitions(M.document(Blob(str(folder / "cells.mcd"))))
    assert [a.id for a in found] == [3, 5, 4] and M.selected([a for a in found if a.id != 3]).id == 5  # equal sizes: the greatest id
    with pytest.raises(ValueError, match="99"):
        M.selected(found, 99)


def test_czi_documents():
    ome = Z.described('<OME xmlns="u"><Image><Pixels SizeC="2" Type="uint8" PhysicalSizeX="0.2"><Channel Name="a" Fluor="Cy3" ExcitationWavelength="550" IlluminationType="Transmitted"/><Channel/></Pixels></Image></OME>')
    assert (ome.channel_count, ome.channel_names, ome.fluorophore_names, ome.excitation_wavelengths, ome.physical_pixel_sizes) == (2, ["a"], ["Cy3"], [550.0], [0.2])
    with pytest.raises(ValueError):
        Z.family(ome)
    with pytest.raises(LookupError):
        Z.family(Z.Metadata())
    assert Z.family(Z.Metadata(pixel_type="Bgr24", channel_count=3)) == "brightfield" and Z.family(Z.Metadata(emission_wavelengths=[500.0])) == "multiplex"
    assert Z.described("<broken") == Z.Metadata() and Z.described("<ImageDocument/>", 3).channel_names == ["channel_0", "channel_1", "channel_2"]
    assert Z.Metadata(channel_names=["x"]).filled(Z.Metadata(channel_count=2, channel_names=["y"])) == Z.Metadata(channel_count=2, channel_names=["x"])
    assert Z.biomarkers(Z.Metadata(2, fluorophore_names=["a"], channel_names=["b", "a"])) == ["a", "b", "channel_0", "channel_1"]


def test_biomarker_regions(spark, folder):
    slides = SlideSet(spark, str(folder))
    path = {r["path"].rpartition("/")[2]: r["path"] for r in slides.metadata.collect()}
    asked = [(1, "ome.tif", 4, 5, 0, 10, 8, "CD3"), (2, "many.qptiff", 4, 6, 1, 5, 4, "DAPI"), (3, "cells.czi", 25, 15, 0, 10, 10, "FITC"), (4, "ome.tif", 400, 5, 0, 3, 2, "DNA"), (5, "ome.tif", 0, 0, 0, 3, 2, "no"), (6, "ome.tif", 0, 0, 1, 3, 2, "DNA"), (7, "plain.tif", 0, 0, 0, 3, 2, "DNA"), (8, "cells.mcd", 0, 0, 0, 30, 20, "Yb(176)"), (9, "pages.tiff", -3, 0, 0, 2, 2, "z"), (10, "gone", 0, 0, 0, 1, 1, "z")]
    requests = spark.createDataFrame([(i, path.get(n, n), x, y, lv, w, h, b) for i, n, x, y, lv, w, h, b in asked], "request_id long, path string, x long, y long, level int, w int, h int, biomarker string")
    got = {r["request_id"]: r for r in slides.read_biomarker_region(requests).collect()}
    assert len(got) == 10

    def image(k):
        r = got[k]
        assert r["error"] is None
        out = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 4)
        assert (out[:, :, 3] == 255).all() and (out[:, :, :1] == out[:, :, 1:3]).all()
        return out[:, :, 0]

    grey = lambda x: raster.to_uint8(x, wide=np.float64)
    assert (image(1) == grey(PLANES[2][5:13, 4:14])).all() and (image(2) == grey(PLANES[1][::2, ::2][3:7, 2:7])).all()
    assert (image(3) == grey(PLANES[1][15:20, 25:30])).all()  # cut at the sides
    assert (image(4) == np.zeros((2, 3))).all() and (image(8) == grey(PLANES[1].astype(np.float32))).all()
    assert (image(9) == grey(PLANES[2][0:2, -3:-1])).all()  # a negative start counts from the far side
    kinds = {k: got[k]["error"]["class"] for k in (5, 6, 7, 10)}
    assert kinds == {5: "UnknownBiomarkerError", 6: "ValueError", 7: "UnsupportedOperationError", 10: "ValueError"}
    refused = slides.read_region(requests.drop("biomarker").filter("request_id in (1, 8)")).collect()
    assert {r["error"]["class"] for r in refused} == {"UnsupportedOperationError"} and len(refused) == 2
    names = {r["path"].rpartition("/")[2]: r for r in slides.biomarkers().collect()}
    assert names["many.qptiff"]["default_biomarker"] == "DAPI" and names["pages.tiff"]["default_biomarker"] == "Histone" and names["cells.mcd"]["default_biomarker"] == "DNA1"
    assert names["plain.tif"]["error"]["class"] == "UnsupportedOperationError" and names["he.qptiff"]["biomarkers"] is None
    has = slides.has_biomarker(spark.createDataFrame([(path["ome.tif"], "CD3"), (path["ome.tif"], "x")], "path string, biomarker string")).collect()
    assert {r["biomarker"]: r["has_biomarker"] for r in has} == {"CD3": True, "x": False}
    assert slides.errors().count() == 1
    kinds = {r["path"].rpartition("/")[2]: (r["format_id"], r["error"]) for r in slides.resolved().collect()}
    assert kinds["ome.tif"] == kinds["pages.tiff"] == kinds["one.tif"] == ("ome_tiff", None) and kinds["plain.tif"] == ("generic_tiff", None) and kinds["cells.czi"] == ("czi", None)
    style = raster.ColorStyle(rgb_rate=(1.0, 0.0, 0.5))
    tinted = {r["request_id"]: r for r in slides.colored(slides.read_biomarker_region(requests), style).collect()}
    assert len(tinted) == 10 and tinted[5]["data"] is None
    now = np.frombuffer(tinted[1]["data"], np.uint8).reshape(tinted[1]["height"], tinted[1]["width"], 4)
    assert (now[:, :, 0] == image(1)).all() and (now[:, :, 1] == 0).all() and (now[:, :, 2] == image(1) // 2).all() and (now[:, :, 3] == 255).all()
    assert slides.colored(requests, None) is requests
    thumbs = {r["path"].rpartition("/")[2]: r["error"] for r in slides.thumbnails(9, 9).collect()}
    assert thumbs["ome.tif"]["class"] == "UnsupportedOperationError"


@pytest.fixture(scope="module")
def pyramid(tmp_path_factory):
    whole = RNG.integers(0, 255, (100, 130, 3), dtype=np.uint8)
    at = tmp_path_factory.mktemp("pyramid")
    con = sqlite3.connect(at / "a.ibl")
    con.execute("CREATE TABLE tbl_base_info (magicNo, version, ratio_step, total_img_width, total_img_height, tile_width, tile_height, img_width, img_height, img_col, img_row, pixel_size, max_zoom_rate, layer_size)")
    con.execute("INSERT INTO tbl_base_info VALUES ('ibl', '2.0', 2, 130, 100, 32, 32, 0, 0, 1, 1, 0.0005, 40, 2)")
    con.execute("CREATE TABLE tbl_tileex_info (layer, col, row, data)")
    for layer in (0, 1):
        level = whole[:: 2**layer, :: 2**layer]
        con.executemany("INSERT INTO tbl_tileex_info VALUES (?, ?, ?, ?)", [(layer, c, r, raster.png(level[32 * r : 32 * r + 32, 32 * c : 32 * c + 32])) for c in range(-(-level.shape[1] // 32)) for r in range(-(-level.shape[0] // 32))])
    con.commit()
    con.close()
    return at, whole


def test_deepzoom_tiles_and_thumbnails(spark, pyramid):
    at, whole = pyramid
    slides = SlideSet(spark, str(at))
    dz = {(r["dz_level"], r["col"], r["row_no"]): r for r in slides.deepzoom(40, 1).collect()}
    path = next(iter(dz.values()))["path"]
    top = max(k[0] for k in dz)
    asked = [(1, top, 0, 0), (2, top, 1, 2), (3, top - 1, 1, 0), (4, 2, 0, 0), (5, top, 9, 0), (6, 40, 0, 0), (7, top, -1, 0)]
    rows = slides.deepzoom_tiles(spark.createDataFrame([(i, path, lv, c, r) for i, lv, c, r in asked], "request_id long, path string, dz_level int, col long, row_no long"), 40, 1).collect()
    got = {r["request_id"]: r for r in rows}
    assert len(rows) == 7 and [got[k]["error"]["message"] for k in (5, 6, 7)] == ["Invalid address", "Invalid level", "Invalid address"]
    image = lambda k: np.frombuffer(got[k]["data"], np.uint8).reshape(got[k]["height"], got[k]["width"], 3)
    assert (image(1) == whole[:41, :41]).all() and (image(2) == whole[79:100, 39:81]).all()
    assert (image(3) == whole[::2, ::2][:41, 39:65]).all()
    small = dz[2, 0, 0]
    want = raster.thumbnail(whole[::2, ::2][: small["l_h"], : small["l_w"]], small["z_w"], small["z_h"])
    assert image(4).shape == want.shape and (image(4) == want).all()
    thumb = slides.thumbnails(20, 20).first()
    assert (thumb["height"], thumb["width"]) == (15, 20) and thumb["error"] is None
    made = np.frombuffer(thumb["data"], np.uint8).reshape(15, 20, 4)
    assert (made[:, :, :3] == raster.thumbnail(whole[::2, ::2], 20, 20)).all()
    assert slides.label_images().first()["data"] is None
    wrong = slides.read_region(spark.createDataFrame([(1, path, 0, 0, 2, 4, 4), (2, path, 0, 0, -1, 4, 4)], "request_id long, path string, x long, y long, level int, w int, h int")).collect()
    assert {r["error"]["class"] for r in wrong} == {"ValueError"} and len(wrong) == 2
    fixed = slides.read_fixed_region(spark.createDataFrame([(1, path, 0, 0, 0, 4, 4)], "request_id long, path string, x long, y long, level int, w int, h int")).first()
    assert fixed["error"]["class"] == "UnsupportedOperationError"
    slides.close()


def test_channels_of_a_slide_go_into_several_files(spark, tmp_path, monkeypatch):
    """A slide of many channels: no file holds more than twice the stated number, and numbers and sums are those of one file."""
    from strataslide.plans import container_queries as C
    from strataslide.plans.registry import QUERIES

    rng = np.random.default_rng(5)
    ids = [*range(0, 3000, 7), 1 << 20, 5 << 20]
    rows = [(k, [float(v) for v in rng.normal(size=64).astype(np.float32)], 3 if n % 40 else 4) for n, k in enumerate(ids)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(C, "_MOST_CHANNELS", 20)
    monkeypatch.setattr(C, "_RUN", 500)
    made = []
    write = C.write_blobs
    monkeypatch.setattr(C, "write_blobs", lambda images, root, name: made.append(write(images, root, name).collect()))
    want = {}
    for slide in (3, 4):
        for at, (k, px, _) in enumerate(r for r in rows if r[2] == slide):
            want[slide, at] = (f" {k}", px)
    for name in ("named_page_planes", "ome_tiff_planes", "qptiff_planes", "mcd_planes", "czi_planes"):
        got = {(r["slide_id"], r["channel"]): r for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got.keys() == want.keys()
        for key, r in got.items():
            px = np.array(want[key][1], np.float32)
            px = np.floor(abs(px) * 1000) if name == "czi_planes" else px
            assert abs(r["total"] - float((px.astype(float) * np.arange(1, 65)).sum())) < 0.002
            assert name == "czi_planes" or r["name"].endswith(want[key][0])
    per_slide = {s: sum(k[0] == s for k in want) for s in (3, 4)}
    assert [len(files) for files in made] == [sum(max(1, n // 20) for n in per_slide.values())] * 5
    regions = {(r["slide_id"], r["channel"]): (r["w"], r["h"]) for r in QUERIES["biomarker_regions"](spark, str(tmp_path)).collect()}
    assert regions == {(s, c): (min(4, 8 - c % 9) if c % 9 < 8 else 4, 3 if c % 9 == 8 else min(3, 8 - c % 7)) for s, c in want}


def test_a_channels_subblocks_are_not_looked_for_among_all(monkeypatch):
    """Of 300 channels each read meets its own subblocks only."""
    planes = [np.full((8, 8), k, np.uint16) for k in range(300)]
    found = open_planes(Blob(makers.czi(planes, "<ImageDocument/>", tile=5)))
    met = []
    overlapping = Z.overlapping
    monkeypatch.setattr(Z, "overlapping", lambda blocks, *a: met.append(len(blocks)) or overlapping(blocks, *a))
    assert [int(found.plane(found.index(n), 0)[0, 0]) for n in found.names] == list(range(300)) and max(met) <= 5


def test_a_file_is_opened_by_few_tasks(spark, tmp_path):
    """Regions of all channels of a small file are one task's, so its directory isn't read by every task."""
    from pyspark.sql import functions as F

    names = [f"m{k}" for k in range(16)]
    (tmp_path / "a.tif").write_bytes(makers.tiff_pages([(PLANES[0], makers.ome(names) if k == 0 else "", "", "") for k in range(16)]))
    slides = SlideSet(spark, str(tmp_path))
    asked = slides.channels().select(F.col("channel_index").cast("long").alias("request_id"), "path", F.col("name").alias("biomarker"), F.lit(1).cast("long").alias("x"), F.lit(2).cast("long").alias("y"), F.lit(0).alias("level"), F.lit(4).alias("w"), F.lit(3).alias("h"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = slides.read_biomarker_region(asked).filter("error is null").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(got) == 16 and len({r["task"] for r in got}) == 1
