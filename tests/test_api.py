"""A set of slides: metadata, best level, regions, Deep Zoom."""

import sqlite3

import numpy as np
import pytest

from strataslide.api import SlideSet
from strataslide.functions.raster import png


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 255, (48, 64, 3), dtype=np.uint8)
    at = tmp_path_factory.mktemp("set")
    con = sqlite3.connect(at / "a.ibl")
    con.execute("CREATE TABLE tbl_base_info (magicNo, version, ratio_step, total_img_width, total_img_height, tile_width, tile_height, img_width, img_height, img_col, img_row, pixel_size, max_zoom_rate, layer_size)")
    con.execute("INSERT INTO tbl_base_info VALUES ('ibl', '2.0', 2, 64, 48, 16, 16, 0, 0, 1, 1, 0.0005, 40, 2)")
    con.execute("CREATE TABLE tbl_tileex_info (layer, col, row, data)")
    rows = [(0, c, r, png(whole[16 * r : 16 * r + 16, 16 * c : 16 * c + 16])) for c in range(4) for r in range(3) if (c, r) != (2, 1)]
    rows += [(1, c, r, png(whole[::2, ::2][16 * r : 16 * r + 16, 16 * c : 16 * c + 16])) for c in range(2) for r in range(2)]
    con.executemany("INSERT INTO tbl_tileex_info VALUES (?, ?, ?, ?)", rows)
    con.commit()
    con.close()
    (at / "broken.dyj").write_bytes(b"nothing")
    return at, whole


def test_slides(spark, made):
    at, whole = made
    slides = SlideSet(spark, str(at))
    assert [(r["level"], r["width"], r["height"], r["downsample"]) for r in slides.levels().orderBy("level").collect()] == [(0, 64, 48, 1.0), (1, 32, 24, 2.0)]
    assert slides.errors().count() == 1 and slides.properties().filter("key = 'openslide.objective-power'").first()["value"] == "20"
    path = slides.levels().first()["path"]
    best = slides.best_level(spark.createDataFrame([(path, 1.5), (path, 2.0), (path, 9.0)], "path string, target_downsample double"))
    assert sorted((r["target_downsample"], r["best_level"]) for r in best.collect()) == [(1.5, 0), (2.0, 1), (9.0, 1)]
    asked = spark.createDataFrame([(1, path, 5, 7, 0, 50, 40), (2, path, 8, 4, 1, 20, 18), (3, path, 900, 900, 0, 2, 2)], "request_id long, path string, x long, y long, level int, w int, h int")
    got = {r["request_id"]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 4) for r in slides.read_region(asked, 16).collect()}
    canvas = np.full((48, 64, 4), (255, 255, 255, 0), np.uint8)
    canvas[:, :, :3], canvas[:, :, 3] = whole, 255
    canvas[16:32, 32:48] = (255, 255, 255, 0)
    assert (got[1] == canvas[7:47, 5:55]).all()
    assert (got[2][:, :, :3] == whole[::2, ::2][2:20, 4:24]).all()
    assert (got[3] == (255, 255, 255, 0)).all()
    dz = slides.deepzoom(20, 1).collect()
    top = [r for r in dz if r["dz_level"] == 6]
    assert len(top) == 4 * 3 and {(r["z_w"], r["z_h"]) for r in top if (r["col"], r["row_no"]) == (1, 1)} == {(22, 22)}
    assert 'Width="64"' in slides.descriptors().first()["dzi"]
