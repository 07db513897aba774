"""Requests against tiles, blocks and scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import canvas as V
from ..operators import region as R
from .registry import query, table


@query("SELECT request_id, CAST(trunc(x / target_downsample) AS BIGINT) AS lx, CAST(trunc(y / target_downsample) AS BIGINT) AS ly FROM v_requests")
def level_coordinates(spark, sf_dir):
    return table(spark, sf_dir, "v_requests").select("request_id", R.level_coordinate(F.col("x"), F.col("target_downsample")).alias("lx"), R.level_coordinate(F.col("y"), F.col("target_downsample")).alias("ly"))


@query("SELECT request_id, CAST(floor((x - 700) / 256) AS BIGINT) AS col0, CAST(floor((y - 300) / 256) AS BIGINT) AS row0, CAST(floor((x - 700 + w - 1) / 256) AS BIGINT) AS col1, CAST(floor((y - 300 + h - 1) / 256) AS BIGINT) AS row1 FROM v_requests")
def tile_range(spark, sf_dir):
    moved = table(spark, sf_dir, "v_requests").withColumn("x", F.col("x") - 700).withColumn("y", F.col("y") - 300)
    return R.cell_range(moved, 256, 256).select("request_id", "col0", "row0", "col1", "row1")


_CELLS = "SELECT request_id, slide_id, CAST(request_id % 3 AS INTEGER) AS level, col, unnest(range(y // 256, (y + h - 1) // 256 + 1)) AS row_no FROM (SELECT *, unnest(range(x // 256, (x + w - 1) // 256 + 1)) AS col FROM v_requests)"


@query(f"SELECT c.request_id, c.level, c.col, c.row_no, t.data_offset FROM ({_CELLS}) c LEFT JOIN v_tiles t ON c.slide_id = t.slide_id AND c.level = t.level AND c.col = t.col AND c.row_no = t.row_no")
def tile_point_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "v_requests").withColumn("level", (F.col("request_id") % 3).cast("int"))
    return R.tile_lookup(asked, table(spark, sf_dir, "v_tiles"), 256, 256).select("request_id", "level", "col", "row_no", "data_offset")


@query(f"SELECT c.request_id, CAST(any_value(c.level) AS INTEGER) AS level, count(t.data_offset) AS n_tiles, count(*) - count(t.data_offset) AS n_background FROM ({_CELLS}) c LEFT JOIN v_tiles t ON c.slide_id = t.slide_id AND c.level = t.level AND c.col = t.col AND c.row_no = t.row_no GROUP BY c.request_id")
def tile_range_join(spark, sf_dir):
    asked = table(spark, sf_dir, "v_requests").withColumn("level", (F.col("request_id") % 3).cast("int"))
    found = R.tile_lookup(asked, table(spark, sf_dir, "v_tiles"), 256, 256)
    return found.groupBy("request_id").agg(F.first("level").alias("level"), F.count("data_offset").alias("n_tiles"), F.count_if(F.col("data_offset").isNull()).alias("n_background"))


def _scenes(spark, sf_dir):
    s = table(spark, sf_dir, "v_scenes")
    return s.groupBy("slide_id", "scene_index", "x", "y", "w", "h").agg(F.count("*").alias("n")).drop("n")


_PAIRS = "FROM v_requests r JOIN (SELECT DISTINCT * FROM v_scenes) s ON r.slide_id = s.slide_id AND r.x < s.x + s.w AND s.x < r.x + r.w AND r.y < s.y + s.h AND s.y < r.y + r.h"


@query(f"SELECT r.request_id, s.scene_index, s.x AS scene_x, s.y AS scene_y, greatest(r.x, s.x) - r.x AS dst_x, greatest(r.y, s.y) - r.y AS dst_y, least(r.x + r.w, s.x + s.w) - greatest(r.x, s.x) AS cut_w, least(r.y + r.h, s.y + s.h) - greatest(r.y, s.y) AS cut_h {_PAIRS}")
def spatial_join(spark, sf_dir):
    scenes = _scenes(spark, sf_dir).select("slide_id", "scene_index", *[F.col(c).alias(f"{c}2") for c in "xywh"])
    pairs = R.rectangle_join(table(spark, sf_dir, "v_requests"), scenes, ("slide_id",))
    cut = R.intersection(tuple(map(F.col, "xywh")), tuple(F.col(f"{c}2") for c in "xywh")).alias("cut")
    return pairs.withColumn("cut", cut).select("request_id", "scene_index", F.col("x2").alias("scene_x"), F.col("y2").alias("scene_y"), (F.col("cut.x") - F.col("x")).alias("dst_x"), (F.col("cut.y") - F.col("y")).alias("dst_y"), F.col("cut.w").alias("cut_w"), F.col("cut.h").alias("cut_h"))


@query("SELECT request_id, CASE WHEN w1 > 0 AND h1 > 0 THEN x1 END AS cut_x, CASE WHEN w1 > 0 AND h1 > 0 THEN y1 END AS cut_y, CASE WHEN w1 > 0 AND h1 > 0 THEN w1 END AS cut_w, CASE WHEN w1 > 0 AND h1 > 0 THEN h1 END AS cut_h FROM (SELECT request_id, greatest(x, 500) AS x1, greatest(y, 250) AS y1, least(x + w, 1500) - greatest(x, 500) AS w1, least(y + h, 650) - greatest(y, 250) AS h1 FROM v_requests)")
def rect_intersect(spark, sf_dir):
    window = tuple(F.lit(v).cast("long") for v in (500, 250, 1000, 400))
    cut = table(spark, sf_dir, "v_requests").withColumn("cut", R.intersection(tuple(map(F.col, "xywh")), window))
    return cut.select("request_id", *[F.col(f"cut.{c}").alias(f"cut_{c}") for c in "xywh"])


@query("SELECT count(*) AS n_strict, (SELECT count(*) FROM v_requests WHERE x <= 600 AND 344 <= x + w AND y <= 500 AND 244 <= y + h) AS n_touching FROM v_requests WHERE x < 600 AND 344 < x + w AND y < 500 AND 244 < y + h")
def overlap_rules(spark, sf_dir):
    r = table(spark, sf_dir, "v_requests")
    a, b = tuple(map(F.col, "xywh")), tuple(map(F.lit, (344, 244, 256, 256)))
    return r.agg(F.count_if(R.overlaps(a, b)).alias("n_strict"), F.count_if(R.overlaps(a, b, strict=False)).alias("n_touching"))


_BLOCKS = "SELECT DISTINCT slide_id, col, row_no FROM v_tiles WHERE level = 0"


@query(f"SELECT slide_id, col, row_no, sub_col, sub_row, CAST(col * 4 + sub_col AS BIGINT) * 612 AS x, CAST(row_no * 4 + sub_row AS BIGINT) * 512 AS y FROM (SELECT *, CAST(unnest(range(4)) AS INTEGER) AS sub_row FROM (SELECT *, CAST(unnest(range(4)) AS INTEGER) AS sub_col FROM ({_BLOCKS})))")
def block_subtile_join(spark, sf_dir):
    blocks = table(spark, sf_dir, "v_tiles").filter("level = 0").select("slide_id", "col", "row_no")
    return R.sub_tiles(blocks).select("slide_id", "col", "row_no", "sub_col", "sub_row", "x", "y")


@query("SELECT slide_id, cx, cy, arg_max(value, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := value)) AS value FROM (SELECT l_partkey AS slide_id, CAST(l_quantity AS INTEGER) % 8 AS cx, l_linenumber % 8 AS cy, l_shipdate, l_orderkey, l_linenumber, l_extendedprice AS value FROM lineitem) GROUP BY slide_id, cx, cy")
def overlay_last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS slide_id", "CAST(l_quantity AS INT) % 8 AS cx", "l_linenumber % 8 AS cy", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice AS value")
    return R.overlay(rows, ("slide_id", "cx", "cy"), "value", ("l_shipdate", "l_orderkey", "l_linenumber", "value"))


# Rectangles of one colour in place of decoded tiles.
_W, _H, _CELL, _UNDER = 200, 150, 64, 7
_PAINTS = "SELECT o_custkey % 20 AS slide_id, o_orderkey AS draw_seq, CAST(o_orderkey * 7 % 230 - 15 AS INT) AS x, CAST(o_orderkey * 3 % 170 - 10 AS INT) AS y, CAST(5 + o_orderkey % 13 AS INT) AS w, CAST(4 + o_orderkey % 9 AS INT) AS h, CAST(o_orderkey % 251 AS INT) AS color FROM {orders}"


@query(
    f"WITH p AS (SELECT slide_id, px, py, arg_max(color, draw_seq) AS v FROM (SELECT *, unnest(range(y, y + h)) AS py FROM (SELECT *, unnest(range(x, x + w)) AS px FROM ({_PAINTS.format(orders='orders')}))) WHERE px BETWEEN 0 AND {_W - 1} AND py BETWEEN 0 AND {_H - 1} GROUP BY ALL),"
    f" g AS (SELECT slide_id, px, py FROM (SELECT DISTINCT o_custkey % 20 AS slide_id FROM orders), range({_W}) a(px), range({_H}) b(py))"
    f" SELECT slide_id, CAST(px // {_CELL} AS INTEGER) AS cell_x, CAST(py // {_CELL} AS INTEGER) AS cell_y, count(*) AS pixels, CAST(sum(coalesce(v, {_UNDER})) AS BIGINT) AS total, CAST(sum(coalesce(v, {_UNDER}) * (1 + (px % {_CELL}) * 3 + py % {_CELL})) AS BIGINT) AS placed FROM g LEFT JOIN p USING (slide_id, px, py) GROUP BY ALL"
)
def canvas_paint(spark, sf_dir):
    """Sums, plain and by place, of the cells that overlapping pastes leave."""
    import numpy as np
    import pandas as pd

    orders = table(spark, sf_dir, "orders")

    def cut(batches):
        for b in batches:
            rows = [c for t in b.itertuples() for c in V.crops(t.slide_id, t.x, t.y, t.draw_seq, np.full((t.h, t.w, 4), t.color, np.uint8), _W, _H, _CELL)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in V.CROP.split(", ")])

    def sums(batches):
        for b in batches:
            rows = []
            for t in b.itertuples():
                v = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, 4)[:, :, 0].astype(np.int64)
                rows.append((t.request_id, t.cell_x, t.cell_y, v.size, v.sum(), (v * (1 + 3 * np.arange(t.width) + np.arange(t.height)[:, None])).sum()))
            yield pd.DataFrame(rows, columns=["slide_id", "cell_x", "cell_y", "pixels", "total", "placed"])

    pastes = spark.sql(_PAINTS, orders=orders).mapInPandas(cut, V.CROP)
    canvases = orders.select((F.col("o_custkey") % 20).alias("request_id")).distinct().selectExpr("request_id", f"{_W} AS w", f"{_H} AS h", f"{_W} AS out_w", f"{_H} AS out_h", f"array({_UNDER}, {_UNDER}, {_UNDER}, 255) AS background")
    return V.painted(pastes, canvases, _CELL).mapInPandas(sums, "slide_id long, cell_x int, cell_y int, pixels long, total long, placed long")


# Scenes of subblocks, 16 pixels in one: each pixel's value is told by its subblock and place.
_SUBBLOCKS = "SELECT DISTINCT slide_id, scene_index AS scene, CAST(x // 32 + 30 * scene_index AS BIGINT) AS x, CAST(y // 32 + 9 * scene_index AS BIGINT) AS y, CAST(8 AS BIGINT) AS w, CAST(6 AS BIGINT) AS h FROM v_scenes"
_ASKED = "SELECT request_id, slide_id, x // 16 AS x, y // 16 AS y, CAST(w // 16 AS BIGINT) AS w, CAST(h // 16 AS BIGINT) AS h FROM v_requests"
_SPREAD = "SELECT *, unnest(range(y, y + h)) AS py FROM (SELECT *, unnest(range(x, x + w)) AS px FROM ({}))"


@query(
    f"WITH b AS ({_SUBBLOCKS}), g AS (SELECT *, count(*) OVER (PARTITION BY slide_id) AS n FROM (SELECT slide_id, scene, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM b GROUP BY slide_id, scene)),"
    f" laid AS (SELECT slide_id, px, py, scene, 1 + x * 4096 + y AS seq, (x * 31 + y * 17 + scene * 7 + px * 3 + py) % 256 AS v FROM ({_SPREAD.format('SELECT * FROM b')}) UNION ALL SELECT slide_id, px, py, scene, 0, {_UNDER} FROM ({_SPREAD.format('SELECT * FROM g WHERE n > 1')})),"
    f" seen AS (SELECT slide_id, px, py, arg_max(v, scene * 4294967296 + seq) AS v FROM laid GROUP BY slide_id, px, py),"
    f" want AS (SELECT request_id, slide_id, px, py, px - x AS dx, py - y AS dy FROM ({_SPREAD.format(_ASKED)}))"
    f" SELECT request_id, count(*) AS pixels, CAST(sum(coalesce(v, {_UNDER})) AS BIGINT) AS total, CAST(sum(coalesce(v, {_UNDER}) * (1 + 3 * dx + dy)) AS BIGINT) AS placed FROM want LEFT JOIN seen USING (slide_id, px, py) GROUP BY request_id"
)
def scene_canvas(spark, sf_dir):
    """Regions of canvases of several scenes: sums, plain and by place, of what the scenes leave."""
    import numpy as np
    import pandas as pd

    whole = lambda c, n: F.floor(F.col(c) / n).cast("long")
    s = table(spark, sf_dir, "v_scenes")
    blocks = s.select("slide_id", F.col("scene_index").alias("scene"), (whole("x", 32) + 30 * F.col("scene_index")).alias("x2"), (whole("y", 32) + 9 * F.col("scene_index")).alias("y2"), F.lit(8).cast("long").alias("w2"), F.lit(6).cast("long").alias("h2")).distinct()
    laid = blocks.withColumn("seq", 1 + F.col("x2") * 4096 + F.col("y2")).unionByName(R.scene_grounds(blocks, ("slide_id",)).withColumn("seq", F.lit(0).cast("long")))
    asked = table(spark, sf_dir, "v_requests").select("request_id", "slide_id", *[whole(c, 16).alias(c) for c in "xywh"])
    met = R.rectangle_join(asked, laid, ("slide_id",), 32)

    def cut(batches):
        for b in batches:
            rows = []
            for t in b.itertuples():
                seq, x, y = t.scene * (1 << 32) + t.seq, t.x2 - t.x, t.y2 - t.y
                if t.seq == 0:
                    rows += V.grounds(t.request_id, x, y, seq, t.w2, t.h2, t.w, t.h, _CELL)
                    continue
                value = (t.x2 * 31 + t.y2 * 17 + t.scene * 7 + 3 * np.arange(t.x2, t.x2 + t.w2) + np.arange(t.y2, t.y2 + t.h2)[:, None]) % 256
                rows += V.crops(t.request_id, x, y, seq, np.repeat(value.astype(np.uint8)[:, :, None], 4, 2), t.w, t.h, _CELL)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in V.CROP.split(", ")])

    def sums(batches):
        for b in batches:
            rows = []
            for t in b.itertuples():
                v = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, 4)[:, :, 0].astype(np.int64)
                rows.append((t.request_id, v.size, v.sum(), (v * (1 + 3 * (t.left + np.arange(t.width)) + t.top + np.arange(t.height)[:, None])).sum()))
            yield pd.DataFrame(rows, columns=["request_id", "pixels", "total", "placed"])

    canvases = asked.selectExpr("request_id", "CAST(w AS INT) AS w", "CAST(h AS INT) AS h", "CAST(w AS INT) AS out_w", "CAST(h AS INT) AS out_h", f"array({_UNDER}, {_UNDER}, {_UNDER}, 255) AS background")
    per = V.painted(met.mapInPandas(cut, V.CROP), canvases, _CELL).mapInPandas(sums, "request_id long, pixels long, total long, placed long")
    return per.groupBy("request_id").agg(*[F.sum(c).alias(c) for c in ("pixels", "total", "placed")])
