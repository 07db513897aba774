"""Levels, downsamples, best level, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels as L
from .registry import query, table


def _leveled(spark, sf_dir):
    return L.with_levels(table(spark, sf_dir, "v_slides"))


_LEVELS = "SELECT slide_id, width AS base_w, height AS base_h, step, level_count, CAST(unnest(range(level_count)) AS INTEGER) AS level FROM v_slides"
_DIMS = f"SELECT slide_id, level, level_count, step, greatest(1, base_w // CAST(pow(step, level) AS BIGINT)) AS width, greatest(1, base_h // CAST(pow(step, level) AS BIGINT)) AS height FROM ({_LEVELS})"


def _dims(spark, sf_dir, rule="floor_clamped"):
    d = _leveled(spark, sf_dir)
    step, level = F.col("step"), F.col("level")
    return d.withColumn("width", L.dimension(F.col("width"), step, level, rule)).withColumn("height", L.dimension(F.col("height"), step, level, rule))


@query(f"SELECT slide_id, level, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height FROM ({_DIMS})")
def levels_floor(spark, sf_dir):
    return _dims(spark, sf_dir).select("slide_id", "level", "width", "height")


@query(f"SELECT slide_id, level, base_w // CAST(pow(step, level) AS BIGINT) AS width, base_h // CAST(pow(step, level) AS BIGINT) AS height FROM ({_LEVELS})")
def levels_floor_unclamped(spark, sf_dir):
    return _dims(spark, sf_dir, "floor").select("slide_id", "level", "width", "height")


@query(f"SELECT slide_id, level, CAST(ceil(base_w / pow(step, level)) AS BIGINT) AS width, CAST(ceil(base_h / pow(step, level)) AS BIGINT) AS height FROM ({_LEVELS})")
def levels_ceil(spark, sf_dir):
    return _dims(spark, sf_dir, "ceil").select("slide_id", "level", "width", "height")


@query("SELECT slide_id, level, max(col) + 1 AS cols, max(row_no) + 1 AS rows, CAST((max(col) + 1) * 256 AS BIGINT) AS width, CAST((max(row_no) + 1) * 256 AS BIGINT) AS height FROM v_tiles GROUP BY slide_id, level")
def levels_grid(spark, sf_dir):
    return L.grid_dimensions(table(spark, sf_dir, "v_tiles"), 256, 256)


@query("SELECT slide_id, greatest(width - slide_id % 300, 0) AS width, greatest(height - slide_id % 700, 0) AS height FROM v_slides")
def levels_padded(spark, sf_dir):
    return table(spark, sf_dir, "v_slides").select("slide_id", L.padded_dimension(F.col("width"), F.col("slide_id") % 300).alias("width"), L.padded_dimension(F.col("height"), F.col("slide_id") % 700).alias("height"))


@query(f"SELECT slide_id, level, round(first_value(width) OVER (PARTITION BY slide_id ORDER BY level) / width, 9) AS downsample FROM ({_DIMS})")
def downsample_width(spark, sf_dir):
    return L.downsample_by_width(_dims(spark, sf_dir)).select("slide_id", "level", F.round("downsample", 9).alias("downsample"))


@query(f"SELECT slide_id, level, round(greatest(first_value(width) OVER w / width, first_value(height) OVER w / height), 9) AS downsample FROM ({_DIMS}) WINDOW w AS (PARTITION BY slide_id ORDER BY level)")
def downsample_max(spark, sf_dir):
    return L.downsample_by_larger_side(_dims(spark, sf_dir)).select("slide_id", "level", F.round("downsample", 9).alias("downsample"))


@query(f"SELECT slide_id, level, pow(step, level) AS downsample FROM ({_LEVELS})")
def downsample_step(spark, sf_dir):
    return _leveled(spark, sf_dir).select("slide_id", "level", L.downsample_by_step(F.col("step"), F.col("level")).alias("downsample"))


_SCALES = "SELECT DISTINCT l_partkey AS slide_id, CAST(l_quantity AS DOUBLE) AS scale FROM lineitem"


@query(f"SELECT slide_id, CAST(row_number() OVER w - 1 AS INTEGER) AS level, scale, round(first_value(scale) OVER w / scale, 9) AS downsample FROM ({_SCALES}) WINDOW w AS (PARTITION BY slide_id ORDER BY scale DESC)")
def downsample_scale(spark, sf_dir):
    scales = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("slide_id"), F.col("l_quantity").cast("double").alias("scale")).distinct()
    return L.downsample_by_scale(scales).select("slide_id", "level", "scale", F.round("downsample", 9).alias("downsample"))


_RAW = f"SELECT slide_id, level, CASE WHEN slide_id % 3 = 0 AND level > 0 THEN 1 / pow(step, level) WHEN (slide_id + level) % 7 = 0 THEN pow(step, level) / 3 ELSE pow(step, level) END AS raw FROM ({_LEVELS})"


@query(f"SELECT slide_id, level, round(max(CASE WHEN raw <= 0 THEN CAST('inf' AS DOUBLE) WHEN raw <= 1 AND level > 0 THEN 1 / raw ELSE raw END) OVER (PARTITION BY slide_id ORDER BY level ROWS UNBOUNDED PRECEDING), 9) AS downsample FROM ({_RAW})")
def downsample_inverse_monotone(spark, sf_dir):
    ds = F.pow("step", "level")
    raw = F.when((F.col("slide_id") % 3 == 0) & (F.col("level") > 0), 1 / ds).when((F.col("slide_id") + F.col("level")) % 7 == 0, ds / 3).otherwise(ds)
    return L.direct_and_monotone(_leveled(spark, sf_dir).withColumn("raw", raw), "raw").select("slide_id", "level", F.round("downsample", 9).alias("downsample"))


_AS_OF = f"SELECT r.request_id, r.target_downsample AS t, l.level, l.level_count, pow(l.step, l.level) AS ds FROM v_requests r JOIN ({_LEVELS}) l ON r.slide_id = l.slide_id"


def _asked(spark, sf_dir, rule):
    levels = _leveled(spark, sf_dir).withColumn("downsample", F.pow("step", "level"))
    asked = table(spark, sf_dir, "v_requests").join(L.level_array(levels), "slide_id")
    return asked.select("request_id", L.best_level(F.col("downsamples"), F.col("target_downsample"), rule).alias("best_level"))


@query(f"SELECT request_id, CAST(CASE WHEN any_value(t) < min(ds) FILTER (WHERE level = 0) THEN 0 ELSE coalesce(min(level) FILTER (WHERE level >= 1 AND ds > t) - 1, any_value(level_count) - 1) END AS INTEGER) AS best_level FROM ({_AS_OF}) GROUP BY request_id")
def best_level_floor(spark, sf_dir):
    return _asked(spark, sf_dir, "floor")


@query(f"SELECT request_id, CAST(CASE WHEN min(level) FILTER (WHERE ds >= t) IS NULL THEN any_value(level_count) - 1 ELSE greatest(0, min(level) FILTER (WHERE ds >= t) - 1) END AS INTEGER) AS best_level FROM ({_AS_OF}) GROUP BY request_id")
def best_level_prev(spark, sf_dir):
    return _asked(spark, sf_dir, "prev")


_MPP = "SELECT p_partkey AS slide_id, CASE WHEN p_size % 5 > 0 THEN p_retailprice / 4000 END AS mx, CASE WHEN p_size % 3 > 0 THEN p_retailprice / 3900 END AS my, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS objective FROM part"


def _mpp(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("slide_id"), F.when(F.col("p_size") % 5 > 0, F.col("p_retailprice") / 4000).alias("mx"), F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice") / 3900).alias("my"), F.when(F.col("p_size") % 4 == 0, F.col("p_size").cast("double")).alias("objective"))


@query(f"SELECT slide_id, round(coalesce((mx + my) / 2, mx), 9) AS mpp FROM ({_MPP})")
def mpp_coalesce(spark, sf_dir):
    return _mpp(spark, sf_dir).select("slide_id", F.round(L.mpp(F.col("mx"), F.col("my")), 9).alias("mpp"))


@query(f"SELECT slide_id, round(coalesce(objective, 10 / mx), 9) AS magnification FROM ({_MPP})")
def magnification(spark, sf_dir):
    return _mpp(spark, sf_dir).select("slide_id", F.round(L.magnification(F.col("objective"), F.col("mx")), 9).alias("magnification"))


@query(f"SELECT slide_id, CAST(CAST(trunc(10 / mx) AS INTEGER) AS VARCHAR) AS objective_power FROM ({_MPP})")
def objective_power(spark, sf_dir):
    return _mpp(spark, sf_dir).select("slide_id", L.objective_power(F.col("mx")).alias("objective_power"))


@query(f"SELECT slide_id, CAST(coalesce(min(level) FILTER (WHERE width <= 2 * 500 AND height <= 2 * 500), 0) AS INTEGER) AS thumbnail_level FROM ({_DIMS}) GROUP BY slide_id")
def thumbnail_level(spark, sf_dir):
    per = _dims(spark, sf_dir).groupBy("slide_id").agg(F.array_sort(F.collect_list(F.struct("level", "width", "height"))).alias("l"))
    return per.select("slide_id", L.thumbnail_level(F.col("l.width"), F.col("l.height"), F.lit(500), F.lit(500)).alias("thumbnail_level"))
