"""Pyramid levels: dimensions, downsamples, best level, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _long(c: Column) -> Column:
    return c.cast("long")


def with_levels(slides: DataFrame, count: str = "level_count") -> DataFrame:
    """A row for each level of each slide."""
    return slides.withColumn("level", F.explode(F.sequence(F.lit(0), F.col(count) - 1)))


def dimension(size: Column, step: Column, level: Column, rule: str) -> Column:
    """A level's size under a rule: floor_clamped (at least 1), floor, or ceil (the iterated ceiling in closed form)."""
    factor = _long(F.pow(step, level))
    if rule == "ceil":
        return _long(F.floor((size + factor - 1) / factor))
    down = _long(F.floor(size / factor))
    return F.greatest(down, F.lit(1).cast("long")) if rule == "floor_clamped" else down


def grid_dimensions(tiles: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Levels as the extent of their tile grid times the tile size."""
    per = tiles.groupBy("slide_id", "level").agg((F.max("col") + 1).alias("cols"), (F.max("row_no") + 1).alias("rows"))
    return per.select("slide_id", "level", "cols", "rows", _long(F.col("cols") * tile_w).alias("width"), _long(F.col("rows") * tile_h).alias("height"))


def padded_dimension(size: Column, padding: Column) -> Column:
    return F.greatest(size - padding, F.lit(0).cast("long"))


def _by_level(keys: tuple[str, ...] = ("slide_id",)):
    return Window.partitionBy(*keys).orderBy("level")


def downsample_by_width(levels: DataFrame) -> DataFrame:
    """downsample = base width / width; 1 where a width is not positive."""
    base = F.first("width").over(_by_level())
    return levels.withColumn("downsample", F.when(F.col("width") > 0, base / F.col("width")).otherwise(1.0))


def downsample_by_larger_side(levels: DataFrame) -> DataFrame:
    w, h = F.first("width").over(_by_level()), F.first("height").over(_by_level())
    return levels.withColumn("downsample", F.greatest(w / F.col("width"), h / F.col("height")))


def downsample_by_step(step: Column, level: Column) -> Column:
    return F.pow(step, level)


def downsample_by_scale(scales: DataFrame) -> DataFrame:
    """downsample = first scale / scale, levels by falling scale."""
    w = Window.partitionBy("slide_id").orderBy(F.col("scale").desc())
    return scales.withColumn("level", F.row_number().over(w) - 1).withColumn("downsample", F.first("scale").over(w) / F.col("scale"))


def direct_and_monotone(levels: DataFrame, raw: str) -> DataFrame:
    """Inverse factors (0 < d <= 1 above level 0) are turned round, d <= 0 is infinite; then the running greatest."""
    d = F.col(raw)
    direct = F.when(d <= 0, F.lit(float("inf"))).when((d <= 1) & (F.col("level") > 0), 1 / d).otherwise(d)
    return levels.withColumn("direct", direct).withColumn("downsample", F.max("direct").over(_by_level().rowsBetween(Window.unboundedPreceding, 0)))


def level_array(levels: DataFrame, keys: tuple[str, ...] = ("slide_id",)) -> DataFrame:
    """A slide's downsamples in level order as one array: what the as-of rules below read."""
    return levels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "downsample"))), lambda x: x["downsample"]).alias("downsamples"))


def best_level(downsamples: Column, target: Column, rule: str = "floor") -> Column:
    """The pyramid level for a downsample.

    floor: the level before the first (from 1 on) that exceeds the target, else the last; 0
    if the target is below level 0. prev: the level before the first that reaches the target
    (equality moves up), at least 0, else the last. single: 0.
    """
    if rule == "single":
        return F.lit(0)
    last = F.size(downsamples) - 1
    if rule == "floor":
        hits = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: (i <= last) & (F.get(downsamples, i) > target))
        return F.when(target < F.get(downsamples, F.lit(0)), 0).otherwise(F.coalesce(F.array_min(hits) - 1, last)).cast("int")
    if rule == "prev":
        hits = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(downsamples, i) >= target)
        first = F.array_min(hits)
        return F.when(first.isNull(), last).otherwise(F.greatest(first - 1, F.lit(0))).cast("int")
    raise ValueError(f"no rule {rule}")


def mpp(x: Column, y: Column) -> Column:
    """Mean of the two resolutions, else the first."""
    return F.coalesce((x + y) / 2, x)


def magnification(objective: Column, resolution: Column) -> Column:
    return F.coalesce(objective, F.when(resolution > 0, 10 / resolution))


def objective_power(resolution: Column) -> Column:
    """The truncated magnification as text."""
    return (10 / resolution).cast("int").cast("string")


def thumbnail_level(widths: Column, heights: Column, tw: Column, th: Column) -> Column:
    """The first level at most twice the thumbnail on both sides, else 0."""
    fits = F.filter(F.sequence(F.lit(0), F.size(widths) - 1), lambda i: (F.get(widths, i) <= 2 * tw) & (F.get(heights, i) <= 2 * th))
    return F.coalesce(F.array_min(fits), F.lit(0)).cast("int")


def prefix_level(downsamples: Column, most: Column) -> Column:
    """The last level before the first whose downsample exceeds most, at least 0."""
    hits = F.filter(F.sequence(F.lit(0), F.size(downsamples) - 1), lambda i: F.get(downsamples, i) > most)
    return F.greatest(F.lit(0), F.coalesce(F.array_min(hits), F.size(downsamples)) - 1).cast("int")
