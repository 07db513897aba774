"""Aggregates and ordered rules over containers' indexes and metadata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layer_extent(tiles: DataFrame) -> DataFrame:
    """Per slide and level: least and greatest column and row, number of tiles."""
    return tiles.groupBy("slide_id", "level").agg(F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.min("row_no").alias("min_row"), F.max("row_no").alias("max_row"), F.count("*").alias("n_tiles"))


def last_wins(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """One row a key: the greatest value of order, and how many rows there were."""
    return rows.groupBy(*keys).agg(F.max(order).cast("long").alias(order), F.count("*").alias("n_records"))


def bounding_box(scenes: DataFrame, keys: tuple[str, ...] = ("slide_id", "scene_index")) -> DataFrame:
    x1, y1 = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    return scenes.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), x1.alias("x1"), y1.alias("y1"))


def rebased(scenes: DataFrame) -> DataFrame:
    """Scenes moved so that a slide's least x and y are 0."""
    origin = scenes.groupBy("slide_id").agg(F.min("x").alias("ox"), F.min("y").alias("oy"))
    return scenes.join(origin, "slide_id").withColumn("x", F.col("x") - F.col("ox")).withColumn("y", F.col("y") - F.col("oy")).drop("ox", "oy")


def unified_extent(tiles: DataFrame, tile_size: int) -> DataFrame:
    """Extent over all levels of tiles at pixel origins x, y."""
    return tiles.groupBy("slide_id").agg((F.max("x") + tile_size).alias("width"), (F.max("y") + tile_size).alias("height"))


def roi_offset(tiles: DataFrame, levels: DataFrame) -> DataFrame:
    """A level's least tile x and y; levels without tiles take level 0's divided by 2**level."""
    per = tiles.groupBy("slide_id", "level").agg(F.min("x").alias("lx"), F.min("y").alias("ly"))
    base = tiles.filter("level = 0").groupBy("slide_id").agg(F.min("x").alias("bx"), F.min("y").alias("by"))
    down = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0)) / F.pow(F.lit(2), F.col("level"))).cast("long")
    out = levels.join(per, ["slide_id", "level"], "left").join(base, "slide_id", "left")
    return out.select("slide_id", "level", F.coalesce("lx", down("bx")).alias("roi_x"), F.coalesce("ly", down("by")).alias("roi_y"))


def level_count(max_level: Column, stated: Column) -> Column:
    return F.greatest(max_level + 1, F.coalesce(stated, F.lit(0)))


def last_level(levels: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key's last level, and the level."""
    return levels.groupBy(key).agg(F.max_by(value, "level").alias(value), F.max("level").alias("level"))


def first_match(rows: DataFrame, key: str, wanted: Column, order: str, value: str) -> DataFrame:
    """Per key the value of the first row that is wanted; null where none is."""
    return rows.groupBy(key).agg(F.min_by(F.when(wanted, F.col(value)), F.when(wanted, F.col(order))).alias(value))


def first_stated(*sources: Column) -> Column:
    """A field of the first source that states it."""
    return F.coalesce(*sources)


def present(offset: Column, length: Column) -> Column:
    """A tile that is stored."""
    return (offset > 0) & (length > 0)


def inconsistent_levels(rows: DataFrame) -> DataFrame:
    """Levels whose channels have more than one size."""
    return rows.groupBy("slide_id", "level").agg(F.count_distinct(F.struct("width", "height")).alias("sizes")).filter("sizes > 1")


def votes(records: DataFrame, keys: tuple[str, ...], valid: Column, least: int = 3) -> DataFrame:
    """Candidates of which at least `least` records are valid."""
    return records.groupBy(*keys).agg(F.count_if(valid).alias("n_valid")).withColumn("accepted", F.col("n_valid") >= least)


def until_invalid(records: DataFrame, key: str, order: str, valid: Column) -> DataFrame:
    """Records before a key's first invalid one. The first bad place is aggregated and joined, so a long index is not one task's."""
    bad = records.filter(~valid).groupBy(key).agg(F.min(order).alias("first_bad"))
    return records.join(bad, key, "left").filter(F.col("first_bad").isNull() | (F.col(order) < F.col("first_bad"))).drop("first_bad")


def largest(rows: DataFrame, key: str, area: Column, tie: Column, value: str) -> DataFrame:
    """Per key the value of the greatest area; ties go to the greatest tie."""
    return rows.groupBy(key).agg(F.max_by(F.col(value), F.struct(area, tie)).alias(value))


def best_dataset(datasets: DataFrame, key: str, path: str) -> DataFrame:
    """The dataset of fewest slashes, then the first name."""
    depth = F.length(path) - F.length(F.replace(F.col(path), F.lit("/")))
    return datasets.groupBy(key).agg(F.min_by(F.col(path), F.struct(depth, F.col(path))).alias("best"))


def preferred_time_point(names: DataFrame, key: str, name: str) -> DataFrame:
    """'TimePoint 0', else the first time point by name."""
    return names.groupBy(key).agg(F.min_by(F.col(name), F.struct(F.col(name) != "TimePoint 0", F.col(name))).alias("time_point"))


def token_pairs(tokens: DataFrame, key: str, order: str, token: str, step: int = 2) -> DataFrame:
    """Runs of `step` tokens, from every step-th: tok0, tok1, …"""
    w = Window.partitionBy(key).orderBy(order)
    out = tokens.withColumn("place", F.row_number().over(w) - 1).withColumn("tok0", F.col(token))
    for k in range(1, step):
        out = out.withColumn(f"tok{k}", F.lead(token, k).over(w))
    return out.filter((F.col("place") % step == 0) & F.col(f"tok{step - 1}").isNotNull()).select(key, "place", *[f"tok{k}" for k in range(step)])


def associated_images(images: DataFrame, slides: DataFrame) -> DataFrame:
    """Stored images, and a thumbnail to be made for brightfield slides that store none."""
    made = slides.filter("slide_family = 'brightfield'").select("slide_id").join(images.filter("name = 'thumbnail'").select("slide_id"), "slide_id", "left_anti")
    return images.select("slide_id", "name", F.lit(False).alias("made")).unionByName(made.select("slide_id", F.lit("thumbnail").alias("name"), F.lit(True).alias("made")))


def match_scenes(scenes: DataFrame, images: DataFrame, near: int = 512) -> DataFrame:
    """Scenes take, in order, the first unused image whose sides differ by at most `near`. Greedy, so one slide at a time.

    scenes: slide_id, scene_index, w, h; images: slide_id, image_index, iw, ih. A slide has a
    few dozen of either.
    """

    def take(key: tuple, s: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        free = list(i.sort_values("image_index")[["image_index", "iw", "ih"]].itertuples(index=False))
        out = []
        for scene in s.sort_values("scene_index").itertuples():
            hit = next((x for x in free if abs(x.iw - scene.w) <= near and abs(x.ih - scene.h) <= near), None)
            if hit is not None:
                free.remove(hit)
            out.append((key[0], scene.scene_index, None if hit is None else int(hit.image_index)))
        return pd.DataFrame(out, columns=["slide_id", "scene_index", "image_index"]).astype({"image_index": "Int64"})

    return scenes.groupBy("slide_id").cogroup(images.groupBy("slide_id")).applyInPandas(take, "slide_id long, scene_index int, image_index long")


def greedy_entries(tokens: DataFrame, key: str, order: str, token: str, marks: tuple[str, str] = ("StartPosition", "DataLength")) -> DataFrame:
    """Entries 'name, StartPosition, p, DataLength, l' of a token stream, consumed greedily: key, name, position, length.

    For files whose values may equal the marks or be names of what follows. Whether an entry
    may begin at a token is told by the four that come after it; an entry is taken unless one
    before it took its first token. Entries five tokens apart don't touch, so the stream falls
    into chains of entries that overlap, and only a chain is folded in order. order is total
    within a key; numbers are longs, with a sign or without.
    """
    w = Window.partitionBy(key).orderBy(order)
    ahead = lambda k: F.lead(token, k).over(w)
    number = lambda c: F.when(F.col(c).rlike(r"\A-?[0-9]+\z"), F.col(c).try_cast("long"))
    rows = tokens.select(key, F.col(token).alias("name"), (F.row_number().over(w) - 1).cast("long").alias("at"), *[ahead(k).alias(f"t{k}") for k in range(1, 5)])
    starts = rows.filter((F.col("t1") == marks[0]) & (F.col("t3") == marks[1])).withColumn("position", number("t2")).withColumn("length", number("t4")).filter("position is not null and length is not null")
    near = Window.partitionBy(key).orderBy("at")
    chain = F.sum(F.when(F.col("at") - F.lag("at").over(near) < 5, 0).otherwise(1)).over(near)
    chains = starts.withColumn("chain", chain).groupBy(key, "chain").agg(F.array_sort(F.collect_list(F.struct("at", "name", "position", "length"))).alias("entries"))
    first = lambda: F.slice("entries", 1, 1)
    take = lambda taken, e: F.when(e["at"] >= F.element_at(taken, -1)["at"] + 5, F.concat(taken, F.array(e))).otherwise(taken)
    return chains.select(key, F.explode(F.aggregate("entries", first(), take)).alias("e")).select(key, "e.name", "e.position", "e.length")
