"""Region requests against stored tiles: cell ranges, point and rectangle joins, overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level_coordinate(x: Column, downsample: Column) -> Column:
    """Level-0 pixel to level pixel, truncated toward zero."""
    return (x / downsample).cast("long")


def cell(at: Column, size) -> Column:
    """Tile index of a pixel; floors, so negatives go down."""
    return F.floor(at / size).cast("long")


def cell_range(requests: DataFrame, tile_w, tile_h, x: str = "x", y: str = "y") -> DataFrame:
    """col0, row0, col1, row1: the first and last grid cells that a request touches."""
    return (
        requests.withColumn("col0", cell(F.col(x), tile_w)).withColumn("row0", cell(F.col(y), tile_h))
        .withColumn("col1", cell(F.col(x) + F.col("w") - 1, tile_w)).withColumn("row1", cell(F.col(y) + F.col("h") - 1, tile_h))
    )


def cells(ranged: DataFrame) -> DataFrame:
    """A row for each cell of a cell range."""
    return ranged.withColumn("col", F.explode(F.sequence("col0", "col1"))).withColumn("row_no", F.explode(F.sequence("row0", "row1")))


def tile_lookup(requests: DataFrame, tiles: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Every cell of every request with its stored tile; cells without one keep nulls (background)."""
    asked = cells(cell_range(requests, tile_w, tile_h))
    return asked.join(tiles, ["slide_id", "level", "col", "row_no"], "left")


def overlaps(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column], strict: bool = True) -> Column:
    """Rectangles (x, y, w, h) overlap; strict leaves out touching edges."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    if strict:
        return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)
    return (ax <= bx + bw) & (bx <= ax + aw) & (ay <= by + bh) & (by <= ay + ah)


def intersection(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """struct x, y, w, h of the common rectangle; null if it is empty."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    x, y = F.greatest(ax, bx), F.greatest(ay, by)
    w, h = F.least(ax + aw, bx + bw) - x, F.least(ay + ah, by + bh) - y
    return F.when((w > 0) & (h > 0), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), w.cast("long").alias("w"), h.cast("long").alias("h")))


def rectangle_join(left: DataFrame, right: DataFrame, keys: tuple[str, ...], cell_size: int = 512) -> DataFrame:
    """Pairs of overlapping rectangles (x, y, w, h; right's are named x2, y2, w2, h2) with equal keys.

    Both sides are dealt to grid cells and joined on (keys, cell): a slide with most of the
    rectangles spreads over its cells, and only rectangles that share a cell are compared. A
    pair that shares several cells is kept in the one that holds the corner of its
    intersection, so no second shuffle is needed to drop doubles.
    """

    def dealt(df: DataFrame, x: str, y: str, w: str, h: str) -> DataFrame:
        out = df.filter((F.col(w) > 0) & (F.col(h) > 0))
        for name, at, n in (("cell_x", x, w), ("cell_y", y, h)):
            out = out.withColumn(name, F.explode(F.sequence(cell(F.col(at), cell_size), cell(F.col(at) + F.col(n) - 1, cell_size))))
        return out

    a, b = dealt(left, "x", "y", "w", "h"), dealt(right, "x2", "y2", "w2", "h2")
    pairs = a.join(b, [*keys, "cell_x", "cell_y"])
    both = overlaps(tuple(map(F.col, "xywh")), tuple(F.col(f"{c}2") for c in "xywh"))
    corner = (cell(F.greatest("x", "x2"), cell_size) == F.col("cell_x")) & (cell(F.greatest("y", "y2"), cell_size) == F.col("cell_y"))
    return pairs.filter(both & corner).drop("cell_x", "cell_y")


def scene_grounds(tiles: DataFrame, keys: tuple[str, ...], scene: str = "scene") -> DataFrame:
    """keys, scene and the rectangle (x2, y2, w2, h2) that bounds a scene's tiles, of slides with several scenes.

    On a canvas of several scenes each is laid down whole, so what is empty in a later one
    covers an earlier one: its rectangle is painted before its tiles. A request thus meets
    scenes and tiles in one join of rectangles, in the order (scene, ground, tiles). Bounds are
    aggregated before anything moves, and only they are counted a slide.
    """
    x1, y1 = F.max(F.col("x2") + F.col("w2")), F.max(F.col("y2") + F.col("h2"))
    x0, y0 = F.min("x2"), F.min("y2")
    bounds = tiles.groupBy(*keys, scene).agg(x0.alias("x2"), y0.alias("y2"), (x1 - x0).alias("w2"), (y1 - y0).alias("h2"))
    several = bounds.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return bounds.join(several, list(keys), "left_semi")


def sub_tiles(blocks: DataFrame, tile_w: int = 612, tile_h: int = 512, per_side: int = 4) -> DataFrame:
    """The per_side x per_side sub-tiles of each block, with their level-0 origin."""
    out = blocks.withColumn("sub_col", F.explode(F.sequence(F.lit(0), F.lit(per_side - 1)))).withColumn("sub_row", F.explode(F.sequence(F.lit(0), F.lit(per_side - 1))))
    return out.withColumn("x", (F.col("col") * per_side + F.col("sub_col")).cast("long") * tile_w).withColumn("y", (F.col("row_no") * per_side + F.col("sub_row")).cast("long") * tile_h)


def overlay(pastes: DataFrame, keys: tuple[str, ...], value: str, order: tuple[str, ...]) -> DataFrame:
    """The value that the last paste leaves at each key; order is total within a key."""
    return pastes.groupBy(*keys).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def compose(pastes: DataFrame, requests: DataFrame, background: tuple[int, ...] | str = (255, 255, 255, 0)) -> DataFrame:
    """Requests (request_id, w, h) as rasters: request_id, height, width, n_channels, mode, data.

    pastes: request_id, dst_x, dst_y, draw_seq and a tile raster (height, width, data of
    RGBA). A request's tiles are pasted in draw order, without blending, on the background
    and cut to the canvas; background is a colour, or a column of requests with one each. A
    task holds one canvas; its size is the request's.
    """
    import numpy as np
    import pandas as pd

    def paint(key: tuple, canvases: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        out = []
        for w, h, color in zip(canvases["w"], canvases["h"], canvases["background"], strict=True):
            image = np.empty((h, w, 4), np.uint8)
            image[:] = color
            for t in tiles.sort_values("draw_seq", kind="stable").itertuples():
                part = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, 4)
                x0, y0, x1, y1 = max(0, t.dst_x), max(0, t.dst_y), min(w, t.dst_x + t.width), min(h, t.dst_y + t.height)
                if x0 < x1 and y0 < y1:
                    image[y0:y1, x0:x1] = part[y0 - t.dst_y : y1 - t.dst_y, x0 - t.dst_x : x1 - t.dst_x]
            out.append((key[0], h, w, 4, "RGBA", image.tobytes()))
        return pd.DataFrame(out, columns=["request_id", "height", "width", "n_channels", "mode", "data"])

    held = pastes.select("request_id", "dst_x", "dst_y", "draw_seq", "height", "width", "data")
    color = F.col(background) if isinstance(background, str) else F.array(*map(F.lit, background))
    asked = requests.select("request_id", "w", "h", color.alias("background"))
    return asked.groupBy("request_id").cogroup(held.groupBy("request_id")).applyInPandas(paint, "request_id long, height int, width int, n_channels int, mode string, data binary")
