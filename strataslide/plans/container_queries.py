"""Containers written from table rows, a file a slide, and read back by the data sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..api import SlideSet
from ..sinks import containers as W
from ..sinks import write_blobs
from ..sinks.shared import scratch
from ..sources import register_sources
from .registry import query, table


def _files(spark, rows, suffix: str, order: list[str], make: Callable, name: tuple[str, ...] = ("slide_id",)) -> str:
    """make(rows of equal name in order) is the file <name>.<suffix>, e.g. <slide_id>.<suffix>; the folder of all. A task holds one file's rows."""
    import pandas as pd

    root = scratch(spark, f"containers-{suffix}")

    def each(slide: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{'_'.join(str(slide[c].iloc[0]) for c in name)}.{suffix}"], "data": [make(slide.sort_values(order, kind="stable"))]})

    made = rows.groupBy(*name).applyInPandas(each, "name string, data binary")
    write_blobs(made, root, "name")
    register_sources(spark)
    return root.removeprefix("file:")


def _slide():
    """The slide that a file is of."""
    return F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("slide_id")


_TILES = "SELECT slide_id, level, col, row_no, data_offset + 1 AS place, n_records AS length FROM v_tiles"


def _tiles(spark, sf_dir, suffix: str, make: Callable, only: str = "true"):
    rows = table(spark, sf_dir, "v_tiles").filter(only).select("slide_id", "level", "col", "row_no", (F.col("data_offset") + 1).alias("offset"), F.col("n_records").alias("length"))
    root = _files(spark, rows, suffix, ["level", "row_no", "col"], lambda s: make([tuple(map(int, t)) for t in s[["level", "col", "row_no", "offset", "length"]].itertuples(index=False)]))
    return spark.read.format("slide_tiles").load(root).withColumn("slide_id", _slide())


@query(f"SELECT slide_id, level, col, row_no, CAST(col * 256 * (1 << level) AS BIGINT) AS x0, CAST(row_no * 256 * (1 << level) AS BIGINT) AS y0, 256 * (1 << level) AS cov, place, length FROM ({_TILES})")
def tmap07_tiles(spark, sf_dir):
    return _tiles(spark, sf_dir, "tmap", W.tmap07).select("slide_id", "level", "col", "row_no", "x0", "y0", F.col("cov_w").alias("cov"), F.col("offset").alias("place"), "length")


@query(f"SELECT slide_id, level, col, row_no, CAST(col * 1280 AS BIGINT) AS x0, CAST(row_no * 1280 AS BIGINT) AS y0, length FROM ({_TILES})")
def dyj_tiles(spark, sf_dir):
    return _tiles(spark, sf_dir, "dyj", W.dyj).select("slide_id", "level", "col", "row_no", "x0", "y0", "length")


@query(f"SELECT slide_id, level, col, row_no, CAST((col - min(col) OVER w) * 256 * (1 << level) AS BIGINT) AS x0, CAST((row_no - min(row_no) OVER w) * 256 * (1 << level) AS BIGINT) AS y0, place, length FROM ({_TILES}) WINDOW w AS (PARTITION BY slide_id, level)")
def zyp_tiles(spark, sf_dir):
    return _tiles(spark, sf_dir, "zyp", W.zyp).select("slide_id", "level", "col", "row_no", "x0", "y0", F.col("offset").alias("place"), "length")


@query(f"SELECT slide_id, CAST(level - min(level) OVER (PARTITION BY slide_id) AS INTEGER) AS level, col, row_no, length FROM ({_TILES})")
def tron_tiles(spark, sf_dir):
    return _tiles(spark, sf_dir, "tron", W.tron).select("slide_id", "level", "col", "row_no", "length")


@query(f"SELECT slide_id, level, col, row_no, CAST(col * 256 AS BIGINT) AS x0, CAST(row_no * 256 AS BIGINT) AS y0, place, length FROM ({_TILES}) WHERE level = 0")
def mdsx_tiles(spark, sf_dir):
    return _tiles(spark, sf_dir, "mdsx", W.mdsx, "level = 0").select("slide_id", "level", "col", "row_no", "x0", "y0", F.col("offset").alias("place"), "length")


_NAMED = "SELECT p.slide_id, CAST(row_number() OVER (PARTITION BY p.slide_id ORDER BY p.channel_index) - 1 AS INTEGER) AS channel, c.name || ' ' || c.channel_index AS name, p.px FROM v_planes p JOIN v_channels c ON p.channel_index = c.channel_index"
_SUMS = "round(list_sum(list_transform(range(64), lambda i: (i + 1) * CAST(px[i + 1] AS DOUBLE))), 3)"


#: Channels of a slide go into files of so many, the last up to twice as many; by index, in runs of so many to be numbered.
_MOST_CHANNELS, _RUN = 256, 1 << 16


def _numbered(channels):
    """channels (slide_id, channel_index) with `first`, the number within its slide of the first channel of its file."""
    runs = channels.withColumn("run", F.floor(F.col("channel_index") / _RUN))
    before = Window.partitionBy("slide_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counted = runs.groupBy("slide_id", "run").agg(F.count("*").alias("n"))
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("slide_id")))
    place = F.row_number().over(Window.partitionBy("slide_id", "run").orderBy("channel_index")) - 1
    at = runs.withColumn("place", place).join(counted.drop("n"), ["slide_id", "run"])
    last = F.greatest(F.floor(F.col("all") / _MOST_CHANNELS) - 1, F.lit(0))
    return at.withColumn("first", (F.least(F.floor((F.col("place") + F.col("before")) / _MOST_CHANNELS), last) * _MOST_CHANNELS).cast("long")).drop("run", "place", "before", "all")


def _planes(spark, sf_dir, suffix: str, make: Callable):
    """Planes of 8 x 8 numbers; make(names, planes). A slide's channels are in files <slide_id>_<first>, so a file and what its reader holds stay small however many the slide has."""
    import numpy as np

    names = table(spark, sf_dir, "v_channels").select("channel_index", F.concat_ws(" ", "name", F.col("channel_index").cast("string")).alias("name"))
    rows = _numbered(table(spark, sf_dir, "v_planes").join(names, "channel_index").select("slide_id", "channel_index", "name", "px"))
    return _files(spark, rows, suffix, ["channel_index"], lambda s: make(s["name"].tolist(), [np.array(p, np.float32).reshape(8, 8) for p in s["px"]]), ("slide_id", "first"))


def _part(place: int, kind: str):
    """Of a path <slide_id>_<first>.<suffix> the slide (1) or the number of its first channel (2)."""
    return F.regexp_extract("path", r"(-?\d+)_(\d+)\.\w+$", place).cast(kind)


def _summed(spark, root: str, names: bool = True):
    """Per slide and channel the sum of the plane's numbers times their places."""
    import numpy as np
    import pandas as pd

    def each(batches):
        for b in batches:
            flat = [np.frombuffer(d, t).astype(float) for d, t in zip(b["data"], b["dtype"], strict=True)]
            yield pd.DataFrame({"slide_id": b["slide_id"], "channel": b["channel"], "name": b["name"], "total": [round(float((f * np.arange(1, len(f) + 1)).sum()), 3) for f in flat]})

    found = spark.read.format("slide_planes").load(root)
    found = found.select(_part(1, "long").alias("slide_id"), (F.col("channel_index") + _part(2, "int")).alias("channel"), "name", "dtype", "data")
    return found.mapInPandas(each, "slide_id long, channel int, name string, total double").select("slide_id", "channel", *(["name"] if names else []), "total")


def _ome(names, planes) -> bytes:
    return W.tiff_pages([(p, W.ome(names) if k == 0 else "", "", "") for k, p in enumerate(planes)], compress=True)


@query(f"SELECT CAST(slide_id AS BIGINT) AS slide_id, channel, name, {_SUMS} AS total FROM ({_NAMED})")
def ome_tiff_planes(spark, sf_dir):
    return _summed(spark, _planes(spark, sf_dir, "tif", _ome))


@query(f"SELECT CAST(slide_id AS BIGINT) AS slide_id, channel, name, {_SUMS} AS total FROM ({_NAMED})")
def named_page_planes(spark, sf_dir):
    return _summed(spark, _planes(spark, sf_dir, "tiff", lambda names, planes: W.tiff_pages([(p, "", n, "Fluidigm MCD Viewer") for n, p in zip(names, planes, strict=True)])))


def _qptiff(names, planes) -> bytes:
    page = "<PerkinElmer-QPI-ImageDescription><ImageType>{}</ImageType><Biomarker>{}</Biomarker></PerkinElmer-QPI-ImageDescription>"
    return W.tiff_pages([(p, page.format("FullResolution", n), "", "") for n, p in zip(names, planes, strict=True)])


@query(f"SELECT CAST(slide_id AS BIGINT) AS slide_id, channel, name, {_SUMS} AS total FROM ({_NAMED})")
def qptiff_planes(spark, sf_dir):
    return _summed(spark, _planes(spark, sf_dir, "qptiff", _qptiff))


@query(f"SELECT CAST(slide_id AS BIGINT) AS slide_id, channel, name, {_SUMS} AS total FROM ({_NAMED})")
def mcd_planes(spark, sf_dir):
    return _summed(spark, _planes(spark, sf_dir, "mcd", lambda names, planes: W.mcd({1: {f"Ir({k})": (n, p) for k, (n, p) in enumerate(zip(names, planes, strict=True))}})))


def _czi(names, planes) -> bytes:
    import numpy as np

    return W.czi([np.floor(abs(p) * 1000).astype(np.uint16) for p in planes], "<ImageDocument/>", tile=5)


@query(f"SELECT CAST(slide_id AS BIGINT) AS slide_id, channel, CAST(list_sum(list_transform(range(64), lambda i: (i + 1) * floor(CAST(abs(px[i + 1]) * CAST(1000 AS FLOAT) AS FLOAT)))) AS DOUBLE) AS total FROM ({_NAMED})")
def czi_planes(spark, sf_dir):
    return _summed(spark, _planes(spark, sf_dir, "czi", _czi), names=False)


_RECT = "SELECT *, (channel % 9) AS x, (channel % 7) AS y, least(channel % 9 + 4, 8) AS x1, least(channel % 7 + 3, 8) AS y1 FROM (" + _NAMED + ")"
_CUT = f"SELECT slide_id, channel, CASE WHEN x < 8 THEN list_transform(range((y1 - y) * (x1 - x)), lambda i: CAST(px[(y + i // (x1 - x)) * 8 + x + i % (x1 - x) + 1] AS DOUBLE)) ELSE list_transform(range(12), lambda i: CAST(0 AS DOUBLE)) END AS v, CASE WHEN x < 8 THEN x1 - x ELSE 4 END AS w, CASE WHEN x < 8 THEN y1 - y ELSE 3 END AS h FROM ({_RECT})"


@query(f"SELECT CAST(slide_id AS BIGINT) AS slide_id, channel, CAST(w AS INTEGER) AS w, CAST(h AS INTEGER) AS h, CAST(list_sum(list_transform(range(len(v)), lambda i: (i + 1) * CASE WHEN list_max(v) > list_min(v) THEN floor((v[i + 1] - list_min(v)) / (list_max(v) - list_min(v)) * 255) ELSE 0 END)) AS BIGINT) AS total FROM ({_CUT})")
def biomarker_regions(spark, sf_dir):
    """A rectangle of every channel, cut at the sides or outside, stretched to 8 bits."""
    import numpy as np
    import pandas as pd

    slides = SlideSet(spark, _planes(spark, sf_dir, "tif", _ome))
    c = F.col("channel_index")
    asked = slides.channels().withColumn("channel_index", c + _part(2, "int")).select((F.xxhash64("path", "channel_index")).alias("request_id"), "path", "channel_index", F.col("name").alias("biomarker"), (c % 9).cast("long").alias("x"), (c % 7).cast("long").alias("y"), F.lit(0).alias("level"), F.lit(4).alias("w"), F.lit(3).alias("h"))
    read = slides.read_biomarker_region(asked.drop("channel_index")).filter("error is null").select("request_id", "width", "height", "data")

    def each(batches):
        for b in batches:
            grey = [np.frombuffer(d, np.uint8).reshape(-1, 4)[:, 0].astype(np.int64) for d in b["data"]]
            yield pd.DataFrame({"request_id": b["request_id"], "w": b["width"], "h": b["height"], "total": [int((g * np.arange(1, len(g) + 1)).sum()) for g in grey]})

    found = read.mapInPandas(each, "request_id long, w int, h int, total long")
    return found.join(asked.select("request_id", _part(1, "long").alias("slide_id"), F.col("channel_index").alias("channel")), "request_id").select("slide_id", "channel", "w", "h", "total")
