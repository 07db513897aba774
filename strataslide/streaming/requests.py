"""Region requests that arrive as files, joined with the stored tile index.

The reference index is static, so the join keeps no state; only the counts do, and their
watermark bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.region import tile_lookup

SCHEMA = "request_id long, slide_id long, ts timestamp, x long, y long, level int, w int, h int"


def requests_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of requests as they land."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tiles_for_requests(requests: DataFrame, tiles: DataFrame, tile_w: int = 256, tile_h: int = 256) -> DataFrame:
    """Each cell of each request with its stored tile, or null."""
    return tile_lookup(requests, tiles, tile_w, tile_h)


def request_counts(requests: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests of each slide in windows of time; rows later than the watermark are left out."""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", every), "slide_id").agg(F.count("*").alias("n"))
