"""One file a row, all of a job or none: a Spark data source writes them.

Tasks write below <root>/.strataslide/<job>, which no reader of slides looks into. Once every
task is done, the driver moves the files to their names, as committers of Hadoop do, and
leaves a manifest (name, bytes) there, which is what the functions return. A job that fails
leaves no file that can be seen, nor does a repeated task; of one name the last row wins. A
name may have folders.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.raster import png
from ..operators.deepzoom import descriptor
from ..sources.blob import HIDDEN, file_system

_MOVERS = 16


@dataclass
class _Written(WriterCommitMessage):
    attempt: str
    files: list[tuple[str, int]]


class _Files(DataSourceWriter):
    def __init__(self, options: dict):
        self._root, self._job = options["path"], options["job"]

    def _top(self):
        where, top = file_system(self._root)
        return where, top, f"{top}/{HIDDEN}/{self._job}"

    def write(self, iterator: Iterator) -> _Written:
        where, _, staging = self._top()
        attempt = uuid.uuid4().hex
        where.create_dir(f"{staging}/{attempt}", recursive=True)
        files = []
        for row in iterator:
            data = bytes(row["data"])
            with where.open_output_stream(f"{staging}/{attempt}/{len(files)}", compression=None) as f:
                f.write(data)
            files.append((row["name"], len(data)))
        return _Written(attempt, files)

    def commit(self, messages: list[_Written | None]) -> None:
        where, top, staging = self._top()
        found = {name: (f"{staging}/{m.attempt}/{k}", n) for m in messages if m is not None for k, (name, n) in enumerate(m.files)}
        for folder in sorted({f"{top}/{name}".rpartition("/")[0] for name in found}):
            where.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(_MOVERS) as movers:
            list(movers.map(lambda item: where.move(item[1][0], f"{top}/{item[0]}"), found.items()))
        where.create_dir(f"{top}/{HIDDEN}", recursive=True)
        told = pa.table({"name": pa.array(found, pa.string()), "bytes": pa.array([n for _, n in found.values()], pa.int64())})
        with where.open_output_stream(f"{staging}.parquet", compression=None) as f:
            pq.write_table(told, f)
        self._clear(where, staging)

    def abort(self, messages: list[_Written | None]) -> None:
        where, _, staging = self._top()
        self._clear(where, staging)

    @staticmethod
    def _clear(where, staging: str) -> None:
        try:
            where.delete_dir(staging)
        except OSError:  # no task wrote
            pass


class SlideFilesSink(DataSource):
    """Rows (name, data) as files; options path and job."""

    @classmethod
    def name(cls) -> str:
        return "slide_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Files(self.options)


def _write(rows: DataFrame, root: str, content: Callable) -> DataFrame:
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):  # a file at a time: rasters are large
                yield pd.DataFrame({"name": [row.name], "data": [content(row)]})

    spark, job = rows.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(SlideFilesSink)
    rows.mapInPandas(each, "name string, data binary").write.format("slide_files").option("job", job).mode("append").save(root)
    return spark.read.parquet(f"{root if '://' in root or root.startswith('file:') else f'file:{os.path.abspath(root)}'}/{HIDDEN}/{job}.parquet")


def write_png(rasters: DataFrame, root: str, name: str) -> DataFrame:
    """rasters: height, width, n_channels, data; name: an expression for each file's name."""
    rows = rasters.select(F.expr(name).alias("name"), "height", "width", "n_channels", "data")
    return _write(rows, root, lambda r: png(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.n_channels)))


def write_blobs(images: DataFrame, root: str, name: str, data: str = "data") -> DataFrame:
    """Bytes as they are, e.g. a label image."""
    return _write(images.select(F.expr(name).alias("name"), F.col(data).alias("data")), root, lambda r: bytes(r.data))


def write_descriptors(slides: DataFrame, root: str, tile_size: int = 254, overlap: int = 1, image_format: str = "jpeg") -> DataFrame:
    """<slide_id>.dzi of each slide."""
    rows = slides.select(F.concat(F.col("slide_id").cast("string"), F.lit(".dzi")).alias("name"), descriptor(F.col("width"), F.col("height"), tile_size, overlap, image_format).alias("text"))
    return _write(rows, root, lambda r: r.text.encode())
