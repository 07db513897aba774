"""Spark data sources over containers: files dealt by size, reads by range, errors as rows.

Equality and membership of `path` and `level` are pushed into the sources: a file that is not
asked for is not opened. Spark still applies the filters to what comes back.

    register_sources(spark)
    spark.read.format("slide_tiles").option("data", "true").load("/slides")
    spark.read.format("slide_metadata").load("/slides")
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .blob import Blob, sized
from .containers import parse
from .planes import accepted, planes

TILES = "path string, format_id string, level int, z int, channel int, col int, row_no int, x0 long, y0 long, cov_w int, cov_h int, file_id int, offset long, length long, data binary"
PROBES = "path string, probes array<string>"
PLANES = "path string, channel_index int, name string, level int, height int, width int, dtype string, data binary"
METADATA = "path string, format_id string, width long, height long, level_count int, levels array<struct<width: long, height: long, downsample: double>>, mpp double, channels array<string>, properties map<string,string>, stored map<string,struct<offset: long, length: long>>, error struct<class: string, message: string>"


#: A partition takes files up to so many, or so many bytes together.
MOST_FILES, MOST_BYTES = 64, 1 << 30


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


def dealt(files: list[tuple[str, int]], data: bool) -> list[_Files]:
    """Runs of files; without their data a file counts as its index at most."""
    out: list[list[str]] = []
    held = 0
    for path, size in files:
        cost = size if data else min(size, MOST_BYTES // MOST_FILES)
        if not out or len(out[-1]) >= MOST_FILES or held + cost > MOST_BYTES:
            out.append([])
            held = 0
        out[-1].append(path)
        held += cost
    return [_Files(tuple(p)) for p in out]


def side_file(path: str, number: int) -> Blob | None:
    """<name>.DT<n> beside a file; None where it is missing, so its tiles have no bytes."""
    try:
        return Blob(f"{path.rpartition('.')[0]}.DT{number}")
    except OSError:
        return None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self._path = options.get("path") or ""
        self._with_data = str(options.get("data", "false")).lower() == "true"
        acquisition = options.get("acquisition_id")  # of MCD files; other options are not looked at
        self._acquisition = int(acquisition) if acquisition else None
        self._readers: dict[str, str] = json.loads(options.get("readers") or "{}")  # suffix -> module:function
        self._asked: dict[str, set] = {}  # of path and level, where only some are asked for

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("path",), ("level",)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                column = f.attribute[0]
                self._asked[column] = values & self._asked.get(column, values)
            yield f

    def _asks(self, column: str, value) -> bool:
        return column not in self._asked or value in self._asked[column]

    def partitions(self) -> list[_Files]:
        return dealt([(p, n) for p, n in sized(self._path) if self._asks("path", p)], self._with_data)

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self.file(path)


class _TilesReader(_Reader):
    def file(self, path: str) -> Iterator[tuple]:
        try:
            blob = Blob(path)
        except OSError:  # slide_metadata tells
            return
        try:
            found = parse(blob, self._with_data, readers=self._readers)
            aside: dict[int, Blob] = {0: blob}
            for k, t in enumerate(found.tiles.tolist()):
                if not self._asks("level", t[0]):
                    continue
                data = None
                if self._with_data:
                    if k in found.data:
                        data = found.data[k]
                    else:  # tiles of side files lie in <name>.DT<n>
                        if t[9] not in aside:
                            aside[t[9]] = side_file(path, t[9])
                        data = aside[t[9]].read(t[10], t[11]) if aside[t[9]] is not None else None
                yield (path, found.format_id, *t, data)
        except Exception:  # slide_metadata tells what is wrong with the file
            return
        finally:
            blob.close()


class _MetadataReader(_Reader):
    def file(self, path: str) -> Iterator[tuple]:
        try:
            blob = Blob(path)
            try:
                p = parse(blob, acquisition_id=self._acquisition, readers=self._readers)
            finally:
                blob.close()
            if p.format_id == "mds":
                p.properties |= side_properties(path)
            yield (path, p.format_id, p.width, p.height, len(p.levels), [(int(w), int(h), float(d)) for w, h, d in p.levels], p.mpp, p.channels, p.properties, {k: (int(a), int(n)) for k, (a, n) in p.stored.items()}, None)
        except Exception as e:  # one file's fault is that file's row
            yield (path, None, None, None, None, None, None, None, None, None, (type(e).__name__, str(e)))


def side_properties(path: str) -> dict[str, str]:
    """What the info.xml beside a slide tells; nothing where it is missing or no XML."""
    try:
        blob = Blob(f"{path.rpartition('/')[0]}/info.xml")
    except OSError:
        return {}
    try:
        text = blob.read(0, blob.size).decode("utf-8", "ignore").replace('encoding="unicode"', 'encoding="utf-8"')
        items = [dict(e.attrib) for e in ET.fromstring(text.encode()).findall("item")]
    except ET.ParseError:
        return {}
    finally:
        blob.close()
    named = ("rows", "cols", "objective", "create_time", "scan_machine")
    return {f"mds.{k}": v for item in items for k, v in item.items() if k in named}


class _ProbesReader(_Reader):
    def file(self, path: str) -> Iterator[tuple]:
        try:
            blob = Blob(path)
        except OSError:
            yield (path, [])
            return
        try:
            yield (path, accepted(blob))
        finally:
            blob.close()


class _PlanesReader(_Reader):
    def file(self, path: str) -> Iterator[tuple]:
        try:
            blob = Blob(path)
        except OSError:  # as above
            return
        try:
            for channel, name, level, plane in planes(blob, self._acquisition, lambda level: self._asks("level", level)):
                yield (path, channel, name, level, *plane.shape, plane.dtype.str, plane.tobytes())
        except Exception:  # as above
            return
        finally:
            blob.close()


class SlidePlanesSource(DataSource):
    """The planes of multiplex containers, a row a channel and level."""

    @classmethod
    def name(cls) -> str:
        return "slide_planes"

    def schema(self) -> str:
        return PLANES

    def reader(self, schema) -> DataSourceReader:
        return _PlanesReader(self.options)


class SlideProbesSource(DataSource):
    """A row a file: the formats whose probe accepts it."""

    @classmethod
    def name(cls) -> str:
        return "slide_probes"

    def schema(self) -> str:
        return PROBES

    def reader(self, schema) -> DataSourceReader:
        return _ProbesReader(self.options)


class SlideTilesSource(DataSource):
    """The tile index of each file; option data=true reads the tiles' bytes."""

    @classmethod
    def name(cls) -> str:
        return "slide_tiles"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> DataSourceReader:
        return _TilesReader(self.options)


class SlideMetadataSource(DataSource):
    """A row a file: dimensions, levels, resolution, properties, stored images, or the error."""

    @classmethod
    def name(cls) -> str:
        return "slide_metadata"

    def schema(self) -> str:
        return METADATA

    def reader(self, schema) -> DataSourceReader:
        return _MetadataReader(self.options)


def register_sources(spark: SparkSession) -> None:
    """Registers the sources; the session's filters then reach Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SlideTilesSource, SlideMetadataSource, SlidePlanesSource, SlideProbesSource):
        spark.dataSource.register(source)
