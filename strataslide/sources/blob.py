"""Random access to a file of any file system, and records read by declared layouts."""

from __future__ import annotations

import numpy as np
from pyarrow import fs


#: A folder of a writer's own; what lies in one of that name is no slide.
HIDDEN = ".strataslide"


class Blob:
    """read(offset, n) on a path or on bytes."""

    def __init__(self, source: str | bytes):
        self.name = source if isinstance(source, str) else ""
        if isinstance(source, bytes):
            self._data, self.size = source, len(source)
        else:
            where, path = file_system(source)
            self._data = None
            self._file = where.open_input_file(path)
            self.size = self._file.size()

    def read(self, offset: int, n: int) -> bytes:
        if offset < 0 or n <= 0:
            return b""
        if self._data is not None:
            return self._data[offset : offset + n]
        self._file.seek(min(offset, self.size))
        return self._file.read(n)

    def records(self, offset: int, layout: np.dtype, n: int = 1) -> np.ndarray:
        """n records of a layout; fewer where the file ends."""
        raw = self.read(offset, layout.itemsize * n)
        return np.frombuffer(raw, layout, len(raw) // layout.itemsize)

    def record(self, offset: int, layout: np.dtype) -> np.void:
        found = self.records(offset, layout)
        if not len(found):
            raise ValueError(f"the file ends before offset {offset}")
        return found[0]

    def close(self) -> None:
        if self._data is None:
            self._file.close()


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sized(path: str) -> list[tuple[str, int]]:
    """The files of a folder (all below it), or the path itself, with their sizes."""
    where, at = file_system(path)
    here = where.get_file_info(at)
    if here.type != fs.FileType.Directory:
        return [(path, here.size or 0)]
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((head + f.path, f.size or 0) for f in where.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f"/{HIDDEN}/" not in f.path)
