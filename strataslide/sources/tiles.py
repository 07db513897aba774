"""Bytes or pixels of single tiles and stored images, read by range from the files that hold them."""

from __future__ import annotations

import zlib

import numpy as np

from ..functions.raster import shown
from . import czi
from .blob import Blob
from .containers import ibl_data, parse, sqlite_of
from .datasource import side_file
from .tiff import place_in_page, tiff_pages, tiff_region, whole_jpeg


class TileReader:
    """One file at a time: what is asked for should come file by file, in the order of its places."""

    def __init__(self):
        self._path: str | None = None
        self._close: list = []

    def _open(self, path: str, format_id: str) -> None:
        self.close()
        self._path, self._blob, self._aside, self._con, self._held = path, Blob(path), {}, None, None
        self._close.append(self._blob.close)
        self._pages: list[dict] | None = None
        if format_id == "ibl":
            self._con = sqlite_of(self._blob)
            self._close.append(self._con.close)
        elif self._blob.read(0, 4) == b"\xd0\xcf\x11\xe0":  # streams are no ranges
            p = parse(self._blob)
            self._held = {(int(t["level"]), int(t["row_no"]), int(t["col"])): p.data[k] for k, t in enumerate(p.tiles)}

    def read(self, path: str, format_id: str, level: int, row_no: int, col: int, file_id: int, offset: int, length: int) -> bytes | None:
        if path != self._path:
            self._open(path, format_id)
        if self._con is not None:
            return ibl_data(self._con, level, offset)
        if self._held is not None:
            return self._held.get((level, row_no, col))
        if file_id:
            if file_id not in self._aside:
                self._aside[file_id] = side_file(path, file_id)
                if self._aside[file_id] is not None:
                    self._close.append(self._aside[file_id].close)
            blob = self._aside[file_id]
            return None if blob is None else blob.read(offset, length)
        return self._blob.read(offset, length)

    def image(self, path: str, format_id: str, level: int, row_no: int, col: int, file_id: int, offset: int, length: int) -> np.ndarray | bytes | None:
        """A tile as RGBA where its container holds plain, deflated or Zstandard pixels; else the bytes for a decoder."""
        if path != self._path:
            self._open(path, format_id)
        if format_id == "czi":
            try:
                found = czi.picture(self._blob, czi.block_at(self._blob, offset))
                return found if isinstance(found, bytes) else shown(found)
            except ValueError:  # of a kind that is not read
                return None
        if self._con is None and self._held is None and not file_id and self._tiff(offset) is not None:
            page, k = self._tiff(offset)
            packing = page.get(259, (1,))[0]
            if packing == 7:
                return whole_jpeg(page, self._blob.read(offset, length))
            try:
                found = tiff_region(self._blob, page, *place_in_page(page, k))
                return shown(~found if page.get(262, (1,))[0] == 0 else found)  # where zero is white
            except (ValueError, zlib.error):  # not pixels of this page's type
                pass
        return self.read(path, format_id, level, row_no, col, file_id, offset, length)

    def _tiff(self, offset: int) -> tuple[dict, int] | None:
        """The page and the number in it of the tile or strip at offset; None in files that are no TIFF."""
        if self._pages is None:
            self._pages = tiff_pages(self._blob) if self._blob.read(0, 4) in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+") else []
            starts = [np.asarray(p.get(324, p.get(273, ())), np.int64) for p in self._pages]
            held = np.concatenate([[], *starts]).astype(np.int64)
            of = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
            at = np.concatenate([[], *[np.arange(len(s)) for s in starts]]).astype(np.int64)
            order = np.argsort(held, kind="stable")
            self._starts, self._of, self._at = held[order], of[order], at[order]
        k = np.searchsorted(self._starts, offset)
        return (self._pages[self._of[k]], int(self._at[k])) if k < len(self._starts) and self._starts[k] == offset else None

    def close(self) -> None:
        for f in self._close:
            f()
        self._path, self._close = None, []
