"""TIFF: tags of pages, and rectangles of their pixels (uncompressed or deflated)."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .blob import Blob

#: Key of a page's byte order among its tags.
ORDER = -1
_TIFF_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("s", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}


def tiff_pages(blob: Blob) -> list[dict[int, tuple | bytes]]:
    """Tags of every page of a classic or big TIFF."""
    head = blob.read(0, 16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
    pages, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(order + ("Q" if big else "H"), blob.read(at, 8 if big else 2))[0]
        first, size, inline = at + (8 if big else 2), 20 if big else 12, 8 if big else 4
        raw = blob.read(first, n * size)
        page: dict[int, tuple | bytes] = {ORDER: order}
        for k in range(n):
            e = raw[k * size : (k + 1) * size]
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + ("Q" if big else "I"), e[4 : 12 if big else 8])[0]
            if kind not in _TIFF_TYPES:
                continue
            code, width = _TIFF_TYPES[kind]
            value = e[-inline:]
            if count * width > inline:
                value = blob.read(struct.unpack(order + ("Q" if big else "I"), value)[0], count * width)
            value = value[: count * width]
            page[tag] = value.rstrip(b"\0") if code == "s" else struct.unpack(order + code * count, value)
        pages.append(page)
        at = struct.unpack(order + ("Q" if big else "I"), blob.read(first + n * size, 8 if big else 4))[0]
    return pages


def text(page: dict, tag: int) -> str:
    """A tag of text, or of bytes that hold text."""
    value = page.get(tag, b"")
    if not isinstance(value, bytes):
        value = bytes(value) if all(isinstance(v, int) and 0 <= v < 256 for v in value) else b""
    return value.decode("utf-8", "ignore")


def samples(page: dict) -> tuple[np.dtype, int, bool]:
    """Type of a sample, samples of a pixel, and whether each sample is a plane of its own."""
    bits, kind, order = page.get(258, (1,))[0], page.get(339, (1,))[0], page.get(ORDER, "<")
    if bits not in (8, 16, 32, 64):
        raise ValueError(f"TIFF samples of {bits} bits are not read")
    return np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}.get(kind, 'u') }{bits // 8}"), page.get(277, (1,))[0], page.get(284, (1,))[0] == 2


def tiff_region(blob: Blob, page: dict, x: int, y: int, w: int, h: int) -> np.ndarray:
    """h x w x samples from (x, y), which lies within the page; only the tiles or strips that hold it are read."""
    width, height = page[256][0], page[257][0]
    dtype, c, apart = samples(page)
    packing, predictor = page.get(259, (1,))[0], page.get(317, (1,))[0]
    if packing not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError("this kind of TIFF is not read")
    tiled = 324 in page
    tw, th = (page[322][0], page[323][0]) if tiled else (width, min(height, page.get(278, (height,))[0]))
    offsets, lengths = (page[324], page[325]) if tiled else (page[273], page[279])
    across, down = -(-width // tw), -(-height // th)
    out = np.zeros((h, w, c), dtype)
    inner = 1 if apart else c
    for plane in range(c if apart else 1):
        for row in range(y // th, -(-(y + h) // th)):
            for col in range(x // tw, -(-(x + w) // tw)):
                k = (plane * down + row) * across + col
                if k >= len(offsets) or not lengths[k]:
                    continue  # a sparse tile is empty
                raw = blob.read(int(offsets[k]), int(lengths[k]))
                raw = zlib.decompress(raw) if packing != 1 else raw
                rows = th if tiled else min(th, height - row * th)
                part = np.frombuffer(raw, dtype, tw * rows * inner).reshape(rows, tw, inner)
                if predictor == 2:
                    part = np.cumsum(part, axis=1, dtype=dtype)
                x0, y0, x1, y1 = max(x, col * tw), max(y, row * th), min(x + w, col * tw + tw), min(y + h, row * th + rows)
                out[y0 - y : y1 - y, x0 - x : x1 - x, plane if apart else slice(None)] = part[y0 - row * th : y1 - row * th, x0 - col * tw : x1 - col * tw, 0 if apart else slice(None)]
    return out


def place_in_page(page: dict, k: int) -> tuple[int, int, int, int]:
    """x, y, w, h of a page's k-th tile or strip, cut at the page's sides."""
    width, height = page[256][0], page[257][0]
    tw, th = (page[322][0], page[323][0]) if 324 in page else (width, min(height, page.get(278, (height,))[0]))
    row, col = divmod(k, -(-width // tw))
    return col * tw, row * th, min(tw, width - col * tw), min(th, height - row * th)


def whole_jpeg(page: dict, data: bytes) -> bytes:
    """A tile's JPEG with the tables that its page holds for all tiles."""
    tables = page.get(347, b"")
    return tables[:-2] + data[2:] if isinstance(tables, bytes) and tables[-2:] == b"\xff\xd9" and data[:2] == b"\xff\xd8" else data


def tiff_page_pixels(blob: Blob, page: dict) -> np.ndarray:
    """A whole page as height x width x samples."""
    return tiff_region(blob, page, 0, 0, page[256][0], page[257][0])
