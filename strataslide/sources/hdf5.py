"""A small HDF5 reader: groups, attributes, and datasets stored whole or in chunks (deflate, shuffle).

Reads files of the classic and of the second object-header format with version 1 chunk trees,
which is what common writers make by default; other layouts raise ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .blob import Blob

SIGNATURE = b"\x89HDF\r\n\x1a\n"
_NONE = 2**64 - 1


@dataclass
class Node:
    """A group (children) or a dataset (shape, dtype)."""

    path: str
    attributes: dict = field(default_factory=dict)
    children: dict[str, int] = field(default_factory=dict)
    shape: tuple[int, ...] | None = None
    dtype: np.dtype | None = None
    layout: tuple = ()
    filters: list[tuple[int, tuple]] = field(default_factory=list)


def _u(raw: bytes, at: int, n: int = 8) -> int:
    return int.from_bytes(raw[at : at + n], "little")


def _shape(raw: bytes) -> tuple[int, ...]:
    rank, at = raw[1], 8 if raw[0] == 1 else 4
    return tuple(_u(raw, at + 8 * k) for k in range(rank))


def _dtype(raw: bytes) -> np.dtype | str:
    kind, size = raw[0] & 15, _u(raw, 4, 4)
    order = ">" if raw[1] & 1 else "<"
    if kind == 0:
        return np.dtype(f"{order}{'i' if raw[1] & 8 else 'u'}{size}")
    if kind == 1:
        return np.dtype(f"{order}f{size}")
    if kind == 3:
        return np.dtype(f"S{size}")
    if kind == 9:
        return "vlen"
    if kind == 8:  # an enumeration: its base type
        return _dtype(raw[8:])
    raise ValueError(f"HDF5 type class {kind} is not read")


class File:
    def __init__(self, blob: Blob):
        self._b = blob
        head = blob.read(0, 96)
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        if head[8] in (0, 1):
            self._root = _u(head, 64 if head[8] == 0 else 68)
        elif head[8] in (2, 3):
            self._root = _u(head, 36)
        else:
            raise ValueError("unknown HDF5 superblock")

    def _messages(self, at: int) -> Iterator[tuple[int, bytes]]:
        head = self._b.read(at, 64)
        if head[:4] == b"OHDR":
            flags = head[5]
            pos = 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            runs = [(at + pos + width, _u(head, pos, width))]
            extra = 2 if flags & 4 else 0
            while runs:
                start, n = runs.pop(0)
                raw, k = self._b.read(start, n), 0
                while k + 4 + extra <= len(raw):
                    kind, size = raw[k], _u(raw, k + 1, 2)
                    data = raw[k + 4 + extra : k + 4 + extra + size]
                    k += 4 + extra + size
                    if kind == 0x10:
                        runs.append((_u(data, 0) + 4, _u(data, 8) - 8))
                    else:
                        yield kind, data
            return
        if head[0] != 1:
            raise ValueError("unknown HDF5 object header")
        left, runs = _u(head, 2, 2), [(at + 16, _u(head, 8, 4))]
        while runs and left > 0:
            start, n = runs.pop(0)
            raw, k = self._b.read(start, n), 0
            while k + 8 <= len(raw) and left > 0:
                kind, size = _u(raw, k, 2), _u(raw, k + 2, 2)
                data = raw[k + 8 : k + 8 + size]
                k += 8 + size
                left -= 1
                if kind == 0x10:
                    runs.append((_u(data, 0), _u(data, 8)))
                else:
                    yield kind, data

    def _members(self, tree: int, heap: int) -> Iterator[tuple[str, int]]:
        names = self._b.read(heap, 32)
        text = self._b.read(_u(names, 24), _u(names, 8))
        queue = [tree]
        while queue:
            at = queue.pop(0)
            head = self._b.read(at, 24)
            if head[:4] == b"TREE":
                raw = self._b.read(at + 24, 16 * _u(head, 6, 2) + 8)
                queue += [_u(raw, 16 * k + 8) for k in range(_u(head, 6, 2))]
            elif head[:4] == b"SNOD":
                n = _u(head, 6, 2)
                raw = self._b.read(at + 8, 40 * n)
                for k in range(n):
                    start = _u(raw, 40 * k)
                    yield text[start : text.index(b"\0", start)].decode("utf-8", "replace"), _u(raw, 40 * k + 8)

    def _text(self, raw: bytes, n: int) -> list[str]:
        """Strings of variable length, out of global heaps."""
        out = []
        for k in range(n):
            size, at, index = struct.unpack_from("<IQI", raw, 16 * k)
            heap = self._b.read(at, _u(self._b.read(at, 16), 8))
            pos = 16
            while pos + 16 <= len(heap) and _u(heap, pos, 2) != index:
                pos += 16 + -(-_u(heap, pos + 8) // 8) * 8
            out.append(heap[pos + 16 : pos + 16 + size].decode("utf-8", "replace"))
        return out

    def _attribute(self, raw: bytes) -> tuple[str, object]:
        version, n, t, s = raw[0], _u(raw, 2, 2), _u(raw, 4, 2), _u(raw, 6, 2)
        pad = (lambda v: -(-v // 8) * 8) if version == 1 else (lambda v: v)
        at = 9 if version == 3 else 8
        name = raw[at : at + n].rstrip(b"\0").decode("utf-8", "replace")
        at += pad(n)
        dtype = _dtype(raw[at : at + t])
        at += pad(t)
        shape = _shape(raw[at : at + s]) if s >= 4 else ()
        at += pad(s)
        n = int(np.prod(shape)) if shape else 1
        if isinstance(dtype, str):
            return name, self._text(raw[at:], n)
        values = np.frombuffer(raw, dtype, n, at)
        if dtype.kind == "S":
            return name, [v.decode("utf-8", "replace").strip("\0 ") for v in values.tolist()]
        return name, values.tolist()

    def node(self, at: int, path: str) -> Node:
        out = Node(path)
        for kind, raw in self._messages(at):
            if kind == 0x11:
                out.children |= dict(self._members(_u(raw, 0), _u(raw, 8)))
            elif kind == 0x06:  # a link of the second format: hard ones only
                flags, pos = raw[1], 2
                link = raw[pos] if flags & 8 else 0
                pos += (1 if flags & 8 else 0) + (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                width = 1 << (flags & 3)
                n = _u(raw, pos, width)
                if link == 0:
                    out.children[raw[pos + width : pos + width + n].decode("utf-8", "replace")] = _u(raw, pos + width + n)
            elif kind == 0x0C:
                try:
                    name, value = self._attribute(raw)
                    out.attributes[name] = value
                except ValueError:
                    continue  # an attribute of a type that is not read
            elif kind == 0x01:
                out.shape = _shape(raw)
            elif kind == 0x03:
                try:
                    dtype = _dtype(raw)
                    out.dtype = dtype if isinstance(dtype, np.dtype) else None
                except ValueError:
                    out.dtype = None
            elif kind == 0x08:
                if raw[0] != 3:
                    out.layout = ("unread",)
                elif raw[1] == 0:
                    out.layout = ("compact", raw[4 : 4 + _u(raw, 2, 2)])
                elif raw[1] == 1:
                    out.layout = ("whole", _u(raw, 2))
                else:
                    rank = raw[2]
                    out.layout = ("chunks", _u(raw, 3), tuple(_u(raw, 11 + 4 * k, 4) for k in range(rank - 1)))
            elif kind == 0x0B:
                n, pos = raw[1], 8 if raw[0] == 1 else 2
                for _ in range(n):
                    ident = _u(raw, pos, 2)
                    named = raw[0] == 1 or ident >= 256
                    length = _u(raw, pos + 2, 2) if named else 0
                    count = _u(raw, pos + (6 if named else 4), 2)
                    pos += (8 if named else 6) + (-(-length // 8) * 8 if raw[0] == 1 else length)
                    out.filters.append((ident, struct.unpack_from(f"<{count}I", raw, pos)))
                    pos += 4 * count + (4 if raw[0] == 1 and count % 2 else 0)
        return out

    def walk(self) -> Iterator[Node]:
        """Every group and dataset, by path."""
        queue = [("", self._root)]
        seen = set()
        while queue:
            path, at = queue.pop(0)
            if at in seen:
                continue
            seen.add(at)
            node = self.node(at, path)
            yield node
            queue += sorted((f"{path}/{k}".lstrip("/"), v) for k, v in node.children.items())

    def _chunks(self, at: int, rank: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
        head = self._b.read(at, 24)
        if head[:4] != b"TREE":
            return
        step = 8 + 8 * (rank + 1)
        raw = self._b.read(at + 24, (step + 8) * _u(head, 6, 2) + step)
        for k in range(_u(head, 6, 2)):
            key = k * (step + 8)
            child = _u(raw, key + step)
            if head[5]:
                yield from self._chunks(child, rank)
            else:
                yield tuple(_u(raw, key + 8 + 8 * d) for d in range(rank)), child, _u(raw, key, 4)

    def plane(self, node: Node, index: int | None) -> np.ndarray:
        """A 2-D dataset, or one channel of a 3-D one; only the chunks that hold it are read."""
        return self.region(node, index, 0, 0, node.shape[-1], node.shape[-2])

    def region(self, node: Node, index: int | None, x: int, y: int, w: int, h: int) -> np.ndarray:
        """The same for a rectangle that lies within the plane."""
        shape = node.shape
        box = [(y, y + h), (x, x + w)] if index is None else [(index, index + 1), (y, y + h), (x, x + w)]
        out = np.zeros([b - a for a, b in box], node.dtype)
        kind = node.layout[0] if node.layout else "unread"
        if kind in ("whole", "compact"):
            # whole rows from the first to the last of the rectangle lie in one run
            wide = node.dtype.itemsize
            skip = ((0 if index is None else index * shape[-2]) + y) * shape[-1] * wide
            size = h * shape[-1] * wide
            raw = node.layout[1][skip : skip + size] if kind == "compact" else self._b.read(node.layout[1] + skip, size) if node.layout[1] != _NONE else b""
            if len(raw) == size and size:
                out = np.frombuffer(raw, node.dtype).reshape(h, shape[-1])[:, x : x + w].reshape(out.shape)
        elif kind == "chunks":
            chunk = node.layout[2]
            for at, place, n in self._chunks(node.layout[1], len(shape)):
                cut = [(max(a, o), min(b, o + c)) for (a, b), o, c in zip(box, at, chunk, strict=True)]
                if any(a >= b for a, b in cut):
                    continue
                raw = self._b.read(place, n)
                for ident, values in reversed(node.filters):
                    if ident == 1:
                        raw = zlib.decompress(raw)
                    elif ident == 2:
                        raw = np.frombuffer(raw, np.uint8).reshape(values[0] if values else node.dtype.itemsize, -1).T.tobytes()
                    else:
                        raise ValueError(f"HDF5 filter {ident} is not read")
                part = np.frombuffer(raw, node.dtype, int(np.prod(chunk))).reshape(chunk)
                out[tuple(slice(a - s, b - s) for (a, b), (s, _) in zip(cut, box, strict=True))] = part[tuple(slice(a - o, b - o) for (a, b), o in zip(cut, at, strict=True))]
        else:
            raise ValueError("this HDF5 layout is not read")
        return out if index is None else out[0]


# The attributes that may hold marker names, in their order.
MARKERS = ("markers", "marker_names", "channel_names", "channels")


def multiplex_dataset(nodes: list[Node], strict_anndata: bool = False) -> tuple[Node, list[str]] | None:
    """The dataset of 3 dimensions and two channels or more whose marker attribute names every channel: fewest slashes, then the first name.

    strict_anndata: only the attribute `markers`, and no file that looks like AnnData.
    """
    if strict_anndata and ({"obs", "var"} <= {n.path for n in nodes} or any("encoding-type" in n.attributes for n in nodes[:1])):
        return None
    found = []
    for n in nodes:
        if n.shape is not None and len(n.shape) == 3 and n.shape[0] > 1 and n.dtype is not None:
            for key in MARKERS[:1] if strict_anndata else MARKERS:
                value = n.attributes.get(key)
                names = [v for v in (str(v).strip() for v in value or []) if v]
                if len(names) == n.shape[0]:
                    found.append((n.path.count("/"), n.path, n, names))
                    break
    return min(found, key=lambda x: x[:2])[2:] if found else None


def levels_of_ims(nodes: list[Node]) -> dict[int, dict[int, Node]]:
    """level -> channel -> dataset, of 'TimePoint 0' or else the first time point by name."""
    times: dict[int, dict[str, dict[int, Node]]] = {}
    for n in nodes:
        p = n.path.split("/")
        if len(p) == 5 and p[0] == "DataSet" and p[4] == "Data" and p[1].startswith("ResolutionLevel ") and p[2].startswith("TimePoint ") and p[3].startswith("Channel ") and p[1].split()[-1].isdigit() and p[3].split()[-1].isdigit():
            times.setdefault(int(p[1].split()[-1]), {}).setdefault(p[2], {})[int(p[3].split()[-1])] = n
    return {k: t.get("TimePoint 0", t[min(t)]) for k, t in sorted(times.items())}


def ims_names(nodes: list[Node], channels: list[int]) -> list[str]:
    """Channel names from DataSetInfo, made distinct: a further one gets ' (2)' and so on, stepping over names in use."""
    named = {}
    for n in nodes:
        p = n.path.split("/")
        if len(p) == 2 and p[0] == "DataSetInfo" and p[1].startswith("Channel ") and p[1].split()[-1].isdigit():
            value = n.attributes.get("Name", "")
            named[int(p[1].split()[-1])] = ("".join(value) if isinstance(value, list) else str(value)).strip("\0 ")
    wanted = [named.get(c) or f"Channel {c}" for c in channels]
    seen: set[str] = set()
    out = []
    for name in wanted:
        label, k = name, 2
        while label in seen or (label != name and label in wanted):
            label, k = f"{name} ({k})", k + 1
        seen.add(label)
        out.append(label)
    return out
