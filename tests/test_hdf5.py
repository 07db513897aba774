"""HDF5 files laid out by hand: symbol-table groups, attributes, whole and chunked datasets."""

import struct
import zlib

import numpy as np
import pytest

from strataslide.sources import hdf5, register_sources
from strataslide.sources.blob import Blob
from strataslide.sources.containers import multiplex as parse_hdf5

NONE = 2**64 - 1


class Maker:
    def __init__(self):
        self.out = bytearray(96)

    def put(self, raw: bytes) -> int:
        self.out += bytes(-len(self.out) % 8)
        at = len(self.out)
        self.out += raw
        return at

    @staticmethod
    def dtype(d: np.dtype) -> bytes:
        if d.kind == "S":
            return struct.pack("<BBBBI", 0x13, 0, 0, 0, d.itemsize)
        if d.kind == "f":
            return struct.pack("<BBBBI", 0x11, 0x20, d.itemsize * 8 - 1, 0, d.itemsize) + struct.pack("<HHBBBBI", 0, d.itemsize * 8, 23, 8, 0, 23, 127)
        return struct.pack("<BBBBIHH", 0x10, 8 if d.kind == "i" else 0, 0, 0, d.itemsize, 0, d.itemsize * 8)

    @staticmethod
    def space(shape) -> bytes:
        return struct.pack("<BBB5x", 1, len(shape), 0) + struct.pack(f"<{len(shape)}Q", *shape)

    def attribute(self, name: str, values) -> bytes:
        a = np.array([v.encode() for v in values]) if isinstance(values[0], str) else np.array(values)
        pad = lambda b: b + bytes(-len(b) % 8)
        n, t, s = name.encode() + b"\0", self.dtype(a.dtype), self.space(a.shape)
        return struct.pack("<BBHHH", 1, 0, len(n), len(t), len(s)) + pad(n) + pad(t) + pad(s) + a.tobytes()

    def text_attribute(self, name: str, values: list[str]) -> bytes:
        """Strings of variable length in a global heap."""
        body = b"".join(struct.pack("<HHIQ", k + 1, 0, 0, len(v)) + v.encode() + bytes(-len(v) % 8) for k, v in enumerate(values))
        heap = self.put(b"GCOL" + struct.pack("<BxxxQ", 1, 16 + len(body)) + body)
        pad = lambda b: b + bytes(-len(b) % 8)
        n, t, s = name.encode() + b"\0", struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + self.dtype(np.dtype("S1")), self.space((len(values),))
        return struct.pack("<BBHHH", 1, 0, len(n), len(t), len(s)) + pad(n) + pad(t) + pad(s) + b"".join(struct.pack("<IQI", len(v), heap, k + 1) for k, v in enumerate(values))

    def header(self, messages) -> int:
        body = b""
        for kind, raw in messages:
            raw += bytes(-len(raw) % 8)
            body += struct.pack("<HHBxxx", kind, len(raw), 0) + raw
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def dataset(self, a: np.ndarray, attributes=(), chunk=None, shuffle=False) -> int:
        if chunk is None:
            layout, more = struct.pack("<BBQQ", 3, 1, self.put(a.tobytes()), a.nbytes), []
        else:
            keys = []
            for at in np.ndindex(*[-(-n // c) for n, c in zip(a.shape, chunk, strict=True)]):
                start = [k * c for k, c in zip(at, chunk, strict=True)]
                full = np.zeros(chunk, a.dtype)
                part = a[tuple(slice(s, s + c) for s, c in zip(start, chunk, strict=True))]
                full[tuple(slice(0, n) for n in part.shape)] = part
                raw = full.tobytes()
                if shuffle:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
                raw = zlib.compress(raw)
                keys.append((start, self.put(raw), len(raw)))
            tree = b"TREE" + struct.pack("<BBHQQ", 1, 0, len(keys), NONE, NONE)
            for start, at, n in keys:
                tree += struct.pack("<II", n, 0) + struct.pack(f"<{len(start) + 1}Q", *start, 0) + struct.pack("<Q", at)
            tree += bytes(8 + 8 * (a.ndim + 1))
            layout = struct.pack("<BBBQ", 3, 2, a.ndim + 1, self.put(tree)) + struct.pack(f"<{a.ndim + 1}I", *chunk, a.dtype.itemsize)
            filters = [(2, (a.dtype.itemsize,))] if shuffle else []
            filters += [(1, (6,))]
            more = [(0x0B, struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHH", i, 0, 0, len(v)) + struct.pack(f"<{len(v)}I", *v) + bytes(4 * (len(v) % 2)) for i, v in filters))]
        return self.header([(0x01, self.space(a.shape)), (0x03, self.dtype(a.dtype)), (0x08, layout), *more, *((0x0C, raw) for raw in attributes)])

    def group(self, children: dict[str, int], attributes=()) -> int:
        names, starts = bytearray(8), {}
        for n in sorted(children):
            starts[n] = len(names)
            names += n.encode() + b"\0" + bytes(-(len(n) + 1) % 8)
        heap = self.put(b"HEAP" + struct.pack("<BxxxQQQ", 0, len(names), NONE, self.put(bytes(names))))
        snod = self.put(b"SNOD" + struct.pack("<BxH", 1, len(children)) + b"".join(struct.pack("<QQII16x", starts[n], children[n], 0, 0) for n in sorted(children)))
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NONE, NONE) + struct.pack("<QQQ", 0, snod, 0))
        return self.header([(0x11, struct.pack("<QQ", tree, heap)), *((0x0C, raw) for raw in attributes)])

    def file(self, root: int) -> bytes:
        self.out[:96] = hdf5.SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<QQQQ", 0, NONE, len(self.out), NONE) + struct.pack("<QQII16x", 0, root, 0, 0)
        return bytes(self.out)


PLANES = np.arange(3 * 10 * 14, dtype="<u2").reshape(3, 10, 14)


def make_hdf5(chunk=None, shuffle=False, text=False):
    m = Maker()
    names = m.text_attribute("markers", ["DAPI", "CD3 ", "CD8"]) if text else m.attribute("channel_names", ["DAPI", "CD3", "CD8"])
    deep = m.dataset(PLANES, [names], chunk, shuffle)
    other = m.dataset(np.zeros((4, 4), "<f4"))
    return m.file(m.group({"layers": m.group({"raw": deep}), "flat": other, "obs": m.group({}), "var": m.group({})}))


def make_ims():
    m = Maker()
    level = lambda a, c: m.group({"TimePoint 0": m.group({f"Channel {k}": m.group({"Data": m.dataset(a[k][None], chunk=c)}) for k in range(2)})})
    names = m.group({f"Channel {k}": m.group({}, [m.attribute("Name", list("DNA"))]) for k in range(2)})
    tree = m.group({"ResolutionLevel 0": level(PLANES, (1, 4, 5)), "ResolutionLevel 1": level(PLANES[:, ::2, ::2], (1, 4, 5))})
    return m.file(m.group({"DataSet": tree, "DataSetInfo": names}))


@pytest.mark.parametrize("options", [{}, {"chunk": (1, 4, 5)}, {"chunk": (2, 10, 3), "shuffle": True}, {"text": True}])
def test_planes(options):
    file = hdf5.File(Blob(make_hdf5(**options)))
    nodes = list(file.walk())
    node, names = hdf5.multiplex_dataset(nodes)
    assert node.path == "layers/raw" and names == ["DAPI", "CD3", "CD8"]
    for k in range(3):
        assert (file.plane(node, k) == PLANES[k]).all()
    assert hdf5.multiplex_dataset(nodes, strict_anndata=True) is None
    p = parse_hdf5(Blob(make_hdf5(**options)))
    assert (p.format_id, p.width, p.height, p.channels) == ("hdf5", 14, 10, names)


def test_sources(spark, tmp_path):
    (tmp_path / "a.h5").write_bytes(make_hdf5(chunk=(1, 4, 5)))
    (tmp_path / "b.ims").write_bytes(make_ims())
    (tmp_path / "c.h5").write_bytes(hdf5.SIGNATURE + bytes(200))
    register_sources(spark)
    meta = {r["path"][-4:]: r for r in spark.read.format("slide_metadata").load(str(tmp_path)).collect()}
    assert meta["c.h5"]["error"] is not None and meta["a.h5"]["channels"] == ["DAPI", "CD3", "CD8"]
    ims = next(r for r in meta.values() if r["format_id"] == "ims")
    assert ims["channels"] == ["DNA", "DNA (2)"] and [tuple(x) for x in ims["levels"]] == [(14, 10, 1.0), (7, 5, 2.0)]
    rows = spark.read.format("slide_planes").load(str(tmp_path)).collect()
    for r in rows:
        want = PLANES[r["channel_index"]][:: 1 << r["level"], :: 1 << r["level"]]
        assert (np.frombuffer(r["data"], r["dtype"]).reshape(r["height"], r["width"]) == want).all()
    assert len(rows) == 3 + 4
