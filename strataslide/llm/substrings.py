"""Exact substring deduplication: every window of so many words that also starts earlier is cut out.

A window is hashed by Rabin and Karp's polynomial over the hashes of its words (polynomials of their bytes), so all
windows of a text follow from a few array operations. Documents are dealt to groups of a
bounded number of bytes by a hash of their content, windows to buckets by a second,
independent polynomial. A group sends each bucket the first of its own occurrences of every
window, ordered by document; the bucket counts occurrences over all groups and answers with
one bit a window: whether a smaller document of another group holds it. The groups then
know, for each of their windows, whether it starts earlier, and merge the windows that do
into maximal intervals. A passage that a third of the corpus holds reaches its bucket once a
group. Texts are shuffled once, an answer is a bit.

Two windows are taken as equal if their 64 bits agree within a bucket of some two million
windows: a wrong pair is expected once in about 10**13 windows, however large the corpus.

Defined results: null and empty texts have no words; texts with fewer words than a window
keep them all; null ids come before all others; rows that share an id are not earlier than
each other, so each keeps what only they repeat; an empty table gives an empty frame; other
columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .words import hashed_rows, mixed

WINDOW = 20
#: Odd bases of the two polynomials, 5 modulo 8, so that sums of their powers stay odd or nearly so.
BASE, BUCKET_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D
GROUP_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
_SENT = "grp long, bucket long, ids binary, nulls long, counts binary, windows binary"
_SHOWN = "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string"


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """The polynomial of every `size` consecutive values modulo 2**64, by doubling."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, span, have = None, 0, words
    width, shift = 1, base  # have[i] is the polynomial of width values from i on, shift is base**width
    left = size
    while True:
        if left & 1:
            if out is None:
                out, span, power = have, width, shift
            else:  # what is there moves behind this piece
                m = min(len(have), len(out) - width)
                out = have[:m] * np.uint64(power) + out[width : width + m]
                span, power = span + width, power * shift % 2**64
        left >>= 1
        if not left:
            return out[:n]
        have = have[: len(have) - width] * np.uint64(shift) + have[width:]
        width, shift = 2 * width, shift * shift % 2**64


class _Group:
    """The windows of one group's documents, in order of id."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
        texts = table.column("text").cast(pa.binary())
        self.ids = [ids[k] for k in order]
        self.texts = [texts[k].as_py() or b"" for k in order]
        words, at = hashed_rows(self.texts)
        n = np.maximum(np.diff(at) - (window - 1), 0)
        self.at = np.concatenate([[0], np.cumsum(n)])
        self.row = np.repeat(np.arange(len(n)), n)
        keys = [(i is not None, i or 0) for i in self.ids]
        self.rank = np.cumsum([0, *(a != b for a, b in zip(keys, keys[1:], strict=False))])[: len(keys)]
        inside = np.arange(len(self.row)) - self.at[self.row] + at[self.row]  # windows that run over two texts are passed over
        self.h = window_hashes(words, window, BASE)[inside]
        self.side = window_hashes(mixed(words), window, BUCKET_BASE)[inside]
        self.sorted = np.argsort(self.h, kind="stable")
        hs = self.h[self.sorted]
        self.new = np.ones(len(hs), bool)
        self.new[1:] = hs[1:] != hs[:-1]
        self.first = self.sorted[self.new]  # the earliest occurrence of each, by value

    def cells(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """(bucket, places of its windows in order of document)."""
        first = np.sort(self.first)
        b = ((self.side[first] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(b, kind="stable")
        b, first = b[order], first[order]
        cuts = np.flatnonzero(np.diff(b)) + 1
        return [(int(b[s]), first[s:e]) for s, e in zip([0, *cuts], [*cuts, len(b)], strict=True) if e > s]

    def earlier(self, told: np.ndarray) -> np.ndarray:
        """Whether each window starts earlier: told for first occurrences, else by what the group holds itself."""
        run = np.cumsum(self.new) - 1
        rows = self.row[self.sorted]
        ranks = self.rank[rows]
        gone = told[self.first][run] | (ranks > self.rank[self.row[self.first]][run])
        gone[1:] |= ~self.new[1:] & (rows[1:] == rows[:-1])
        out = np.zeros(len(run), bool)
        out[self.sorted] = gone
        return out


def _ask(window: int, buckets: int):
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g, out = _Group(table, window), []
        known = np.array([i or 0 for i in g.ids], np.int64)
        for bucket, places in g.cells(buckets):
            rows, counts = np.unique(g.row[places], return_counts=True)
            nulls = sum(g.ids[r] is None for r in rows[: g.ids.count(None)])
            out.append({"grp": key[0].as_py(), "bucket": bucket, "ids": known[rows].tobytes(), "nulls": nulls, "counts": counts.astype(np.uint32).tobytes(), "windows": g.h[places].tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("ids", pa.binary()), ("nulls", pa.int64()), ("counts", pa.binary()), ("windows", pa.binary())]))

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Of one bucket's windows, those that a smaller document of another group holds, as bits in the order in which they came."""
    cells = table.to_pylist()
    h = np.concatenate([np.frombuffer(c["windows"], np.uint64) for c in cells])
    ids = [np.frombuffer(c["ids"], np.int64) for c in cells]
    ranks = np.unique(np.concatenate(ids), return_inverse=True)[1] + 1
    docs, at = np.empty(len(h), np.int64), 0
    seen = 0
    for c, i in zip(cells, ids, strict=True):
        mine = ranks[seen : seen + len(i)].copy()
        mine[: c["nulls"]] = 0
        each = np.repeat(mine, np.frombuffer(c["counts"], np.uint32))
        docs[at : at + len(each)] = each
        at, seen = at + len(each), seen + len(i)
    order = np.argsort(h, kind="stable")
    hs, by = h[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = hs[1:] != hs[:-1]
    least = np.minimum.reduceat(by, np.flatnonzero(new))
    bits = np.empty(len(h), bool)
    bits[order] = by > least[np.cumsum(new) - 1]
    out, at = [], 0
    for c in cells:
        n = len(c["windows"]) // 8
        out.append({"grp": c["grp"], "bucket": c["bucket"], "bits": np.packbits(bits[at : at + n]).tobytes()})
        at += n
    return pa.Table.from_pylist(out, pa.schema([("grp", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())]))


def _intervals(flags: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals of words that windows starting at the flags cover; those that touch are one."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > window)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + window).tolist(), strict=True))


def _cut(window: int, buckets: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        g, out = _Group(table, window), []
        told = np.zeros(len(g.h), bool)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        for bucket, places in g.cells(buckets):
            told[places] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(places)).astype(bool)
        gone = g.earlier(told)
        for k, text in enumerate(g.texts):
            words = text.split()
            spans = _intervals(gone[g.at[k] : g.at[k + 1]], window)
            kept, at = [], 0
            for s, e in spans:
                kept += words[at:s]
                at = e
            kept += words[at:]
            out.append({"doc_id": g.ids[k], "n_words": len(words), "n_removed": len(words) - len(kept), "removed": [{"start": s, "end": e} for s, e in spans], "kept": b" ".join(kept)})
        if not out:
            return schema.empty_table()
        columns = [pa.array([r[f.name] for r in out], pa.binary() if f.name == "kept" else f.type) for f in schema]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return cut


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, the removed intervals of words, and what is kept, joined by spaces.

    A word goes if any window that covers it has its words starting earlier: in a smaller
    doc_id, or earlier in the same document. Groups hold group_bytes of text on average,
    buckets the windows of bucket_bytes.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = size // group_bytes + 1, min(size // bucket_bytes + 1, 2**31)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    name = fresh(rows, "grp")
    rows = rows.withColumn(name, F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    asked = rows.groupBy(name).applyInArrow(_ask(window, buckets), _SENT)
    told = asked.groupBy("bucket").applyInArrow(_answer, "grp long, bucket long, bits binary")
    return rows.groupBy(name).cogroup(told.groupBy("grp")).applyInArrow(_cut(window, buckets), _SHOWN)
