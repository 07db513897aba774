"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a band. A document's
distinct lexicon terms are sorted, and for each of `seeds` randomised subsets of the lexicon
the terms that fall into it are hashed together. Subsets come in nested levels, each half the
one before; a fingerprint holds the levels at which a document of its length leaves one or
two terms in a subset, so that one differing term doesn't change every hash of a long text.
The likeness of two fingerprints is the share of equal hashes among those that either has, at
the sparsest level that both hold.

The band is relative to the number of documents, so the lexicon is at most (mean distinct
terms of a document) / (least document share) terms, however large the corpus; it is
broadcast as sorted 64-bit hashes. Document frequencies cover every document.

A text with fewer than `min_terms` lexicon terms says little by them, so the fingerprint of one
with fewer than four times as many holds two sections: of its lexicon terms and of all its
distinct terms. Two texts are compared by lexicon terms where both have `min_terms` of them or
where one has that section alone, else by all terms. Texts whose numbers of terms differ about
eightfold or more share no level and have likeness 0.

Defined results: a null or empty text has no terms and its own fingerprint; equal texts have
equal fingerprints and likeness 1; equal rows count as documents of their own; a null doc_id
sorts first; an empty table gives an empty frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SEEDS, LEVELS = 24, 3
WIDE, NONE = 8, "00000000"
_ODD = (np.random.default_rng(23).integers(0, 2**63, SEEDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_FIRST = -(2**63)


def terms(text: str) -> list[str]:
    return text.lower().split()


def lexicon(docs: DataFrame, least: float = 0.0005, most: float = 0.02, min_docs: int = 2, flush: int = 400_000) -> np.ndarray:
    """Sorted hashes of the terms that a share of least to most of all documents hold."""
    from xxhash import xxh64_intdigest

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                seen.update(set(terms(text or "")))
                if len(seen) > flush:
                    yield packed(seen)
                    seen = Counter()
        yield packed(seen)

    def packed(seen: Counter) -> pd.DataFrame:
        h = np.array([xxh64_intdigest(w.encode("utf-8", "replace")) for w in seen], np.uint64).view(np.int64)
        return pd.DataFrame({"term": h, "n": np.fromiter(seen.values(), np.int32, len(seen))})

    n = docs.count()
    low, high = max(min_docs, least * n), max(min_docs, most * n)
    kept = docs.select("text").mapInPandas(count, "term long, n int").groupBy("term").agg(F.sum("n").alias("n")).filter((F.col("n") >= low) & (F.col("n") <= high)).select("term")
    found = kept.toPandas()["term"].to_numpy(np.int64) if n else np.empty(0, np.int64)  # bounded by the band, see above
    return np.sort(found.view(np.uint64))


class Maker:
    """Fingerprints texts under a lexicon; keeps each word's hash."""

    def __init__(self, lex: np.ndarray, min_terms: int = 8, max_cached: int = 400_000):
        self._lex, self._min, self._max = lex, min_terms, max_cached
        self._known: dict[str, int] = {}  # hash; the sign bit of another dict would cost more than a set
        self._in: set[int] = set(lex.tolist())

    def hashes(self, words: set[str]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        known = self._known
        if len(known) > self._max:
            known.clear()
        out, lex = [], self._in
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxh64_intdigest(w.encode("utf-8", "replace"))
                known[w] = h = h if h in lex else -h - 1
            if h >= 0:
                out.append(h)
        every = [known[w] if known[w] >= 0 else -known[w] - 1 for w in words] if len(out) < 4 * self._min else []
        return np.sort(np.array(out, np.uint64)), np.sort(np.array(every, np.uint64))

    def fingerprint(self, text: str) -> str:
        """Sections of mode, level, then LEVELS x SEEDS hashes of WIDE hexadecimal digits; all 0: no term.

        Mode b: lexicon terms, s: fewer than min_terms of them, a: all terms; e alone: no terms.
        """
        some, every = self.hashes(set(terms(text)))
        sections = [_section("b" if len(some) >= self._min else "s", some)] if len(some) else []
        return "".join([*sections, *([_section("a", every)] if len(every) else [])]) or "e"


def _section(mode: str, h: np.ndarray) -> str:
    from xxhash import xxh32_intdigest

    level = max(0, (max(len(h) - 1, 0) // 2).bit_length())
    low = max(0, level - 1)
    mixed = (h[None, :] * _ODD[:, None]) >> np.uint64(20)
    out = [f"{mode}{low:02d}"]
    for k in range(low, low + LEVELS):
        row, col = np.nonzero((mixed & np.uint64((1 << k) - 1)) == 0)
        cut = np.searchsorted(row, np.arange(SEEDS + 1)).tolist()
        held = h[col].tobytes()
        out += [f"{xxh32_intdigest(held[8 * a : 8 * z]) % (2**32 - 1) + 1:08x}" if z > a else NONE for a, z in zip(cut, cut[1:], strict=False)]
    return "".join(out)


def _sections(fingerprint: str) -> dict[str, str]:
    size = 3 + LEVELS * SEEDS * WIDE
    return {fingerprint[at]: fingerprint[at : at + size] for at in range(0, len(fingerprint), size)}


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    p, q = _sections(a), _sections(b)
    few = "s" in p or "s" in q or not ("b" in p and "b" in q)
    mode = next((m for m in (("a", "bs") if few else ("bs", "a")) if set(m) & set(p) and set(m) & set(q)), None)
    if mode is None:
        return 0.0
    a, b = (next(x[m] for m in mode if m in x) for x in (p, q))
    la, lb = int(a[1:3]), int(b[1:3])
    for k in range(min(la, lb) + LEVELS - 1, max(la, lb) - 1, -1):
        x, y = a[3 + WIDE * SEEDS * (k - la) :], b[3 + WIDE * SEEDS * (k - lb) :]
        held = same = 0
        for s in range(0, WIDE * SEEDS, WIDE):
            p, q = x[s : s + WIDE], y[s : s + WIDE]
            if p != NONE or q != NONE:
                held += 1
                same += p == q
        if held >= SEEDS // 2 or (held and k == max(la, lb)):
            return same / held
    return 0.0


def _in_order(docs: DataFrame) -> DataFrame:
    """(part, tail, key, known, z) sorted within partitions: z is the packed text, tail marks the next part's first row.

    key is doc_id, or the least long where that is null; known tells the two apart.

    Parts are ranges of doc_id; each also gets the row that follows its last one, the last
    part the very first row.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key")
    known = F.col("doc_id").isNotNull().alias("known")
    ids = docs.select(key)
    cuts = ids.select(F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], 20_000)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = np.array(cuts, np.int64)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.searchsorted(bounds, b["key"].to_numpy(), side="left")
            yield pd.DataFrame({"part": at, "key": b["key"]}).groupby("part", as_index=False)["key"].min()

    first = ids.mapInPandas(of, "part int, key long").groupBy("part").agg(F.min("key").alias("key")).orderBy("part").collect()  # one row a part
    before = {r["key"]: first[k - 1]["part"] for k, r in enumerate(first)}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            part, z = np.searchsorted(bounds, keys, side="left").tolist(), [zlib.compress((t or "").encode("utf-8", "surrogatepass"), 1) for t in b.column(2).to_pylist()]
            rows = [(p, False, k, i, x) for p, k, i, x in zip(part, keys.tolist(), b.column(1).to_pylist(), z, strict=True)]
            rows += [(before[k], True, k, i, x) for _, _, k, i, x in rows if k in before]
            yield pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "tail": pa.array([r[1] for r in rows], pa.bool_()), "key": pa.array([r[2] for r in rows], pa.int64()), "known": pa.array([r[3] for r in rows], pa.bool_()), "z": pa.array([r[4] for r in rows], pa.binary())})

    sent = docs.select(key, known, "text").mapInArrow(send, "part int, tail boolean, key long, known boolean, z binary")
    return sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "tail", "key", "known", "z")


def fingerprints(docs: DataFrame, lex: np.ndarray) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Maker(sent.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fingerprint": [make.fingerprint(t or "") for t in b["text"]]})

    return map_rows(docs.select("doc_id", "text"), each, "doc_id long, fingerprint string")


def edit(text: str, after: str) -> str:
    """text with its last half replaced by as much of after's start."""
    k = len(text) // 2
    return text[: len(text) - k] + after[:k]


def against_next(docs: DataFrame, lex: np.ndarray) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's, by ascending doc_id."""
    sent = docs.sparkSession.sparkContext.broadcast(lex)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Maker(sent.value)
        held = None  # part, id, text, fingerprint of the row whose follower comes next
        for b in batches:
            out = []
            for part, tail, key, known, z in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if tail and (held is None or held[0] != part):
                    continue  # a further row with the following part's first id
                text = zlib.decompress(z).decode("utf-8", "surrogatepass")
                mark = make.fingerprint(text)
                if held is not None and held[0] == part:
                    _, k, t, f = held
                    new = edit(t, text)
                    e = make.fingerprint(new) if new != t else f
                    out.append((k, len(t), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), f, e, likeness(f, e), likeness(f, mark)))
                held = None if tail else (part, key if known else None, text, mark)
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return _in_order(docs).mapInArrow(each, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
