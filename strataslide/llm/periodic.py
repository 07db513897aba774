"""Runs of words that repeat with a period inside one document, and texts with the repetitions folded.

A run is a stretch of words with smallest period q, at least `exponent` periods and
`least` words long, that no neighbouring word extends. Two copies of it, q words apart,
overlap in at least k words, k = min over q of max(least, exponent * q) - q; so every word
of a run lies in a k-gram that its document repeats. Words outside such k-grams are masked.
What survives is cut into segments, and only these meet Main and Lorentz's divide and
conquer: the runs across the middle of a block are those whose longest common extensions
left and right of the middle, for some period, reach each other. All blocks of one size are
worked on at once; extensions are compared by prefix polynomials, and every run is checked
word by word at the end. A run is taken at the smallest block that holds it whole, so
periods up to a quarter of the block are enough for an exponent of 4.

Documents are independent: a map over batches, no shuffle. A batch is worked on in slices
of a few megabytes; a longer text is a slice of its own, at some 70 bytes of memory a word
(measured on 1.5 million words).

Defined results: null and empty texts have no words and no runs; rows that share an id, and
equal rows, each give their own row; null ids stay null; an empty table gives an empty
frame; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, tidy
from .substrings import window_hashes
from .words import hashed_rows, mixed

EXPONENT, LEAST = 4, 6
#: Odd bases; another one is taken should a check fail.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4D, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD95)
SLICE_BYTES = 2 << 20


def least_overlap(exponent: int, least: int) -> int:
    """Words that a run shares with itself one period on, at least."""
    return min(max(least, exponent * q) - q for q in range(1, least + 1))


def repeated(values: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Marks the words that lie in a k-gram which their own text (at[i] to at[i + 1]) holds twice or more."""
    n = np.maximum(np.diff(at) - (k - 1), 0)
    first = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - first[row] + at[row]
    grams = mixed(window_hashes(values, k, BASES[0])[place] ^ mixed(row.astype(np.uint64)))
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(values) + 1, np.int64)
    np.add.at(cover, place[twice], 1)
    np.add.at(cover, place[twice] + k, -1)
    return np.cumsum(cover[:-1]) > 0


def segments(kept: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every stretch of marked words within a text, of at least that many words."""
    edge = np.zeros(len(kept) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(kept & (edge[:-1] | ~np.concatenate([[False], kept[:-1]])))
    stops = np.flatnonzero(kept & (edge[1:] | ~np.concatenate([kept[1:], [False]]))) + 1
    long = stops - starts >= least
    return starts[long], stops[long]


class _Prefix:
    """Whether a stretch has a period, in constant time."""

    def __init__(self, values: np.ndarray, base: int):
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(len(values), base, np.uint64)])
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * self.power[:-1])])

    def periodic(self, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
        s = self.sums
        return (s[b - p] - s[a]) * self.power[p] == s[b] - s[a + p]


def _last(true, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest value from low to high for which true holds, where it holds at low and up to some value."""
    while (low < high).any():
        mid = (low + high + 1) // 2
        holds = true(mid)
        low, high = np.where(holds, mid, low), np.where(holds, high, mid - 1)
    return low


def _crossing(x: _Prefix, starts: np.ndarray, stops: np.ndarray, half: int, exponent: int, least: int) -> list[np.ndarray]:
    """(start, end, period) of the runs that lie in a block of 2 * half words of a segment and touch its middle."""
    n = np.maximum((stops - starts - 1) // half + 1, 0) // 2  # odd multiples of half before the segment's end
    seg = np.repeat(np.arange(len(n)), n)
    mid = starts[seg] + half * (2 * (np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)) + 1)
    left, right = mid - half, np.minimum(mid + half, stops[seg])
    most = (right - left) // exponent
    block = np.repeat(np.arange(len(most)), most)
    period = np.arange(len(block)) - np.repeat(np.cumsum(most) - most, most) + 1
    out = []
    need = exponent // 2  # whole periods that lie on one side of the middle, at least
    for ahead in (True, False):
        a = mid[block] if ahead else mid[block] - need * period
        fits = (a + need * period <= right[block]) if ahead else (a >= left[block])
        b, a, p = block[fits], a[fits], period[fits]
        hit = x.periodic(a, a + need * p, p)
        b, a, p = b[hit], a[hit], p[hit]
        end, lo, hi = a + need * p, left[b], right[b]
        # what goes on beyond the block is found in a larger one
        inner = ~((lo > starts[seg[b]]) & x.periodic(np.maximum(lo - 1, 0), end, p))
        inner &= ~((hi < stops[seg[b]]) & x.periodic(a, np.minimum(hi + 1, len(x.sums) - 1), p))
        a, p, end, lo, hi = a[inner], p[inner], end[inner], lo[inner], hi[inner]
        s = -_last(lambda at: x.periodic(-at, end, p), -a, -lo)  # noqa: B023
        e = _last(lambda at: x.periodic(a, at, p), end, hi)  # noqa: B023
        long = e - s >= np.maximum(least, exponent * p)
        out.append(np.stack([s, e, p], 1)[long])
    return out


def _checked(values: np.ndarray, runs: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> bool:
    """Every run has its period, word by word, and ends where it says."""
    for (s, e, p), lo, hi in zip(runs.tolist(), starts.tolist(), stops.tolist(), strict=True):
        if not (values[s : e - p] == values[s + p : e]).all() or (s > lo and values[s - 1] == values[s - 1 + p]) or (e < hi and values[e] == values[e - p]):
            return False
    return True


def runs_within(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, smallest period) of all runs of the segments, by start and period: Main and Lorentz's method."""
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    if exponent < 2:
        raise ValueError("a run has at least two periods")
    for base in BASES:
        x, found, half = _Prefix(values, base), [], 1
        while half < (stops - starts).max():
            if 2 * half >= least:
                found += _crossing(x, starts, stops, half, exponent, least)
            half *= 2
        runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
        first = np.ones(len(runs), bool)  # of the periods of one stretch the smallest
        first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
        runs = runs[first]
        seg = np.searchsorted(starts, runs[:, 0], "right") - 1
        if _checked(values, runs, starts[seg], stops[seg]):
            return runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    raise ArithmeticError("polynomials of every base took different words as equal")


def runs_of(texts: list[bytes], exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(runs of all texts, places at which each text's words begin), by masking and Main and Lorentz's method."""
    values, at = hashed_rows(texts)
    starts, stops = segments(repeated(values, at, least_overlap(exponent, least)), at, least)
    return runs_within(values, starts, stops, exponent, least), at


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield begin, k
            begin, held = k, 0
        held += n
    yield begin, len(sizes)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _folded(text: bytes, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds beyond its first period."""
    words, kept, at = text.split(), [], 0
    for s, e in sorted((s + q, e) for s, e, q in runs):
        kept += words[at:s] if at < s else []
        at = max(at, e)
    return b" ".join(kept + words[at:])


def _find(exponent: int, least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for lo, hi in _slices([len(t) for t in texts]):
                found, at = runs_of(texts[lo:hi], exponent, least)
                rows = np.searchsorted(found[:, 0], at)
                runs, folded = [], []
                for k in range(hi - lo):
                    mine = [(s - int(at[k]), e - int(at[k]), q) for s, e, q in found[rows[k] : rows[k + 1]].tolist()]
                    runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in mine])
                    folded.append(_folded(texts[lo + k], mine))
                columns = [batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(at), pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(folded, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    return find


def find_runs(docs: DataFrame, *, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, runs by start and period, and the text with every run folded to its first period, its words joined by spaces."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(_find(exponent, least)), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: F.Column) -> F.Column:
    """The run of the greatest length / period, compared exactly; of equal ones the first. Null without runs."""
    return F.aggregate(runs, F.try_element_at(runs, F.lit(1)), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def looped(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) where every tenth document, by the checksum h of its id, runs into a loop.

    With g = h // 10 and n words, each word from a = g % n on becomes word a + (i - a) % p,
    p = 1 + (n - a) // (3 + g % 8). Words are joined by spaces there.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("CASE WHEN n > 0 THEN CAST(g % n AS INT) END"))
    rows = rows.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    loop = F.expr("array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), CAST((n - a + p - 1) div p AS INT))), 1, n - a)), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, loop).otherwise(F.col("text")).alias("text"))
