"""SimHash fingerprints and exact near-duplicate groups by bit-sliced comparison.

Fingerprints of 64 bits are linked at `radius` or fewer differing bits. Equal fingerprints
are one class first. With the 64 bits cut into radius + 2 runs, two linked fingerprints
agree on two runs at least, so classes meet in a bucket for each pair of runs: exact, no
link is lost. Within a bucket the fingerprints lie as vertical bit planes, 64 of them to a
machine word; the distances of one fingerprint to all others are counted plane by plane in
carry-save counters of a few bits, and a block of words is abandoned as soon as every
distance in it is beyond the radius. A bucket gives the links of a spanning forest of its
components only, never all pairs. Buckets above `block` classes are compared as pairs of
blocks, each its own task, so a bucket that holds a third of all rows stays bounded in
memory and nothing is capped.

Defined results: null or empty text has fingerprint 0, linked like any other; rows with
equal texts share a fingerprint; an empty table gives an empty frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, keep, map_rows, tidy
from .components import components


#: Odd factors that spread a shingle's hash over further words of a wide fingerprint.
_ODD = (np.random.default_rng(64).integers(0, 2**63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; fewer words are one shingle, none is no hash."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, seed)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    view = memoryview(joined)
    return np.array([xxh64_intdigest(view[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def sketch(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """`width` words of 64 majority bits; the first is the contract's fingerprint."""
    out, n = np.zeros(width, np.uint64), len(hashes)
    for w in range(width if n else 0):
        h = hashes
        if w:
            h = hashes * _ODD[w]
            h = (h ^ (h >> np.uint64(29))) * _ODD[w - 1]
            h ^= h >> np.uint64(32)
        votes = np.zeros(64, np.int64)
        for at in range(0, n, 65536):
            votes += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0]
    return out


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles."""
    return int(sketch(shingle_hashes(text, shingle))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(id_col, fp): fp is the fingerprint as a signed long."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"k": b["k"], "fp": fp.view(np.int64)})

    return map_rows(docs.select(F.col(id_col).alias("k"), "text"), each, "k long, fp long", ("k",)).withColumnRenamed("k", id_col)


def runs(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 2 runs that make up 64 bits."""
    n = radius + 2
    cut = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:], strict=False)]


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n x words); bit j of word w of plane p is bit p of fingerprint 64 w + j."""
    bits = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1] * 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def within(fp: np.ndarray, sliced: np.ndarray, radius: int, alive: np.ndarray, check_every: int = 8) -> np.ndarray:
    """Words with a bit set for each column of alive at distance <= radius from fp.

    Vertical counters: bit k of a column's distance lies in low[k]; a plane is added with
    carry-save steps, and what runs over the top counter, or is beyond the radius where the
    counters are looked at, is out for good. Words in which all are out are abandoned.
    """
    width = max(1, radius.bit_length())
    ones = ~np.uint64(0)
    words = np.flatnonzero(alive)
    over = ~alive[words]
    low = [np.zeros(len(words), np.uint64) for _ in range(width)]
    bits = np.unpackbits(fp.view(np.uint8), bitorder="little").tolist()
    for p, bit in enumerate(bits):
        carry = sliced[p, words]
        if bit:
            carry = ~carry
        for k in range(width):
            low[k], carry = low[k] ^ carry, low[k] & carry
        over |= carry
        if p % check_every == check_every - 1 or p == len(bits) - 1:
            # counter > radius, from the highest bit down
            more, equal = np.zeros(len(words), np.uint64), np.full(len(words), ones)
            for k in reversed(range(width)):
                if radius >> k & 1:
                    equal &= low[k]
                else:
                    more |= equal & low[k]
                    equal &= ~low[k]
            over |= more
            left = over != ones
            if not left.all():
                words, over = words[left], over[left]
                low = [x[left] for x in low]
                if not len(words):
                    break
    out = np.zeros(len(alive), np.uint64)
    out[words] = ~over
    return out


class _Side:
    """Fingerprints of one side of a comparison, and which of them no component holds yet."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.n = fps, len(fps)
        self.sliced = planes(fps) if self.n >= 64 else None
        self.alive = np.packbits(np.arange(-(-self.n // 64) * 64) < self.n, bitorder="little").view(np.uint64).copy()
        self.open = np.ones(self.n, bool)

    def take(self, j: int) -> None:
        self.open[j] = False
        self.alive[j >> 6] &= ~(np.uint64(1) << np.uint64(j & 63))

    def near(self, fp: np.ndarray, radius: int) -> list[int]:
        if self.sliced is None:  # less than a word of columns
            rest = np.flatnonzero(self.open)
            return rest[np.bitwise_count(self.fps[rest] ^ fp).sum(axis=1) <= radius].tolist()
        hits = within(fp, self.sliced, radius, self.alive)
        return np.flatnonzero(np.unpackbits(hits.view(np.uint8), bitorder="little")[: self.n]).tolist()


def alike(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether each of others has this Jaccard similarity or more to one; all are sorted distinct shingle hashes."""
    sizes = np.array([len(o) for o in others], np.int64)
    both = np.zeros(len(others), np.int64)
    filled = np.flatnonzero(sizes)
    if len(one) and len(filled):
        every = np.concatenate(others)
        hit = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
        both[filled] = np.add.reduceat(hit, (np.cumsum(sizes) - sizes)[filled], dtype=np.int64)
    union = sizes + len(one) - both
    return both >= similarity * union - 1e-9


def forest(fps: np.ndarray, radius: int, split: int | None = None, sets: list[np.ndarray] | None = None, similarity: float = 0.0) -> list[tuple[int, int]]:
    """Index pairs that span the components of the links among fps (n x words).

    A component grows from one member; each member is compared with those that no component
    holds yet, so a group of copies costs little more than its size. split: only links
    between fps[:split] and fps[split:] count. sets: each one's shingle hashes; then what lies
    within the radius is a link only if the sets have this Jaccard similarity.
    """
    if split is None:
        sides, firsts = [_Side(fps)], [0]
    else:
        sides, firsts = [_Side(fps[:split]), _Side(fps[split:])], [0, split]
    found: list[tuple[int, int]] = []
    for s, side in enumerate(sides):
        for i in range(side.n):
            if not side.open[i]:
                continue
            side.take(i)
            queue = [(s, i)]
            while queue:
                at, x = queue.pop()
                to = 0 if len(sides) == 1 else 1 - at
                near = sides[to].near(sides[at].fps[x], radius)
                if sets is not None and near:
                    near = np.array(near)[alike(sets[firsts[at] + x], [sets[firsts[to] + j] for j in near], similarity)].tolist()
                for j in near:
                    sides[to].take(j)
                    found.append((firsts[at] + x, firsts[to] + j))
                    queue.append((to, j))
    return found


def compare_buckets(keyed: DataFrame, payload: DataFrame, radius: int, block: int, tasks: int, similarity: float | None = None) -> DataFrame:
    """Links (a, b) that span the components within each bucket.

    keyed: (name, slot, bits), a fingerprint's buckets; payload: (name, words), its words of
    64 bits. A bucket of more than `block` is compared as pairs of blocks. Buckets are dealt out
    to `tasks` tasks, as their few bytes say little of the work. similarity: payload has `hashes`
    too, and links are confirmed by the exact Jaccard similarity of these.
    """
    sizes = keyed.groupBy("slot", "bits").agg(F.count("*").alias("n")).filter("n > 1").select("slot", "bits", F.ceil(F.col("n") / block).alias("blocks"))
    rows = keyed.join(sizes, ["slot", "bits"]).withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("name", "slot", "bits", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(payload, "name")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        i, j = key[2], key[3]
        group = group.sort_values("name")
        split = None
        if i != j:
            group = pd.concat([group[group["own"] == i], group[group["own"] != i]])
            split = int((group["own"] == i).sum())
        names = group["name"].to_numpy()
        fps = np.frombuffer(b"".join(group["words"].tolist()), "<u8").reshape(len(names), -1)
        sets = None if similarity is None else [np.frombuffer(h, "<u8") for h in group["hashes"]]
        at = np.array(forest(fps, radius, split, sets, similarity or 0.0), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": names[at[:, 0]], "b": names[at[:, 1]]})

    return rows.repartition(tasks, "slot", "bits", "i", "j").groupBy("slot", "bits", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _tasks(classes: DataFrame, slots: int, at_once: int = 50_000) -> int:
    """How many tasks compare classes that each lie in `slots` buckets."""
    return max(4 * classes.sparkSession.sparkContext.defaultParallelism, -(-slots * classes.count() // at_once))


def _words_of(fp: F.Column) -> F.Column:
    """A long as 8 bytes, the lowest first."""
    high = F.lpad(F.hex(fp), 16, "0")
    return F.unhex(F.concat(*[F.substring(high, 15 - 2 * k, 2) for k in range(8)]))


def links(classes: DataFrame, radius: int = 3, block: int = 4096) -> DataFrame:
    """Links (a, b) between class fingerprints that span every component; classes has a distinct `fp` long."""
    cut = runs(radius)

    def key(pair: tuple[int, int]) -> F.Column:
        out = F.lit(0).cast("long")
        for r in pair:
            first, n = cut[r]
            out = F.shiftleft(out, n).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << n) - 1)))
        return out

    slots = [F.struct(F.lit(k).alias("slot"), key(p).alias("bits")) for k, p in enumerate(combinations(range(len(cut)), 2))]
    keyed = classes.select(F.col("fp").alias("name"), F.explode(F.array(*slots)).alias("at")).select("name", "at.slot", "at.bits")
    return compare_buckets(keyed, classes.select(F.col("fp").alias("name"), _words_of(F.col("fp")).alias("words")), radius, block, _tasks(classes, len(slots)))


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, block: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """Per row: id_col, fp, component_id (the smallest id reachable over links, itself included; null ids are no smallest ones)."""
    marked = keep(fingerprints(docs, id_col, shingle), "fingerprints")
    classes = keep(marked.groupBy("fp").agg(F.min(id_col).alias("first_id")), "classes")
    joined = components(links(classes, radius, block))
    whole = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = whole.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return marked.join(whole.join(least, "component").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


# --- texts that are similar, not only almost equal -----------------------------

#: Words of a wide fingerprint, and bands x rows of least shingle hashes that choose its buckets.
WIDTH, BANDS, ROWS = 16, 10, 3


def wide_radius(similarity: float, width: int = WIDTH) -> int:
    """The expected distance of two texts whose shingle sets of one size have this Jaccard similarity."""
    cosine = 2 * similarity / (1 + similarity)
    return round(64 * width * float(np.arccos(cosine)) / np.pi)


#: Bits beyond the expected distance at which a pair is still looked at. Sketches of a few shingles
#: have the largest mean, 192 bits for 4 of 5; the standard deviation is about 12.5.
MARGIN = 7 * WIDTH


def _bands(hashes: np.ndarray) -> list[int]:
    least = [int((hashes * m >> np.uint64(7)).min()) for m in _ODD[: BANDS * ROWS]] if len(hashes) else [0] * (BANDS * ROWS)
    out = []
    for k in range(0, BANDS * ROWS, ROWS):
        h = 0
        for v in least[k : k + ROWS]:
            h = (h * 0x9E3779B97F4A7C15 + v) & (2**64 - 1)
        out.append(h - 2**63)
    return out


def _name(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b" ".join((text or "").encode("utf-8", "replace").lower().split()), 7) - 2**63


def _described(texts: list, shingle: int) -> tuple[list[int], list[bytes], list[list[int]]]:
    names, held, bands = [], [], []
    for text in texts:
        names.append(_name(text))
        h = np.unique(shingle_hashes(text, shingle))  # a repeated line counts once, as in the similarity
        held.append(sketch(h, WIDTH).astype("<u8").tobytes())
        bands.append(_bands(h))
    return names, held, bands


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, block: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """Per row: id_col, name (equal for equal word sequences), component (a name of its group).

    A 64-bit fingerprint can't tell a similarity of 0.8 from 0.6, so texts are compared by
    wide ones of 64 * WIDTH bits, within buckets of equal bands of least shingle hashes. Two
    texts of similarity s share a bucket with probability 1 - (1 - s**ROWS)**BANDS, 0.999 at
    0.8. Those at most MARGIN bits beyond the distance expected at `similarity` are candidates;
    the shingles of each component of candidates then meet once, and a pair is linked if the
    Jaccard similarity of its shingle sets is `similarity` or more.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, held, bands = _described(b["text"].tolist(), shingle)
            yield pd.DataFrame({"k": b["k"], "name": names, "words": held, "bands": bands})

    known = docs.select(F.col(id_col).cast("long").alias("k"), "text")
    marked = keep(map_rows(known, tidy(each), "k long, name long, words binary, bands array<long>", ("k",)).withColumnRenamed("k", id_col), "sketches")
    classes = keep(marked.groupBy("name").agg(F.first("words").alias("words"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select("name", F.posexplode("bands").alias("slot", "bits"))
    radius = wide_radius(similarity) + MARGIN
    near = keep(components(compare_buckets(keyed, classes.select("name", "words"), radius, block, _tasks(classes, BANDS))).withColumnRenamed("node", "name"), "candidates")

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            yield pd.DataFrame({"name": [_name(t) for t in texts], "hashes": [np.unique(shingle_hashes(t, shingle)).astype("<u8").tobytes() for t in texts]})

    # one text of each candidate; rows that share its id fall out by name
    firsts = marked.join(near, "name", "left_semi").groupBy("name").agg(F.min(id_col).alias("k")).select("k").distinct()
    sets = known.join(firsts.withColumnRenamed("k", "k_"), F.col("k").eqNullSafe(F.col("k_")), "left_semi").select("text").mapInPandas(tidy(shingles), "name long, hashes binary")
    sets = sets.join(near.select("name"), "name", "left_semi").groupBy("name").agg(F.first("hashes").alias("hashes"))
    payload = keep(classes.select("name", "words").join(sets, "name"), "shingles")
    joined = components(compare_buckets(near.select("name", F.lit(0).alias("slot"), F.col("component").alias("bits")), payload, radius, block, _tasks(near, 1), similarity))
    labels = joined.withColumnRenamed("node", "name")
    return marked.select(id_col, "name").join(labels, "name", "left").select(id_col, "name", F.coalesce("component", "name").alias("component"))


def drop_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, block: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each group: that of the smallest id.

    Rows whose id is theirs alone are matched by id; of rows that share an id, or have none,
    the words tell which is meant, and of equal ones any one stays.
    """
    found = keep(similar_groups(docs, similarity, shingle, block, id_col), "groups")
    own_id, own_name, name = (fresh(docs, n) for n in ("own_id", "own_name", "name"))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "name"))
    stay = found.groupBy("component").agg(first.alias("first")).select(F.col("first.id").alias(own_id), F.col("first.name").alias(own_name))
    rows = found.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("rows"))
    stay = keep(stay.join(rows, F.col(own_id).eqNullSafe(F.col("id"))).select(own_id, own_name, "rows"), "stay")
    own = F.col(id_col).cast("long")
    lone = docs.join(stay.filter("rows = 1").select(own_id), own.eqNullSafe(F.col(own_id)), "left_semi")
    shared = stay.filter("rows > 1")
    if shared.isEmpty():
        return lone

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [_name(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield b.append_column(name, pa.array(names, pa.int64()))

    again = docs.join(shared.select(own_id).distinct(), own.eqNullSafe(F.col(own_id)), "left_semi")
    again = again.mapInArrow(tidy(mark), T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
    again = again.join(shared.select(own_id, own_name), own.eqNullSafe(F.col(own_id)) & (F.col(name) == F.col(own_name)), "left_semi").dropDuplicates([id_col, name])
    return lone.unionByName(again.drop(name))
