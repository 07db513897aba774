"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions, those of the greatest energy first, are cut into slices; for a query each
slice holds a list of local scores, whose sum is the score. Vectors and queries are packed
into blocks of bounded size, and every query block meets every vector block.

1. Every block gathers the k best local scores of each slice and sums those entries over the
   slices. The k-th greatest of these sums over all blocks is a safe cutoff: k candidates
   reach it.
2. The cutoffs go to all blocks. A block reads its slices one after another and collects the
   entries that still suffice: with what the slices not yet read can add at most (the product
   of the two vectors' lengths within the slice) they reach the cutoff. So few candidates are
   read in all slices, and a slice is left uniformly for every query that has none left.
3. Candidates that all slices collected have exact scores; a task hands on its k best at or
   above the cutoff, and the k best of those are the answer.

Components are floor(scale * x) as integers, so scores are exact and ties are real; ties go to
the smaller id. Products are computed in the narrowest type in which every sum is exact:
float32, float64, or 64-bit integers (slower). Defined results: vectors that are null or hold
null or non-finite components take no part, nor do rows without an id; a shorter vector counts
as padded with zeros; rows that share a query's id count as its own and are left out; a query
id is asked once, with the least of its vectors; with fewer than k candidates all are returned;
an empty table gives an empty frame; further columns are not read. Components and scores that a
long can't hold count as the nearest long. Rows with a component so large that a score might
pass 2**61 are set apart: their products are summed in limbs, block by block, and no others'.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Below every score; exact in every type.
_NONE = -(2**62)


def whole_components(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    least = F.lit(-(2**63 - 1))
    v = F.transform(vec_col, lambda x: F.greatest(F.floor(x.cast("double") * scale).cast("long"), least))
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(ok).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _matrix(rows: list, dims: int, kind: type) -> np.ndarray:
    out = np.zeros((len(rows), dims), kind)
    for k, v in enumerate(rows):
        out[k, : min(dims, len(v))] = v[:dims]
    return out


def _local(queries: np.ndarray, block: np.ndarray, slices: list[slice]) -> list[np.ndarray]:
    return [queries[:, s] @ block[:, s].T for s in slices]


def _lengths(vectors: np.ndarray, slices: list[slice]) -> np.ndarray:
    """Length of each vector within each slice, never too small."""
    return np.stack([np.sqrt((vectors[:, s].astype(float) ** 2).sum(axis=1)) for s in slices], axis=1) * (1 + 1e-9)


def _lower_bounds(local: list[np.ndarray], own: np.ndarray, k: int) -> np.ndarray:
    """Per query the k greatest sums over the slices of the entries in any slice's local list."""
    n = local[0].shape[1]
    if n <= k:
        total = sum(local)
        total[own] = _NONE
        return np.pad(total, ((0, 0), (0, k - n)), constant_values=_NONE)
    at = np.sort(np.concatenate([np.argpartition(x, n - k, axis=1)[:, n - k :] for x in local], axis=1), axis=1)
    total = sum(np.take_along_axis(x, at, axis=1) for x in local)
    total[:, 1:][at[:, 1:] == at[:, :-1]] = _NONE  # in several lists: counts once
    total[np.take_along_axis(own, at, axis=1)] = _NONE
    return np.partition(total, total.shape[1] - k, axis=1)[:, -k:]


def _resolve(queries: np.ndarray, block: np.ndarray, slices: list[slice], own: np.ndarray, ids: np.ndarray, cutoff: np.ndarray, k: int, pairs: int = 200_000, sparse: float = 0.05):
    """(query row, ids, scores) of the k best candidates at or above each query's cutoff."""
    q_len, v_len = _lengths(queries, slices), _lengths(block, slices)
    kind = queries.dtype
    low = cutoff - 0.5 - abs(cutoff) * 1e-12  # sums of lengths are rounded
    score, read, alive = np.zeros((len(queries), len(block)), kind), 0, ~own
    while read < len(slices) and alive.mean() > sparse:  # while many are left, whole slices are cheaper than entries
        s = slices[read]
        score += queries[:, s] @ block[:, s].T
        read += 1
        alive &= score + q_len[:, read:] @ v_len[:, read:].T >= low[:, None]
    row, col = np.nonzero(alive)
    score = score[row, col]
    for n, s in enumerate(slices[read:], read):  # what is left of the entries meets the next slice
        kept = []
        for at in range(0, len(row), pairs):
            r, c = row[at : at + pairs], col[at : at + pairs]
            now = score[at : at + pairs] + np.einsum("pd,pd->p", queries[r, s], block[c, s])
            ok = np.flatnonzero(now + (q_len[r, n + 1 :] * v_len[c, n + 1 :]).sum(axis=1) >= low[r])
            kept.append((r[ok], c[ok], now[ok]))
        row, col, score = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (row, col, score)
    reach = score >= cutoff[row]
    return _best(row[reach], ids[col[reach]], score[reach].astype(np.int64), k)


def _best(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k of the greatest scores of each row, ties to the smaller id."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    best = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[best], ids[best], score[best]


def _packed(rows: DataFrame, dims: int, kind: np.dtype, order: np.ndarray, size: int) -> DataFrame:
    """(ids, vectors): blocks of about `size` rows; dimensions in the order given."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "vectors": [np.ascontiguousarray(_matrix(part["v"].tolist(), dims, kind)[:, order]).tobytes()]})

    return rows.mapInPandas(pack, "ids binary, vectors binary")


def top_k(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: int = 64, query_every: int = 20, slices: int = 4, block: int = 8_192, query_block: int = 4_096, step: int = 128) -> DataFrame:
    """query_id, rank, id, score: the k greatest inner products of each row whose id is divisible by query_every."""
    rows = keep(whole_components(vectors, id_col, vec_col, scale), "vectors")
    dims = rows.select(F.max(F.size("v"))).first()[0] or 0
    rows = rows.withColumn("high", F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0)))
    apart = F.col("high") > math.isqrt((2**61 - 1) // max(dims, 1))
    high, large = (x or 0 for x in rows.select(F.max(F.when(~apart, F.col("high"))), F.count_if(apart)).first())
    asked = rows.filter(F.col("id") % query_every == 0).groupBy("id").agg(F.min(F.struct("v", "high")).alias("least")).select("id", "least.*")
    found = _close(rows.filter(~apart), asked.filter(~apart), dims, high * high * dims, k, slices, block, query_block, step)
    if large:
        found = found.unionByName(_far(asked, rows.filter(apart), dims, k)).unionByName(_far(asked.filter(apart), rows.filter(~apart), dims, k))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _wide_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of longs beyond -2**63, exact but for sums that a long can't hold: these are the nearest long."""
    limbs = lambda x: [(np.sign(x) * ((abs(x) >> 21 * n) & (2**21 - 1))).astype(float) for n in range(3)]
    total = np.zeros((len(a), len(b)), object)
    for n, x in enumerate(limbs(a)):
        for m, y in enumerate(limbs(b)):
            for at in range(0, max(a.shape[1], 1), 1024):  # sums of 1024 products of 42 bits are exact
                total += (x[:, at : at + 1024] @ y[:, at : at + 1024].T).astype(np.int64).astype(object) << 21 * (n + m)
    return np.clip(total, -(2**63), 2**63 - 1).astype(np.int64)


def _far(asked: DataFrame, rows: DataFrame, dims: int, k: int, block: int = 1_024, query_block: int = 256) -> DataFrame:
    """query_id, id, score: the k best of every block of rows, by products in limbs."""
    order = np.arange(dims)
    blocks = _packed(rows, dims, np.dtype(np.int64), order, block)
    queries = _packed(asked, dims, np.dtype(np.int64), order, query_block).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in zip(b["ids"], b["q_ids"], b["vectors"], b["q_vectors"], strict=True):
                ids, q_ids, v, q = (np.frombuffer(x, np.int64) for x in raw)
                scores = _wide_products(q.reshape(-1, dims), v.reshape(-1, dims))
                row, col = np.nonzero(q_ids[:, None] != ids[None, :])
                row, best, top = _best(row, ids[col], scores[row, col], k)
                yield pd.DataFrame({"query_id": q_ids[row], "id": best, "score": top})

    return blocks.crossJoin(queries).mapInPandas(score, "query_id long, id long, score long")


def _close(rows: DataFrame, asked: DataFrame, dims: int, most: int, k: int, slices: int, block: int, query_block: int, step: int) -> DataFrame:
    """query_id, id, score: candidates among which are the k best, where no score passes `most`."""
    kind = np.dtype(np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64)  # the narrowest in which every sum is exact
    per_dim = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("energy"))
    energy = np.zeros(max(dims, 1))
    for r in per_dim.collect():  # a row a dimension
        energy[r["d"]] = r["energy"]
    order = np.argsort(-energy[:dims], kind="stable")
    cut = np.linspace(0, dims, min(slices, max(dims, 1)) + 1).astype(int)
    parts = [slice(a, b) for a, b in zip(cut, cut[1:], strict=False)]
    every = keep(_packed(rows, dims, kind, order, block), "vector_blocks")
    queries = keep(_packed(asked, dims, kind, order, query_block).withColumn("q", F.monotonically_increasing_id()), "query_blocks")
    load = lambda ids, raw: (np.frombuffer(ids, np.int64), np.frombuffer(raw, kind).reshape(-1, dims))

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of this task's query blocks
        for b in batches:
            for ids, raw, q, q_ids, q_raw in zip(b["ids"], b["vectors"], b["q"], b["q_ids"], b["q_vectors"], strict=True):
                (block_ids, block_v), (asked_ids, asked_v) = load(ids, raw), load(q_ids, q_raw)
                found = best.setdefault(q, (asked_ids, np.full((len(asked_ids), k), _NONE, kind)))[1]
                for at in range(0, len(asked_ids), step):
                    own = asked_ids[at : at + step, None] == block_ids[None, :]
                    here = _lower_bounds(_local(asked_v[at : at + step], block_v, parts), own, k)
                    both = np.concatenate([found[at : at + step], here], axis=1)
                    found[at : at + step] = np.partition(both, k, axis=1)[:, k:]
        for q, (asked_ids, found) in best.items():
            row, col = np.nonzero(found > _NONE)
            yield pd.DataFrame({"q": q, "query_id": asked_ids[row], "bound": found[row, col].astype(np.int64)})

    # a stated set of queries against all rows, in blocks: what meets is blocks, not rows
    asked_blocks = queries.select("q", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc()))
    sums = every.crossJoin(asked_blocks).mapInPandas(bounds, "q long, query_id long, bound long")
    cutoffs = sums.withColumn("nth", nth).filter(F.col("nth") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "bound"))).alias("bounds"))  # of a block's queries
    told = keep(asked_blocks.join(cutoffs, "q", "left").withColumn("at", F.map_keys("bounds")).withColumn("bound", F.map_values("bounds")).drop("bounds"), "cutoffs")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, raw, q_ids, q_raw, at_ids, at_bounds in zip(b["ids"], b["vectors"], b["q_ids"], b["q_vectors"], b["at"], b["bound"], strict=True):
                (block_ids, block_v), (asked_ids, asked_v) = load(ids, raw), load(q_ids, q_raw)
                # without k candidates there is no cutoff: everything is resolved
                known = {} if at_ids is None else dict(zip(at_ids.tolist(), at_bounds.tolist(), strict=True))
                safe = np.array([known.get(x, _NONE) for x in asked_ids.tolist()], np.int64)
                for at in range(0, len(asked_ids), step):
                    own = asked_ids[at : at + step, None] == block_ids[None, :]
                    row, found, score = _resolve(asked_v[at : at + step], block_v, parts, own, block_ids, safe[at : at + step], k)
                    yield pd.DataFrame({"query_id": asked_ids[at + row], "id": found, "score": score})

    return every.crossJoin(told.drop("q")).mapInPandas(resolve, "query_id long, id long, score long")
