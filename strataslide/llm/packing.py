"""Best-fit packing planned on the histogram of lengths.

Tokenised documents (each ended by an end id) are cut into pieces of at most `capacity`
tokens. Only the number of pieces of each length goes to the driver: at most `capacity`
counts, however many documents there are. Best fit decreasing runs over those counts,
whole groups of equal bins at a time, and yields slots: for a length, a run of ranks, the
first sequence, how many pieces of it share a bin, and the offset. Pieces get a rank within
their length and take the slot that holds it.

Defined results: a null or empty text is its end id alone (one piece of length 1); equal
rows are packed once each; an empty table gives an empty frame; other columns of the input
are not read, whatever their names; very long texts are cut, nothing is dropped.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, map_rows, tidy
from .tokens import chunk_tokenizer

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over {length: count}.

    Rows (length, first_rank, end_rank, first_sequence, per_bin, offset): the piece of rank
    r goes to sequence first_sequence + (r - first_rank) // per_bin, at
    offset + (r - first_rank) % per_bin * length. Sequences are numbered gapless from 0.
    """
    groups: dict[int, list[list]] = defaultdict(list)  # room left -> [bins, [(length, per_bin, offset)]]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        if left <= 0:
            continue
        if not 1 <= length <= capacity:
            raise ValueError(f"a length of {length} doesn't fit a capacity of {capacity}")
        for room in sorted(r for r in groups if r >= length):
            per = room // length
            while left and groups[room]:
                bins, held = groups[room].pop()
                full, rest = min(bins, left // per), 0
                if full < bins and full * per < left:
                    rest = left - full * per
                if full:
                    groups[room - per * length].append([full, held + [(length, per, capacity - room)]])
                if rest:
                    groups[room - rest * length].append([1, held + [(length, rest, capacity - room)]])
                if same := bins - full - (1 if rest else 0):
                    groups[room].append([same, held])
                left -= full * per + rest
                if same:
                    break
            if not left:
                break
        if left:
            per = capacity // length
            if left // per:
                groups[capacity - per * length].append([left // per, [(length, per, 0)]])
            if left % per:
                groups[capacity - left % per * length].append([1, [(length, left % per, 0)]])
    slots, rank, sequence = [], defaultdict(int), 0
    for room in sorted(groups):
        for bins, held in groups[room]:
            for length, per, offset in held:
                slots.append((length, rank[length], rank[length] + bins * per, sequence, per, offset))
                rank[length] += bins * per
            sequence += bins
    return slots


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary)."""
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = chunk_tokenizer(tokenizer)
        for b in batches:
            rows = []
            for doc, raw in zip(b["doc_id"].tolist(), tok.ids(b["text"].fillna("").tolist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return map_rows(docs.select("doc_id", "text"), tidy(cut), _PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int = 0, with_ids: bool = False, rows_per_bucket: int = 50_000) -> DataFrame:
    """Pieces with sequence_id and offset.

    Ranks are counted in two levels, over hashed buckets of a length and then within a
    bucket, so a length that most pieces have is no single task's work. The slots are
    bounded by the capacity alone and broadcast.
    """
    spark = docs.sparkSession
    cut = keep(pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if not counts:
        return cut.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    buckets = max(1, -(-max(counts.values()) // rows_per_bucket))
    if buckets == 1:  # ranks of a length fit a task
        slot_rank = F.row_number().over(Window.partitionBy("length").orderBy("doc_id", "piece")) - 1
        ranked = cut.withColumn("rank", slot_rank.cast("long"))
    else:
        cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
        per = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        before = per.select("length", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        inner = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
        ranked = cut.withColumn("inner", inner).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inner")).drop("before", "inner", "bucket")
    slots = spark.createDataFrame(plan(counts, capacity), "slot_length long, first_rank long, end_rank long, first_sequence long, per_bin long, slot_offset long")
    k = F.col("rank") - F.col("first_rank")
    return ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))).select(
        *cut.drop("bucket").columns,
        (F.col("first_sequence") + F.floor(k / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("slot_offset") + F.pmod(k, F.col("per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of pack(..., with_ids=True): sequence_id, length, ids (binary)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", F.expr("aggregate(transform(parts, p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))").alias("ids"))
