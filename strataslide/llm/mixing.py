"""Mixing sources to target weights under a time-varying curriculum, in DataFrame functions only.

Every source has a weight schedule over the run, piecewise linear in training time t in
[0, 1]. Its integral is the source's weight; the integral up to t, scaled to the source's
target, is its cumulative token demand. A copy of a document sits at some cumulative token
of its source, and the inverse of the demand at that token is its training position. The
mix is range-sorted by position.

Targets share `ratio` times all sizes by weight, none above `max_repeats` times its source's
size; what is above is shared again by weight. As the shares of sources that are not held
only grow, the result is min(cap, level * weight), with the level found in one pass over
sources sorted by cap / weight.

Documents are taken whole: every one floor(target / size of the source) times, then once
more in hashed order while the rest of the target lasts; in the bucket where it runs out,
small documents fill what is left, of equal rows as many as fit. Cumulative sums are kept for ranges of the hash (buckets)
only, of which there are at most `max_buckets` and one a source: a document's place is its
bucket's sum and its hash's place in the bucket. So each document's copies and positions
follow from its own columns and a table of bounded size, which is broadcast; texts are not
shuffled until they go into order, and a source with most of the rows is no task's work.

Defined results: null text has size 0 and is taken for 0 words; a null source is a source of
its own, ordered last; equal rows have one place in the order, and
where a target ends among them the last copy is taken of some and not of the others; an empty table gives an empty
frame; sources without words get target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, word_count

#: Multipliers of a source's weight at t = 0, 1/2 and 1, in turn by source: fading, growing, level.
CURRICULUM = ((1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (1.0, 1.0, 1.0))


def _segments(shape: tuple[float, ...]) -> list[tuple[float, float, float, float, float]]:
    """(time, width, weight, slope, integral before) of each piece; the whole integral is scaled to 1."""
    width = 1.0 / (len(shape) - 1)
    total = sum((a + b) / 2 * width for a, b in zip(shape, shape[1:], strict=False))
    if min(shape) < 0 or total <= 0:
        raise ValueError("a schedule is nowhere negative and somewhere positive")
    out, before = [], 0.0
    for k, (a, b) in enumerate(zip(shape, shape[1:], strict=False)):
        out.append((k * width, width, a / total, (b - a) / total / width, before))
        before += (a + b) / 2 * width / total
    return out


def _inverse(demand: Column, shape: tuple[float, ...]) -> Column:
    """The time at which the schedule's integral reaches demand (0 to 1)."""
    at = None
    for time, width, weight, slope, before in reversed(_segments(shape)):
        more = F.greatest(demand - before, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(weight * weight) + 2 * slope * more, F.lit(0.0))) + weight
        here = F.lit(time) + F.least(F.coalesce(F.try_divide(2 * more, root), F.lit(0.0)), F.lit(width))
        at = here if at is None else F.when(demand < next_before, here).otherwise(at)
        next_before = before
    return at


def _placed(shape: tuple[float, ...]):
    return lambda demand: _inverse(demand, shape)


def targets(sized: DataFrame, ratio: float, max_repeats: float, cycle: tuple[float, ...]) -> DataFrame:
    """Per source (has_source, source_key): source_rows, source_size, turn, weight, target."""
    per = sized.groupBy("has_source", "source_key").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("has_source").desc(), "source_key")) - 1
    per = per.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod("turn", F.lit(len(cycle))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    held = F.coalesce(F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    level = F.max((F.sum("source_size").over(Window.partitionBy(F.lit(1))) * F.lit(float(ratio)) - F.col("held")) / F.col("open_weight")).over(Window.partitionBy(F.lit(1)))
    per = per.withColumn("held", held).withColumn("open_weight", open_weight).withColumn("level", level)
    return per.select("has_source", "source_key", "source_rows", "source_size", "turn", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


#: A mark is below this.
_MARKS = float(2**63)
_KEY = ("has_source", "source_key")


def _mark(seed: int) -> Column:
    """Orders documents, and with doc_id tells their texts apart; not negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "source", "text"), 1)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("has_source", F.col("source").isNotNull()).withColumn("source_key", F.coalesce("source", F.lit("")))


def _bucket() -> Column:
    return F.least(F.floor(F.col("mark") / F.lit(_MARKS) * F.col("buckets")).cast("long"), F.col("buckets") - 1)


def plan(sized: DataFrame, ratio: float, max_repeats: float, cycle: tuple[float, ...], rows_per_bucket: int, max_buckets: int) -> tuple[DataFrame, DataFrame]:
    """What decides about each document: a table of buckets, and the few documents that fill the rests.

    sized: has_source, source_key, doc_id, mark, size.
    """
    per = targets(sized, ratio, max_repeats, cycle)
    per = per.withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long"))
    per = per.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    wide = F.greatest(F.lit(float(rows_per_bucket)), F.sum("source_rows").over(Window.partitionBy(F.lit(1))) / max_buckets)
    per = keep(per.withColumn("buckets", F.ceil(F.col("source_rows") / wide)), "sources")
    rows = sized.join(_small(per, 50_000), list(_KEY)).withColumn("bucket", _bucket())
    sums = rows.groupBy(*_KEY, "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy(*_KEY).orderBy("bucket")) - F.col("bucket_size")
    table = keep(per.join(sums.select(*_KEY, "bucket", "bucket_size", before.alias("before")), list(_KEY)), "buckets")
    # the bucket of each source in which the rest runs out
    edge = table.filter((F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bucket_size")))
    near = rows.select(*_KEY, "bucket", "doc_id", "mark", "size").join(_small(edge.select(*_KEY, "bucket", "before", "rest"), 50_000), [*_KEY, "bucket"])
    near = near.groupBy(*_KEY, "bucket", "doc_id", "mark", "size", "before", "rest").agg(F.count("*").alias("rows"))  # equal rows are one, taken so many times
    words = F.col("size") * F.col("rows")
    near = near.withColumn("upto", F.col("before") + F.sum(words).over(Window.partitionBy(*_KEY).orderBy("mark")))
    near = keep(near.withColumn("again", F.col("upto") <= F.col("rest")), "edges")
    filled = near.groupBy(*_KEY).agg(F.max(F.when(F.col("again"), F.col("mark"))).alias("cut"), F.greatest(F.max(F.when(F.col("again"), F.col("upto"))), F.max("before")).alias("filled"))
    smaller = F.sum(words).over(Window.partitionBy(*_KEY).orderBy("size", "mark", "doc_id")) - words
    fills = near.filter(~F.col("again") & (F.col("size") > 0)).withColumn("smaller", smaller).join(filled, list(_KEY))
    fits = F.floor((F.col("rest") - F.col("filled") - F.col("smaller")) / F.col("size") + 0.5).cast("long")
    fills = fills.withColumn("fill_rows", F.least(fits, F.col("rows"))).filter("fill_rows > 0")
    fills = keep(fills.select(F.col("doc_id").alias("fill_id"), F.col("mark").alias("fill_mark"), "fill_rows", (F.col("fill_rows") < F.col("rows")).alias("fill_part")), "fills")
    cut = table.join(filled.select(*_KEY, "cut"), list(_KEY), "left")
    # buckets before the edge are taken whole, those behind it not at all
    last = F.when(F.col("before") + F.col("bucket_size") <= F.col("rest"), F.lit(2**63 - 1)).when(F.col("before") < F.col("rest"), F.coalesce("cut", F.lit(-1))).otherwise(F.lit(-1))
    return keep(cut.withColumn("last", F.when(F.col("rest") > 0, last).otherwise(F.lit(-1))).drop("cut"), "plan"), fills


def _small(df: DataFrame, most: int) -> DataFrame:
    """df to be broadcast if it has at most that many rows; else as it is, for Spark to join by shuffle and split what is hot."""
    return F.broadcast(df) if df.count() <= most else df


def _some(rows: DataFrame) -> DataFrame:
    """Of equal rows the first fill_rows have `fill`. They are numbered by where they lie in a written table, in each part of it and then over parts, so equal rows are no task's work."""
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id()), "equal")
    key = (*_KEY, "doc_id", "mark")
    rows = rows.withColumn("part", F.shiftright("row", 33)).withColumn("nth", F.row_number().over(Window.partitionBy(*key, "part").orderBy("row")))
    parts = rows.groupBy(*key, "part").agg(F.count("*").alias("n"))
    parts = parts.select(*[F.col(c).alias(f"{c}_") for c in (*key, "part")], (F.sum("n").over(Window.partitionBy(*key).orderBy("part")) - F.col("n")).alias("ahead"))
    met = F.lit(True)
    for c in (*key, "part"):
        met &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    found = rows.join(parts, met)
    return found.withColumn("fill", F.col("ahead") + F.col("nth") <= F.col("fill_rows")).select(*[c for c in rows.columns if c not in ("row", "part", "nth")])


def placed(docs: DataFrame, table: DataFrame, fills: DataFrame, curriculum: tuple, max_buckets: int) -> DataFrame:
    """docs (with has_source, source_key, doc_id, mark) with copies, positions and their source's columns of the table."""
    rows = docs.join(_small(table.select(*_KEY, "buckets").distinct(), max_buckets), list(_KEY)).withColumn("bucket", _bucket()).drop("buckets")
    rows = rows.join(_small(table, 2 * max_buckets), [*_KEY, "bucket"])
    rows = rows.join(_small(fills, 2 * max_buckets), rows["doc_id"].eqNullSafe(fills["fill_id"]) & (rows["mark"] == fills["fill_mark"]), "left")
    rows = rows.withColumn("fill", F.col("fill_mark").isNotNull())
    if fills.filter("fill_part").limit(1).count():
        part = F.coalesce("fill_part", F.lit(False))
        rows = rows.filter(~part).unionByName(_some(rows.filter(part)))
    fill = F.col("fill")
    again = fill | (F.col("mark") <= F.col("last"))
    rows = rows.withColumn("copies", F.col("whole") + again.cast("long"))
    # words of the source up to a copy; those that fill are spread over the last, partial turn
    place = F.col("mark") / F.lit(_MARKS)
    own = F.col("before") + (place * F.col("buckets") - F.col("bucket")) * F.col("bucket_size")
    spot = F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda e: (e * F.col("source_size") + F.when(fill & (e == F.col("whole")), place * F.col("rest")).otherwise(own)) / F.greatest("target", F.lit(1.0)))
    rows = rows.withColumn("spots", F.when(F.col("copies") > 0, spot).otherwise(F.array().cast("array<double>")))
    at = None
    for k, shape in reversed(list(enumerate(curriculum))):
        here = F.transform("spots", _placed(shape))
        at = here if at is None else F.when(F.pmod("turn", F.lit(len(curriculum))) == k, here).otherwise(at)
    return rows.withColumn("positions", at)


def mix(docs: DataFrame, *, ratio: float = 1.5, max_repeats: float = 2.0, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), curriculum: tuple = CURRICULUM, rows_per_bucket: int = 4_000, max_buckets: int = 50_000, seed: int = 17) -> DataFrame:
    """Per document: doc_id, source, mark, size, source_size, target, copies, taken, positions.

    docs has doc_id, source and text; texts are read once, for their size and mark, and don't
    go along. The rows are not sorted yet; see in_order().
    """
    sized = keep(_keyed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _mark(seed).alias("mark"))), "sized")
    table, fills = plan(sized, ratio, max_repeats, cycle, rows_per_bucket, max_buckets)
    rows = placed(sized, table, fills, curriculum, max_buckets)
    return rows.select("doc_id", "source", "mark", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "positions")


def in_order(mixed: DataFrame) -> DataFrame:
    """Documents range-sorted by their first position; those that the mix leaves out come last."""
    first = F.try_element_at("positions", F.lit(1)).alias("position")
    return mixed.select("*", first).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def schedule(mixed: DataFrame) -> DataFrame:
    """The training order: a row per copy, range-sorted by position."""
    return mixed.select(*[c for c in mixed.columns if c != "positions"], F.posexplode("positions").alias("copy", "position")).orderBy("position", "doc_id", "copy")


def mixture(docs: DataFrame, *, ratio: float = 1.5, max_repeats: float = 2.0, cycle: tuple[float, ...] = (5.0, 2.0, 1.0), curriculum: tuple = CURRICULUM, rows_per_bucket: int = 4_000, max_buckets: int = 50_000, seed: int = 17) -> DataFrame:
    """The rows of docs as the mix takes them: a row per copy, range-sorted by position. Texts are shuffled once, into order."""
    sized = keep(_keyed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _mark(seed).alias("mark"))), "sized")
    table, fills = plan(sized, ratio, max_repeats, cycle, rows_per_bucket, max_buckets)
    whole = docs.select("doc_id", "source", _mark(seed).alias("mark"), F.struct(*[F.col(c) for c in docs.columns]).alias("row_"))
    rows = placed(_keyed(whole), table, fills, curriculum, max_buckets)
    rows = rows.select("doc_id", "row_", F.posexplode("positions").alias("copy", "position")).orderBy("position", "doc_id", "copy")
    return rows.select(*[F.col("row_").getField(c).alias(c) for c in docs.columns])
