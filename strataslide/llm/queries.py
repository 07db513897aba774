"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read, write

    pages = table(spark, sf_dir, "pages")
    return read(write(pages), pages).drop("url")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import in_order, mix

    return in_order(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "position")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find, fit

    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs)).drop("found")


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .imatch import against_next, lexicon

    docs = table(spark, sf_dir, "documents")
    return against_next(docs, lexicon(docs))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_ctxmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctxmix import score

    return score(table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs, labels.filter(~out))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"), "passages")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import find_runs, looped, strongest

    found = find_runs(looped(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import audits, damaged, digests, repaired

    conversations = table(spark, sf_dir, "conversations")
    turns = damaged(conversations)
    found = keep(audits(turns), "audits")
    shas = digests(repaired(turns, found))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    rows = ids.join(found, F.col("id").eqNullSafe(found["conv_id"]), "left").drop("conv_id").join(shas, F.col("id").eqNullSafe(shas["conv_id"]), "left").drop("conv_id")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_pii": op4_pii,
    "op5_imatch": op5_imatch,
    "op6_simhash": op6_simhash,
    "op7_ctxmix": op7_ctxmix,
    "op8_topk": op8_topk,
    "op9_toxicity": op9_toxicity,
    "op10_licenses": op10_licenses,
    "op11_periodic": op11_periodic,
    "op12_conversations": op12_conversations,
    "op13_substrings": op13_substrings,
}

#: Floor of the scaled components as integers; the list is unnested by position, so scores are exact.
OP8_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 20 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: SHA-1 in base32: five bits at a time out of two hexadecimal digits.
OP2_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
    SELECT page_id, octet_length(encode(html)) AS payload_bytes, upper(sha1(html)) AS x, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((instr('0123456789ABCDEF', x[(5 * i) // 4 + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[(5 * i) // 4 + 2]) - 1 >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

#: The cheapest repair as least (cost, audit) a state, one turn a step; crc32 by its table.
OP12_SQL = """
WITH RECURSIVE crc AS (
    SELECT list(list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, k: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) r(i)
), src AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295) % 20 AS kind
    FROM conversations, crc
), dmg AS (
    SELECT conv_id, turn, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE kind <> 0)
), seen AS (
    SELECT *, left(role, 1) AS r, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i
    FROM dmg
), rows_ AS (
    SELECT *, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS extra, r || lead(r) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM seen
), dp AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS s0, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS s1,
        {'c': 5::BIGINT, 'a': 'I', 't': 'user:' || chr(10)} AS s2, {'c': 10::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)} AS s3
    FROM rows_
    UNION ALL
    SELECT conv_id, i, n0, n1, n2, list_min([n3, {'c': n2.c + 5, 'a': n2.a || 'I', 't': n2.t || 'assistant:' || chr(10)}]) FROM (
        SELECT conv_id, i, n0, n1, n3, list_min([n2, {'c': n0.c + 5, 'a': n0.a || 'I', 't': n0.t || 'user:' || chr(10)}, {'c': n1.c + 5, 'a': n1.a || 'I', 't': n1.t || 'user:' || chr(10)}, {'c': n3.c + 5, 'a': n3.a || 'I', 't': n3.t || 'user:' || chr(10)}]) AS n2 FROM (
            SELECT d.conv_id, x.i, {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t} AS n0,
                list_min([{'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t}, {'c': s0.c + CASE WHEN gone OR r <> 's' THEN 1000000000 ELSE extra END, 'a': s0.a || 'K', 't': s0.t || role || ':' || text || chr(10)}]) AS n1,
                list_min(list_prepend({'c': s2.c + 2, 'a': s2.a || 'D', 't': s2.t}, list_transform([s0, s1, s3], lambda s: {'c': s.c + CASE WHEN gone THEN 1000000000 WHEN r = 'u' THEN extra ELSE extra + 1 END, 'a': s.a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END, 't': s.t || CASE WHEN r = 'u' THEN role ELSE 'user' END || ':' || text || chr(10)}))) AS n2,
                list_min([{'c': s3.c + 2, 'a': s3.a || 'D', 't': s3.t}, {'c': s2.c + CASE WHEN gone THEN 1000000000 WHEN r = 'a' THEN extra ELSE extra + 1 END, 'a': s2.a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END, 't': s2.t || CASE WHEN r = 'a' THEN role ELSE 'assistant' END || ':' || text || chr(10)}]) AS n3
            FROM dp d JOIN rows_ x ON x.conv_id IS NOT DISTINCT FROM d.conv_id AND x.i = d.i + 1
        )
    )
), stats AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
        count(*) FILTER (NOT gone AND cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM rows_ GROUP BY conv_id
), ends AS (
    SELECT s.*, list_min([s0, s3]) AS e FROM stats s JOIN dp d ON d.conv_id IS NOT DISTINCT FROM s.conv_id AND d.i = s.n
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(CASE WHEN e.t = '' THEN '' ELSE substr(e.t, 1, length(e.t) - 1) END, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ends n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
"""

#: Windows as lists of words.
OP13_SQL = """
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), win AS (
    SELECT doc_id, i, list_slice(w, i, i + 19) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), late AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), gone AS (
    SELECT DISTINCT doc_id, i + j AS i FROM late, range(20) r(j)
), kept AS (
    SELECT u.doc_id, count(*) AS n_words, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY u.i) AS kept
    FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) u LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.i = u.i
    GROUP BY u.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op8_topk": OP8_SQL,
    "op12_conversations": OP12_SQL,
    "op13_substrings": OP13_SQL,
}
