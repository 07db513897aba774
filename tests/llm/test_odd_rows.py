"""Rows that operators must bear: malformed values, clashing columns, repeated ids, equal rows."""

import time

import pytest

from strataslide.llm import simhash, topk, toxicity, warc

PAGES = "page_id long, url string, html string, url_key string, sha1 string, first_id long, at int"


def test_warc_malformed_urls_and_clashing_columns(spark):
    rows = [
        (1, "http://[broken/", "a"), (2, "http://ex℀mple.com/", "b"), (3, " HTTP://[::1/x ", "a"), (4, None, None), (5, "", ""), (5, "", ""), (5, "http://x.org/", "c"),
        (6, "http://x.org:99999/é", "c"), (7, "http://x.org\n/y", "d"), (None, "http://[", "e"), (None, "http://[", "e"), (2**63 - 1, "//x.org", "f"), (-1, "http://user@x.org/?", "f"),
    ]
    pages = spark.createDataFrame([(*r, "k", "s", 7, 3) for r in rows], PAGES)
    archive = warc.write(pages.repartition(3), block_lines=2)
    want = sorted(str((i, len((h or "").encode()), warc.digest((h or "").encode()))) for i, _, h in rows)
    for got in (warc.read(archive), warc.read(archive, pages)):
        assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"])) for r in got.collect()) == want
    assert [warc.url_key(u) for u in ("http://[broken/", " HTTP://[::1/x ", None)] == ["http://[broken/", "http://[::1/x", ""]
    few = warc.read(archive, pages.filter("page_id in (1, 6)"), with_payload=True).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in few) == [(1, "response"), (6, "revisit")]
    assert warc.read(archive, pages.limit(0)).count() == 0
    asked = spark.createDataFrame([("http://x.org/nowhere", 1), ("http://[broken/", 99)], "url string, page_id long")
    assert warc.read(archive, asked).count() == 0


def test_warc_one_key_over_many_blocks_and_files(spark):
    """A key that fills many blocks and a payload that a third of the pages share."""
    rows = [(k, "http://hot.example.com/" if k % 2 else f"http://h{k % 7}.example.com/{k}", "same" if k % 3 == 0 else f"page {k}") for k in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write(pages, block_lines=3)
    got = {r["page_id"]: r for r in warc.read(archive, pages).collect()}
    assert len(got) == 500 and sum(r["record_type"] == "revisit" for r in got.values()) == 166 and {r["refers_to"] for r in got.values()} == {None, 0}
    assert warc.lookup(archive, spark.createDataFrame([("http://hot.example.com/",)], "url string")).count() == 250


def test_segments_take_linear_time():
    """Hits on a falling sum, each a segment of its own: a stack scanned anew for each would take minutes."""
    began = time.perf_counter()
    found = toxicity.segments(list(range(0, 1_000_000, 10)), [1.0] * 100_000, 0.35)
    assert len(found) == 100_000 and time.perf_counter() - began < 2
    rising = toxicity.segments(list(range(0, 200_000, 2)), [1.0] * 100_000, 0.35)
    assert [(a, b) for a, b, _ in rising] == [(0, 199_998)]


def test_toxicity_of_equal_rows(spark):
    docs = spark.createDataFrame([(k, "the same vile text") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    scores = {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(scores) == 1


def test_simhash_of_equal_rows_and_extreme_ids(spark):
    rows = [(2**63 - 1, "one two three four"), (None, "one two three four"), (None, None), (None, ""), (3, "other words are here now"), (3, "other words are here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 6
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    mark = next(fp for i, fp in by if i == 2**63 - 1)
    assert {v for (i, fp), v in by.items() if fp == 0} == {None} and by[(None, mark)] == by[(2**63 - 1, mark)] == 2**63 - 1
    same = spark.createDataFrame([(k, "all rows hold the very same text") for k in range(300)], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(same, block=16).collect()} == {0}


def test_drop_similar_bears_clashing_columns(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(2, text, 1, "a", "x", 5), (1, text + " more", 2, "b", "y", 6), (2**63 - 1, "quite another text of seven words here", 3, "c", "z", 7), (None, "quite another text of seven words here", 4, "d", "w", 8), (None, "alone without an id in this table", 5, "e", "v", 9), (7, None, 6, "f", "u", 1), (7, "shares its id with an empty text", 7, "g", "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own_id int, own_name string, name string, k int")
    got = simhash.drop_similar(docs)
    assert got.columns == docs.columns
    assert sorted(r["own_id"] for r in got.collect()) == [2, 3, 5, 6, 7]
    assert simhash.drop_similar(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(k, text) for k in range(200)] + [(None, text)] * 3, "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.drop_similar(same, block=16).collect()] == [0]


@pytest.mark.parametrize("block", [4096, 8])
def test_near_copies_are_found(spark, block):
    """Recall on planted pairs: all at 0.9 and above, and nearly all from 0.8 on; none that is clearly less alike."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(7))
    rows, want = [], {}
    for k in range(240):
        n = rng.choice((30, 80, 200, 500))
        words = [word() for _ in range(n)]
        other = list(words)
        for at in rng.sample(range(n), max(1, int(n * (k % 6) * 0.012))):
            other[at] = word()
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other)]
        want[k] = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    name = {r["doc_id"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    linked = {k: name[2 * k] == name[2 * k + 1] for k in want}
    assert all(not linked[k] for k, j in want.items() if j < 0.8)
    assert all(linked[k] for k, j in want.items() if j >= 0.9)
    near = [linked[k] for k, j in want.items() if 0.8 <= j < 0.9]
    assert len(near) > 20 and sum(near) >= 0.95 * len(near)


@pytest.mark.parametrize(("scale", "shape"), [(64, "array<float>"), (2**20, "array<double>"), (2**27, "array<double>")])
def test_top_k_of_large_components_and_clashing_columns(spark, scale, shape):
    """Scores in single, double and whole numbers; columns named as the operator's own."""
    import math
    import random

    rng = random.Random(9)
    rows = [(k, [rng.uniform(-3, 3) for _ in range(7)], "x", k, [1], 5) for k in range(90)]
    rows += [(100 + k, rows[3][1], "y", 0, None, 6) for k in range(5)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding {shape}, q string, id int, v array<int>, bound int")
    got = topk.top_k(df.repartition(5), k=4, scale=scale, block=8, query_block=2, step=1).collect()
    import struct

    cast = (lambda x: struct.unpack("f", struct.pack("f", x))[0]) if shape == "array<float>" else float
    v = {r[0]: [math.floor(scale * cast(x)) for x in r[1]] for r in rows}
    want = []
    for i in (k for k in v if k % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[i], v[j], strict=True)), j) for j in v if j != i)[:4]
        want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_top_k_leaves_most_candidates_early():
    """Entries that can't reach the cutoff are not read in all slices."""
    import numpy as np

    rng = np.random.default_rng(2)
    block = rng.integers(-9, 9, (4000, 32)).astype(np.float64)
    block[:, :8] *= 40
    parts = [slice(a, a + 8) for a in range(0, 32, 8)]
    queries, ids = block[:3].copy(), np.arange(4000)
    exact = queries @ block.T
    own = np.zeros_like(exact, bool)
    cutoff = np.sort(exact, axis=1)[:, -20].astype(np.int64)
    row, found, score = topk._resolve(queries, block, parts, own, ids, cutoff, 20)
    assert all(sorted(score[row == q].tolist(), reverse=True) == np.sort(exact[q])[::-1][:20].astype(int).tolist() for q in range(3))
    first = queries[:, parts[0]] @ block[:, parts[0]].T
    alive = first + topk._lengths(queries, parts)[:, 1:] @ topk._lengths(block, parts)[:, 1:].T >= cutoff[:, None]
    assert alive.mean() < 0.1


def test_top_k_of_repeated_ids_and_of_components_beyond_a_long(spark):
    """The same answer in any order of rows, and one large row that ends nothing for the others."""
    import math
    import random

    rows = [(20, [0.0, 1.0]), (20, [1.0, 0.0]), (1, [4.0, 0.0]), (2, [0.0, 6.0])]
    for order in (rows, rows[::-1]):
        got = topk.top_k(spark.createDataFrame(order, "vec_id long, embedding array<float>"), k=1).collect()
        assert [tuple(r) for r in got] == [(20, 1, 2, 64 * 64 * 6)]
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-3, 3) for _ in range(5)]) for k in range(50)]
    rows += [(60, [1e18, 0.0, -2.0, 1e9, 3.5]), (61, [-1e300, 1.0, 1.0, 1.0, 1.0]), (80, [2.0**40, 2.0**41, -(2.0**42), 1.0, 0.25]), (81, [1e-300, 3.0, 0.0, 0.0, 2.0**50])]
    held = lambda x: max(-(2**63 - 1), min(2**63 - 1, x))
    v = {i: [held(math.floor(64 * x)) for x in e] for i, e in rows}
    want = []
    for i in (k for k in v if k % 20 == 0):
        dots = {j: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v[i], v[j], strict=True)))) for j in v if j != i}
        want += [(i, n + 1, j, dots[j]) for n, j in enumerate(sorted(dots, key=lambda j: (-dots[j], j))[:20])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), block=16).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_imatch_keeps_the_least_id_and_null_apart(spark):
    from strataslide.llm import imatch

    rows = [(-(2**63), "least of all"), (None, "none at all"), (5, "five words are in here"), (None, "again none"), (-(2**63), "least again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = imatch.against_next(docs, imatch.lexicon(docs)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i is not None, i or 0, len(t)) for i, t in rows)


def test_mixing_takes_a_part_of_equal_rows(spark):
    """A source that is one repeated row comes as near its target as any other; reruns agree."""
    from collections import Counter

    from strataslide.llm import mixing

    rows = [(7, "a b c d", "one", k) for k in range(400)] + [(1000 + k, "w " * 9, "two", k) for k in range(100)] + [(None, "n n", None, 1)] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int").repartition(5)
    for got in (mixing.mix(docs, rows_per_bucket=50).collect(), mixing.mix(docs, rows_per_bucket=50).collect()):
        by = {}
        for r in got:
            by.setdefault(r["source"], []).append(r)
        assert {s: len(x) for s, x in by.items()} == {"one": 400, "two": 100, None: 200}
        for x in by.values():
            assert abs(sum(r["taken"] for r in x) - x[0]["target"]) <= x[0]["size"] and all(r["taken"] <= 2 * r["size"] for r in x)
            assert max(r["copies"] for r in x) - min(r["copies"] for r in x) <= 1
    mixed = mixing.mixture(docs, rows_per_bucket=50).collect()
    taken = Counter((r["source"], r["doc_id"], r["copy"]) for r in mixed)
    assert sum(n for (s, *_), n in taken.items() if s == "one") == sum(r["copies"] for r in by["one"]) and max(n for (s, *_), n in taken.items() if s == "one") <= 2
    plan = mixing.mix(docs, rows_per_bucket=50)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
