"""Each operator against a brute-force version, and its defined results for odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataslide.llm import imatch, licenses, mixing, packing, pii, queries, simhash, tokens, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, rank string, bucket double"
LONG = "spam " * 9000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ids that are shared, clashing column names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 1, 1, "x", 0.5), (1, "The quick brown fox jumps over the lazy dog", "en", "a", 1, 1, "x", 0.5),
        (2, "", None, "a", None, None, None, None), (3, None, None, None, None, None, None, None), (None, "no id here", None, "b", None, 2, "y", None),
        (4, LONG, "en", "b", None, None, None, None), (5, "Ünïcödé ½ «x» ́ 数学 <|endoftext|> it's 'T", "fr", None, 3, None, None, None), (2, "another text of two", None, "c", None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_ids_equal_the_tokenizers(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    texts = [r["text"] for r in docs.select("text").limit(60).collect()]
    texts += ["", " \n", "It's I'M 's<|endoftext|>x", "½ a½b İstanbul ſ K Å", "x\x1cy\x0bz", "\"'s ''re", "数学abc１２", "L’été – œuvre…", "\x7f\x00"]
    for text, raw in zip(texts, tokens.chunk_tokenizer("word_bpe_49k.json").ids(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_pieces_are_cut_and_found_by_array():
    """The same ids as the tokenizer's, whatever the cache holds, for less time than a look at each piece."""
    from tokenizers import Tokenizer

    path, rng = tokens.tokenizer_path("word_bpe_49k.json"), random.Random(5)
    t = Tokenizer.from_file(path)
    signs = "'" * 5 + "srtvemlld \n\t0189abz.,!<|>éßÀ–’€÷Σ学\x0b\x01　"
    for most, group in ((1_000_000, 2_000_000), (40, 300)):  # in the second the cache is emptied over and over
        tok = tokens.ChunkTokenizer(path, most)
        for _ in range(12):
            texts = ["".join(rng.choices(signs, k=rng.choice((0, 1, 3, 40)))) for _ in range(25)] + ["a" * 17 + "'ll", "b" * 16 + "!" * 30]
            for text, raw in zip(texts, tok.ids(texts, group), strict=True):
                assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text

    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=400)) + "." for _ in range(500)]
    tok, piece = tokens.ChunkTokenizer(path), re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~¡«»¿°–—‘’“”…€]+")
    known = dict(zip([*words, "."], tok.ids([*words, "."]), strict=True))

    def by_piece():
        cuts = [piece.findall(x.lower()) for x in texts]
        assert known.keys() >= set().union(*cuts)
        return [b"".join(map(known.__getitem__, c)) for c in cuts]

    def took(f):
        began = time.process_time()
        return f(), time.process_time() - began

    plain, fast = [min((took(f) for _ in range(4)), key=lambda x: x[1]) for f in (by_piece, lambda: list(tok.ids(texts)))]
    assert fast[0] == plain[0]
    assert fast[1] < 0.75 * plain[1], (fast[1], plain[1])


def _fits(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(60):
        cap = rng.choice((10, 64, 100))
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 300)))
        rooms: list[int] = []
        for length in sorted(counts.elements(), reverse=True):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(cap - length)
        rows = []
        for length, first, end, seq, per, offset in packing.plan(dict(counts), cap):
            rows += [{"sequence_id": seq + k // per, "offset": offset + k % per * length, "length": length} for k in range(end - first)]
        assert Counter(r["length"] for r in rows) == counts
        assert _fits(rows, cap) == len(rooms)


@pytest.mark.parametrize("per_bucket", [50_000, 1])
def test_packing(spark, odd, per_bucket):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    got = packing.pack(odd, capacity=64, with_ids=True, rows_per_bucket=per_bucket).collect()
    _fits(got, 64)
    want = []
    for r in odd.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r["doc_id"], k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)
    whole = packing.sequences(packing.pack(odd, capacity=64, with_ids=True)).collect()
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole)
    assert packing.pack(odd.limit(0)).count() == 0


def _targets(sizes, weights, ratio=1.5, most=2.0):
    left, open_, out = ratio * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[k] for k in open_)
        over = [k for k in open_ if level * weights[k] > most * sizes[k] + 1e-9]
        if not over:
            for k in open_:
                out[k] = level * weights[k]
            break
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
            open_.remove(k)
    return out


def test_mixing(spark, odd):
    rng = random.Random(1)
    rows = [(k, "w " * rng.choice((0, 1, 3, 20, 60)), f"s{min(6, rng.randint(0, 12))}" if k % 11 else None) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.in_order(mixing.mix(docs, rows_per_bucket=37)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, _targets([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]])
        assert r["taken"] <= 2 * r["size"] and len(r["positions"]) == r["copies"] and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 60
    firsts = [r["position"] for r in got if r["position"] is not None]
    assert firsts == sorted(firsts)
    again = mixing.in_order(mixing.mix(docs, rows_per_bucket=37)).collect()
    assert [(r["doc_id"], r["taken"], r["position"]) for r in again] == [(r["doc_id"], r["taken"], r["position"]) for r in got]
    assert mixing.mix(odd.limit(0)).count() == 0
    assert {r["size"] for r in mixing.mix(odd).filter("doc_id = 3").collect()} == {0}
    whole = mixing.mixture(odd)
    assert whole.columns == odd.columns
    times = Counter((r["doc_id"], r["text"]) for r in whole.collect())
    want = Counter()
    for r in mixing.mix(odd).select("mark", "copies").join(odd.select("doc_id", "text", mixing._mark(17).alias("mark")).distinct(), "mark").collect():
        want[r["doc_id"], r["text"]] += r["copies"]
    assert times == +want
    assert [r["doc_id"] for r in mixing.mixture(docs).collect()] == [r["doc_id"] for r in mixing.schedule(mixing.mix(docs)).collect()]
    plan = mixing.in_order(mixing.mix(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("shape", mixing.CURRICULUM + ((0.0, 1.0), (1.0, 0.0), (0.0, 2.0, 0.0, 1.0)))
def test_positions_invert_the_demand(spark, shape):
    got = spark.range(101).select((F.col("id") / 100).alias("u")).select("u", mixing._inverse(F.col("u"), shape).alias("t")).collect()
    t = np.linspace(0, 1, 200_001)
    w = np.interp(t, np.linspace(0, 1, len(shape)), shape)
    demand = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
    demand /= demand[-1]
    for r in got:
        assert abs(np.interp(r["t"], t, demand) - r["u"]) < 1e-4


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 14 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            if ok:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_the_patterns(docs):
    rng = random.Random(2)
    texts = ["".join(rng.choice("0123456789.. +-()@ab%\n") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["+1 234 567 8901+2 345.678.9012", "a@b.c@d.e", "@a.b x@y", "1.2.3.4.5.6.7.8", "4785380592391139", "9" * 20000, "a@" * 5000, ""]
    for text in texts:
        assert pii.base_spans(text) == _spans(text)


def test_pii_model_on_held_out_forms(spark, docs, odd):
    tagger = pii.fit(docs, max_fit_windows=200)
    held = pii.made_up(200, seed=99)
    found = pii.add_spans([t for t, _ in held], [[] for _ in held], tagger)
    want = {(k, *s) for k, (_, spans) in enumerate(held) for s in spans}
    got = {(k, *s) for k, spans in enumerate(found) for s in spans}
    assert len(want & got) >= 0.85 * len(want) and len(want & got) >= 0.9 * len(got)
    rows = pii.find(docs, tagger, ("doc_id", "text")).collect()
    for r in rows:
        base = _spans(r["text"])
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest() and r["n_ip"] == sum(s[0] == "ip" for s in base)
        assert {pii.joined([s]) for s in base} <= set(r["spans"].split(","))  if base else True
    masked = pii.mask(odd, tagger).collect()
    assert [r["text"] for r in masked] == [r["text"] for r in odd.collect()]
    assert pii.find(odd.limit(0), tagger).count() == 0


def test_imatch(spark, docs, odd):
    lex = imatch.lexicon(docs)
    n = docs.count()
    df = Counter(w for r in docs.select("text").collect() for w in set(imatch.terms(r["text"])))
    from xxhash import xxh64_intdigest

    assert sorted(xxh64_intdigest(w.encode()) for w, c in df.items() if max(2, 0.0005 * n) <= c <= max(2, 0.02 * n)) == lex.tolist()
    rows = sorted(docs.select("doc_id", "text").collect())
    got = sorted(imatch.against_next(docs, lex).collect())
    make = imatch.Maker(lex)
    for k, (a, r) in enumerate(zip(rows, got, strict=True)):
        new = imatch.edit(a["text"], rows[(k + 1) % len(rows)]["text"])
        assert r["n_chars"] == len(a["text"]) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == make.fingerprint(a["text"]) and r["edited_fingerprint"] == make.fingerprint(new)
    assert np.mean([r["near_edited"] for r in got]) > 10 * np.mean([r["near_next"] for r in got]) and max(r["near_edited"] for r in got) <= 1
    some = imatch.against_next(odd, imatch.lexicon(odd)).collect()
    assert len(some) == odd.count() and {r["fingerprint"] for r in some if not r["n_chars"]} == {"e"}
    assert len({r["fingerprint"] for r in some if r["doc_id"] == 1}) == 1
    assert imatch.against_next(odd.limit(0), imatch.lexicon(odd.limit(0))).count() == 0


def _groups(n, near):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in near(i):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_fingerprint_is_the_contract():
    from xxhash import xxh64_intdigest

    for text in ("", "a", "A b", "a b c d e a b c", "Ä  x\x0by z\tQ", "a " * 40):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxh64_intdigest(g.encode(), 42) for g in grams]
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_forest_spans_the_links(radius):
    rng = np.random.default_rng(1)
    fps = np.array([b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, k, False))) for b in rng.integers(0, 2**63, 5, dtype=np.uint64) for k in [*range(6)] * 20], np.uint64)[:, None]
    near = lambda i: np.flatnonzero(np.bitwise_count(fps[:, 0] ^ fps[i, 0]) <= radius)
    want = _groups(len(fps), near)
    for links in (simhash.forest(fps, radius), simhash.forest(fps, radius, 200) + simhash.forest(fps[:200], radius) + [(200 + a, 200 + b) for a, b in simhash.forest(fps[200:], radius)]):
        own = defaultdict(list)
        for a, b in links:
            own[a].append(b)
        assert _groups(len(fps), lambda i, own=own: own[i]) == want


@pytest.mark.parametrize("block", [4096, 8])
def test_near_duplicates(spark, docs, odd, block):
    base = docs.limit(120).union(docs.select("doc_id", F.concat("text", F.lit(" and more")).alias("text"), "lang", "source", "n_chars").limit(60).withColumn("doc_id", F.col("doc_id") + 1000))
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.near_duplicates(base, block=block).collect()}
    ids = sorted(got)
    fps = np.array([got[i][0] for i in ids], np.int64).view(np.uint64)
    want = _groups(len(ids), lambda i: np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3))
    assert [got[i][1] for i in ids] == [ids[w] for w in want] and len(set(want)) < len(ids)
    some = simhash.near_duplicates(odd).collect()
    assert len(some) == odd.count() and {r["fp"] for r in some if r["doc_id"] == 3} == {0}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_similar_texts(spark, docs, odd):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rng = random.Random(5)
    for k, text in rows[:40]:
        words = text.split()
        for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
            words[at] = "changed"
        rows.append((5000 + k, " ".join(words)))
    held = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    sim = lambda a, b: len(a & b) / max(1, len(a | b))
    want = _groups(len(rows), lambda i: [j for j in range(i) if sim(held[i], held[j]) >= 0.8])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    name = {r["doc_id"]: r["component"] for r in simhash.similar_groups(df).collect()}
    pairs = {(name[k], w) for (k, _), w in zip(rows, want, strict=True)}
    assert len(pairs) <= 1.03 * len(set(want)) and abs(len(set(name.values())) - len(set(want))) <= 0.03 * len(set(want))
    stay = simhash.drop_similar(df).collect()
    assert len(stay) == len(set(name.values())) and {r["doc_id"] for r in stay} >= {min(k for (k, _) in rows if name[k] == c) for c in set(name.values())}
    odd_stay = simhash.drop_similar(odd).collect()
    assert odd_stay and sum(r["doc_id"] == 1 for r in odd_stay) == 1 and sum(r["doc_id"] is None for r in odd_stay) == 1 and odd.columns == simhash.drop_similar(odd).columns


def test_top_k(spark, sf):
    rng = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in np.round(rng.normal(size=12), 1)]) for k in range(400)]
    rows += [(1000 + k, rows[20][1]) for k in range(60)]  # ties
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12), (2080, [3.0]), (None, rows[0][1]), (20, rows[20][1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), query_block=9, step=4).collect()
    q = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            q.setdefault(i, []).append(np.floor(np.array(v, np.float32).astype(float) * 64).astype(int).tolist() + [0] * (12 - len(v)))
    want = []
    for i in q:
        if i % 20 == 0:
            scores = sorted((-int(np.dot(q[i][0], v)), j) for j in q if j != i for v in q[j])[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == sorted(want)
    few = topk.top_k(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")).collect()
    assert len(few) == 4
    assert topk.top_k(spark.createDataFrame(rows[:0], "vec_id long, embedding array<float>")).count() == 0


def test_segments_are_maximal():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(1, 25)
        scores = [rng.choice((0, 0, 0, 1.0, 2.0, 3.5)) for _ in range(n)]
        at = [i for i, s in enumerate(scores) if s]
        full = [s or -0.75 for s in scores]
        found = toxicity.segments(at, [scores[i] for i in at], 0.75)
        # brute force: repeatedly take the best segment (the shortest, leftmost) of what is left
        want = []

        def split(a, b):
            best = max(((sum(full[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] > 1e-9:
                i, j = -best[2], -best[2] - best[1]
                want.append((i, j - 1, round(best[0], 6)))
                split(a, i)
                split(j, b)

        split(0, n)
        assert sorted((a, b, round(s, 6)) for a, b, s in found) == sorted(want)


def test_toxicity(spark, odd):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for k in range(600):
        bad = k % 7 == 0
        words = [word() for _ in range(rng.randint(5, 80))]
        if bad:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(("zorkish", "zorkum", "vilest")) + rng.choice(("", "!", "ly")))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks.filter("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[k]["predicted"], y) for k, y in labels if k % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and any(r["passages"] for r in got.values())
    some = toxicity.score(odd, model, ("doc_id", "rank", "size")).collect()
    assert len(some) == odd.count() and len({r["score"] for r in some if r["doc_id"] in (1, 3)}) == 1
    assert toxicity.reject(odd, model).columns == odd.columns
    nothing = toxicity.fit(docs, marks.filter("doc_id < 0"))
    assert nothing.lexicon == {} and toxicity.score(docs.limit(0), nothing).count() == 0


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.unionByName(spark.createDataFrame([(9001, "http://www.A.example.com:80/x?Q=1#f", "twin"), (9000, "http://b.example.com", "twin"), (9002, None, None), (9003, "", ""), (None, "http://c", "twin"), (9004, "http://c", "é" * 100_000)], "page_id long, url string, html string"))
    archive = warc.write(pages, block_lines=7)
    got = {r["page_id"]: r for r in warc.read(archive, with_payload=True).collect()}
    want = {r["page_id"]: (r["url"], (r["html"] or "").encode()) for r in pages.collect()}
    assert got.keys() == want.keys()
    first = {}
    for i in sorted(want, key=lambda x: (x is None, x)):
        first.setdefault(want[i][1], i)
    for i, (url, payload) in want.items():
        r = got[i]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == warc.digest(payload)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[payload] == i else ("revisit", first[payload]))
        assert bytes(r["payload"]) == (payload if first[payload] == i else b"")
    found = warc.lookup(archive, spark.createDataFrame([("http://www.a.example.com/x?q=1",), ("https://nowhere.example.com",), ("http://c",)], "url string")).collect()
    assert sorted(str(r["page_id"]) for r in found) == ["9001", "9004", "None"]
    assert warc.url_key("https://www.Example.com:443/A") == "com,example,www)/a"
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def test_licenses(spark, odd):
    s = licenses.Scanner(licenses.TEMPLATES)
    filler = "lorem ipsum software dolor the license sit amet " * 30
    for name, text in licenses.TEMPLATES.items():
        found = s.scan(f"{filler}{text} {filler}")
        assert name in [f[0] for f in found]
        hit = next(f for f in found if f[0] == name)
        assert hit[1] == 1.0 and (filler + text)[hit[3] :].startswith(text[:5].lstrip("\"'"))
    words = licenses.TEMPLATES["MIT"].split()
    words[10], words[30:32] = "changed", ["lost"]
    assert [f[0] for f in s.scan(" ".join(words))] == ["MIT"]
    assert s.scan(filler) == [] and s.scan("") == []
    got = licenses.scan(odd).collect()
    assert len(got) == odd.count() and all(r["n_licenses"] == 0 for r in got)


def test_registered():
    numbers = {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES}
    assert numbers == set(range(1, 14))


def test_context_mixing(spark, docs, odd):
    from strataslide.llm import ctxmix

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r for r in ctxmix.score(docs, least_bits=16, most_bits=16, dev_rows=10, blob=50_000, bucket_bytes=20_000).collect()}
    words_in = lambda t: (t or "").encode().lower().split()
    seen = Counter()
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    for i, text in rows:
        if not out[i]:
            seen.update([*words_in(text), None])
    n, v = sum(seen.values()), len(seen)
    for i, text in rows:
        words, r = [*words_in(text), None], got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(words), sum(seen[w] > 0 for w in words), n)
        assert abs(r["base_score"] - sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)) < 1e-6 * abs(r["base_score"])
        assert r["score"] < 0
    assert np.mean([r["bits_per_byte"] for r in got.values() if r["held_out"]]) < 4
    some = ctxmix.score(odd, least_bits=12, most_bits=12).collect()
    assert len(some) == odd.count() and len({r["score"] for r in some if r["doc_id"] == 1}) == 1
    assert {r["n_tokens"] for r in some if r["doc_id"] == 3} == {1}
    assert ctxmix.score(odd.limit(0), least_bits=12).count() == 0


def _mixture(texts, bits, most=40):
    from strataslide.llm import ctxmix

    key, n = ctxmix.triple_counts(ctxmix.utf8(texts))
    code = ctxmix.prefix_code(*ctxmix.common_rows(key, n, most))
    counts = ctxmix.Counts(code, bits)
    counts.add(ctxmix.utf8(texts))
    return ctxmix.start_model(code, bits, tuple(ctxmix.log_odds(counts.counts(k)) for k in range(ctxmix.CONTEXTS)))


def _decisions(code, before, byte):
    """Packed decisions of a byte after two bytes, by hand."""
    out = []
    for row in (int(code.base[before]), int(code.last[before & 255])):
        packed = int(code.own[row + byte])
        out += code.decisions[packed >> 8 : (packed >> 8) + (packed >> 1 & 127)].tolist()
        if not packed & 1:
            return out
    raise AssertionError


def _slow_loss(model, text):
    """A text's loss decision by decision, contexts hashed by hand."""
    from strataslide.llm import ctxmix as m

    full = 2**32 - 1
    data = b"\0" * 5 + text.encode() + b"\xff"
    letter = lambda c: 65 <= (c & ~32) <= 90 or 128 <= c < 255
    xs, nears, gates, bits = [], [], [], []
    for i in range(5, len(data)):
        three = int.from_bytes(data[i - 3 : i], "little") * 0x846CA68B & full ^ 0x5A5A5A5A
        five = int.from_bytes(data[i - 4 : i], "little") * 0x9E3779B1 & full ^ data[i - 5] * 0xC2B2AE35 & full
        at = i
        while at and letter(data[at - 1]):
            at -= 1
        word = sum(((c | 32 if 65 <= c <= 90 else c) + 1) * pow(0x01000193, k, 2**32) for k, c in enumerate(data[at:i])) & full
        word = word * 0xB5297A4D + (data[i - 1] if at == i else 7) & full
        slots = [((h ^ h >> 15) * 0x9E3779B1 & full) >> 32 - model.bits for h in (three, five, word)]
        for d in _decisions(model.code, data[i - 2] << 8 | data[i - 1], data[i]):
            x = [(d >> 3 & 255) - 128, *(int(t[s ^ d >> 11]) for t, s in zip(model.tables, slots, strict=True))]
            xs.append([v / m.SCALE for v in x] + [m.BIAS])
            gates.append((d & 6) + (x[m.CONTEXTS] != 0))
            bits.append(d & 1)
    xs, total = np.array(xs), 0.0
    own, turn, done, block = np.zeros(m.INPUTS), np.zeros(2), 0, 0
    while done < len(xs):
        block += m.BLOCK
        grad, heft, slope, shift = np.zeros(m.INPUTS), 40.0, 0.0, 0.0
        for x, g, bit in zip(xs[done : done + block], gates[done:], bits[done:], strict=False):
            mixed = min(11.9, max(-11.9, float((model.weights[g] + own) @ x)))
            mixed += model.cells[int(mixed + 12)]
            mixed = mixed * (1 + turn[0]) + turn[1]
            p = 1 / (1 + math.exp(-mixed))
            total -= math.log(p if bit else 1 - p)
            grad += (bit - p) * x
            slope += (bit - p) * mixed
            shift += bit - p
            heft += p * (1 - p)
        own += m.RATE * grad / heft
        turn += np.array([0.05 * slope, 0.3 * shift]) / heft
        done += block
    return total


def test_context_mixing_is_a_distribution():
    """Decisions of a byte make a proper prefix code, and a text's loss is that of a plain loop, whatever its batch."""
    from strataslide.llm import ctxmix

    texts = ["the cat sat on the mat. " * k for k in (1, 3, 9, 40)] + ["", "Ünï", "a\0b", "The RAT and\nthe CAT " * 25]
    model = _mixture(texts, 14)
    code = model.code
    for two in [0, 32, 116, *np.flatnonzero(code.base >= 65536)[:5].tolist()]:
        # all bytes have a code; what is missing to one is the escape to bytes that have a code of their own
        covered = sum(2.0 ** -len(_decisions(code, two, b)) for b in range(256))
        assert covered <= 1 + 1e-12 and (code.base[two] >= 65536 or abs(covered - 1) < 1e-12)
    model = ctxmix.adapt(model, ctxmix.utf8(texts[:3]), rounds=1)
    whole = ctxmix.losses(model, ctxmix.utf8(texts))
    for text, x in zip(texts, whole, strict=True):
        assert abs(ctxmix.losses(model, [text.encode()])[0] - x) < 1e-4 * (1 + x)
        assert abs(_slow_loss(model, text) - x) < 1e-3 * (1 + x)
    # the sum over all one-byte texts and ends of the next decision is one: P(a) over a after a prefix
    probs = [np.exp(-ctxmix.losses(model, [bytes([b])])[0]) for b in range(128)]
    assert 0 < sum(probs) <= 1 + 1e-6


def test_context_mixing_counts_every_training_text(spark, monkeypatch):
    """Contexts with a code of their own come from all training texts, and the tables hold those that the start weights are fitted on."""
    from strataslide.llm import ctxmix

    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(30 + k % 9))) for k in range(40)] + [(100 + k, "ЖШ" * 60) for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    train = ctxmix.utf8([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1])
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or send(value))
    ctxmix.score(df, least_bits=14, most_bits=14, dev_rows=10)
    model = next(v for v in sent if isinstance(v, ctxmix.Model))
    code = ctxmix.prefix_code(*ctxmix.common_rows(*ctxmix.triple_counts(train), 1500))
    assert all((getattr(model.code, f) == getattr(code, f)).all() for f in ("base", "own", "last", "decisions"))
    counts = ctxmix.Counts(code, 14)
    counts.add(train)
    for k, table in enumerate(model.tables):
        assert (table == ctxmix.log_odds(counts.counts(k))).all()


def test_context_mixing_fits_every_training_text(spark, monkeypatch):
    """Start weights and map are those of all training texts, each mixed from the other fold's counts, wherever the fit sets out."""
    import dataclasses

    from strataslide.llm import ctxmix

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeäß") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(40 + k % 9)) if k % 7 else "%d;" % k * 60) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    mark = {r["doc_id"]: r["mark"] for r in df.select("doc_id", F.expr("pmod(xxhash64(3, doc_id, text), 1000000)").alias("mark")).collect()}
    fold = [ctxmix.utf8([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 and mark[i] % 2 == f]) for f in (0, 1)]
    sent, send = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or send(value))

    def model(**how):
        sent.clear()
        ctxmix.score(df, least_bits=14, most_bits=14, **how)
        return next(v for v in sent if isinstance(v, ctxmix.Model))

    def step(weights, cells):
        """Newton's step from all training texts, told one at a time."""
        sums = {}
        for f in (0, 1):
            other = ctxmix.Counts(found.code, 14)
            other.add(fold[1 - f])
            known = dataclasses.replace(found, tables=tuple(ctxmix.log_odds(other.counts(k)) for k in range(ctxmix.CONTEXTS)), weights=weights, cells=cells)
            for text in fold[f]:
                ctxmix.losses(known, [text], part := {})
                sums = {k: v + sums.get(k, 0) for k, v in part.items()}
        change = np.array([np.linalg.solve(h + 5 * np.eye(ctxmix.INPUTS), g) for g, h in zip(sums["grad"], sums["curve"], strict=True)])
        return weights + change, 0.5 * sums["push"] / (sums["spread"] + 20), (change * sums["grad"]).sum() / 2 / math.log(2)

    # whatever few texts the fit sets out from, it ends where a step of all texts promises next to nothing
    none = np.zeros(ctxmix.CELLS, np.float32)
    found = model(dev_rows=4)
    weights, cells, promise = step(found.weights, none)
    assert promise < 2e-3 * sum(len(t) + 1 for f in fold for t in f) and abs(found.cells - cells).max() < 0.15
    # one step from the fixed start is the step of all texts
    found = model(dev_rows=0, gain=1e9)
    weights, cells, _ = step(ctxmix.start_model(found.code, 14, found.tables).weights, none)
    assert abs(found.weights - weights).max() < 1e-4 and abs(found.cells - cells).max() < 1e-4
    # and more steps lead to the same model from either start
    texts = ctxmix.utf8([t for _, t in rows])
    near, far = (ctxmix.losses(model(dev_rows=n, gain=1e-9, rounds=12), texts) for n in (4, 0))
    assert abs(near.sum() / far.sum() - 1) < 1e-3


def test_context_mixing_of_a_text_that_turns():
    """A long text that is told well, then isn't, has a finite score."""
    from strataslide.llm import ctxmix

    model = _mixture(["the cat sat on the mat. " * 40] * 30, 14)
    text = ctxmix.utf8(["the cat sat on the mat. " * 2000 + "the mat sat on the cat. " * 2000])
    assert 0 < ctxmix.losses(model, text)[0] < 6 * len(text[0])


def test_context_counts_beyond_a_byte():
    """Slots that a byte can't hold keep their whole counts, over many settlements, packed and unpacked."""
    from strataslide.llm import ctxmix

    texts = ctxmix.utf8(["abab " * 400, "the end"])
    code = _mixture(["abab the end " * 5], 12).code
    counts, every = ctxmix.Counts(code, 12, hold=500), [np.zeros((2, 1 << 12), np.int64) for _ in range(ctxmix.CONTEXTS)]
    for _ in range(60):
        counts.add(texts)
    data, lengths = ctxmix._join(texts)
    at, first, size, _ = ctxmix._expand(code, data, ctxmix._places(lengths))
    for k, context in enumerate(ctxmix._contexts(data)):
        for place, a, n in zip(at.tolist(), first.tolist(), size.tolist(), strict=True):
            for d in code.decisions[a : a + n].tolist():
                every[k][d & 1, int(ctxmix._slots(context[place : place + 1], 12)[0]) ^ d >> 11] += 60
        assert (counts.counts(k) == every[k]).all() and every[k].max() > 10_000
    packed = dict(counts.rows(10))
    for k in range(ctxmix.CONTEXTS):
        got = np.zeros((2, 1 << 12), np.int64)
        for shard in range(4):
            if 4 * k + shard in packed:
                slot, n = ctxmix._unpack(packed[4 * k + shard])
                got[:, 1024 * shard + slot] = n
        assert (got == every[k]).all()


def test_context_mixing_inputs():
    """Three contexts are hashed, the three bytes before being one, and each input of a text's mixture has a weight that adapts."""
    import dataclasses
    import inspect

    from strataslide.llm import ctxmix

    data = np.frombuffer(b"\0\0\0\0\0qabcx, zabcx; yabdx\xff", np.uint8)
    at = [i + 3 for i in range(len(data)) if data[i : i + 2].tobytes() == b"ab"]
    three = ctxmix._contexts(data)[0]
    assert three[at[0]] == three[at[1]] != three[at[2]] and ctxmix.CONTEXTS == len(ctxmix._contexts(data)) == 3
    assert inspect.signature(ctxmix.score).parameters["least_bits"].default >= 22
    texts = ["the cat sat on the mat. " * 40]
    unseen = dataclasses.replace(_mixture(texts, 12), tables=(np.zeros(1 << 12, np.int8),) * 3)
    moved, rate = ctxmix.losses(unseen, ctxmix.utf8(texts)), ctxmix.RATE.copy()
    for k in (0, ctxmix.INPUTS - 1):  # the code's own odds and the bias
        ctxmix.RATE[k] = 0
        assert abs(ctxmix.losses(unseen, ctxmix.utf8(texts)) - moved).max() > 1e-3
        ctxmix.RATE[:] = rate


@pytest.mark.parametrize("block", [4096, 8])
def test_similar_texts_are_linked_by_exact_similarity(spark, block):
    """Pairs just above and below 0.8 are told apart, and repeated lines don't part copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    rows, want = [], []
    for k in range(50):  # a text and its first words: m - 4 of n - 4 shingles
        n, m = 204, 164 - k % 2
        words = [word() for _ in range(n)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:m]))]
        want.append((m - 4) / (n - 4) >= 0.8)
    words = [word() for _ in range(204)]
    rows += [(900, " ".join(words)), (901, " ".join(words[:100] + words[88:100] * 9 + words[100:]))]
    name = {r["doc_id"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    linked = [name[2 * k] == name[2 * k + 1] for k in range(len(want))]
    assert sum(a and not b for a, b in zip(linked, want, strict=True)) == 0 and sum(b and not a for a, b in zip(linked, want, strict=True)) <= 1
    assert name[900] == name[901]


@pytest.mark.parametrize("name", ["MIT-line", "Apache-2.0-line", "CC-BY-4.0-line", "CC-BY-NC-4.0-line", "GPL-3.0-line"])
@pytest.mark.parametrize("between", ["\n", " x\n", " x y z\n", " x y z x y z x y z\n"])
def test_repeated_notices(name, between):
    """Copies of a short notice that follow each other closely are all found, each with its own span."""
    text = licenses.TEMPLATES[name].rstrip(".")
    want = [(name, k * (len(text) + len(between)), k * (len(text) + len(between)) + len(text)) for k in range(10)]
    assert [(f[0], f[3], f[4]) for f in licenses.Scanner(licenses.TEMPLATES).scan((text + between) * 10)] == want


def test_equal_contexts_are_unfolded_once(monkeypatch):
    """Counting works on distinct runs of decisions, so copies cost little; all counts are whole, also those that a byte can't hold."""
    from strataslide.llm import ctxmix

    rng = random.Random(5)
    raw = [" ".join("".join(rng.choices("abcdef", k=4)) for _ in range(60)).encode() for _ in range(3)]
    code = ctxmix.prefix_code(*ctxmix.common_rows(*ctxmix.triple_counts(raw), 20))
    unfold, sizes = ctxmix._unfold, []
    monkeypatch.setattr(ctxmix, "_unfold", lambda code, first, size: sizes.append(int(size.sum())) or unfold(code, first, size))
    once, often = ctxmix.Counts(code, 17), ctxmix.Counts(code, 17)
    once.add(raw)
    for _ in range(150):
        often.add(raw * 2)
    for seen, times in ((once, 1), (often, 300)):
        rows = dict(seen.rows())
        for k in range(ctxmix.CONTEXTS):
            assert (seen.counts(k) == times * once.counts(k)).all()
            for shard in range(2):
                at, n = ctxmix._unpack(rows[2 * k + shard])
                part = seen.counts(k, shard << 16, shard + 1 << 16)
                assert (part[:, at] == n).all() and part.sum() == n.sum()
    assert sum(sizes) < 3 * ctxmix.CONTEXTS * sum(int(once.counts(k).sum()) for k in range(ctxmix.CONTEXTS)), sum(sizes)


def test_scoring_holds_a_byte_an_input():
    """Decisions wait for their block in a byte an input, in a fit too; the fit's sums are those of a plain loop."""
    import dataclasses
    import tracemalloc

    from strataslide.llm import ctxmix

    texts = ctxmix.utf8([f"the cat sat on the {w}, and so did the {w[::-1]}. " * 12 for w in ("mat", "roof", "stool", "dresser")] * 80)
    code = ctxmix.prefix_code(*ctxmix.common_rows(*ctxmix.triple_counts(texts[:4]), 30))
    counts = ctxmix.Counts(code, 14)
    counts.add(texts[:4])
    model = ctxmix.start_model(code, 14, tuple(ctxmix.log_odds(counts.counts(k)) for k in range(ctxmix.CONTEXTS)))
    for after in (None, {}):
        tracemalloc.start()
        ctxmix.losses(model, texts, after)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 100 * sum(map(len, texts)), most

    # gradients by gate are what the loss of a text of one block gives as its weights move
    text, told = [texts[0][:25]], {}
    assert 0 < ctxmix.losses(model, text, told)[0]
    for gate in range(ctxmix.GATES):
        for k in range(ctxmix.INPUTS):
            moved = [model.weights.astype(np.float32).copy() for _ in range(2)]
            moved[0][gate, k] -= 0.01
            moved[1][gate, k] += 0.01
            low, high = (ctxmix.losses(dataclasses.replace(model, weights=w), text)[0] for w in moved)
            assert abs((low - high) / 0.02 - told["grad"][gate, k]) < 1e-2 * (1 + abs(told["grad"][gate, k])), (gate, k)
            assert told["curve"][gate, k, 0] == told["curve"][gate, 0, k]


def test_context_counts_are_handed_on_once_a_share(spark, monkeypatch):
    """Counting tasks follow the bytes of the texts, not the files they lie in, and the tables are the same."""
    from strataslide.llm import ctxmix

    df = spark.createDataFrame([(k, f"the cat {k % 7} sat on the mat {k % 11}. " * 9) for k in range(120)], "doc_id long, text string").repartition(24)
    tasks, unite, sent, send = [], DataFrame.unionAll, [], spark.sparkContext.broadcast
    monkeypatch.setattr(DataFrame, "unionAll", lambda a, b: tasks.append(a.rdd.getNumPartitions() + b.rdd.getNumPartitions()) or unite(a, b))
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(value) or send(value))
    for count_bytes in (64_000_000, 1_000):
        ctxmix.score(df, least_bits=14, most_bits=14, dev_rows=10, count_bytes=count_bytes)
    assert tasks[0] <= spark.sparkContext.defaultParallelism < tasks[1], tasks
    few, many = (v for v in sent if isinstance(v, ctxmix.Model))
    assert all((a == b).all() for a, b in zip(few.tables, many.tables, strict=True))


def test_fit_sums_are_whole_over_many_settlements():
    """Sums that are held and settled by gate are those of each decision by itself, wherever they are cut."""
    from strataslide.llm import ctxmix

    rng = np.random.default_rng(3)
    grad, curve, sums = np.zeros((ctxmix.GATES, ctxmix.INPUTS)), np.zeros((ctxmix.GATES, ctxmix.INPUTS, ctxmix.INPUTS)), ctxmix.Sums(hold=500)
    cells = np.zeros((2, ctxmix.CELLS))
    scale = np.array([1 / ctxmix.SCALE] * (ctxmix.INPUTS - 1) + [ctxmix.BIAS])
    for rows, wide in ((3, 7), (4, 125), (2, 900), (1, 1), (5, 333)):
        held = rng.integers(-128, 128, (ctxmix.INPUTS, rows, wide)).astype(np.int8)
        held[-1] = rng.choice([0, 1, 2, 5, 7], (rows, wide))  # some gates have none
        push = rng.uniform(-1, 1, (rows, wide)).astype(np.float32)
        cell = rng.integers(0, ctxmix.CELLS, (rows, wide))
        sums.add(held, push, cell)
        cells += [np.bincount(cell.reshape(-1), x.reshape(-1), ctxmix.CELLS) for x in (push, np.abs(push) - push * push)]
        x = np.concatenate([held[:-1].reshape(ctxmix.INPUTS - 1, -1), np.ones((1, rows * wide))]) * scale[:, None]
        for k, (p, gate) in enumerate(zip(push.reshape(-1).astype(float), ctxmix._GATE[held[-1].reshape(-1)], strict=True)):
            grad[gate] += p * x[:, k]
            curve[gate] += (abs(p) - p * p) * np.outer(x[:, k], x[:, k])
    told = sums.told()
    assert abs(told["grad"] - grad).max() < 1e-4 * abs(grad).max() and abs(told["curve"] - curve).max() < 1e-4 * abs(curve).max()
    assert abs(told["push"] - cells[0]).max() < 1e-3 and abs(told["spread"] - cells[1]).max() < 1e-3
