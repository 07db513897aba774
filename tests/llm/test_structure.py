"""Periodic runs, repair of conversations and repeated windows against brute force, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from strataslide.llm import conversations, periodic, queries, substrings, words

SHA_EMPTY = hashlib.sha256(b"").hexdigest()


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# words


@pytest.mark.parametrize("piece", [1 << 19, 7])
def test_words_are_those_of_ascii_white_space(monkeypatch, piece):
    monkeypatch.setattr(words, "PIECE", piece)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\t\x1c\x85é\x00 ") for _ in range(rng.randrange(60)))
        want = [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", text)]
        starts, values = words.hashed(text.encode())
        assert [text.encode()[s : s + len(w)] for s, w in zip(starts, want, strict=True)] == want
        assert all(words.hashed(w)[1][0] == v for w, v in zip(want, values, strict=True))
        _, at = words.hashed_rows([*want, b"", b" x  y "])
        assert np.diff(at).tolist() == [1] * len(want) + [0, 2]


def test_window_polynomials():
    values = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    for size in (1, 2, 3, 5, 20, 31, 50, 51):
        want = [sum(int(values[i + k]) * pow(substrings.BASE, size - 1 - k, 2**64) for k in range(size)) % 2**64 for i in range(50 - size + 1)]
        assert substrings.window_hashes(values, size, substrings.BASE).tolist() == want


# op11


def _runs(ws, exponent=4, least=6):
    """(start, end, smallest period), period by period."""
    out = {}
    for q in range(1, len(ws) // exponent + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def _odd_text(rng):
    some, out = rng.choice([1, 2, 2, 3, 5, 50]), []
    for _ in range(rng.randrange(7)):
        if rng.random() < 0.5:
            base = [str(rng.randrange(some)) for _ in range(rng.randrange(1, 9))]
            out += (base * rng.randrange(2, 9))[: rng.randrange(1, 80)]
        else:
            out += [str(rng.randrange(some)) for _ in range(rng.randrange(30))]
    return rng.choice([" ", "\n\t"]).join(out)


def test_least_overlap():
    assert periodic.least_overlap(4, 6) == 5
    assert periodic.least_overlap(2, 2) == 1


def test_runs_against_every_period():
    rng = random.Random(5)
    for _ in range(300):
        texts = [_odd_text(rng).encode() for _ in range(rng.randrange(1, 6))]
        exponent, least = rng.choice([(4, 6), (4, 6), (2, 4), (3, 3), (2, 2), (4, 9), (5, 6)])
        found, at = periodic.runs_of(texts, exponent, least)
        want = [[s + at[k], e + at[k], q] for k, t in enumerate(texts) for s, e, q in _runs(t.split(), exponent, least)]
        assert found.tolist() == want


def test_words_outside_repeated_grams_are_masked():
    values, at = words.hashed_rows([b"a b c d e x a b c d e y", b"a b c d e"])
    assert periodic.repeated(values, at, 5).astype(int).tolist() == [1] * 5 + [0] + [1] * 5 + [0] + [0] * 5


def _looped(doc_id, ws):
    n = len(ws)
    if doc_id is None or not n or zlib.crc32(str(doc_id).encode()) % 10:
        return ws
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def _op11(doc_id, text):
    ws = _looped(doc_id, re.findall("[^\x20\x09-\x0d]+", text or ""))
    runs = _runs(ws)
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, _sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), _sha(" ".join(w for i, w in enumerate(ws) if i not in drop)))


def test_op11_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice([k, -k, k * 10**15]), _odd_text(rng), "x", 1) for k in range(400)]
    rows += [(1, None, None, None), (2, "", "", 0), (3, "a " * 3000, "s", 0), (3, "a " * 3000, "s", 0), (None, "b " * 9, None, 1), (-(2**63), "c d " * 5, "s", 2), (4, "é\x1cü " * 8, "s", 1)]
    sf = _write(spark, tmp_path, "documents", rows, "doc_id long, text string, runs string, collapsed int")
    got = [tuple(r) for r in queries.op11_periodic(spark, sf).collect()]
    assert sorted(got, key=repr) == sorted((_op11(d, t) for d, t, *_ in rows), key=repr)


def test_op11_of_an_empty_table(spark, tmp_path):
    sf = _write(spark, tmp_path, "documents", [], "doc_id long, text string")
    assert queries.op11_periodic(spark, sf).collect() == []


# op12


def _repair(turns):
    """(cost, audit, repaired) of classified turns [(role, text, gone, cut)] by searching strings of edits, least cost first, then least string."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(turns) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in done:
            continue
        done.add((i, last))
        nxt = step[last]
        heapq.heappush(heap, (cost + 5, audit + "I", i, nxt, (*out, f"{full[nxt]}:")))
        if i < len(turns):
            role, text, gone, cut = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if not gone:
                if role[:1] == nxt or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + 5 * cut, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + 5 * cut, audit + "R", i + 1, nxt, (*out, f"{full[nxt]}:{text}")))
    raise AssertionError


def _op12(conv_id, rows):
    told = lambda x: " " if x is None else str(x)
    turns = []
    for turn, role, text in rows:
        role, text = told(role), told(text)
        kind = zlib.crc32(f"{told(conv_id)}:{told(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, judged, counts = set(), [], [0, 0, 0]
    for _, role, text in turns:
        shown = re.sub("[\x20\x09-\x0d]+", "", text)
        cut = shown[-1:] not in (".", "!", "?")
        fault = 0 if not shown else 1 if (role, text) in seen else 2 if cut else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        judged.append((role, text, fault in (0, 1), fault == 2))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
    known = {t for t, *_ in turns if t is not None}
    cost, audit, out = _repair(judged)
    return (conv_id, max(known) - min(known) + 1 - len(known) if known else 0, *counts, illegal, cost, audit, _sha("\n".join(out)))


def test_op12_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for conv in [*range(500), None, -(2**63)]:
        for turn in sorted(rng.sample(range(-3, 12), rng.randrange(9))) + [None] * (rng.random() < 0.1):
            text = rng.choice(["Yes.", "No!", "", " \n", " ", "cut", "so? \n", "end.\x1c", f"t{turn}.", f"t{turn}", None])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None]), text, 1))
    sf = _write(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string, audit int")
    got = sorted((tuple(r) for r in queries.op12_conversations(spark, sf).collect()), key=repr)
    assert got == sorted((_op12(c, [r[1:4] for r in rows if r[0] == c]) for c in {r[0] for r in rows}), key=repr)


def test_cheapest_audits_against_search():
    rng = random.Random(6)
    for _ in range(3000):
        turns = [(rng.choice(["system", "user", "assistant", "tool"]), "", rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(9))]
        codes = bytes("suat".index(r[0]) + 4 * cut + 8 * gone for r, _, gone, cut in turns)
        assert conversations.cheapest(codes) == _repair(turns)[:2]


def test_a_long_conversation_and_repeated_rows(spark):
    rows = [(7, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(5000)] + [(8, 1, "user", "Hm.")] * 300
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    found = {r.conv_id: r for r in conversations.audits(turns).collect()}
    assert found[7].audit == "K" * 5000 and found[7].cost == found[7].gaps == 0
    assert found[8].audit == "D" * 300 and found[8].duplicate == 299 and found[8].cost == 600
    fixed = conversations.repaired(turns, conversations.audits(turns))
    assert {r.conv_id: r.sha256 for r in conversations.digests(fixed).collect()} == {7: _sha("\n".join(f"{r[2]}:{r[3]}" for r in rows[:5000]))}


def test_op12_of_an_empty_table(spark, tmp_path):
    sf = _write(spark, tmp_path, "conversations", [], "conv_id long, turn long, role string, text string")
    assert queries.op12_conversations(spark, sf).collect() == []


# op13


def _op13(rows, size):
    order = lambda i: (i is not None, i or 0)
    docs = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    least, out = {}, []
    for i, ws in docs:
        for a in range(len(ws) - size + 1):
            key = tuple(ws[a : a + size])
            least[key] = min(least.get(key, order(i)), order(i))
    for i, ws in docs:
        seen, gone = set(), set()
        for a in range(len(ws) - size + 1):
            key = tuple(ws[a : a + size])
            if key in seen or least[key] < order(i):
                gone |= set(range(a, a + size))
            seen.add(key)
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out, key=repr)


def _passages(rng, n, lengths):
    parts = [[str(rng.randrange(50)) for _ in range(rng.randrange(*lengths))] for _ in range(12)]
    for k in range(n):
        text = [w for _ in range(rng.randrange(6)) for w in (rng.choice(parts) if rng.random() < 0.6 else [str(rng.randrange(5)) for _ in range(rng.randrange(20))])]
        yield rng.choice([k, k, k, -k, rng.randrange(40), None, -(2**63)]), rng.choice([" ", "\n", "\x0b"]).join(text)


@pytest.mark.parametrize("size, group_bytes", [(5, 16 << 20), (5, 3000), (20, 2000)])
def test_repeated_windows_against_brute_force(spark, size, group_bytes):
    rng = random.Random(3)
    rows = [*_passages(rng, 200, (3, 60)), *[(1, None), (2, ""), (7, "a " * 500), (3, "é\x1cü " * 30)] * 3]
    docs = spark.createDataFrame([(t, i, 0) for i, t in rows], "text string, doc_id long, grp int")
    found = substrings.remove_repeats(docs, window=size, group_bytes=group_bytes, bucket_bytes=group_bytes // 2).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=repr) == _op13(rows, size)
    for r in found:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))


def test_op13_whole_table_and_empty_table(spark, tmp_path):
    rng = random.Random(9)
    rows = [*_passages(rng, 60, (15, 80)), (5, None)]
    got = queries.op13_substrings(spark, _write(spark, tmp_path, "documents", rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, n, k, _sha(t)) for i, n, k, t in _op13(rows, 20)), key=repr)
    (tmp_path / "none").mkdir()
    assert queries.op13_substrings(spark, _write(spark, tmp_path / "none", "documents", [], "doc_id long, text string")).collect() == []
