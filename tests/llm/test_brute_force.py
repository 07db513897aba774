"""The parts that learn and compare, against enumeration, numeric derivatives and plain loops."""

import itertools
import random

import numpy as np
import pytest

from strataslide.llm import imatch, licenses, pii, toxicity


def _paths(scores, trans, start):
    """Every label path of a time x labels score, with its sum."""
    steps, n = scores.shape
    for path in itertools.product(range(n), repeat=steps):
        yield path, start[path[0]] + sum(scores[t, k] for t, k in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))


def _loss(scores, gold, trans, start):
    """Mean negative log likelihood over a batch, all paths enumerated."""
    total = 0.0
    for b in range(scores.shape[1]):
        sums = dict(_paths(scores[:, b], trans, start))
        total += np.log(sum(np.exp(s) for s in sums.values())) - sums[tuple(gold[:, b])]
    return total / scores.shape[1]


def _numeric(f, x, eps=1e-5):
    out = np.zeros_like(x)
    for at in np.ndindex(*x.shape):
        was = x[at]
        x[at] = was + eps
        high = f()
        x[at] = was - eps
        out[at] = (high - f()) / (2 * eps)
        x[at] = was
    return out


def test_crf_gradients_and_best_path():
    rng = np.random.default_rng(1)
    scores, gold = rng.normal(size=(4, 3, 4)), rng.integers(0, 4, (4, 3))
    trans, start = rng.normal(size=(4, 4)), rng.normal(size=4)
    d, dtrans, dstart = pii._crf(scores, gold, trans, start)
    loss = lambda: _loss(scores, gold, trans, start)
    for got, x in ((d, scores), (dtrans, trans), (dstart, start)):
        assert np.allclose(got, _numeric(loss, x), atol=1e-6)
    tagger = pii.Tagger({"trans": trans, "start": start})
    for b in range(3):
        best = max(_paths(scores[:, b], trans, start), key=lambda p: p[1])[0]
        assert tagger.decode(scores[:, b]) == list(best)


def test_lstm_gradients():
    rng = np.random.default_rng(2)
    x, wx, wh, b = rng.normal(size=(5, 2, 3)), rng.normal(size=(3, 8)), rng.normal(size=(2, 8)), rng.normal(size=8)
    weight = rng.normal(size=(5, 2, 2))
    out, kept = pii._lstm(x, wx, wh, b)
    found = pii._lstm_back(x, wx, wh, kept, weight)
    for got, of in zip(found, (x, wx, wh, b), strict=True):
        assert np.allclose(got, _numeric(lambda: float((pii._lstm(x, wx, wh, b)[0] * weight).sum()), of), atol=1e-6)


def test_windows_are_averaged_over_a_region():
    """A region's scores are the mean of all windows that hold a character, whatever else is scored beside it."""
    rng = np.random.default_rng(3)
    sizes = {"emb": (pii.N_CHARS, 4), "fx": (4, 12), "fh": (3, 12), "fb": (12,), "bx": (4, 12), "bh": (3, 12), "bb": (12,), "out": (6, len(pii.LABELS)), "ob": (len(pii.LABELS),), "trans": (len(pii.LABELS),) * 2, "start": (len(pii.LABELS),)}
    tagger = pii.Tagger({k: rng.normal(size=s) for k, s in sizes.items()})
    texts = ["", "call 555 " * 40, "no digits", "1" * 200, "x@y " * 30]
    alone = [pii.add_spans([t], [[]], tagger)[0] for t in texts]
    assert pii.add_spans(texts, [[] for _ in texts], tagger, batch=3) == alone
    (a, b), = pii.regions(texts[1])
    mean, n = np.zeros((b - a, len(pii.LABELS))), np.zeros(b - a)
    for at in range(0, b - a, pii.STRIDE):
        if at and at + pii.STRIDE > b - a + pii.STRIDE - 1:
            break
        ids = np.full((1, pii.WINDOW), pii.N_CHARS - 1)
        part = pii.char_ids(texts[1][a + at : min(b, a + at + pii.WINDOW)])
        ids[0, : len(part)] = part
        mean[at : at + len(part)] += tagger.emissions(ids)[0, : len(part)]
        n[at : at + len(part)] += 1
        if at + pii.WINDOW >= b - a:
            break
    path = tagger.decode(mean / n[:, None])
    want, at = [], 0
    while at < len(path):
        end = at + 1
        if path[at] % 2:
            while end < len(path) and path[end] == path[at] + 1:
                end += 1
            kind = pii.KINDS[path[at] // 2]
            if pii._added_ok(kind, texts[1][a + at : a + end]):
                want.append((kind, a + at, a + end))
        at = end
    assert alone[1] == want


def _plain_fingerprint(text, lexicon):
    """By the definition: per level and seed the hash of the sorted terms whose mixed hash ends in that many zero bits."""
    from xxhash import xxh32_intdigest, xxh64_intdigest

    every = sorted(xxh64_intdigest(w.encode()) for w in set(text.lower().split()))
    held = [h for h in every if h in lexicon]
    sections = [("b" if len(held) >= 8 else "s", held), ("a", every if len(held) < 32 else [])]
    out = []
    for mode, h in sections:
        if not h:
            continue
        low = max(0, max(0, (max(len(h) - 1, 0) // 2).bit_length()) - 1)
        out.append(f"{mode}{low:02d}")
        for level in range(low, low + imatch.LEVELS):
            for s in range(imatch.SEEDS):
                odd = int(imatch._ODD[s])
                some = [x for x in h if (x * odd % 2**64 >> 20) % 2**level == 0]
                out.append(f"{xxh32_intdigest(b''.join(x.to_bytes(8, 'little') for x in some)) % (2**32 - 1) + 1:08x}" if some else "0" * 8)
    return "".join(out) or "e"


def test_fingerprints_by_definition_and_likeness():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    from xxhash import xxh64_intdigest

    lexicon = np.sort(np.array([xxh64_intdigest(w.encode()) for w in words[:1500]], np.uint64))
    make = imatch.Maker(lexicon)
    known = set(lexicon.tolist())
    for n in (0, 1, 5, 9, 40, 300):
        text = " ".join(rng.choice(words) for _ in range(n))
        assert make.fingerprint(text) == _plain_fingerprint(text, known) == make.fingerprint(text.upper())
    # likeness falls with the share of terms that are replaced, and is nothing where none is left
    mean = {}
    for share in (0, 10, 50, 100):
        found = []
        for _ in range(40):
            terms = rng.sample(words[:1500], 120)
            kept = terms[: len(terms) * (100 - share) // 100]
            other = kept + rng.sample([w for w in words[:1500] if w not in terms], len(terms) - len(kept))
            a, b = make.fingerprint(" ".join(terms)), make.fingerprint(" ".join(rng.sample(other, len(other))))
            assert imatch.likeness(a, b) == imatch.likeness(b, a)
            found.append(imatch.likeness(a, b))
        mean[share] = sum(found) / len(found)
    assert mean[0] == 1 and 0.55 < mean[10] < 0.95 and 0.05 < mean[50] < 0.5 and mean[100] < 0.02
    assert mean[0] > mean[10] > mean[50] > mean[100]


def test_likeness_has_no_step_at_the_least_number_of_terms():
    """Texts that differ in one lexicon term, or in a share of all words, whatever the number of lexicon terms."""
    rng = random.Random(14)
    from xxhash import xxh64_intdigest

    band = [f"w{k}" for k in range(600)]
    make = imatch.Maker(np.sort(np.array([xxh64_intdigest(w.encode()) for w in band], np.uint64)))
    rest = [f"x{k}" for k in range(4000)]
    for n in (1, 5, 7, 8, 9, 16, 20):
        found = {5: [], 10: [], 50: []}
        for _ in range(30):
            some, other = rng.sample(band, n), rng.sample(rest, 200)
            one = make.fingerprint(" ".join(some + other))
            if n < 8:  # few terms: all words tell
                assert imatch.likeness(one, make.fingerprint(" ".join(some + [rng.choice(band)] + other))) > 0.75
                assert imatch.likeness(one, make.fingerprint(" ".join(some[1:] + other))) > 0.75
            for share, likes in found.items():
                swap = lambda x, pool: [rng.choice(pool) if rng.random() * 100 < share else w for w in x]  # noqa: E731, B023
                likes.append(imatch.likeness(one, make.fingerprint(" ".join(swap(some, band) + swap(other, rest)))))
        mean = {share: sum(x) / len(x) for share, x in found.items()}
        assert mean[5] > 0.5 and mean[5] > mean[10] > mean[50] and mean[10] > 0.35 and mean[50] < 0.5, (n, mean)
    eight = rng.sample(band, 8)
    other = rng.sample(rest, 200)
    assert imatch.likeness(make.fingerprint(" ".join(eight + other)), make.fingerprint(" ".join(eight[1:] + other))) > 0.8


def test_alignment_reaches_the_best_local_score():
    """Within a band as wide as the template, the matches are those of some best local alignment."""
    rng = random.Random(6)
    for _ in range(60):
        template = [rng.randint(0, 5) for _ in range(rng.randint(3, 9))]
        doc = [rng.randint(0, 6) for _ in range(rng.randint(1, 14))]
        s = licenses.Scanner({"t": "a b c"}, band=30)
        best, ways = 0, {0}
        table = {}
        for i in range(len(doc) + 1):
            for j in range(len(template) + 1):
                cells = {(0, 0)}
                if i and j:
                    same = doc[i - 1] == template[j - 1]
                    cells |= {(v + (2 if same else -1), m + same) for v, m in table[i - 1, j - 1]}
                if i:
                    cells |= {(v - 1, m) for v, m in table[i - 1, j]}
                if j:
                    cells |= {(v - 1, m) for v, m in table[i, j - 1]}
                top = max(v for v, _ in cells)
                table[i, j] = {c for c in cells if c[0] == top and top >= 0}
                if top > best:
                    best, ways = top, set()
                if top == best:
                    ways |= {m for v, m in table[i, j]}
        assert s._align(doc, template, 0)[0] in ways


@pytest.mark.parametrize("gap", [0.35, 1.0])
def test_tail_of_chance_scores(gap):
    """lambda solves its equation, and K gives back the mean number of clean segments at the least score."""
    model = toxicity.Model({"a ": 2.0, "b ": 1.0}, gap, 1.0, 1.0, (0.0, 0.0, 0.0))
    seen = {0.0: 999, 2.0: 10, 1.0: 30, -1.0: 35}
    m = toxicity._tail(model, seen)
    share = {2.0: 10 / 1000, 1.0: 31 / 1000}
    assert sum(p * np.exp(m.decay * s) for s, p in share.items()) + (1 - sum(share.values())) * np.exp(-m.decay * gap) == pytest.approx(1, abs=1e-6)
    assert m.scale * 1000 * np.exp(-m.decay * 1.0) == pytest.approx(35.5)
