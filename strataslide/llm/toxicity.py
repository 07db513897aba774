"""Toxic passages as maximal scoring segments of token log-odds.

Training counts, for every word and every prefix of 4 to 7 letters, the toxic and the clean
labelled rows that hold it. A Dirichlet prior centred on the joint rate smooths both rates; keys
whose log-odds are `z_min` standard errors above 0 form the lexicon. A token scores the
log-odds of its longest key in the lexicon, any other token scores -`gap`.

A linear scan finds all maximal scoring segments of a text. Under the clean distribution of
token scores a segment of score S among n tokens is exceeded by chance K n exp(-lambda S)
times (extreme-value statistics); lambda solves sum p exp(lambda s) = 1 and K is set by the
clean rows' segments. A logistic curve over the best and the summed significance, fitted on
the labelled rows, gives the score.

Fitting reads at most about `max_fit_rows` labelled rows, chosen by a hash of doc_id; scoring
reads every text whole. Inputs of a score are the text's words only.

Defined results: a null or empty text has no tokens and gets the score of a text without
passages; labels that are null are not learnt from, several labels of a document count as
toxic if one is; without labelled rows every score is the prior 0.5 less a margin; equal rows
get equal scores; an empty table gives an empty frame.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, keep, map_rows, tidy

_WORDS = re.compile(r"[^\W\d_]+")
_PREFIXES = (7, 6, 5, 4)


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def keys(word: str) -> list[str]:
    """A word's keys, longest first: itself (marked by a final space), then its prefixes."""
    return [word + " ", *[word[:n] for n in _PREFIXES if len(word) > n]]


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    gap: float
    decay: float  #: lambda of the extreme-value law
    scale: float  #: its K
    weights: tuple[float, float, float]
    significant: float = 0.05


def segments(at: list[int], scores: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in order.

    at and scores are the tokens of positive score; every token between two of them costs gap.
    Linear: candidates lie on a stack, each with a link to the nearest one below that starts
    lower. The sums never fall along the links, so a search follows them instead of the whole
    stack, and a candidate that is extended swallows those on top of it.
    """
    stack: list[tuple] = []  # (first, last, sum before, sum with, link)
    total, end = 0.0, None
    for i, s in zip(at, scores, strict=True):
        if end is not None:
            total -= gap * (i - end - 1)
        end = i
        first, low, high, j = i, total, total + s, len(stack) - 1
        total += s
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                # candidates that start no lower than this one can't grow any more, but stay segments
                stack.append((first, i, low, high, j))
                break
            first, _, low, _, link = stack[j]
            del stack[j:]
            j = link
    return [(a, b, after - before) for a, b, before, after, _ in stack]


class Scorer:
    """Scores texts with a model; keeps each word's score."""

    def __init__(self, model: Model, max_cached: int = 300_000):
        self.model, self._max = model, max_cached
        self._known: dict[str, float] = {}

    def token(self, word: str) -> float:
        s = self._known.get(word)
        if s is None:
            if len(self._known) > self._max:
                self._known.clear()
            lexicon = self.model.lexicon
            s = self._known[word] = next((lexicon[k] for k in keys(word) if k in lexicon), 0.0)
        return s

    def hits(self, tokens: list[str]) -> tuple[list[int], list[float]]:
        get, token = self._known.get, self.token
        all_scores = [s if (s := get(w)) is not None else token(w) for w in tokens]
        at = [i for i, s in enumerate(all_scores) if s]
        return at, [all_scores[i] for i in at]

    def passages(self, tokens: list[str]) -> list[tuple[int, int, float, float]]:
        """(first, last, score, expected number by chance) of every segment."""
        m = self.model
        at, scores = self.hits(tokens)
        return [(a, b, s, m.scale * len(tokens) * math.exp(-m.decay * s)) for a, b, s in segments(at, scores, m.gap)] if at else []

    def features(self, found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
        """(significance of the best passage, log of the sum over significant ones), in powers of ten."""
        strong = [min(300.0, -math.log10(-math.expm1(-e) if e > 1e-12 else max(e, 1e-300))) for _, _, _, e in found if e <= self.model.significant]
        return (min(30.0, max(strong)), math.log1p(sum(strong))) if strong else (0.0, 0.0)

    def score(self, found: list[tuple[int, int, float, float]]) -> float:
        a, b = self.features(found)
        w = self.model.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * a + w[2] * b))))


def fit(docs: DataFrame, labels: DataFrame, *, max_fit_rows: int = 20_000, z_min: float = 3.0, prior: float = 0.05, gap: float = 0.35, min_rows: int = 3) -> Model:
    """docs (doc_id, text) and labels (doc_id, toxic) of the rows that may be learnt from."""
    marked = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    if n > max_fit_rows:
        marked = marked.filter(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_000)) < int(1e6 * max_fit_rows / n))
    rows = keep(docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", "toxic"), "labelled")  # about max_fit_rows pairs of numbers are broadcast

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                y = int(toxic > 0)
                for k in {"", *(k for w in set(words(text)) for k in keys(w))}:
                    sums.setdefault(k, [0, 0])[y] += 1
            if len(sums) > 300_000:
                total = sums.pop("", None)
                yield _counts(sums)
                sums = {"": total} if total else {}
        yield _counts(sums)

    per = rows.mapInPandas(tidy(count), "key string, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    per = per.filter(F.col("clean") + F.col("toxic") >= min_rows).persist()
    total = per.filter("key = ''").select("clean", "toxic").first()
    lexicon: dict[str, float] = {}
    if total and total["clean"] and total["toxic"]:
        n0, n1 = float(total["clean"]), float(total["toxic"])
        both = F.col("clean") + F.col("toxic")
        a1, a0 = F.col("toxic") + prior * both, F.col("clean") + prior * both
        all1, all0 = n1 + prior * (n0 + n1), n0 + prior * (n0 + n1)
        # a key that every row holds has nothing beside it: half a row at least
        odds = F.log(a1 / F.greatest(all1 - a1, F.lit(0.5))) - F.log(a0 / F.greatest(all0 - a0, F.lit(0.5)))
        scored = per.filter("key <> '' and toxic > 0").select("key", odds.alias("odds"), (odds / F.sqrt(1 / a1 + 1 / a0)).alias("z"))
        lexicon = {r["key"]: r["odds"] for r in scored.filter((F.col("z") >= z_min) & (F.col("odds") >= 1.0)).collect()}  # bounded by the rows fitted
    per.unpersist()
    model = Model(lexicon, gap, 1.0, 1.0, (-1.0, 0.0, 0.0))
    if not lexicon:
        return model

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Clean rows: how often each score occurs; under no score their tokens, under minus one their segments."""
        scorer, seen = Scorer(model), Counter()
        for b in batches:
            for text in b.loc[b["toxic"] <= 0, "text"]:
                ws = words(text)
                at, scores = scorer.hits(ws)
                seen.update(scores)
                seen[0.0] += len(ws)
                seen[-1.0] += len(segments(at, scores, gap))
        yield pd.DataFrame({"score": list(seen), "n": list(seen.values())}, columns=["score", "n"])

    totals = rows.mapInPandas(measure, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()  # a row a distinct score of the lexicon
    model = _tail(model, {r["score"]: r["n"] for r in totals})

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            found = [scorer.features(scorer.passages(words(t))) for t in b["text"]]
            yield pd.DataFrame(found, columns=["best", "every"]).assign(toxic=b["toxic"].to_numpy() > 0)

    seen = sorted(rows.mapInPandas(features, "best double, every double, toxic boolean").collect(), key=tuple)  # about max_fit_rows rows of two numbers
    drop(rows)
    return _calibrate(model, seen)


def _counts(sums: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame([(k, *v) for k, v in sums.items()], columns=["key", "clean", "toxic"])


def _tail(model: Model, seen: dict[float, int]) -> Model:
    """lambda and K of the extreme-value law from what clean rows hold, see fit()."""
    n = seen.get(0.0, 0) + 1.0
    found = np.array([*sorted(s for s in seen if s > 0), min(model.lexicon.values())])
    shares = np.array([*(seen[s] for s in sorted(seen) if s > 0), 1.0]) / n
    rest = 1 - shares.sum()
    low, high = 1e-6, 50.0
    for _ in range(200):
        mid = (low + high) / 2
        above = (shares * np.exp(np.minimum(mid * found, 700))).sum() + rest * math.exp(-mid * model.gap) > 1
        low, high = (low, mid) if above else (mid, high)
    scale = (seen.get(-1.0, 0) + 0.5) / n * math.exp(low * min(model.lexicon.values()))
    return replace(model, decay=low, scale=scale)


def _calibrate(model: Model, seen: list) -> Model:
    x = np.array([(1.0, r["best"], r["every"]) for r in seen]).reshape(-1, 3)
    y = np.array([float(r["toxic"]) for r in seen])
    w = np.zeros(3)
    for _ in range(50):  # ridge-penalised logistic regression by Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - 0.5 * np.array([0.1, 1, 1]) * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 0.5, 0.5])
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return replace(model, weights=tuple(float(v) for v in w))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model predicts to be toxic; all columns are untouched."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array([scorer.score(scorer.passages(words(t))) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(tidy(each), docs.schema)


def score(docs: DataFrame, model: Model, keep_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep_cols, score, predicted, passages: array of (start, end in tokens, end exclusive; score; e_value) that are significant."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the rows fitted

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for b in batches:
            scores, spans = [], []
            for text in b["text_"]:
                found = scorer.passages(words(text))
                scores.append(scorer.score(found))
                spans.append([{"start": a, "end": z + 1, "score": s, "e_value": e} for a, z, s, e in found if e <= sent.value.significant])
            kept = {c: b[c] for c in b.columns if c != "text_"}
            yield pd.DataFrame({**kept, "score": scores, "predicted": (np.array(scores) >= 0.5).astype(np.int32), "passages": spans})

    kept = docs.select(*keep_cols, F.col("text").alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text_")
    longs = tuple(f.name for f in kept.schema if isinstance(f.dataType, T.LongType))
    return map_rows(kept, each, schema + ", score double, predicted int, passages array<struct<start: int, end: int, score: double, e_value: double>>", longs)
