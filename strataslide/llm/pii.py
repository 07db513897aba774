"""Personal data: exact patterns, and a character BiLSTM-CRF that adds spans.

The patterns (email, ip, card, phone) run over every whole text. The model is a
character-level bidirectional LSTM with CRF transitions, trained in numpy on labelled spans:
windows of a bounded sample of texts with their pattern spans as labels, and windows with
generated data in the forms the patterns miss (phone numbers without a plus, written-out
addresses). It decodes every window around a digit or an at sign, the only places where these
kinds can be. Windows overlap; the scores of a character are averaged over the windows that
hold it and each run of windows is decoded once more as a whole. Spans that overlap a pattern
span, or that lack the digits of their kind, are not added; pattern spans always stay.

Fitting reads at most about `max_fit_windows` windows; decoding covers all of every text.

Defined results: null or empty text has no spans; equal rows get equal spans; an empty table
gives an empty frame; texts of any length are read whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, tidy

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_ZONE = re.compile(r"[0-9+][\x20().0-9+-]*")
#: A start within a run of digits matches only if the run's own start does.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]")
#: Where the model looks: digits, at signs and their written-out forms.
_TRIGGER = re.compile(r"[0-9@]|[\[({]\s?(?:at|AT)\s?[\])}]|(?<=[\s\[({])(?:dot|DOT)(?=[\s\])}])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at)):
            yield "email", start, m.end()
            after = m.end()
            at = text.find("@", after)
        else:
            at = text.find("@", at + 1)


def _ip_ok(found: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.split("."))


def base_spans(text: str) -> list[Span]:
    """The pattern spans by start, then kind as listed."""
    out = list(_emails(text)) if "@" in text else []
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        if text.find(".", a, b) >= 0:
            out += [("ip", *m.span()) for m in _IP.finditer(text, a, b) if _ip_ok(m.group())]
        for m in _CARD.finditer(text, a, b):
            digits = _DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if text.find("+", a, b) >= 0:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text, a, b) if 10 <= len(_DIGITS.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# --- the model ---------------------------------------------------------------

#: Characters are read as classes: every ASCII character its own, letters and the rest of Unicode one each.
N_CHARS = 98
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, STRIDE, MARGIN = 64, 32, 24


def char_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    ascii_id = np.clip(codes.astype(np.int64) - 31, 0, 95)  # controls are 0
    return np.where(codes < 127, ascii_id, 96)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """x: time, batch, input. The hidden states, and what the way back needs."""
    steps, batch, _ = x.shape
    n = wh.shape[0]
    pre = x @ wx + b
    h, c = np.zeros((batch, n), x.dtype), np.zeros((batch, n), x.dtype)
    out, kept = np.empty((steps, batch, n), x.dtype), []
    for t in range(steps):
        g = pre[t] + h @ wh
        s = _sigmoid(g[:, : 3 * n])
        i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
        u = np.tanh(g[:, 3 * n :])
        new = f * c + i * u
        tc = np.tanh(new)
        kept.append((i, f, o, u, c, tc, h))
        c, h = new, o * tc
        out[t] = h
    return out, kept


def _lstm_back(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list, dout: np.ndarray):
    steps, batch, _ = x.shape
    n = wh.shape[0]
    dpre = np.empty((steps, batch, 4 * n), x.dtype)
    dh, dc, dwh = np.zeros((batch, n), x.dtype), np.zeros((batch, n), x.dtype), np.zeros_like(wh)
    for t in reversed(range(steps)):
        i, f, o, u, c, tc, h = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc * tc)
        d = dpre[t]
        d[:, :n] = dc * u * i * (1 - i)
        d[:, n : 2 * n] = dc * c * f * (1 - f)
        d[:, 2 * n : 3 * n] = dh * tc * o * (1 - o)
        d[:, 3 * n :] = dc * i * (1 - u * u)
        dwh += h.T @ d
        dh, dc = d @ wh.T, dc * f
    flat = dpre.reshape(-1, 4 * n)
    return dpre @ wx.T, x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(axis=0)


@dataclass(frozen=True)
class Tagger:
    p: dict[str, np.ndarray]

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """ids: batch, time -> batch, time, labels."""
        x = self.p["emb"][ids.T]
        a, _ = _lstm(x, self.p["fx"], self.p["fh"], self.p["fb"])
        z, _ = _lstm(x[::-1], self.p["bx"], self.p["bh"], self.p["bb"])
        return (np.concatenate([a, z[::-1]], axis=2) @ self.p["out"] + self.p["ob"]).transpose(1, 0, 2)

    def decode(self, scores: np.ndarray) -> list[int]:
        """The best label path of time x labels scores under the transitions."""
        trans, best, back = self.p["trans"], scores[0] + self.p["start"], []
        for row in scores[1:]:
            way = best[:, None] + trans
            back.append(way.argmax(axis=0))
            best = way.max(axis=0) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _crf(scores: np.ndarray, gold: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Mean negative log likelihood's gradients; scores: time, batch, labels."""
    steps, batch, n = scores.shape
    fwd, bwd = np.empty_like(scores), np.zeros_like(scores)
    fwd[0] = scores[0] + start
    for t in range(1, steps):
        fwd[t] = _lse(fwd[t - 1][:, :, None] + trans, 1) + scores[t]
    for t in reversed(range(steps - 1)):
        bwd[t] = _lse(trans[None] + (scores[t + 1] + bwd[t + 1])[:, None, :], 2)
    z = _lse(fwd[-1], 1)
    d = np.exp(fwd + bwd - z[None, :, None])
    dtrans = np.zeros_like(trans)
    for t in range(1, steps):
        dtrans += np.exp(fwd[t - 1][:, :, None] + trans + (scores[t] + bwd[t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.subtract.at(dtrans, (gold[t - 1], gold[t]), 1)
    dstart = d[0].sum(axis=0) - np.bincount(gold[0], minlength=n)
    np.subtract.at(d, (np.arange(steps)[:, None], np.arange(batch)[None], gold), 1)
    return d / batch, dtrans / batch, dstart / batch


def train(ids: np.ndarray, gold: np.ndarray, *, hidden: int = 20, embed: int = 12, epochs: int = 10, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Tagger:
    """ids, gold: windows x time."""
    rng = np.random.default_rng(seed)
    n, w = len(LABELS), lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    p = {"emb": rng.normal(size=(N_CHARS, embed)).astype(np.float32) * 0.5, "out": w(2 * hidden, n), "ob": np.zeros(n, np.float32), "trans": np.zeros((n, n), np.float32), "start": np.zeros(n, np.float32)}
    for k in "fb":
        p |= {f"{k}x": w(embed, 4 * hidden), f"{k}h": w(hidden, 4 * hidden), f"{k}b": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    total = max(1, epochs * -(-len(ids) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            it, y = ids[rows].T, gold[rows].T
            x = p["emb"][it]
            a, ka = _lstm(x, p["fx"], p["fh"], p["fb"])
            z, kz = _lstm(x[::-1], p["bx"], p["bh"], p["bb"])
            h = np.concatenate([a, z[::-1]], axis=2)
            d, dtrans, dstart = _crf(h @ p["out"] + p["ob"], y, p["trans"], p["start"])
            g = {"trans": dtrans, "start": dstart, "out": h.reshape(-1, 2 * hidden).T @ d.reshape(-1, n), "ob": d.sum(axis=(0, 1))}
            dh = d @ p["out"].T
            dx, g["fx"], g["fh"], g["fb"] = _lstm_back(x, p["fx"], p["fh"], ka, np.ascontiguousarray(dh[:, :, :hidden]))
            dz, g["bx"], g["bh"], g["bb"] = _lstm_back(np.ascontiguousarray(x[::-1]), p["bx"], p["bh"], kz, np.ascontiguousarray(dh[::-1, :, hidden:]))
            g["emb"] = np.zeros_like(p["emb"])
            np.add.at(g["emb"], it, dx + dz[::-1])
            step += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            lr = rate * (1 - (step - 1) / total) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, x in g.items():
                x = x * min(1.0, 5.0 / (norm + 1e-6))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.999 * v[k] + 0.001 * x * x
                p[k] = (p[k] - lr * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return Tagger(p)


# --- windows -----------------------------------------------------------------


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of text within MARGIN of a trigger."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def starts(length: int) -> range:
    """Where the overlapping windows of a region begin."""
    return range(0, max(1, length - WINDOW + STRIDE), STRIDE)


def _windows(text: str, a: int, b: int) -> np.ndarray:
    ids = char_ids(text[a:b])
    out = np.full((len(starts(b - a)), WINDOW), N_CHARS - 1)
    for k, at in enumerate(starts(b - a)):
        part = ids[at : at + WINDOW]
        out[k, : len(part)] = part
    return out


def _gold(spans: list[Span], a: int, b: int) -> np.ndarray:
    y = np.zeros(b - a, np.int64)
    for kind, s, e in spans:
        if s < b and e > a:
            k = 1 + 2 * KINDS.index(kind)
            y[max(s, a) - a : min(e, b) - a] = k + 1
            if s >= a:
                y[s - a] = k
    return y


def made_up(n: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Generated texts with labelled spans, some in forms that the patterns miss, and look-alikes without."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("an", "the", "or", "ti", "es", "que", "sch", "ment", "ó", "re")) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        body = digits(15)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def one() -> tuple[str, str]:
        area, mid, end = digits(3), digits(3), digits(4)
        host = f"{word()}{rng.randint(0, 9)}.example.{rng.choice(('com', 'org', 'net'))}".replace("ó", "o")
        name = f"{word()}.{digits(2)}".replace("ó", "o")
        return rng.choice((
            ("phone", f"+{rng.randint(1, 99)} ({area}) {mid}-{end}"), ("phone", f"+1 {area} {mid} {end}"), ("phone", f"({area}) {mid}-{end}"), ("phone", f"{area}-{mid}-{end}"),
            ("email", f"{name}@{host}"), ("email", f"{name}[at]{host}"), ("email", f"{name} (at) {host}"), *(("email", f"{name}{at}{host.replace('.', dot)}") for at, dot in ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"))), ("", f"{word()} a dot {word()}"), ("", f"the dot {word()} at {word()}"),
            ("ip", ".".join(str(rng.randint(0, 255)) for _ in range(4))), ("card", card()), ("card", "{0}-{1}-{2}-{3}".format(*(lambda c: (c[:4], c[4:8], c[8:12], c[12:]))(card()))),
            ("", digits(rng.randint(1, 9))), ("", f"{digits(4)}-{digits(2)}-{digits(2)}"), ("", "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(16, 40)))), ("", f"{digits(2)}:{digits(2)}"), ("", f"{digits(1)}.{digits(2)}"),
        ))

    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 6))), []
        for _ in range(rng.randint(1, 2)):
            kind, value = one()
            text += rng.choice((" ", " ", "\n", ": "))
            if kind:
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + rng.choice((" ", ". ", ", ", "\n", "*** ")) + " ".join(word() for _ in range(rng.randint(1, 5)))
        out.append((text, spans))
    return out


def fit(docs: DataFrame, max_fit_windows: int = 1500, generated: int = 900) -> Tagger:
    """Train on the first windows of a hashed sample of distinct texts, and on generated ones.

    The sample is about max_fit_windows windows, the first WINDOW characters of a text's first
    region: labelled by the patterns, they teach what pages look like around personal data.
    Forms that the patterns miss are taught by the generated texts alone.
    """
    marked = docs.filter(F.col("text").rlike("[0-9@]")).select("text")
    n = marked.count()
    if n > max_fit_windows:
        marked = marked.filter(F.pmod(F.xxhash64(F.lit(4), "text"), F.lit(1_000_000)) < int(1e6 * max_fit_windows / n))
    marked = marked.dropDuplicates(["text"])  # a text of many rows, if it is picked, counts once

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                for a, z in regions(text)[:1]:
                    part = text[a : min(z, a + WINDOW)]
                    rows.append((part, _gold(base_spans(text), a, a + len(part)).tolist()))
            yield pd.DataFrame(rows, columns=["part", "gold"])

    seen = [(r["part"], r["gold"]) for r in marked.mapInPandas(cut, "part string, gold array<long>").collect()]  # about max_fit_windows short strings
    seen.sort()
    for text, spans in made_up(generated):
        seen.append((text[:WINDOW], _gold(spans, 0, min(len(text), WINDOW)).tolist()))
    ids, gold = np.full((len(seen), WINDOW), N_CHARS - 1), np.zeros((len(seen), WINDOW), np.int64)
    for k, (part, y) in enumerate(seen):
        ids[k, : len(part)] = char_ids(part)
        gold[k, : len(y)] = y
    return train(ids, gold)


#: An address with @ or a written-out at, bracketed or not, and dots or written-out dots.
_WRITTEN = re.compile(r"[\w.%+-]+\s?(?:@|[\[({]\s?(?:at|AT)\s?[\])}]|(?<=\s)(?:at|AT)(?=\s))\s?[A-Za-z0-9-]+((?:\.|\s?[\[({]\s?(?:dot|DOT)\s?[\])}]\s?|\s(?:dot|DOT)\s)[A-Za-z0-9-]+)+")


def _added_ok(kind: str, found: str) -> bool:
    digits = _DIGITS.sub("", found)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and re.fullmatch(r"[\x20()+.0-9-]+", found) is not None and any(c in found for c in "() -.")
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return re.fullmatch(r"[0-9]+(\.[0-9]+){3}", found) is not None and _ip_ok(found)
    return _WRITTEN.fullmatch(found) is not None


def add_spans(texts: list[str], base: list[list[Span]], tagger: Tagger, batch: int = 512) -> list[list[Span]]:
    """Spans of the model for each text that overlap none of its base spans."""
    where = [(k, a, b) for k, text in enumerate(texts) for a, b in regions(text)]
    sums: list[np.ndarray | None] = [None] * len(where)
    held: list[tuple[int, int, np.ndarray]] = []
    out: list[list[Span]] = [[] for _ in texts]

    def run() -> None:
        scores = tagger.emissions(np.stack([w for _, _, w in held]))
        for (r, at, _), s in zip(held, scores, strict=True):
            a, b = where[r][1:]
            if sums[r] is None:
                sums[r] = np.zeros((b - a, len(LABELS) + 1), np.float32)
            n = min(WINDOW, b - a - at)
            sums[r][at : at + n, :-1] += s[:n]
            sums[r][at : at + n, -1] += 1
        held.clear()

    for r, (k, a, b) in enumerate(where):
        for at, w in zip(starts(b - a), _windows(texts[k], a, b), strict=True):
            held.append((r, at, w))
            if len(held) == batch:
                run()
    if held:
        run()
    for (k, a, _), total in zip(where, sums, strict=True):
        mean = total[:, :-1] / total[:, -1:]
        path, at = tagger.decode(mean), 0
        while at < len(path):
            label, end = path[at], at + 1
            if label % 2 == 1:
                while end < len(path) and path[end] == label + 1:
                    end += 1
                kind, s, e = KINDS[label // 2], a + at, a + end
                if all(e <= x or s >= y for _, x, y in base[k]) and _added_ok(kind, texts[k][s:e]):
                    out[k].append((kind, s, e))
            at = end
    return out


def find(docs: DataFrame, tagger: Tagger, keep_cols: tuple[str, ...] = ("doc_id",), batch: int = 64) -> DataFrame:
    """keep_cols, n_<kind>, base (spans joined), spans (base and added, joined), n_added, found array<struct>."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)  # some thousand numbers

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text_"].fillna("").tolist()
            base = [base_spans(t) for t in texts]
            more = add_spans(texts, base, sent.value)
            both = [sorted(x + y, key=lambda s: (s[1], KINDS.index(s[0]))) for x, y in zip(base, more, strict=True)]
            out = {c: b[c] for c in b.columns if c != "text_"}
            out |= {f"n_{k}": [sum(s[0] == k for s in x) for x in base] for k in KINDS}
            out |= {"base_sha256": [hashlib.sha256(joined(x).encode()).hexdigest() for x in base], "spans": [joined(x) for x in both], "n_added": [len(x) for x in more]}
            out["found"] = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in both]
            yield pd.DataFrame(out)

    kept = docs.select(*keep_cols, F.col("text").alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text_")
    longs = tuple(f.name for f in kept.schema if isinstance(f.dataType, T.LongType))
    return map_rows(kept, each, f"{schema}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long, found array<struct<kind: string, start: int, end: int>>", longs)


def mask(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """docs with every span replaced by its kind in brackets; the other columns are untouched."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            was = b.column(at).to_pylist()
            texts = [t or "" for t in was]
            base = [base_spans(t) for t in texts]
            out = []
            for text, old, x, y in zip(texts, was, base, add_spans(texts, base, sent.value), strict=True):
                done, upto = [], 0
                for kind, s, e in sorted(x + y, key=lambda z: (z[1], KINDS.index(z[0]))):
                    if s >= upto:  # of overlapping spans the first gives the mark
                        done += [text[upto:s], f"[{kind.upper()}]"]
                    upto = max(upto, e)
                out.append("".join([*done, text[upto:]]) if done else old)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return docs.mapInArrow(tidy(each), docs.schema)
