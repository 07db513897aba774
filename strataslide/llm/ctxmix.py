"""Language-model scores by online logistic context mixing.

A text is its UTF-8 bytes and an end mark. Each byte is a few binary decisions, along a
prefix code for what follows the two bytes before it (of the pairs commonest in all training
texts; else, and for bytes not seen there, for what follows the byte before). For every
decision several predictors look up a hashed context (the three and the five bytes before, the
word so far) in tables of counts of all training texts. Their log-odds are mixed by weights
that a gate picks (depth of the decision, whether the word was seen before); a map from the
mixed log-odds, and a slope and an offset of each text's own, correct them. Weights, slope and
offset adapt along each text: after every block of bytes, so the probability of a block rests
on what came before it only. Blocks grow with the distance from the start.

The weights and the map that texts start with are fitted on all training texts: these are dealt
to two folds by a hash, each fold is mixed from the counts of the other, and the sums of both
give Newton's step. Steps go on until one promises less than `gain` bits a byte (`rounds` passes
at most); the map is of the same sums. About `dev_rows` texts only give the place where the
steps set out.

Beside it a unigram base: counts of words over all training texts. They are summed by ranges
of the words' 64-bit hashes and handed back to the parts of the input that hold the word, so
no table of all words is ever in one place. The hashed contexts have 2**bits slots each, and
bits follows the size of the training texts between `least_bits` and `most_bits`.

Texts are packed once into compressed blobs of about `blob` bytes, which the passes read.

Defined results: null or empty text is the end mark alone; equal rows get equal scores; a null
doc_id counts as training; without training rows contexts are unknown and every byte costs
eight bits or so; an empty table gives an empty frame. Fits set out from texts of at most
`dev_chars` bytes; what they end with, and all else, rests on all training texts, whole.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, map_rows

#: The end mark: a byte that UTF-8 never has.
END = 255
LEAD = 5  # zeros before each text
CONTEXTS = 3  # hashed: three and five bytes, and the word so far
INPUTS = CONTEXTS + 2  # with the code's own odds and a bias
GATES, CELLS = 8, 24
SCALE = 16.0  # of stored log-odds
NEAR = 6  # bits of a slot that tell the decisions of one context apart
#: Bytes worked on at once, and decisions unfolded at once, which stay in a core's cache.
AT_ONCE, UNFOLD = 200_000, 24_000
#: Step sizes of a text's own weights: an input of larger log-odds moves less.
RATE = np.array([0.15, 0.1, 0.1, 0.1, 0.5], np.float32)
BIAS = 0.3
#: How far a text's own slope and offset may go, and the log-odds that they may lead to.
SLOPE, OFFSET, MOST = 0.9, 4.0, 40.0
_M = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Code:
    """Prefix codes, flat. A context is a pair of bytes with a code of its own, or else the last byte.

    base: by the two bytes before, where its context's 256 bytes begin; own: first decision << 8 |
    length << 1 | whether the last byte's path follows, of a context's byte; last: where the 256
    bytes of each last byte begin; decisions: near bits << 11 | (log-odds + 128) << 3 | depth << 1 | bit.
    """

    base: np.ndarray
    own: np.ndarray
    last: np.ndarray
    decisions: np.ndarray


def _paths(weights: list[tuple[int, float]]) -> dict[int, list[tuple[int, int, float]]]:
    """Huffman: symbol -> [(node, bit, log-odds of a 1)] from the root down."""
    heap = [(w, s, s) for s, w in weights]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    odds: dict[int, float] = {}
    at = 512
    while len(heap) > 1:
        w0, _, a = heapq.heappop(heap)
        w1, _, b = heapq.heappop(heap)
        up[a], up[b], odds[at] = (at, 0), (at, 1), float(np.log(w1 / w0))
        heapq.heappush(heap, (w0 + w1, at, at))
        at += 1
    out = {}
    for s, _ in weights:
        path, x = [], s
        while x in up:
            x, bit = up[x]
            path.append((x - 512, bit, odds[x]))
        out[s] = path[::-1]
    return out


def _near(node: int) -> int:
    """The bits of a slot that a decision's node takes."""
    return ((node + 1) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - NEAR


def prefix_code(pairs: np.ndarray, row: np.ndarray, triples: np.ndarray) -> Code:
    """pairs: 256 x 256 counts of a byte after a byte; triples: counts of a byte after each context of row (row 0 is none).

    A byte not seen after a pair is the pair's escape and then the last byte's path.
    """
    shared = pairs.sum(axis=0) + 0.01
    shared = shared / shared.sum()
    flat: list[int] = []

    def put(path: list, of: int, deeper: int) -> list[int]:
        return [_near(of * 512 + x) << 11 | min(255, max(1, round(o * SCALE) + 128)) << 3 | min(deeper + d, GATES // 2 - 1) << 1 | bit for d, (x, bit, o) in enumerate(path)]

    own, base, last = [], np.zeros(65536, np.int32), np.arange(256, dtype=np.int32) * 256

    def add(path: list[int]) -> int:
        flat.extend(path)
        return len(flat) - len(path) << 8 | len(path) << 1

    for before in range(256):
        paths = _paths(list(enumerate((pairs[before] + shared).tolist())))
        own += [add(put(paths[s], before, 1)) for s in range(256)]
        base[before::256] = last[before]
    for r, pair in enumerate(np.argsort(row, kind="stable")[65536 - int((row > 0).sum()) :].tolist(), 1):
        counts = triples[r]
        seen = np.flatnonzero(counts).tolist()
        paths = _paths([*((s, float(counts[s])) for s in seen), (256, 0.5 + 0.1 * len(seen))])
        base[pair] = len(own)
        escape = add(put(paths.pop(256), 256 + r, 0)) | 1
        here = {s: add(put(path, 256 + r, 0)) for s, path in paths.items()}
        own += [here.get(s, escape) for s in range(256)]
    if len(flat) >= 1 << 24:
        raise ValueError("too many contexts have a code of their own")
    return Code(base, np.array(own, np.uint32), last, np.array(flat, np.uint32))


def _join(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each led by zeros and ended by END; the lengths with the end."""
    lead = b"\0" * LEAD
    return np.frombuffer(b"".join([x for r in raw for x in (lead, r, b"\xff")]), np.uint8), np.array([len(r) + 1 for r in raw], np.int64)


def utf8(texts: list) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]


def _places(lengths: np.ndarray) -> np.ndarray:
    """Places in the joined array that are symbols, text after text."""
    ends = np.cumsum(lengths + LEAD).tolist()
    every = np.arange(ends[-1] if ends else 0)
    return np.concatenate([every[z - n : z] for z, n in zip(ends, lengths.tolist(), strict=True)] or [every])


_POWERS: dict = {}


def _powers(n: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**32 or 2**64, and of its inverse; kept."""
    if len(_POWERS.get(kind, ((),))[0]) < n:
        odd, size = 0x01000193 if kind is np.uint32 else 0xD1342543DE82EF95, 1 << 8 * np.dtype(kind).itemsize
        _POWERS[kind] = tuple(np.cumprod(np.full(n + n // 4, base, kind), dtype=kind) for base in (odd, pow(odd, -1, size)))
    return _POWERS[kind][0][:n], _POWERS[kind][1][:n]


_LETTER = np.array([65 <= (c & ~32) <= 90 or 128 <= c < 255 for c in range(256)])
_LOW = np.array([(c | 32 if 65 <= c <= 90 else c) + 1 if _LETTER[c] else 0 for c in range(256)], np.uint32)
_FIRST = np.where(_LETTER, 7, np.arange(256)).astype(np.uint32)
_WORD = np.array([c != 32 and not 9 <= c <= 13 and c != END for c in range(256)])
#: 64 bits for each byte in lower case.
_SPREAD = np.random.default_rng(64).integers(0, 2**64, 256, dtype=np.uint64)[[c | 32 if 65 <= c <= 90 else c for c in range(256)]]


def _contexts(data: np.ndarray) -> list[np.ndarray]:
    """Hash of each context before every byte, as uint32: the three and the five bytes before, and the letters since the last other byte."""
    n = len(data)
    four = np.zeros(n, np.uint32)
    if n > 4:
        four[4:] = np.ndarray((n - 4,), "<u4", np.ascontiguousarray(data), strides=(1,))
    three = four >> np.uint32(8)
    three *= np.uint32(0x846CA68B)
    three ^= np.uint32(0x5A5A5A5A)
    five = four * _M
    five[5:] ^= data[: n - 5] * np.uint32(0xC2B2AE35)
    power, inverse = _powers(n, np.uint32)
    low = np.take(_LOW, data, mode="clip")
    place = np.arange(1, n + 1)
    place *= low == 0
    start = np.zeros(n, np.int64)  # just after the last other byte before each place
    np.maximum.accumulate(place[:-1], out=start[1:])
    sums = np.zeros(n + 1, np.uint32)
    low *= power
    np.cumsum(low, dtype=np.uint32, out=sums[1:])
    word = sums[:-1] - np.take(sums, start, mode="clip")
    word *= np.take(inverse, start, mode="clip")
    word *= np.uint32(0xB5297A4D)
    word[1:] += np.take(_FIRST, data[:-1], mode="clip")  # a word's first letter knows the byte before
    return [three, five, word]


def _slots(context: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each context, whose last NEAR bits its decisions change."""
    h = context ^ context >> np.uint32(15)
    h *= _M
    h >>= np.uint32(32 - bits)
    return h.astype(np.int64)


def _before(data: np.ndarray) -> np.ndarray:
    """The two bytes before each place, the later one low; 0 before the first."""
    two = np.zeros(len(data), np.int64)
    if len(data) > 2:
        two[2:] = np.ndarray((len(data) - 2,), ">u2", np.ascontiguousarray(data), strides=(1,))
    return two


def _expand(code: Code, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of decisions of the symbols at `at`: each one's place in data, where it lies in the code and its length; and the symbols of two runs.

    A symbol is one run, or two where it is not in the code of its own context.
    """
    two = _before(data)
    key = np.take(code.base, two, mode="clip")
    key += data
    packed = np.take(code.own, np.take(key, at, mode="clip"), mode="clip")
    far = np.flatnonzero(packed & np.uint32(1))
    if len(far):
        rest = code.own[code.last[two[at[far]] & 255] + data[at[far]]]
        second = far + np.arange(1, len(far) + 1)
        once = np.ones(len(at) + len(far), bool)
        once[second] = False
        more, places = np.empty(len(once), np.uint32), np.empty(len(once), np.int64)
        more[once], places[once] = packed, at
        more[second], places[second] = rest, at[far]
        packed, at = more, places
    first = (packed >> np.uint32(8)).astype(np.int64)
    packed >>= np.uint32(1)
    packed &= np.uint32(127)
    return at, first, packed.astype(np.int64), far


def _unfold(code: Code, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run and the packed form of each decision; no run is empty."""
    begin = np.cumsum(size)
    total = int(begin[-1])
    begin = begin[:-1]
    which, entry = np.zeros(total, np.int64), np.ones(total, np.int64)
    which[begin] = 1
    entry[0] = first[0]
    entry[begin] = first[1:] - first[:-1] - size[:-1] + 1
    return np.cumsum(which, out=which), code.decisions[np.cumsum(entry, out=entry)]


def triple_counts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(two bytes before << 8 | byte, times), sorted, of all symbols."""
    data, lengths = _join(raw)
    triple = _before(data)
    triple <<= 8
    triple |= data
    key, n = np.unique(triple[_places(lengths)].astype(np.int32), return_counts=True)
    return key.astype(np.int64), n.astype(np.int64)


def common_rows(triples: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What prefix_code() takes: pairs; row of each pair of bytes, 1, 2, … for the `most` commonest, else 0; and the triples of these."""
    pairs = np.bincount(triples & 0xFFFF, counts, 65536)
    top = np.argsort(-pairs, kind="stable")[: min(most, int((pairs > 0).sum()))]
    row = np.zeros(65536, np.int32)
    row[top] = np.arange(1, len(top) + 1)
    after = np.bincount(row[triples >> 8].astype(np.int64) * 256 + (triples & 255), counts, 256 * (len(top) + 1))
    return pairs.reshape(256, 256), row, after.reshape(-1, 256)


class Counts:
    """What a task has seen of every slot: times 0 and times 1, interleaved; what a byte can't hold lies beside."""

    def __init__(self, code: Code, bits: int, hold: int = 3_000_000):
        self.code, self.bits, self._hold = code, bits, hold
        self._seen = [np.zeros(2 << bits, np.uint8) for _ in range(CONTEXTS)]
        self._over: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(CONTEXTS)]
        self._runs = np.empty((CONTEXTS, hold), np.int64)  # slot << 24 | first decision
        self._held = 0
        self._size = np.zeros(len(code.decisions), np.int64)  # of the run that begins at a decision
        own = code.own[(code.own & np.uint32(254)) > 0]  # a context that nothing follows has an empty one
        self._size[own >> np.uint32(8)] = own >> np.uint32(1) & np.uint32(127)

    def add(self, raw: list[bytes]) -> None:
        data, lengths = _join(raw)
        at, first, _, _ = _expand(self.code, data, _places(lengths))
        contexts, step = _contexts(data), min(UNFOLD, self._hold)
        for a in range(0, len(at), step):
            few = first[a : a + step]
            if self._held + len(few) > self._hold:
                self.settle()
            for held, context in zip(self._runs, contexts, strict=True):
                run = held[self._held : self._held + len(few)]
                run[:] = _slots(np.take(context, at[a : a + step], mode="clip"), self.bits)
                run <<= 24
                run |= few
            self._held += len(few)

    def settle(self) -> None:
        """Add up the runs that are held: equal ones are unfolded once, and slots sorted first, as a large table is slow to meet at random."""
        for seen, over, held in zip(self._seen, self._over, self._runs, strict=True):
            if self._held:
                run = held[: self._held]
                run.sort()
                head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
                times = np.diff(head, append=len(run))
                run = run[head]
                slot = run >> 24 << 33
                slot |= times
                run &= (1 << 24) - 1
                size = self._size[run]
                begin = np.concatenate([[0], np.cumsum(size)])
                found = np.empty(int(begin[-1]), np.int64)  # slot and bit << 32 | times
                for a, b in _cuts(begin, UNFOLD):
                    which, decisions = _unfold(self.code, run[a:b], size[a:b])
                    change = (decisions >> np.uint32(10) & np.uint32((2 << NEAR) - 2) | decisions & np.uint32(1)).astype(np.int64)
                    change <<= 32
                    np.bitwise_xor(np.take(slot[a:b], which, mode="clip"), change, out=found[int(begin[a]) : int(begin[b])])
                found.sort()
                slot = found >> 32
                head = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
                slot = slot[head]
                found &= (1 << 32) - 1
                n = np.add.reduceat(found, head)
                n += seen[slot]
                far = n > 255
                if far.any():
                    over.append((slot[far], n[far] - 255))
                    n[far] = 255
                seen[slot] = n
            if len(over) > 20:
                over[:] = [summed(*map(np.concatenate, zip(*over, strict=True)))]
        self._held = 0

    def counts(self, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """2 x n counts of context k's slots from first to last."""
        self.settle()
        out = self._seen[k][2 * first : None if last is None else 2 * last].astype(np.int64)
        for slot, n in self._over[k]:
            a, z = np.searchsorted(slot, [2 * first, 2 * first + len(out)])
            out[slot[a:z] - 2 * first] += n[a:z]
        return out.reshape(-1, 2).T

    def rows(self, shard_bits: int = 16) -> Iterator[tuple[int, bytes]]:
        """(shard, packed): the slots that were seen, with their two counts."""
        self.settle()
        size = min(1 << shard_bits, 1 << self.bits)
        shards = (1 << self.bits) // size
        for k, (seen, over) in enumerate(zip(self._seen, self._over, strict=True)):
            slot, n = summed(*map(np.concatenate, zip(*over, strict=True))) if over else (np.empty(0, np.int64),) * 2
            cut = np.searchsorted(slot, np.arange(shards + 1) * 2 * size).tolist()
            both, pairs = seen.view(np.uint16), seen.reshape(-1, 2)
            for shard in range(shards):
                at = np.flatnonzero(both[shard * size : (shard + 1) * size])
                if len(at):
                    part = pairs[shard * size : (shard + 1) * size][at].astype(np.int64)
                    here = slice(cut[shard], cut[shard + 1])
                    far = slot[here] - 2 * size * shard
                    part[np.searchsorted(at, far >> 1), far & 1] += n[here]
                    far = np.flatnonzero((part > 254).any(axis=1))  # few counts need more than a byte
                    head = np.array([len(at), len(far)], "<u4").tobytes()
                    yield k * shards + shard, head + at.astype("<u2").tobytes() + np.minimum(part, 255).astype(np.uint8).tobytes() + far.astype("<u4").tobytes() + part[far].astype("<u8").tobytes()


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a shard and their 2 x n counts."""
    n, m = np.frombuffer(packed, "<u4", 2).tolist()
    at = np.frombuffer(packed, "<u2", n, 8).astype(np.int64)
    counts = np.frombuffer(packed, np.uint8, 2 * n, 8 + 2 * n).reshape(n, 2).astype(np.int64)
    far = np.frombuffer(packed, "<u4", m, 8 + 4 * n)
    counts[far] = np.frombuffer(packed, "<u8", 2 * m, 8 + 4 * n + 4 * m).reshape(m, 2)
    return at, counts.T


def log_odds(counts: np.ndarray) -> np.ndarray:
    """2 x n counts -> stored log-odds; 0 for slots that were never seen."""
    return np.clip(np.round(SCALE * np.log((counts[1] + 0.15) / (counts[0] + 0.15))), -127, 127).astype(np.int8)


@dataclass(frozen=True)
class Model:
    code: Code
    bits: int
    tables: tuple[np.ndarray, ...]
    weights: np.ndarray  # gates x inputs
    cells: np.ndarray  # correction of log-odds by cell


def start_model(code: Code, bits: int, tables: tuple[np.ndarray, ...]) -> Model:
    weights = np.tile(np.array([0.1, 0.35, 0.4, 0.3, 0.0], np.float32), (GATES, 1))
    return Model(code, bits, tables, weights, np.zeros(CELLS, np.float32))

def _cuts(begin: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of runs of about `size` decisions; begin has each run's first decision, and the end."""
    at = np.unique(np.append(np.searchsorted(begin, np.arange(0, int(begin[-1]), size)), len(begin) - 1))
    return list(zip(at.tolist(), at[1:].tolist(), strict=False))


#: A text's weights move after blocks of this many decisions, twice as many, and so on.
BLOCK = 192
#: Decisions of a block worked on together, which stay in a core's cache.
TOGETHER = 32_000


#: The gate (depth << 1 | whether the word was seen) that a mark's bits above the decision's own stand for (seen << 2 | depth).
_GATE = np.array([(m & 3) << 1 | m >> 2 for m in range(GATES)])


def losses(model: Model, raw: list[bytes], after: dict | None = None) -> np.ndarray:
    """Negative natural log probability of each text.

    A text's weights are the model's of the gate plus a change of its own, which moves after
    each block of decisions; a slope and an offset of its own follow. Log-odds are SCALE times
    as large as they are, and weights as much smaller. after: gets what a fit needs, see adapt().
    """
    data, lengths = _join(raw)
    at, first, size, far = _expand(model.code, data, _places(lengths))
    begin = np.concatenate([[0], np.cumsum(size)])
    contexts = _contexts(data)
    many = int(begin[-1])
    # a byte each until a block takes them: log-odds, and at last whether the word was seen << 3 | depth << 1 | bit
    inputs = np.empty((INPUTS, many), np.int8)
    for a, b in _cuts(begin, UNFOLD):
        which, decisions = _unfold(model.code, first[a:b], size[a:b])
        x = inputs[:, int(begin[a]) : int(begin[b])]
        mark = x[-1]
        mark[:] = decisions & np.uint32(7)
        near = (decisions >> np.uint32(11)).astype(np.int64)
        decisions >>= np.uint32(3)
        np.bitwise_xor(decisions.astype(np.uint8), np.uint8(128), out=x[0].view(np.uint8))  # less 128
        for k, context in enumerate(contexts):
            place = np.take(_slots(np.take(context, at[a:b], mode="clip"), model.bits), which, mode="clip")
            place ^= near
            np.take(model.tables[k], place, mode="clip", out=x[1 + k])
        mark |= (x[CONTEXTS] != 0).view(np.int8) << np.int8(3)
    head = np.cumsum(lengths) - lengths  # each text's first symbol, and so its first run
    starts = begin[head + np.searchsorted(far, head)].tolist()
    counts = np.diff(np.append(starts, many).astype(np.int64))
    weights = model.weights.T[:, _GATE]
    weights[:-1] /= SCALE
    weights[-1] *= BIAS
    mapped, bound = model.cells.any(), (12 + float(np.abs(model.cells).max())) * (1 + SLOPE) + OFFSET > MOST
    total = np.zeros(len(lengths))
    own = np.zeros((INPUTS, len(lengths)), np.float32)
    turn = np.zeros((2, len(lengths)), np.float32)  # each text's change of slope and offset after the map
    scale = np.array([1.0] * CONTEXTS + [1.0, BIAS], np.float32)[:, None]
    rate = RATE[:, None].copy()
    rate[:-1] /= SCALE * SCALE
    sums = Sums() if after is not None else None
    rest, done, block, parts = np.arange(len(lengths)), 0, 0, []
    while len(rest) or parts:
        if not parts:  # the next block, a few texts at a time
            block += BLOCK
            few = max(1, TOGETHER // block)
            parts = [rest[k : k + few] for k in range(0, len(rest), few)][::-1]
        docs = parts.pop()
        left = counts[docs] - done
        wide = min(block, int(left.max()))
        # each text's decisions of the block in a row; what is missing at a text's end is 0 and not counted
        held = np.empty((INPUTS, len(docs), wide), np.int8)
        for k, (d, n) in enumerate(zip(docs.tolist(), np.minimum(left, wide).tolist(), strict=True)):
            held[:, k, :n] = inputs[:, starts[d] + done : starts[d] + done + n]
            if n < wide:
                held[:, k, n:] = 0
        x, mark = held[:-1].astype(np.float32), held[-1]
        sign = mark.astype(np.uint32)
        sign <<= np.uint32(31)  # the sign bit of a 1
        mark >>= np.int8(1)
        gate = mark.astype(np.intp)
        gate += (GATES * np.arange(len(docs)))[:, None]
        each = (weights[:, None] + (scale * own[:, docs])[:, :, None]).reshape(INPUTS, -1)
        mixed = np.take(each[-1], gate, mode="clip")
        for k in range(INPUTS - 1):
            part = np.take(each[k], gate, mode="clip")
            part *= x[k]
            mixed += part
        np.clip(mixed, -11.9, 11.9, out=mixed)
        cell = (mixed + np.float32(12)).astype(np.intp if mapped else np.uint8)
        if mapped:
            mixed += np.take(model.cells, cell, mode="clip")
        if done:
            mixed *= 1 + turn[0, docs][:, None]
            mixed += turn[1, docs][:, None]
        if bound:  # else map, slope and offset can't lead there
            np.clip(mixed, -MOST, MOST, out=mixed)
        e = (mixed.view(np.uint32) ^ sign).view(np.float32)
        np.exp(e, out=e)
        one = e + np.float32(1)
        miss = np.divide(e, one, out=e)  # the probability that the decision didn't get
        for k in np.flatnonzero(left < wide).tolist():
            one[k, left[k] :] = 1
            miss[k, left[k] :] = 0
        half = (wide + 1) // 2  # a logarithm of two decisions' product, which MOST keeps finite
        one[:, : wide - half] *= one[:, half:]
        total[docs] += np.log(one[:, :half]).sum(axis=1)
        more = left > wide
        if more.any() or sums is not None:
            spread = np.multiply(miss, miss, out=one)
            np.subtract(miss, spread, out=spread)
            push = miss
            sign ^= np.uint32(1 << 31)
            push.view(np.uint32)[:] ^= sign
        if sums is not None:
            sums.add(held, push, cell)
        if more.any():
            # damped Newton steps on the text's weights, and on the slope and offset of what comes after
            heft = spread.sum(axis=1) + np.float32(40)
            grad = np.empty((INPUTS, len(docs)), np.float32)
            grad[:-1] = np.matmul(x.transpose(1, 0, 2), push[:, :, None])[:, :, 0].T
            pushed = push.sum(axis=1)
            grad[-1] = pushed * np.float32(BIAS)
            own[:, docs] += rate * (grad / heft)
            turn[1, docs] += np.float32(0.3) * pushed / heft
            turn[0, docs] += np.float32(0.05) * np.matmul(push[:, None], mixed[:, :, None])[:, 0, 0] / heft
            np.clip(turn[0], -SLOPE, SLOPE, out=turn[0])  # a long text that turns would send them off
            np.clip(turn[1], -OFFSET, OFFSET, out=turn[1])
        if not parts:
            rest, done = rest[counts[rest] > done + block], done + block
    if after is not None:
        after |= sums.told()
    return total


class Sums:
    """Gradient and curvature of the log probability by gate, and by cell of the map, over decisions with their pushes and spreads."""

    def __init__(self, hold: int = 60_000):
        self._grad, self._curve = np.zeros((GATES, INPUTS)), np.zeros((GATES, INPUTS, INPUTS))
        self._push, self._spread = np.zeros(CELLS), np.zeros(CELLS)
        self._inputs, self._pushes, self._keys, self._held = np.empty((INPUTS - 1, hold), np.int8), np.empty(hold, np.float32), np.empty(hold, np.uint8), 0
        self._rows, self._weighed = np.ones((INPUTS, hold), np.float32), np.empty((INPUTS, hold), np.float32)

    def add(self, held: np.ndarray, push: np.ndarray, cell: np.ndarray) -> None:
        """held: inputs and gates' marks; what is missing has no push."""
        held, push, cell = held.reshape(INPUTS, -1), push.reshape(-1), cell.reshape(-1)
        a, hold = 0, len(self._pushes)
        while a < len(push):
            n = min(hold - self._held, len(push) - a)
            here = slice(self._held, self._held + n)
            self._inputs[:, here], self._pushes[here] = held[:-1, a : a + n], push[a : a + n]
            key = self._keys[here]
            np.left_shift(held[-1, a : a + n].view(np.uint8), np.uint8(5), out=key)
            key |= cell[a : a + n].astype(np.uint8)
            self._held, a = self._held + n, a + n
            if self._held == hold:
                self._settle()

    def _settle(self) -> None:
        """Add up what is held, gate by gate: a product of a matrix and one row is faster than one of two so narrow matrices."""
        if not self._held:
            return
        keys, rows, weighed = self._keys[: self._held], self._rows[:, : self._held], self._weighed[:, : self._held]
        order = np.argsort(keys, kind="stable")
        for row, held in zip(rows[:-1], self._inputs, strict=True):
            row[:] = np.take(held[: self._held], order, mode="clip")
        push = np.take(self._pushes, order, mode="clip")
        spread = np.abs(push)
        spread -= push * push
        keys = np.take(keys, order, mode="clip")
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        cell = keys[head] & 31
        self._push += np.bincount(cell, np.add.reduceat(push, head, dtype=np.float64), CELLS)
        self._spread += np.bincount(cell, np.add.reduceat(spread, head, dtype=np.float64), CELLS)
        np.multiply(rows, spread, out=weighed)
        ends = np.searchsorted(keys, np.arange(0, GATES << 5, 32, dtype=np.uint8)).tolist()
        for gate, a, z in zip(_GATE.tolist(), ends, [*ends[1:], self._held], strict=True):
            if a < z:
                here = rows[:, a:z]
                self._grad[gate] += here @ push[a:z]
                for k in range(INPUTS):
                    self._curve[gate, k, k:] += here[k:] @ weighed[k, a:z]
        self._held = 0

    def told(self) -> dict[str, np.ndarray]:
        self._settle()
        scale = np.array([1 / SCALE] * (INPUTS - 1) + [BIAS])
        upper = np.triu(self._curve)
        curve = upper + np.triu(upper, 1).transpose(0, 2, 1)
        return {"grad": self._grad * scale, "curve": curve * scale * scale[:, None], "push": self._push, "spread": self._spread}


def words_of(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and 64-bit hash of each word in lower case (A-Z), without the ends, of joined texts."""
    inside = _WORD[data]
    head = np.cumsum(lengths + LEAD) - (lengths + LEAD)
    for k in range(LEAD):
        inside[head + k] = False
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # a text begins and ends with what is no word
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(data), np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    spread = _SPREAD[data]
    spread *= power
    np.cumsum(spread, out=sums[1:])
    key = sums[end] - sums[start]
    key *= inverse[start]
    key ^= key >> np.uint64(32)
    key *= np.uint64(0x9E3779B97F4A7C15)
    key ^= (end - start).astype(np.uint64)
    per = np.diff(np.searchsorted(start, np.append(head, len(data))))
    return np.repeat(np.arange(len(lengths)), per), key.view(np.int64)


def fit_sums(model: Model, raw: list[bytes]) -> dict[str, np.ndarray]:
    """What a step of the fit needs of texts that the model's tables don't know; add up by key."""
    sums: dict = {}
    for g in groups([len(r) for r in raw]):
        part: dict = {}
        loss = losses(model, [raw[i] for i in g], part).sum()
        sums = _add([sums, part | {"loss": loss}])
    return sums


def _add(sums: Iterable[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    out: dict = {}
    for part in sums:
        out = {k: v + out.get(k, 0) for k, v in part.items()}
    return out


def fit(model: Model, told: Callable[[np.ndarray], dict[str, np.ndarray]], gain: float, rounds: int) -> Model:
    """Newton's method on the gates' weights, then half a step of it on the map, which is 0 until then.

    told: fit_sums() of all texts at some weights. A step that made the loss larger is halved. The
    last is one that promises less than `gain` bits; after `rounds` calls the best weights are taken.
    """
    weights = np.asarray(model.weights, np.float32)
    best, step, sums = weights, None, None
    for _ in range(rounds):
        now = told(weights)
        if sums is not None and not now["loss"] <= sums["loss"]:
            step = step / 2
        else:
            best, sums = weights, now
            step = np.array([np.linalg.solve(h + 5 * np.eye(INPUTS), g) for g, h in zip(sums["grad"], sums["curve"], strict=True)])
        weights = (best + step).astype(np.float32)
        if (step * sums["grad"]).sum() / 2 < gain * np.log(2):
            best = weights
            break
    return replace(model, weights=best, cells=(0.5 * sums["push"] / (sums["spread"] + 20)).astype(np.float32))


def adapt(model: Model, raw: list[bytes], rounds: int = 5) -> Model:
    """Start weights and map from texts that the tables don't know, all in this process."""
    model = replace(model, cells=np.zeros(CELLS, np.float32))
    return fit(model, lambda w: fit_sums(replace(model, weights=w), raw), 1e-4 * sum(len(r) + 1 for r in raw), rounds) if raw else model


def groups(sizes: list[int], size: int = AT_ONCE) -> Iterator[list[int]]:
    """Indices of texts of like length, about size bytes at once."""
    held, n = [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        held.append(i)
        n += sizes[i] + 40
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


# --- the corpus ----------------------------------------------------------------

_BLOB = "part int, seq int, ids binary, train binary, marks binary, sizes binary, raw binary, n_train long, n_bytes long"


def _pack(batches: Iterator[pd.DataFrame], blob: int) -> Iterator[pd.DataFrame]:
    """Texts of a part in compressed blobs, with a null flag and an id, the training flag and the mark of each."""
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
    press = zstandard.ZstdCompressor(1)

    def out() -> pd.DataFrame:
        nonlocal seq, held, size
        ids, train, marks, raw = zip(*held, strict=True)
        row = (
            part, seq, np.array([[i is None, i or 0] for i in ids], "<i8").tobytes(), np.array(train, np.uint8).tobytes(), np.array(marks, "<i4").tobytes(),
            np.array([len(r) for r in raw], "<i8").tobytes(), press.compress(b"".join(raw)), int(sum(train)), size,
        )
        seq, held, size = seq + 1, [], 0
        return pd.DataFrame([row], columns=[c.strip().split(" ")[0] for c in _BLOB.split(",")])

    for b in batches:
        for i, text, train, mark in zip(b["doc_id"], b["text"], b["train"], b["mark"], strict=True):
            raw = (text or "").encode("utf-8", "replace")
            held.append((None if i is None else int(i), bool(train), int(mark), raw))
            size += len(raw)
            if size >= blob:
                yield out()
    if held:
        yield out()


def _raw(packed: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
    whole = zstandard.ZstdDecompressor().decompress(packed, max_output_size=ends[-1] + 1) if ends[-1] else b""
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class WordCounts:
    """(key, times in training texts) of a part's words, sorted; 0 for words of other texts alone."""

    def __init__(self, hold: int = 4_000_000):
        self._train: list[np.ndarray] = []
        self._other: list[np.ndarray] = []
        self._runs: list[tuple[np.ndarray, np.ndarray]] = []
        self._held, self._hold = 0, hold

    def add(self, doc: np.ndarray, key: np.ndarray, train: np.ndarray) -> None:
        learn = train[doc]
        self._train.append(key[learn])
        self._other.append(key[~learn])
        self._held += len(learn)
        if self._held >= self._hold:
            self.settle()

    def settle(self) -> None:
        if self._held:
            key, n = np.unique(np.concatenate(self._train), return_counts=True)
            self._runs.append((key, n.astype(np.int64)))
            other = np.unique(np.concatenate(self._other))
            self._runs.append((other, np.zeros(len(other), np.int64)))
            self._train, self._other, self._held = [], [], 0
            if len(self._runs) > 2:
                self._runs = [summed(*map(np.concatenate, zip(*self._runs, strict=True)))]

    def rows(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, keys and counts); buckets are ranges of the key, in order."""
        self.settle()
        if self._runs:
            key, n = summed(*map(np.concatenate, zip(*self._runs, strict=True)))
            cut = np.searchsorted(key, np.array([k * 2**64 // buckets - 2**63 for k in range(buckets)], np.int64)).tolist() + [len(key)]
            for k, (a, z) in enumerate(zip(cut, cut[1:], strict=False)):
                if z > a:
                    yield k, key[a:z].tobytes() + n[a:z].tobytes()


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their numbers."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[head], np.add.reduceat(n, head) if len(head) else n


def _pairs_of(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two arrays of packed runs, each joined."""
    both = [np.frombuffer(b, "<i8").reshape(2, -1) for b in blobs]
    return np.concatenate([x[0] for x in both]), np.concatenate([x[1] for x in both])


_WORDS, _TRIPLES, _DEV = range(3)
FOLDS = 2  # of training texts, by their marks; each is fitted on the counts of the other


def _gather(batches: Iterator[pd.DataFrame], buckets: int, dev_below: int, dev_bytes: int) -> Iterator[pd.DataFrame]:
    """(kind, bucket, part, packed): word counts of each part by bucket; of the task: byte triples by first byte, texts that the fit sets out from."""
    words: dict[int, WordCounts] = {}
    triples, held, n_held = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

    def fold(now: tuple, held: list) -> tuple:
        return summed(np.concatenate([now[0], *(t for t, _ in held)]), np.concatenate([now[1], *(n for _, n in held)]))

    for b in batches:
        rows = []
        for part, raw, sizes, train, marks in zip(b["part"], b["raw"], b["sizes"], b["train"], b["marks"], strict=True):
            if part not in words:  # parts come one after another
                for p, w in words.items():
                    rows += [(_WORDS, k, p, packed) for k, packed in w.rows(buckets)]
                words = {part: WordCounts()}
            raw, train = _raw(raw, sizes), np.frombuffer(train, np.uint8) > 0
            mark = np.frombuffer(marks, "<i4")
            for i in np.flatnonzero(train & (mark < dev_below) & (mark % FOLDS == 0)).tolist():
                if len(raw[i]) <= dev_bytes:
                    rows.append((_DEV, int(mark[i]), part, raw[i]))
            for g in groups([len(r) for r in raw]):
                data, lengths = _join([raw[i] for i in g])
                words[part].add(*words_of(data, lengths), train[g])
                learn = [raw[i] for i in g if train[i]]
                if learn:
                    held.append(triple_counts(learn))
                    n_held += len(held[-1][0])
                if n_held > 2_000_000:
                    triples, held, n_held = fold(triples, held), [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["kind", "bucket", "part", "packed"])
    rows = []
    for p, w in words.items():
        rows += [(_WORDS, k, p, packed) for k, packed in w.rows(buckets)]
    if words:
        key, n = fold(triples, held)
        cut = np.searchsorted(key, np.arange(257) << 16).tolist()
        rows += [(_TRIPLES, k, -1, key[a:z].tobytes() + n[a:z].tobytes()) for k, (a, z) in enumerate(zip(cut, cut[1:], strict=False)) if z > a]
        yield pd.DataFrame(rows, columns=["kind", "bucket", "part", "packed"])


def _sum_words(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """A bucket's counts over all parts, handed back to each part; part -1: the bucket's words and distinct words of training texts."""
    h, n = _pairs_of(group["packed"].tolist())
    part = np.repeat(group["part"].to_numpy(), [len(p) // 16 for p in group["packed"]])
    every, total = summed(h, n)
    rows = [(-1, key[0], None, int(total.sum()), int((total > 0).sum()))]
    asked = np.argsort(part, kind="stable")  # a part's keys may come in several runs
    ends = np.flatnonzero(np.append(part[asked][1:] != part[asked][:-1], True)) + 1
    for a, z in zip([0, *ends.tolist()], ends.tolist(), strict=False):
        mine = np.unique(h[asked[a:z]])
        rows.append((int(part[asked[a]]), key[0], mine.tobytes() + total[np.searchsorted(every, mine)].tobytes(), None, None))
    return pd.DataFrame(rows, columns=["part", "bucket", "words", "n_all", "distinct"]).astype({"n_all": "Int64", "distinct": "Int64"})


def _sum_triples(group: pd.DataFrame) -> pd.DataFrame:
    """Counts of byte triples of all tasks with one first byte."""
    return pd.DataFrame({"packed": [b"".join(x.tobytes() for x in summed(*_pairs_of(group["packed"].tolist())))]})


def _folds(raw: list[bytes], train: bytes, marks: bytes) -> list[list[bytes]]:
    """The training texts of a blob by fold."""
    fold = np.where(np.frombuffer(train, np.uint8) > 0, np.frombuffer(marks, "<i4") % FOLDS, -1)
    return [[raw[i] for i in np.flatnonzero(fold == f).tolist()] for f in range(FOLDS)]


def _fit_pass(code: Broadcast, tables: Broadcast, bits: int, weights: np.ndarray) -> Callable:
    """(task, sums) of all training texts, each from the tables of the other fold and a map of zeros."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [Model(code.value, bits, t, weights, np.zeros(CELLS, np.float32)) for t in tables.value]
        sums: dict = {}
        for b in batches:
            for raw, sizes, train, marks in zip(b["raw"], b["sizes"], b["train"], b["marks"], strict=True):
                for f, learn in enumerate(_folds(_raw(raw, sizes), train, marks)):
                    if learn:
                        sums = _add([sums, fit_sums(models[1 - f], learn)])
        if sums:
            yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "sums": [pickle.dumps(sums)]})

    return each


def score(docs: DataFrame, *, least_bits: int = 22, most_bits: int = 24, dev_rows: int = 300, dev_chars: int = 50_000, code_rows: int = 1500, blob: int = 2_000_000, bucket_bytes: int = 16_000_000, count_bytes: int = 64_000_000, fold: int = 1, folds: int = 5, gain: float = 2e-3, rounds: int = 12) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out).alias("train"), F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1_000_000)).alias("mark"))
    texts = keep(map_rows(rows, lambda b: _pack(b, blob), _BLOB), "texts")
    n_train, n_bytes, parts = (x or 0 for x in texts.agg(F.sum("n_train"), F.sum("n_bytes"), F.max("part") + 1).first())
    bits = min(most_bits, max(least_bits, int(n_bytes).bit_length() - 6))  # 3 * 2**most_bits bytes are broadcast at most
    dev_below = int(1e6 * min(1, FOLDS * dev_rows / max(1, n_train)))  # about dev_rows texts of the first fold
    buckets = 1 + int(n_bytes // (4 * bucket_bytes))  # words' keys and counts take a quarter of their texts, or less

    # counts of words, summed over all parts, handed back to the parts that asked; and what the code needs
    gathered = keep(texts.select("part", "raw", "sizes", "train", "marks").mapInPandas(lambda b: _gather(b, buckets, dev_below, dev_chars), "kind int, bucket int, part int, packed binary"), "gathered")
    known = keep(gathered.filter(F.col("kind") == _WORDS).groupBy("bucket").applyInPandas(_sum_words, "part int, bucket int, words binary, n_all long, distinct long"), "word_counts")
    n_words, distinct = known.filter("part < 0").agg(F.coalesce(F.sum("n_all"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n_all, distinct = n_words + n_train, distinct + (n_train > 0)  # with the ends
    few = gathered.filter(F.col("kind") == _TRIPLES).groupBy("bucket").applyInPandas(_sum_triples, "packed binary").collect()  # 256 rows: byte triples that occur
    dev = [bytes(r["packed"]) for r in gathered.filter(F.col("kind") == _DEV).orderBy("bucket", "packed").select("packed").collect()]  # about dev_rows texts of at most dev_chars characters
    drop(gathered)
    code = prefix_code(*common_rows(*(_pairs_of([r["packed"] for r in few]) if few else (np.empty(0, np.int64),) * 2), code_rows))
    sent_code = spark.sparkContext.broadcast(code)

    def contexts(f: int) -> Callable:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = None
            for b in batches:
                for raw, sizes, train, marks in zip(b["raw"], b["sizes"], b["train"], b["marks"], strict=True):
                    learn = _folds(_raw(raw, sizes), train, marks)[f]
                    for g in groups([len(r) for r in learn]):
                        seen = seen or Counts(sent_code.value, bits)
                        seen.add([learn[i] for i in g])
            if seen is not None:
                for some in batched(seen.rows(), 32):  # a frame costs more than a shard
                    yield pd.DataFrame({"shard": [shard for shard, _ in some], "fold": f, "packed": [packed for _, packed in some]})

        return each

    size = min(1 << 16, 1 << bits)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Log-odds of a shard's slots: of each fold, then of all."""

        def odds() -> pd.DataFrame:
            return pd.DataFrame({"shard": [now], "odds": [b"".join(log_odds(x).tobytes() for x in (*total, total.sum(axis=0)))]})

        now, total = None, None
        for b in batches:
            for shard, f, packed in zip(b["shard"], b["fold"], b["packed"], strict=True):
                if shard != now:
                    if now is not None:
                        yield odds()
                    now, total = shard, np.zeros((FOLDS, 2, size), np.int64)
                at, n = _unpack(packed)
                total[f][:, at] += n
        if now is not None:
            yield odds()

    learned = texts.filter("n_train > 0").select("raw", "sizes", "train", "marks")
    # a task holds one fold's counts, of some count_bytes of texts: what it hands on takes as long for few texts as for many
    shares = max(1 + int(n_bytes // count_bytes), spark.sparkContext.defaultParallelism // FOLDS)
    sums = reduce(DataFrame.unionAll, [learned.coalesce(shares).mapInPandas(contexts(f), "shard int, fold int, packed binary") for f in range(FOLDS)])
    merged = keep(sums.repartition("shard").sortWithinPartitions("shard").mapInPandas(merge, "shard int, odds binary"), "odds")
    flat = [np.zeros(CONTEXTS << bits, np.int8) for _ in range(FOLDS + 1)]
    for r in merged.toLocalIterator():  # 2**bits bytes a context and fold, and for all
        for k, x in enumerate(flat):
            x[r["shard"] * size : (r["shard"] + 1) * size] = np.frombuffer(r["odds"], np.int8, size, k * size)
    drop(merged)
    tables = [tuple(x.reshape(CONTEXTS, -1)) for x in flat]
    del flat

    # the start values: each call of told() is a pass over all training texts, from the other fold's tables
    fitted = adapt(start_model(code, bits, tables[1]), dev)
    sent_tables = spark.sparkContext.broadcast(tables[:FOLDS])
    del tables[:FOLDS]

    def told(weights: np.ndarray) -> dict[str, np.ndarray]:
        sums = learned.mapInPandas(_fit_pass(sent_code, sent_tables, bits, weights), "task int, sums binary").collect()  # a row a task, some 2 kB
        return _add(pickle.loads(r["sums"]) for r in sorted(sums, key=lambda r: r["task"]))

    if n_train:
        fitted = fit(fitted, told, gain * (n_bytes + n_train), rounds)
    sent_tables.destroy()
    sent = spark.sparkContext.broadcast(replace(fitted, tables=tables.pop()))

    # texts meet their part's words
    base = 0.5 * (distinct + 1) + n_all
    end = float(np.log10((n_train + 0.5) / base))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, table = None, [], None

        def counts(key: np.ndarray) -> np.ndarray:
            order = np.argsort(key)
            out = np.empty(len(key), np.int64)
            out[order] = table[1][np.searchsorted(table[0], key[order])]
            return out

        for b in batches:
            for part, words, ids, train, sizes, raw in zip(b["part"], b["words"], b["ids"], b["train"], b["sizes"], b["raw"], strict=True):
                if part != now:
                    now, held, table = part, [], None
                if words is not None:  # the part's counts come first, by ranges of the key
                    held.append(words)
                    continue
                if table is None:
                    table, held = _pairs_of(held) if held else (np.empty(0, np.int64),) * 2, []
                raw, n = _raw(raw, sizes), np.frombuffer(sizes, "<i8")
                out = np.zeros((4, len(raw)))
                for g in groups(n.tolist()):
                    some = [raw[i] for i in g]
                    doc, key = words_of(*_join(some))
                    seen = counts(key)
                    tokens, hits, score10 = (np.bincount(doc, w, len(g)) for w in (None, seen > 0, np.log10((seen + 0.5) / base)))
                    out[:, g] = tokens + 1, hits + (n_train > 0), score10 + end, losses(sent.value, some)
                ids = np.frombuffer(ids, "<i8").reshape(-1, 2)
                d = pd.DataFrame({"doc_id": pd.array(ids[:, 1].tolist(), "Int64"), "held_out": np.frombuffer(train, np.uint8) == 0, "n_tokens": out[0].astype(np.int64), "n_known": out[1].astype(np.int64), "train_tokens": n_all, "base_score": out[2], "score": -out[3] / np.log(10), "n_bytes": n, "bits_per_byte": out[3] / np.log(2) / np.maximum(1, n)})
                d.loc[ids[:, 0] > 0, "doc_id"] = pd.NA
                yield d[names]

    none = {c: F.lit(None).cast("binary").alias(c) for c in ("words", "ids", "train", "sizes", "raw")}
    told = known.filter("part >= 0").select("part", F.lit(0).alias("kind"), F.col("bucket").alias("seq"), "words", *[none[c] for c in ("ids", "train", "sizes", "raw")])
    both = told.unionByName(texts.select("part", F.lit(1).alias("kind"), "seq", none["words"], "ids", "train", "sizes", "raw"))
    met = both.repartitionById(max(1, parts), F.col("part")).sortWithinPartitions("part", "kind", "seq")
    return met.mapInPandas(each, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double")
