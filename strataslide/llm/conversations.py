"""Repair of conversation structure at least cost, with an audit of the edits.

The turns of a conversation are a path through the layers of a graph: node (i, s) is "the
first i turns are dealt with, and the roles so far left the pattern `(s?(ua)+)?` in state s".
Arcs keep a turn, give it another role, delete it or insert one, at a cost. The least costs
from the start to every node and from every node to an end tell which arcs are tight, that
is, on some cheapest path. From the set of nodes that the letters so far can have reached,
the least letter of a tight arc is taken at every step, which gives the ASCII-least of all
cheapest audits. Equal letters so far mean equal layers, so that set holds four nodes at most.

Faults, in this order: blank (no word), duplicate (role and text stand earlier in the
conversation), truncated (the last character of a word is none of `.!?`). Turns go by number,
nulls first; turns of one number by role and then by a hash of the text.

Facts about turns (fixed size, no text) are shuffled by role and text to find duplicates and
once more by conversation; texts are shuffled once, to be written out in order. Conversations
are streamed in sorted order, none is held as a group: an audit takes some 70 bytes of memory
a turn while it is worked out, of which a letter stays, as it is one value of the result.

Defined results: null role or text is one space; a null conv_id is a conversation of its own;
a null turn comes first and doesn't count for gaps; equal rows are duplicates of each other;
roles count by their first character, others than s, u and a can't be kept; an empty text is
blank; an empty table gives an empty frame; other columns are left out.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits; the letters of an audit are their initials.
RETITLE, DELETE, INSERT, STILL_TRUNCATED = 1, 2, 5, 5
#: Roles that edits can give, by the state that they lead to.
GIVEN = {2: "user", 3: "assistant"}
_FAR = 1 << 60
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_ENDS = (_START, _ASSISTANT)
#: Where a user's or assistant's turn leads from each state.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_OPEN, _BLANK, _DOUBLE = 4, 8, 16
_LEGAL = ((0, 1), (1, 2), (2, 1))
_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of what can be done with a turn: its role's place in "sua", else 3, and its faults."""
    out = [("D", DELETE, state)]
    if code < _BLANK:
        extra, role = STILL_TRUNCATED if code & _OPEN else 0, code & 3
        if role == 0 and state == _START:
            out.append(("K", extra, _SYSTEM))
        to = _NEXT[state]
        out.append(("K", extra, to) if role == to - 1 else ("R", RETITLE + extra, to))
    return out


_ARCS = [[_arcs(code, state) for state in range(4)] for code in range(32)]


def _costs(codes: bytes) -> tuple[array, array]:
    """Least costs from the start to every node, and from every node to an end; four a layer."""
    n = len(codes)
    ahead, back = array("q", [_FAR]) * (4 * n + 4), array("q", [_FAR]) * (4 * n + 4)

    def inserted(at: int) -> None:
        ahead[at + 2] = min(ahead[at + 2], ahead[at] + INSERT, ahead[at + 1] + INSERT, ahead[at + 3] + INSERT)
        ahead[at + 3] = min(ahead[at + 3], ahead[at + 2] + INSERT)

    ahead[0] = 0
    inserted(0)
    for i, code in enumerate(codes):
        at, arcs = 4 * i, _ARCS[code]
        for s in range(4):
            for _, cost, to in arcs[s]:
                ahead[at + 4 + to] = min(ahead[at + 4 + to], ahead[at + s] + cost)
        inserted(at + 4)
    for i in range(n, -1, -1):
        at = 4 * i
        for s in range(4):
            back[at + s] = (0 if s in _ENDS else _FAR) if i == n else min(cost + back[at + 4 + to] for _, cost, to in _ARCS[codes[i]][s])
        back[at + 2] = min(back[at + 2], back[at + 3] + INSERT)
        for s in (0, 1, 3):
            back[at + s] = min(back[at + s], back[at + 2] + INSERT)
    return ahead, back


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, ASCII-least audit) of a conversation's cheapest repair."""
    ahead, back = _costs(codes)
    n, total, at, nodes, out = len(codes), back[0], 0, {_START}, []
    while at < n or all(back[4 * at + s] for s in nodes):
        best, reached = "Z", set()
        for s in nodes:
            arcs = [("I", INSERT, _NEXT[s], at)] + ([(*arc, at + 1) for arc in _ARCS[codes[at]][s]] if at < n else [])
            for letter, cost, to, layer in arcs:
                if letter <= best and ahead[4 * at + s] + cost + back[4 * layer + to] == total:
                    best, reached = letter, {to} | (reached if letter == best else set())
        out.append(best)
        nodes, at = reached, at + (best != "I")
    return total, "".join(out)


_cheapest = functools.lru_cache(1 << 14)(cheapest)


class _Conversation:
    """What is known of a conversation while its turns stream by."""

    def __init__(self, conv_id: int | None):
        self.id, self.codes, self.first, self.last, self.distinct = conv_id, bytearray(), None, None, 0

    def add(self, codes: np.ndarray, turns: np.ndarray) -> None:
        self.codes += codes.tobytes()
        if len(turns):
            self.distinct += int((np.diff(turns) > 0).sum()) + (self.last is None or int(turns[0]) != self.last)
            self.first = int(turns[0]) if self.first is None else self.first
            self.last = int(turns[-1])

    def row(self) -> dict:
        c = np.frombuffer(self.codes, np.uint8)
        blank, double = c & _BLANK > 0, (c & _DOUBLE > 0) & (c & _BLANK == 0)
        cut = (c & _OPEN > 0) & (c < _BLANK)
        pairs = np.bincount((c[:-1] & 3) * 4 + (c[1:] & 3), minlength=16) if len(c) > 1 else np.zeros(16, int)
        cost, audit = (_cheapest if len(c) < 64 else cheapest)(bytes(self.codes))
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.distinct, 2**63 - 1)
        legal = sum(int(pairs[a * 4 + b]) for a, b in _LEGAL)
        return {"conv_id": self.id, "gaps": gaps, "blank": int(blank.sum()), "duplicate": int(double.sum()), "truncated": int(cut.sum()), "illegal": int(pairs.sum()) - legal, "cost": cost, "audit": audit}


def _stretches(ids: pa.Array) -> list[tuple[int, int]]:
    """Places of equal neighbouring ids; null is a value."""
    null, value = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero((null[1:] != null[:-1]) | (value[1:] != value[:-1])) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(ids)], strict=True))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted facts in, an audit a conversation out."""
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
    now = None
    for batch in batches:
        done = []
        if not batch.num_rows:
            continue
        ids, codes, turns = batch.column("conv_id"), batch.column("code").to_numpy(zero_copy_only=False).astype(np.uint8), batch.column("turn")
        for a, b in _stretches(ids):
            if now is None or now.id != ids[a].as_py():
                if now is not None:
                    done.append(now.row())
                now = _Conversation(ids[a].as_py())
            now.add(codes[a:b], turns.slice(a, b - a).drop_null().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pylist(done, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.row()], schema)


def _turns(turns: DataFrame) -> DataFrame:
    told = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *told).withColumn("mark", F.xxhash64("text"))


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation of turns (conv_id, turn, role, text): its gaps and faults, the cost of the cheapest repair and its audit."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    place = F.instr(F.lit("sua"), F.substring("role", 1, 1))
    role = F.when((F.length("role") > 0) & (place > 0), place - 1).otherwise(3)
    facts = _turns(turns).select("conv_id", "turn", "role", "mark", F.xxhash64(F.lit(1), "text").alias("mark2"), (role + F.when(cut, _OPEN).otherwise(0) + F.when(blank, _BLANK).otherwise(0)).alias("code"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "mark", "mark2").orderBy("turn")) > 1
    facts = facts.select("conv_id", "turn", "role", "mark", (F.col("code") + F.when(again, _DOUBLE).otherwise(0)).alias("code"))
    return facts.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark", "code").select("conv_id", "turn", "code").mapInArrow(_solve, _AUDIT)


class _Writer:
    """Plays an audit against the turns of its conversation."""

    def __init__(self, conv_id: int | None, audit: str):
        self.id, self.audit, self.at, self.place, self.last = conv_id, audit, 0, 0, ""

    def _out(self, role: str, text: str) -> tuple:
        self.last, self.place = role[:1], self.place + 1
        return (self.id, self.place - 1, role, text)

    def _given(self) -> str:
        return GIVEN[_ASSISTANT if self.last == "u" else _USER]

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._out(self._given(), "")

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield self._out(role if letter == "K" else self._given(), text)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: for each conversation its audit, then its turns. Out: the turns as repaired."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    now = None
    for batch in batches:
        out = []
        for conv_id, is_turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "is_turn", "role", "text")), strict=True):
            if is_turn:
                out += now.turn(role, text)
            else:
                out += now.inserted() if now else ()
                now = _Writer(conv_id, text)
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
    if now:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in now.inserted()], schema)


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns after the edits that audits() found: conv_id, place (from 0), role, text; a conversation's rows lie in one partition, in order."""
    rows = _turns(turns).select("conv_id", F.lit(True).alias("is_turn"), "turn", "role", "mark", "text")
    heads = found.select("conv_id", F.lit(False).alias("is_turn"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(0).cast("long").alias("mark"), F.col("audit").alias("text"))
    order = ("conv_id", "is_turn", "turn", "role", "mark")
    sorted_rows = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order)
    return sorted_rows.select("conv_id", "is_turn", "role", "text").mapInArrow(_write, "conv_id long, place long, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])
    known, conv, sha = False, None, None
    for batch in batches:
        done = []
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            line = f"{role}:{text}".encode()
            if known and conv_id == conv:
                sha.update(b"\n" + line)
                continue
            if known:
                done.append({"conv_id": conv, "sha256": sha.hexdigest()})
            known, conv, sha = True, conv_id, hashlib.sha256(line)
        yield pa.RecordBatch.from_pylist(done, schema)
    if known:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "sha256": sha.hexdigest()}], schema)


def digests(fixed: DataFrame) -> DataFrame:
    """Per conversation of repaired() rows, as they come: SHA-256 of its `role:text` lines. A digest is sequential, so a conversation streams through one task, without being held."""
    return fixed.select("conv_id", "role", "text").mapInArrow(_digest, "conv_id long, sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after planted faults, by the checksum of `conv_id:turn`; nulls become one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
