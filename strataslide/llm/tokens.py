"""Exact subword ids from a tokenizer file, with a cache by pre-token.

The pre-tokenizer of the word vocabulary drops white space and cuts text into runs of
letters, single digits and runs of signs, each encoded on its own. Text of plain letters,
digits and signs is cut into those pieces here, by array over many texts at once, and each
distinct piece is encoded once per worker; new pieces are encoded in one call and told apart
by the end-of-word mark. Pieces are told apart by their characters, not by hashes alone. Any
other stretch between white space goes to the tokenizer as it is.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_BY_PATH: dict[str, "ChunkTokenizer"] = {}

#: Characters that lower-case and normalise one by one, and white space that every part agrees on.
_PLAIN = re.compile(r"[ \t\n\r!-~À-ÖØ-öø-ÿ¡«»¿°–—‘’“”…€]*")
_CHUNK = re.compile(r"[^ \t\n\r]+")
#: Stands for a stretch that isn't plain, where texts are cut.
_ODD = "\x01"
#: Plain text has a byte a character in this encoding.
_BYTES = "cp1252"
_LETTER, _DIGIT, _SIGN, _STRETCH = range(1, 5)
_KIND = np.zeros(256, np.uint8)
for _kind, _chars in ((_LETTER, "[a-zß-öø-ÿ]"), (_DIGIT, "[0-9]"), (_SIGN, r"[!-/:-@\[-`{-~¡«»¿°–—‘’“”…€]"), (_STRETCH, _ODD)):
    _KIND[[c for c in range(256) if re.fullmatch(_chars, bytes([c]).decode(_BYTES, "ignore"))]] = _kind
_WIDE = 16  # characters of a piece that its two keys hold
#: The bytes of a word that n characters take.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def tokenizer_path(name: str) -> str:
    """name: a file's place, or the name of a file of the installed vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each piece of plain lower-case text, a byte a character, that ends in white space.

    The contractions that the pre-tokenizer splits off ('s 't 're 've 'm 'll 'd) are pieces where a run of signs could begin.
    """
    kind = _KIND[data]
    before = np.concatenate([[np.uint8(0)], kind[:-1]])
    edge = kind != before
    edge |= (kind == _DIGIT) | (kind == _STRETCH)
    mark = np.flatnonzero((data == ord("'")) & (before != _SIGN))
    mark = mark[mark + 2 < len(data)]
    one, two = data[mark + 1], data[mark + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    for k, at in ((2, mark[short]), (3, mark[~short & np.isin(one.astype(np.uint16) << 8 | two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])])):
        edge[at + 1] = False
        edge[at + k] = True
    at = np.flatnonzero(edge)
    held = np.flatnonzero(kind[at])
    return at[held], at[held + 1] if len(held) else at[:0]


class ChunkTokenizer:
    """ids(text) gives little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, max_cached: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tok = self._bare = Tokenizer.from_file(path)
        self._max = max_cached
        vocab = self._tok.get_vocab(with_added_tokens=True)
        self._end = np.zeros(max(vocab.values()) + 1, bool)
        self._end[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._cuts = bool(self._end.any())  # else the vocabulary is of another kind
        steps = (json.loads(self._tok.to_str())["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if len(steps) == 2 and steps[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}:
            # pieces are cut and in lower case already, so they need none of it again
            self._bare = Tokenizer.from_file(path)
            self._bare.normalizer = None
            self._bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._clear()

    def _clear(self) -> None:
        """Forget all pieces. Number 0 is none; the table has the number of a piece at its hash or in the places after it."""
        self._n, self._n_ids, self._bits = 1, 0, 16
        self._low, self._high = np.zeros(1 << 15, np.uint64), np.zeros(1 << 15, np.uint64)
        self._first, self._size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self._flat = np.zeros(1 << 17, "<u4")
        self._table = np.zeros(1 << self._bits, np.int32)
        self._named: dict[str, int] = {}  # pieces longer than their keys, and stretches, marked by a first space

    def _encode(self, text: str) -> bytes:
        return np.array(self._tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and "<|" not in text

    def _place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15)
        h ^= high * np.uint64(0xD1342543DE82EF95)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h >>= np.uint64(64 - self._bits)
        return h.astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each piece; 0 if it is new."""
        place = self._place(low, high)
        found = self._table[place].astype(np.int64)
        rest = np.flatnonzero((found > 0) & ((self._low[found] != low) | (self._high[found] != high)))
        while len(rest):
            place[rest] += 1
            place[rest] &= len(self._table) - 1
            now = self._table[place[rest]].astype(np.int64)
            found[rest] = now
            rest = rest[(now > 0) & ((self._low[now] != low[rest]) | (self._high[now] != high[rest]))]
        return found

    def _enter(self, number: np.ndarray) -> None:
        place = self._place(self._low[number], self._high[number])
        while len(number):
            free = np.flatnonzero(self._table[place] == 0)
            self._table[place[free]] = number[free]  # of pieces that meet at a place, one stays
            left = np.flatnonzero(self._table[place] != number)
            number, place = number[left], place[left] + 1 & len(self._table) - 1

    def _learn(self, pieces: list[str], low: np.ndarray, high: np.ndarray) -> None:
        """Give new pieces the next numbers; low, high: the keys of the first ones, the others go by name."""
        whole = [p for p in pieces if p[0] != " "]
        parts = []
        if whole:
            ids = np.array(self._bare.encode_batch_fast([" ".join(whole)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self._end[ids]) + 1
            if len(ends) != len(whole) or ends[-1] != len(ids):
                raise ValueError("the tokenizer doesn't end every piece with an end-of-word mark")
            parts, sizes = [ids], [np.diff(ends, prepend=0)]
        else:
            sizes = []
        for p in pieces[len(whole) :]:  # stretches come last
            parts.append(np.frombuffer(self._encode(p[1:]), "<u4"))
            sizes.append([len(parts[-1])])
        flat, size = np.concatenate(parts), np.concatenate(sizes)
        n, n_ids = self._n + len(pieces), self._n_ids + len(flat)
        for name in ("_low", "_high", "_first", "_size", "_flat"):
            was, need = getattr(self, name), n_ids if name == "_flat" else n
            if need > len(was):
                setattr(self, name, np.concatenate([was, np.zeros(max(need, 2 * len(was)) - len(was), was.dtype)]))
        self._flat[self._n_ids : n_ids] = flat
        self._size[self._n : n] = size
        self._first[self._n : n] = self._n_ids + np.cumsum(size) - size
        keyed = self._n + len(low)
        self._low[self._n : keyed], self._high[self._n : keyed] = low, high
        self._named.update(zip(pieces[len(low) :], range(keyed, n), strict=True))
        new = np.arange(self._n, keyed)
        self._n, self._n_ids = n, n_ids
        if 2 * n > len(self._table):
            self._bits = int(4 * n).bit_length()
            self._table = np.zeros(1 << self._bits, np.int32)
            new = np.flatnonzero(self._low[:n])
        self._enter(new)

    def _numbers(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, odd: list[str]) -> np.ndarray:
        """The number of each piece of data, new ones learned; odd: the stretches, in order."""
        padded = np.concatenate([data, np.zeros(_WIDE, np.uint8)])
        words = np.ndarray((len(data) + _WIDE - 7,), "<u8", padded, strides=(1,))
        low = words[at] & _MASK[np.minimum(size, 8)]
        high = np.zeros(len(at), np.uint64)
        long = np.flatnonzero(size > 8)
        high[long] = words[at[long] + 8] & _MASK[np.minimum(size[long] - 8, 8)]
        by_name = (size > _WIDE) | (data[at] == ord(_ODD))
        stretch, keyed = iter(odd), np.flatnonzero(~by_name)
        by_name = np.flatnonzero(by_name)
        names = [" " + next(stretch) if data[a] == ord(_ODD) else data[a : a + n].tobytes().decode(_BYTES) for a, n in zip(at[by_name].tolist(), size[by_name].tolist(), strict=True)]
        if len(by_name):
            low, high = low[keyed], high[keyed]
        while True:
            found = self._find(low, high)
            new = np.flatnonzero(found == 0)
            order = new[np.lexsort((low[new], high[new]))]
            first = np.concatenate([[True], (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])])[: len(order)]
            head = order[first]
            named = sorted({s for s in names if s not in self._named}, key=lambda s: (s[0] == " ", s))
            if self._n == 1 or self._n + len(head) + len(named) <= self._max:
                break
            self._clear()
        if len(head) or named:
            found[order] = self._n + np.cumsum(first) - 1
            raw = data.tobytes()
            begin = at[keyed[head]]
            pieces = b" ".join([raw[a:b] for a, b in zip(begin.tolist(), (begin + size[keyed[head]]).tolist(), strict=True)]).decode(_BYTES)
            self._learn((pieces.split(" ") if pieces else []) + named, low[head], high[head])
        if not names:
            return found
        out = np.empty(len(at), np.int64)
        out[keyed], out[by_name] = found, [self._named[s] for s in names]
        return out

    def ids(self, texts: list[str], group: int = 2_000_000):
        """Yields each text's ids; texts of about group characters are cut, looked up and learned from together."""
        if not self._cuts:
            for text in texts:
                yield self._encode(text)
            return
        at = 0
        while at < len(texts):
            some, odd, n = [], [], 0
            while at < len(texts) and (not some or n + len(texts[at]) <= group):
                text = texts[at]
                n += len(text)
                if not self._plain(text):
                    chunks = [(c, self._plain(c)) for c in _CHUNK.findall(text)]
                    odd += [c for c, plain in chunks if not plain]
                    text = " ".join([c if plain else _ODD for c, plain in chunks])
                some.append(text)
                at += 1
            data = np.frombuffer(("\n".join(some) + "\n").lower().encode(_BYTES), np.uint8)
            begin, end = cut(data)
            number = self._numbers(data, begin, end - begin, odd)
            size = self._size[number]
            ends = np.cumsum(size)
            place = np.repeat(self._first[number] - ends + size, size)
            place += np.arange(len(place))
            raw = self._flat[place].tobytes()
            after = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in some]))  # pieces up to each text's end
            ends = (4 * np.concatenate([[0], ends])[after]).tolist()
            for a, z in zip([0, *ends], ends, strict=False):
                yield raw[a:z]


def chunk_tokenizer(name: str) -> ChunkTokenizer:
    """One per worker process."""
    path = tokenizer_path(name)
    if path not in _BY_PATH:
        _BY_PATH[path] = ChunkTokenizer(path)
    return _BY_PATH[path]
