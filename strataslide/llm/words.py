"""Words of many texts at once, found and hashed by array operations."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_C = 0xD1342543DE82EF95
_INVERSE = pow(_C, -1, 2**64)
#: Bytes that are hashed at a time; a longer word makes its piece longer.
PIECE = 1 << 19


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            ahead = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])
            self.up, self.down = ahead(_C), ahead(_INVERSE)


_powers = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """A fixed shuffle of 64-bit values in which every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start byte, 64-bit hash) of every `[^\\x20\\x09-\\x0D]+` of a UTF-8 text: a polynomial of the word's bytes, mixed."""
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    begins, values, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not space[end]:  # a word is not cut
            here = np.flatnonzero(space[end : end + 4096])
            end = end + int(here[0]) if len(here) else min(end + 4096, len(data))
        gap = np.concatenate([[True], space[at:end], [True]])
        starts = np.flatnonzero(gap[:-2] & ~gap[1:-1])
        ends = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
        _powers.reach(end - at + 1)
        sums = np.zeros(end - at + 1, np.uint64)
        np.cumsum((data[at:end].astype(np.uint64) + np.uint64(1)) * _powers.up[: end - at], out=sums[1:])
        begins.append(starts + at)
        values.append(mixed((sums[ends] - sums[starts]) * _powers.down[starts]))
        at = end
    if not begins:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(begins), np.concatenate(values)


def hashed_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts in a row, and where each text's begin; one more place ends the last."""
    starts, values = hashed(b" ".join(texts))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return values, np.searchsorted(starts, offsets)
