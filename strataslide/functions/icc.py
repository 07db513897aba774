"""ICC profiles: from a scanner's colours to sRGB, by curves and matrix or by a lattice.

    profile = read_profile(data)      # a ValueError if it is none that is read
    profile.apply(image)              # RGB or RGBA of 8 bits; alpha stays

Of a profile the perceptual table (A2B0) is taken where it has one, else its curves and
primaries. Between the points of a lattice colours are interpolated in the simplex that holds
them. Black points are not moved, and results are rounded to 8 bits and cut at 0 and 255.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

# Primaries of sRGB (columns) and white, both in light of 5,000 K.
SRGB = np.array([[0.4360747, 0.3850649, 0.1430804], [0.2225045, 0.7168786, 0.0606169], [0.0139322, 0.0971045, 0.7141733]])
WHITE = np.array([0.9642, 1.0, 0.8249])
# How many parameters each form of a parametric curve has.
PARAMETERS = {0: 1, 1: 3, 2: 4, 3: 5, 4: 7}
#: Pixels that are worked on at a time.
BLOCK = 1 << 18


def _fixed(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, ">i4", n, at) / 65536


def encoded(linear: np.ndarray) -> np.ndarray:
    """Light to sRGB, both 0 to 1."""
    x = np.clip(linear, 0, 1)
    return np.where(x <= 0.0031308, 12.92 * x, 1.055 * x ** (1 / 2.4) - 0.055)


def lab_to_xyz(lab: np.ndarray) -> np.ndarray:
    y = (lab[:, 0] + 16) / 116
    f = np.stack([y + lab[:, 1] / 500, y, y - lab[:, 2] / 200], 1)
    return np.where(f > 6 / 29, f**3, (f - 4 / 29) * 3 * (6 / 29) ** 2) * WHITE


# --- curves ------------------------------------------------------------------


@dataclass(frozen=True)
class Curve:
    """Points over 0 to 1, or a formula's parameters g a b c d e f (None for points)."""

    points: np.ndarray | None
    formula: tuple[float, ...] = ()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.points is not None:
            return np.interp(x, np.linspace(0, 1, len(self.points)), self.points)
        g, a, b, c, d, e, f = self.formula
        return np.where(x >= d, np.maximum(a * x + b, 0) ** g + e, c * x + f)


def _curve(raw: bytes, at: int) -> tuple[Curve, int]:
    """The curve at a place, and its length in bytes."""
    kind, n = raw[at : at + 4], int.from_bytes(raw[at + 8 : at + 12], "big")
    if kind == b"curv":
        if n == 0:
            return Curve(np.array([0.0, 1.0])), 12
        values = np.frombuffer(raw, ">u2", n, at + 12)
        return (Curve(None, (values[0] / 256, 1, 0, 0, 0, 0, 0)) if n == 1 else Curve(values / 65535)), 12 + 2 * n
    if kind == b"para" and (form := n >> 16) in PARAMETERS:
        p = _fixed(raw, at + 12, PARAMETERS[form]).tolist()
        g, a, b, c, d, e, f = (*p, *[0.0] * (7 - len(p)))
        if form == 0:
            formula = (g, 1, 0, 0, 0, 0, 0)
        elif form in (1, 2):  # beyond the zero of a x + b, both with c added
            formula = (g, a, b, 0, -b / a, c, c)
        else:
            formula = (g, a, b, c, d, e, f)
        return Curve(None, formula), 12 + 4 * len(p)
    raise ValueError(f"ICC curves of type {kind!r} are not read")


def _curves(raw: bytes, at: int, n: int) -> list[Curve]:
    """n curves, each filled up to four bytes."""
    out = []
    for _ in range(n):
        c, length = _curve(raw, at)
        out.append(c)
        at += -(-length // 4) * 4
    return out


def _each(curves: list[Curve], x: np.ndarray) -> np.ndarray:
    return np.stack([c(x[:, k]) for k, c in enumerate(curves)], 1) if curves else x


# --- lattice -----------------------------------------------------------------


@dataclass(frozen=True)
class Lattice:
    """Values (points x 3) at a grid of colours; the last axis runs fastest."""

    grid: tuple[int, ...]
    values: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        size = np.array(self.grid)
        step = np.array([int(np.prod(self.grid[k + 1 :])) for k in range(len(self.grid))])
        place = np.clip(x, 0, 1) * (size - 1)
        low = np.minimum(place.astype(np.int64), np.maximum(size - 2, 0))
        part = place - low
        order = np.argsort(-part, axis=1, kind="stable")  # from a corner to its opposite, the longest way first
        sorted_ = np.take_along_axis(part, order, 1)
        at = low @ step
        out = self.values[at] * (1 - sorted_[:, :1])
        for k in range(len(self.grid)):
            at = at + np.where(size[order[:, k]] > 1, step[order[:, k]], 0)
            after = sorted_[:, k + 1] if k + 1 < len(self.grid) else 0
            out += self.values[at] * (sorted_[:, k] - after)[:, None]
        return out


# --- profiles ----------------------------------------------------------------


@dataclass(frozen=True)
class Profile:
    """Curves in, then a lattice, curves, a matrix with an offset, curves; each may be missing. space: what comes out."""

    first: list[Curve]
    lattice: Lattice | None
    between: list[Curve]
    matrix: np.ndarray | None  # 3 x 4
    last: list[Curve]
    space: str  # xyz (as it is), xyz16, lab8, lab16

    def xyz(self, x: np.ndarray) -> np.ndarray:
        """XYZ in light of 5,000 K of colours (n x 3, 0 to 1)."""
        v = _each(self.first, x)
        v = v if self.lattice is None else self.lattice(v)
        v = _each(self.between, v)
        v = v if self.matrix is None else v @ self.matrix[:, :3].T + self.matrix[:, 3]
        v = _each(self.last, v)
        if self.space == "xyz":
            return v
        if self.space == "xyz16":
            return v * (65535 / 32768)
        by_16 = self.space == "lab16"
        scale = np.array([65535 / 652.8, 65535 / 256, 65535 / 256] if by_16 else [100.0, 255.0, 255.0])
        return lab_to_xyz(v * scale - np.array([0.0, 128.0, 128.0]))

    def apply(self, image: np.ndarray) -> np.ndarray:
        flat = np.ascontiguousarray(image[:, :, :3]).reshape(-1, 3)
        done, back = np.empty_like(flat), np.linalg.inv(SRGB).T
        for k in range(0, len(flat), BLOCK):
            done[k : k + BLOCK] = np.floor(encoded(self.xyz(flat[k : k + BLOCK] / 255) @ back) * 255 + 0.5)
        out = image.copy()
        out[:, :, :3] = done.reshape(*image.shape[:2], 3)
        return out


def _table(raw: bytes, at: int, pcs: bytes) -> Profile:
    kind, n_in, n_out = raw[at : at + 4], raw[at + 8], raw[at + 9]
    if (n_in, n_out) != (3, 3):
        raise ValueError("an ICC table of other than three colours")
    if kind in (b"mft1", b"mft2"):
        wide = kind == b"mft2"
        grid, pos = raw[at + 10], at + (52 if wide else 48)
        into, out_of = struct.unpack(">HH", raw[at + 48 : at + 52]) if wide else (256, 256)
        sizes = (3 * into, grid**3 * 3, 3 * out_of)
        v = np.frombuffer(raw, ">u2" if wide else "u1", sum(sizes), pos) / (65535 if wide else 255)
        first, lattice, last = np.split(v, np.cumsum(sizes)[:-1])
        curves = lambda x: [Curve(c) for c in x.reshape(3, -1)]
        space = ("lab16" if wide else "lab8") if pcs == b"Lab " else "xyz16"
        return Profile(curves(first), Lattice((grid,) * 3, lattice.reshape(-1, 3)), [], None, curves(last), space)
    if kind == b"mAB ":
        b, m, mid, lattice, a = struct.unpack(">5I", raw[at + 12 : at + 32])
        held = None
        if lattice:
            grid, wide = tuple(raw[at + lattice : at + lattice + 3]), raw[at + lattice + 16] == 2
            v = np.frombuffer(raw, ">u2" if wide else "u1", int(np.prod(grid)) * 3, at + lattice + 20) / (65535 if wide else 255)
            held = Lattice(grid, v.reshape(-1, 3))
        some = lambda p: _curves(raw, at + p, 3) if p else []
        e = _fixed(raw, at + m, 12) if m else None
        matrix = None if e is None else np.column_stack([e[:9].reshape(3, 3), e[9:]])
        return Profile(some(a), held, some(mid), matrix, some(b), "lab8" if pcs == b"Lab " else "xyz16")
    raise ValueError(f"ICC tables of type {kind!r} are not read")


def read_profile(data: bytes) -> Profile:
    """A profile of RGB; a ValueError for what is none, is cut short or is of a kind that is not read."""
    try:
        if data[36:40] != b"acsp" or data[16:20] != b"RGB ":
            raise ValueError("not an ICC profile of RGB")
        tags = {data[k : k + 4]: struct.unpack(">II", data[k + 4 : k + 12]) for k in range(132, 132 + 12 * int.from_bytes(data[128:132], "big"), 12)}
        if b"A2B0" in tags:
            found = _table(data, tags[b"A2B0"][0], data[20:24])
        else:
            primaries = np.stack([_fixed(data, tags[c + b"XYZ"][0] + 8, 3) for c in (b"r", b"g", b"b")], 1)
            curves = [_curve(data, tags[c + b"TRC"][0])[0] for c in (b"r", b"g", b"b")]
            found = Profile(curves, None, [], np.column_stack([primaries, np.zeros(3)]), [], "xyz")
        if not np.isfinite(found.xyz(np.array([[0.0, 0.5, 1.0]]))).all():
            raise ValueError("an ICC profile without finite colours")
        return found
    except (KeyError, IndexError, struct.error, ZeroDivisionError) as e:
        raise ValueError(f"a broken ICC profile: {e!r}") from e
