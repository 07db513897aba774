"""ICC profiles against closed forms; profiles are laid out here, not by the package."""

import struct

import numpy as np
import pytest

from strataslide.api import SlideSet
from strataslide.functions import icc
from strataslide.functions.raster import ColorStyle, read_correction

RNG = np.random.default_rng(5)
IMAGE = RNG.integers(0, 256, (40, 50, 3), dtype=np.uint8)
fixed = lambda *v: struct.pack(f">{len(v)}i", *[round(x * 65536) for x in v])


def profile(tags, pcs=b"XYZ "):
    table, body = struct.pack(">I", len(tags)), b""
    for name, held in tags.items():
        table += name + struct.pack(">II", 132 + 12 * len(tags) + len(body), len(held))
        body += held + bytes(-len(held) % 4)
    head = bytearray(128)
    head[16:24], head[36:40] = b"RGB " + pcs, b"acsp"
    return bytes(head) + table + body


def matrix(rows, curve):
    return profile({c + b"XYZ": b"XYZ \0\0\0\0" + fixed(*[r[k] for r in rows]) for k, c in enumerate((b"r", b"g", b"b"))} | {c + b"TRC": curve for c in (b"r", b"g", b"b")})


def gamma(g):
    return b"curv\0\0\0\0" + struct.pack(">IH", 1, round(g * 256))


def srgb(xyz):
    """XYZ to 8-bit sRGB, written out for one colour at a time."""
    light = np.linalg.solve(icc.SRGB, xyz)
    out = []
    for v in light:
        v = min(max(v, 0.0), 1.0)
        out.append(int(255 * (12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055) + 0.5))
    return out


def from_lab(L, a, b):
    y = (L + 16) / 116
    cube = lambda t: t**3 if t > 6 / 29 else (t - 4 / 29) * 108 / 841
    return np.array([0.9642 * cube(y + a / 500), cube(y), 0.8249 * cube(y - b / 200)])


def by_rule(rule):
    return np.array([[srgb(rule(*(p / 255))) for p in row] for row in IMAGE])


def near(got, want, most=1, share=0.01):
    """Equal but for a step here and there, where rounding of the profile's own numbers falls on an edge."""
    off = abs(got.astype(int) - want)
    assert off.max() <= most and (off > 0).mean() <= share


def test_curves_and_matrix():
    srgb_curve = b"para\0\0\0\0" + struct.pack(">HH", 3, 0) + fixed(2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)
    near(icc.read_profile(matrix(icc.SRGB, srgb_curve)).apply(IMAGE), IMAGE.astype(int), share=0.02)  # its own space
    turned = icc.SRGB @ np.array([[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.0, 0.2, 0.8]])
    near(icc.read_profile(matrix(turned, gamma(1.75))).apply(IMAGE), by_rule(lambda *p: turned @ np.array(p) ** 1.75))
    steps = np.linspace(0, 1, 33) ** 2
    points = b"curv\0\0\0\0" + struct.pack(">I33H", 33, *np.round(steps * 65535).astype(int))
    near(icc.read_profile(matrix(turned, points)).apply(IMAGE), by_rule(lambda *p: turned @ np.interp(p, np.linspace(0, 1, 33), steps)))
    empty = b"curv\0\0\0\0" + bytes(4)
    near(icc.read_profile(matrix(turned, empty)).apply(IMAGE), by_rule(lambda *p: turned @ np.array(p)))
    for form, params, rule in ((0, (2.0,), lambda x: x**2), (1, (2.0, 1.25, -0.25), lambda x: np.where(x >= 0.2, np.maximum(1.25 * x - 0.25, 0) ** 2, 0)), (2, (2.0, 1.25, -0.25, 0.1), lambda x: np.where(x >= 0.2, np.maximum(1.25 * x - 0.25, 0) ** 2, 0) + 0.1), (4, (2.0, 0.9, 0.1, 0.3, 0.1, 0.05, 0.02), lambda x: np.where(x >= 0.1, (0.9 * x + 0.1) ** 2 + 0.05, 0.3 * x + 0.02))):
        held = b"para\0\0\0\0" + struct.pack(">HH", form, 0) + fixed(*params)
        x = np.linspace(0.003, 0.997, 100)  # beside the joints
        assert abs(icc._curve(held, 0)[0](x) - rule(x)).max() < 1e-3


def lut16(grid, rule, into=None, out_of=None):
    """mft2: rule takes a colour, 0 to 1, to three numbers, 0 to 1."""
    line = np.array([0, 65535])
    into, out_of = line if into is None else into, line if out_of is None else out_of
    axis = np.linspace(0, 1, grid)
    values = np.array([rule(r, g, b) for r in axis for g in axis for b in axis])
    body = np.concatenate([np.tile(into, 3), np.round(np.clip(values, 0, 1) * 65535).astype(int).ravel(), np.tile(out_of, 3)])
    return b"mft2\0\0\0\0" + bytes([3, 3, grid, 0]) + fixed(1, 0, 0, 0, 1, 0, 0, 0, 1) + struct.pack(">HH", len(into), len(out_of)) + body.astype(">u2").tobytes()


def test_lattices():
    lab = lambda r, g, b: (95 * (0.3 * r + 0.6 * g + 0.1 * b), 60 * (r - g), 50 * (g - b))
    of_16 = lambda L, a, b: (L * 652.8 / 65535, (a + 128) * 256 / 65535, (b + 128) * 256 / 65535)
    of_8 = lambda L, a, b: (L / 100, (a + 128) / 255, (b + 128) / 255)
    want = by_rule(lambda *p: from_lab(*lab(*p)))
    for grid in (2, 5, 17):  # a linear rule is met exactly between the points too
        near(icc.read_profile(profile({b"A2B0": lut16(grid, lambda *p: of_16(*lab(*p)))}, b"Lab ")).apply(IMAGE), want)
    square = np.round(np.linspace(0, 1, 256) ** 2 * 65535).astype(int)
    curved = icc.read_profile(profile({b"A2B0": lut16(9, lambda *p: of_16(*lab(*p)), into=square)}, b"Lab ")).apply(IMAGE)
    near(curved, by_rule(lambda *p: from_lab(*lab(*np.array(p) ** 2))))
    as_xyz = icc.read_profile(profile({b"A2B0": lut16(3, lambda *p: icc.SRGB @ np.array(p) * 32768 / 65535)})).apply(IMAGE)
    near(as_xyz, by_rule(lambda *p: icc.SRGB @ np.array(p)))
    # mAB: curves, lattice of unequal sides, curves, matrix with offset, curves
    grid = (2, 3, 4)
    axes = [np.linspace(0, 1, g) for g in grid]
    values = np.array([of_8(*lab(r, g, b)) for r in axes[0] for g in axes[1] for b in axes[2]])
    empty = b"curv\0\0\0\0" + bytes(4)
    parts = {"b": empty * 3, "m": fixed(1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0), "mid": empty * 3, "clut": bytes(grid) + bytes(13) + b"\2\0\0\0" + np.round(values * 65535).astype(">u2").tobytes(), "a": empty * 3}
    head, at, body = b"mAB \0\0\0\0" + bytes([3, 3, 0, 0]), 32, b""
    for held in parts.values():
        head += struct.pack(">I", at + len(body))
        body += held + bytes(-len(held) % 4)
    near(icc.read_profile(profile({b"A2B0": head + body}, b"Lab ")).apply(IMAGE), want)
    # mft1, at the points of its own lattice
    points = RNG.integers(0, 256, (3, 3, 3, 3))
    table = np.arange(256)
    small = b"mft1\0\0\0\0" + bytes([3, 3, 3, 0]) + fixed(1, 0, 0, 0, 1, 0, 0, 0, 1) + np.concatenate([np.tile(table, 3), points.ravel(), np.tile(table, 3)]).astype(np.uint8).tobytes()
    corners = np.array([[[r, g, b] for g in (0, 255) for b in (0, 255)] for r in (0, 255)], np.uint8)
    got = icc.read_profile(profile({b"A2B0": small}, b"Lab ")).apply(corners)
    assert (got == [[srgb(from_lab(*(points[r // 127, g // 127, b // 127] * [100 / 255, 1, 1] - [0, 128, 128]))) for r, g, b in row] for row in corners.astype(int)]).all()


def test_a_simplex_between_points():
    """On the diagonal of a cell only its two ends count; on a face's only three corners."""
    values = RNG.random((8, 3))
    lattice = icc.Lattice((2, 2, 2), values)
    assert np.allclose(lattice(np.array([[0.3, 0.3, 0.3]])), 0.7 * values[0] + 0.3 * values[7])
    assert np.allclose(lattice(np.array([[0.6, 0.0, 0.2]])), 0.4 * values[0] + 0.4 * values[4] + 0.2 * values[5])
    assert np.allclose(lattice(np.array([[1.0, 1.0, 1.0], [1.0, 0.0, 1.0]])), values[[7, 5]])


def test_broken_profiles_leave_images(spark):
    good = matrix(icc.SRGB, gamma(2.2))
    for bad in (b"", b"no profile", good[:200], good.replace(b"rTRC", b"xTRC"), good.replace(b"curv", b"curx"), profile({b"A2B0": b"mft2\0\0\0\0" + bytes([4, 3, 2, 0]) + bytes(60)}), profile({b"A2B0": lut16(5, lambda *p: p)[:300]}), profile({b"A2B0": b"????" + bytes(60)})):
        with pytest.raises(ValueError):
            icc.read_profile(bad)
        assert read_correction(bad) is None
    lut = b"<lut><gamma>1.5</gamma><rgbRate><float>1</float><float>0.5</float><float>1</float></rgbRate><hsvRate><float>1</float><float>2</float><float>3</float></hsvRate></lut>"
    styles = spark.createDataFrame([("Real", good), ("Gorgeous", lut), ("torn", good[:200]), ("none", None), (None, good)], "name string, document binary")
    alpha = np.dstack([IMAGE, RNG.integers(0, 256, IMAGE.shape[:2], dtype=np.uint8)])
    rows = [(k, 40, 50, alpha.shape[2], "RGBA", alpha.tobytes(), s) for k, s in enumerate(("Real", "Gorgeous", "torn", "none", "unknown", None))] + [(6, None, None, None, None, None, "Real")]
    rasters = spark.createDataFrame(rows, "request_id long, height int, width int, n_channels int, mode string, data binary, style string")
    out = SlideSet.corrected(rasters, styles)
    assert out.schema == rasters.schema
    got = {r["request_id"]: r["data"] for r in out.collect()}
    image = lambda k: np.frombuffer(got[k], np.uint8).reshape(alpha.shape)
    assert (image(0)[:, :, :3] == icc.read_profile(good).apply(IMAGE)).all() and (image(0)[:, :, 3] == alpha[:, :, 3]).all() and (image(0) != alpha).any()
    assert (image(1) == ColorStyle(1.5, rgb_rate=(1.0, 0.5, 1.0)).apply(alpha)).all()
    assert all((image(k) == alpha).all() for k in (2, 3, 4, 5)) and got[6] is None
    info = {r["name"]: r for r in SlideSet.style_info(styles.filter("name is not null")).collect()}
    assert {k: (r["kind"], r["has_transform"]) for k, r in info.items()} == {"Real": ("icc", True), "Gorgeous": ("lut", True), "torn": (None, False), "none": (None, False)}
    assert (info["Gorgeous"]["gamma"], info["Gorgeous"]["rgb_rate"], info["Gorgeous"]["hsv_rate"]) == (1.5, [1.0, 0.5, 1.0], [1.0, 2.0, 3.0])
    many = spark.range(300).selectExpr("CAST(id AS STRING) AS name", "CAST('x' AS BINARY) AS document")
    with pytest.raises(ValueError, match="too many"):
        SlideSet.corrected(rasters, many)
    assert SlideSet.corrected(rasters.limit(0), styles).count() == 0
