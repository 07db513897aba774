"""A format from outside, as a user would write it: one row of PNG tiles, their lengths in front."""

import numpy as np

from strataslide.sources.containers import TILE, Parsed


def parse(blob):
    side, n = (int(v) for v in blob.record(0, np.dtype([("side", "<u4"), ("n", "<u4")])).tolist())
    lengths = blob.records(8, np.dtype([("length", "<u4")]), n)["length"].astype(np.int64)
    tiles = np.zeros(n, TILE)
    tiles["col"], tiles["x0"] = np.arange(n), np.arange(n) * side
    tiles["cov_w"] = tiles["cov_h"] = side
    tiles["offset"], tiles["length"] = 8 + 4 * n + np.cumsum(lengths) - lengths, lengths
    return Parsed("strip", n * side, side, [(n * side, side, 1.0)], tiles=tiles).stated("strip")
