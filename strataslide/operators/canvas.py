"""Canvases of any size, painted and shrunk by cell: no task holds more than a few cells.

A canvas is cut into square cells. Each cell is painted by its own task from the crops of
tiles that fall into it, in draw order. A canvas that is wanted smaller is resampled in two
phases, as the kernel is separable and its sums are linear: every cell is weighed by the rows
and columns of the kernel that reach it, which gives a small block of partial sums, and the
blocks are added up by cell of the result.

    placed(images) -> crops, painted(crops, canvases) -> cells, shrunk(cells) -> cells, whole(cells) -> rasters

canvases: request_id, w, h (what is painted), out_w, out_h (what is wanted), background
(colour). A cell: request_id, cell_x, cell_y, left, top, height, width, data, and the sides
of its canvas. Results are those of painting and resampling in one piece, up to the rounding
of sums. Empty canvases give no cells.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.raster import on_background, weights_between

CELL = 1024
#: Bytes of finished cells that a task hands on together, and what a cell counts for besides its pixels.
MOST_HELD, A_CELL = 16 << 20, 4 << 10
CROP = "request_id long, cell_x int, cell_y int, left int, top int, draw_seq long, height int, width int, data binary"
CELLS = "request_id long, cell_x int, cell_y int, left int, top int, height int, width int, data binary, w int, h int, out_w int, out_h int"
_CELLS = [c.split()[0] for c in CELLS.split(", ")]


def crops(request_id: int, x: int, y: int, draw_seq: int, image: np.ndarray, w: int, h: int, cell: int = CELL) -> Iterator[tuple]:
    """The parts of an image at (x, y) by the cells of a w x h canvas, with their places in the cell."""
    for cx, cy, a, b, c, d in _by_cell(x, y, image.shape[1], image.shape[0], w, h, cell):
        yield request_id, cx, cy, a - cx * cell, c - cy * cell, draw_seq, d - c, b - a, np.ascontiguousarray(image[c - y : d - y, a - x : b - x]).tobytes()


def grounds(request_id: int, x: int, y: int, draw_seq: int, width: int, height: int, w: int, h: int, cell: int = CELL) -> Iterator[tuple]:
    """As crops, of a width x height rectangle that shows the canvas's background again; without data, as the cell has its colour."""
    for cx, cy, a, b, c, d in _by_cell(x, y, width, height, w, h, cell):
        yield request_id, cx, cy, a - cx * cell, c - cy * cell, draw_seq, d - c, b - a, None


def _by_cell(x: int, y: int, width: int, height: int, w: int, h: int, cell: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """cell_x, cell_y and the bounds x0, x1, y0, y1 of a rectangle's parts, on a w x h canvas."""
    x0, y0, x1, y1 = max(0, x), max(0, y), min(w, x + width), min(h, y + height)
    if x0 >= x1 or y0 >= y1:
        return
    for cy in range(y0 // cell, (y1 - 1) // cell + 1):
        for cx in range(x0 // cell, (x1 - 1) // cell + 1):
            a, b = max(x0, cx * cell), min(x1, cx * cell + cell)
            c, d = max(y0, cy * cell), min(y1, cy * cell + cell)
            yield cx, cy, a, b, c, d


def painted(pastes: DataFrame, canvases: DataFrame, cell: int = CELL, flat: tuple[int, int, int] | None = None) -> DataFrame:
    """Every cell of every canvas: its crops pasted in draw order without blending; laid on the colour `flat`, as RGB, if one is given.

    Cells and crops come as one sorted stream, a cell before its crops, so a task holds one cell
    and a batch, however many crops a cell has, and millions of small cells cost no group each.
    """
    side = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / cell).cast("int")))
    asked = canvases.filter("w > 0 and h > 0 and out_w > 0 and out_h > 0").withColumn("cell_x", side("w")).withColumn("cell_y", side("h"))

    def paint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, open_ = None, []  # cells of one key, each with its row; more than one if a request is repeated
        out, held = [], 0  # cells that are done, and their bytes

        def done() -> int:
            for s, image in open_:
                image = image if flat is None else on_background(image, flat)
                out.append((s.request_id, int(s.cell_x), int(s.cell_y), int(s.cell_x) * cell, int(s.cell_y) * cell, *image.shape[:2], image.tobytes(), int(s.w), int(s.h), int(s.out_w), int(s.out_h)))
            return sum(image.size + A_CELL for _, image in open_)

        for b in batches:
            for t in b.itertuples(index=False):
                now = (t.request_id, t.cell_x, t.cell_y)
                if now != key:
                    held += done()
                    key, open_ = now, []
                    if held > MOST_HELD:
                        yield pd.DataFrame(out, columns=_CELLS)
                        out.clear()
                        held = 0
                if t.background is not None:
                    image = np.empty((min(cell, int(t.h) - int(t.cell_y) * cell), min(cell, int(t.w) - int(t.cell_x) * cell), 4), np.uint8)
                    image[:] = t.background
                    open_.append((t._replace(data=None), image))
                    continue
                top, left, height, width = (int(v) for v in (t.top, t.left, t.height, t.width))
                for s, image in open_:
                    image[top : top + height, left : left + width] = s.background if t.data is None else np.frombuffer(t.data, np.uint8).reshape(height, width, 4)
        done()
        yield pd.DataFrame(out, columns=_CELLS)

    keys = ("request_id", "cell_x", "cell_y")
    both = asked.select(*keys, "w", "h", "out_w", "out_h", "background").unionByName(pastes, allowMissingColumns=True)
    order = [*keys, F.col("background").isNull(), "draw_seq", "top", "left", "height", "width"]
    return both.repartition(*keys).sortWithinPartitions(*order).mapInPandas(paint, CELLS)


def shrunk(cells: DataFrame, channels: int = 4, cell: int = CELL, kernel: str = "lanczos", held: int = 4) -> DataFrame:
    """Cells of canvases brought to (out_w, out_h); those that have that size already pass.

    A task adds what it can before it hands on: at most `held` cells of results are open.
    """

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: OrderedDict[tuple, np.ndarray] = OrderedDict()
        frame = lambda items: pd.DataFrame([(*k[:3], sums.tobytes(), *k[3:]) for k, sums in items], columns=["request_id", "cell_x", "cell_y", "sums", "out_w", "out_h"])
        for b in batches:
            for t in b.itertuples(index=False):
                image = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, channels).astype(float)
                top, rows = weights_between(t.h, t.out_h, t.top, t.top + t.height, kernel)
                left, cols = weights_between(t.w, t.out_w, t.left, t.left + t.width, kernel)
                part = np.einsum("Xx,yxc->yXc", cols, np.einsum("Yy,yxc->Yxc", rows, image))
                for cy in range(top // cell, (top + len(rows) - 1) // cell + 1):
                    for cx in range(left // cell, (left + len(cols) - 1) // cell + 1):
                        key = (t.request_id, cx, cy, t.out_w, t.out_h)
                        if key not in open_:
                            open_[key] = np.zeros((min(cell, t.out_h - cy * cell), min(cell, t.out_w - cx * cell), channels))
                        open_.move_to_end(key)
                        y0, x0 = max(top, cy * cell), max(left, cx * cell)
                        y1, x1 = min(top + len(rows), cy * cell + cell), min(left + len(cols), cx * cell + cell)
                        open_[key][y0 - cy * cell : y1 - cy * cell, x0 - cx * cell : x1 - cx * cell] += part[y0 - top : y1 - top, x0 - left : x1 - left]
                while len(open_) > held:
                    yield frame([open_.popitem(last=False)])
        for item in open_.items():
            yield frame([item])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sums = None, None

        def done() -> pd.DataFrame:
            request_id, cx, cy, w, h = key
            image = np.clip(np.floor(sums + 0.5), 0, 255).astype(np.uint8)
            return pd.DataFrame([(request_id, cx, cy, cx * cell, cy * cell, *image.shape[:2], image.tobytes(), w, h, w, h)], columns=_CELLS)

        for b in batches:
            for t in b.itertuples(index=False):
                now = (t.request_id, t.cell_x, t.cell_y, t.out_w, t.out_h)
                part = np.frombuffer(t.sums).reshape(min(cell, t.out_h - t.cell_y * cell), min(cell, t.out_w - t.cell_x * cell), channels)
                if now != key:
                    if key is not None:
                        yield done()
                    key, sums = now, np.zeros(part.shape)
                sums += part
        if key is not None:
            yield done()

    asis = (F.col("w") == F.col("out_w")) & (F.col("h") == F.col("out_h"))
    sums = cells.filter(~asis).mapInPandas(weigh, "request_id long, cell_x int, cell_y int, sums binary, out_w int, out_h int")
    keys = ("request_id", "cell_x", "cell_y")
    return cells.filter(asis).unionByName(sums.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(add, CELLS))


def whole(cells: DataFrame, channels: int = 4) -> DataFrame:
    """request_id, height, width, n_channels, mode, data: cells put together, as large as the result that is asked for."""

    def join(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(parts["out_h"].iloc[0]), int(parts["out_w"].iloc[0]), channels), np.uint8)
        for t in parts.itertuples():
            image[t.top : t.top + t.height, t.left : t.left + t.width] = np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, channels)
        return pd.DataFrame([(key[0], *image.shape, "RGBA" if channels == 4 else "RGB", image.tobytes())], columns=["request_id", "height", "width", "n_channels", "mode", "data"])

    return cells.groupBy("request_id").applyInPandas(join, "request_id long, height int, width int, n_channels int, mode string, data binary")
