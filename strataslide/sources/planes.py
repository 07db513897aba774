"""Planes of multiplex containers: a channel's rectangle at a level, reading only what holds it."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

from . import czi, mcd
from .blob import Blob
from .hdf5 import File, ims_names, levels_of_ims, multiplex_dataset
from .tiff import samples, text, tiff_pages, tiff_region


@dataclass
class Planes:
    """read(channel, level, x, y, w, h): the rectangle, which lies within the level."""

    format_id: str
    names: list[str]
    levels: list[tuple[int, int, float]]  # width, height, downsample
    read: Callable[[int, int, int, int, int, int], np.ndarray]
    mpp: float | None = None
    family: str = "multiplex"
    properties: dict[str, str] = field(default_factory=dict)
    indices: dict[str, int] | None = None  # of names, where these aren't simply in order
    blocks: list = field(default_factory=list)  # a picture's subblocks, see czi.laid_out
    pages: list[dict] = field(default_factory=list)  # a picture's page of each level

    def index(self, name: str) -> int | None:
        """The channel of a name, of doubled names the last."""
        return self._places.get(name)

    @cached_property
    def _places(self) -> dict[str, int]:
        return self.indices or {n: k for k, n in enumerate(self.names)}

    def plane(self, channel: int, level: int) -> np.ndarray:
        w, h, _ = self.levels[level]
        return self.read(channel, level, 0, 0, w, h)


def _hdf5(blob: Blob) -> Planes:
    file = File(blob)
    nodes = list(file.walk())
    levels = levels_of_ims(nodes)
    if levels and 0 in levels:
        per, sizes = [], []
        for channels in levels.values():
            shapes = {n.shape[-2:] for n in channels.values()}
            if len(shapes) > 1:
                raise ValueError("a level's channels differ in size")
            h, w = shapes.pop()
            first = sizes[0] if sizes else (w, h)
            sizes.append((w, h, max(first[0] / w, first[1] / h)))
            per.append([channels[c] for c in sorted(channels)])
        read = lambda c, level, x, y, w, h: file.region(per[level][c], 0 if len(per[level][c].shape) == 3 else None, x, y, w, h)
        return Planes("ims", ims_names(nodes, sorted(levels[0])), sizes, read)
    found = multiplex_dataset(nodes)
    if found is None:
        raise ValueError("no multiplex dataset")
    node, names = found
    return Planes("hdf5", names, [(node.shape[2], node.shape[1], 1.0)], lambda c, level, x, y, w, h: file.region(node, c, x, y, w, h), properties={"hdf5.dataset": node.path})


# --- tiff ------------------------------------------------------------------------


def is_ome(pages: list[dict]) -> bool:
    return text(pages[0], 270).rstrip("\0 \r\n").endswith("OME>")


def is_ome_candidate(pages: list[dict]) -> bool:
    """OME metadata, or a page with a name that the viewer of mass cytometry wrote."""
    return is_ome(pages) or "fluidigm mcd viewer" in text(pages[0], 305).lower() and bool(text(pages[0], 285))


def channel_stride(order: str, sizes: dict[str, int]) -> int:
    """Pages from a channel to the next, by the order of dimensions after X and Y: those before C go through all their places first."""
    dims = order.upper().replace("X", "").replace("Y", "")
    return math.prod(max(1, sizes.get(d, 1)) for d in dims.partition("C")[0])


def ome_document(xml: str) -> tuple[list[str], float | None, int]:
    """Channel names, mean pixel size in micrometres and pages from a channel to the next of an OME document, namespaces aside."""
    from ..functions.scalars import UNITS_UM

    root = ET.fromstring(xml)
    local = lambda e: e.tag.rpartition("}")[2]
    pixels = next((e for e in root.iter() if local(e) == "Pixels"), None)
    channels = [e for e in pixels if local(e) == "Channel"] if pixels is not None else []
    channels = channels or [e for e in root.iter() if local(e) == "Channel"]
    sizes = []
    for axis in "XY" if pixels is not None else "":
        unit = (pixels.get(f"PhysicalSize{axis}Unit") or "um").strip().lower().replace("µ", "u").replace("μ", "u")
        try:
            sizes.append(float(pixels.get(f"PhysicalSize{axis}")) * UNITS_UM[unit])
        except (TypeError, ValueError, KeyError):
            continue
    told = dict(pixels.attrib) if pixels is not None else {}
    stride = channel_stride(told.get("DimensionOrder", "XYCZT"), {d: int(told.get(f"Size{d}") or 1) for d in "CZT"})
    return [e.get("Name") or f"Channel {k}" for k, e in enumerate(channels)], sum(sizes) / len(sizes) if sizes else None, stride


def _by_page(blob: Blob, levels: list[list[dict]], n: int, stride: int = 1) -> Callable:
    """Channel c is page c * stride of its level (of several focus planes or times the first), or sample c of the one page."""

    def read(c: int, level: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        pages = levels[level]
        return tiff_region(blob, pages[c * stride], x, y, w, h)[:, :, 0] if len(pages) > (n - 1) * stride else tiff_region(blob, pages[0], x, y, w, h)[:, :, c]

    return read


def _ome(blob: Blob, pages: list[dict]) -> Planes:
    names, mpp, stride = ome_document(text(pages[0], 270)) if is_ome(pages) else ([], None, 1)
    named = [text(p, 285) for p in pages]
    if not names and len(pages) > 1 and all(named):
        names = named
    alone = not names
    if alone:  # a file of one channel, whose siblings have the others
        names = [named[0] or blob.name.rpartition("/")[2].rpartition(".")[0]]
        pages = pages[:1]
    w, h = pages[0][256][0], pages[0][257][0]
    if len(pages) <= (len(names) - 1) * stride and samples(pages[0])[1] < len(names):
        raise ValueError("fewer pages than channels")
    return Planes("ome_tiff", names, [(w, h, 1.0)], _by_page(blob, [pages], len(names), stride), mpp, properties={"ome.alone": "true"} if alone else {})


def _qptiff(blob: Blob, pages: list[dict]) -> Planes:
    """Full-resolution pages are channels, one size after another; reduced ones are levels with as many pages."""
    tags = [dict(re.findall(r"<(ImageType|Biomarker|Name)>([^<]*)</\1>", text(p, 270))) for p in pages]
    full = [k for k, t in enumerate(tags) if t.get("ImageType") == "FullResolution"]
    if not full:
        raise ValueError("no full-resolution pages")
    names = [tags[k].get("Biomarker") or tags[k].get("Name") or f"Channel {c + 1}" for c, k in enumerate(full)]
    by_size: dict[tuple[int, int], list[int]] = {}
    for k, t in enumerate(tags):
        if t.get("ImageType") in ("FullResolution", "ReducedResolution"):
            by_size.setdefault((pages[k][256][0], pages[k][257][0]), []).append(k)
    levels = [(size, held) for size, held in sorted(by_size.items(), reverse=True) if len(held) == len(full)]
    w0 = levels[0][0][0]
    sizes = [(w, h, w0 / w) for (w, h), _ in levels]
    bright = len(names) == 1 and names[0].strip().lower() in ("h&e", "he")
    shown = [pages[held[0]] for _, held in levels] if bright else []
    found = Planes("qptiff", names, sizes, _by_page(blob, [[pages[k] for k in held] for _, held in levels], len(names)), family="brightfield" if bright else "multiplex", pages=shown)
    found.properties |= {"qptiff.biomarkers": ",".join(names), "qptiff.biomarker-count": str(len(names))}
    return found


# --- czi, mcd --------------------------------------------------------------------


def _czi(blob: Blob) -> Planes:
    blocks = [b for b in czi.directory(blob) if b.full]
    counted = 1 + max((b.start.get("C", 0) for b in blocks), default=-1)
    m = czi.described(czi.document(blob), counted)
    kind = czi.PIXELS.get(blocks[0].pixel_type, ("", 1, None)) if blocks else ("", 1, None)
    m = m.filled(czi.Metadata(channel_count=counted, pixel_type=kind[2]))
    ox, oy = czi.origin(blocks)
    w = max((b.start.get("X", 0) + b.size.get("X", 0) for b in blocks), default=0) - ox
    h = max((b.start.get("Y", 0) + b.size.get("Y", 0) for b in blocks), default=0) - oy

    of_channel: dict[int, list] = {}  # a channel's subblocks, so that one isn't looked for among all
    for b in blocks:
        for c in {b.start.get("C", -1), b.start.get("M", -1)}:
            of_channel.setdefault(c, []).append(b)

    def read(c: int, level: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        out = None
        for b, (x0, y0, x1, y1), (bx, by) in czi.overlapping(of_channel.get(c, []), c, (x, y, x + w, y + h), (ox, oy)):
            part = czi.pixels(blob, b)[y0 - by : y1 - by, x0 - bx : x1 - bx]
            out = np.zeros((h, w), part.dtype) if out is None else out
            out[y0 - y : y1 - y, x0 - x : x1 - x] = part
        if out is None and c not in of_channel:
            raise LookupError(f"no subblock of channel {c}")
        return np.zeros((h, w), np.uint8) if out is None else out

    names = czi.biomarkers(m)
    found = Planes("czi", names, [(w, h, 1.0)], read, family=czi.family(m), indices=czi.biomarker_indices(m))
    sizes = [s * 1e6 if s < 1e-3 else s for s in m.physical_pixel_sizes]
    found.mpp = sum(sizes) / len(sizes) if sizes else None
    found.properties |= {"czi.pixel-type": m.pixel_type or "", "czi.channel-count": str(m.channel_count)}
    if found.family == "brightfield":
        found.blocks = blocks
    return found


def _mcd(blob: Blob, acquisition_id: int | None) -> Planes:
    every = mcd.acquisitions(mcd.document(blob))
    a = mcd.selected(every, acquisition_id)
    kept: dict[int, np.ndarray] = {}

    def read(c: int, level: int, x: int, y: int, w: int, h: int) -> np.ndarray:
        if c not in kept:
            kept.clear()  # records hold all channels, so one plane is a pass over the acquisition
            kept[c] = mcd.plane(blob, a, c)
        return kept[c][y : y + h, x : x + w]

    found = Planes("mcd", a.biomarkers, [(a.width, a.height, 1.0)], read, sum(a.pixel) / 2)
    found.properties |= {"mcd.acquisition-count": str(len(every)), "mcd.channel-count": str(len(a.names)), "mcd.selected-acquisition-id": str(a.id), "mcd.selected-acquisition-description": a.description, "mcd.source-names": ",".join(a.names), "mcd.metals": ",".join(a.metals), "mcd.masses": ",".join(a.masses)}
    return found


def open_planes(blob: Blob, acquisition_id: int | None = None) -> Planes:
    """By the file's first bytes and, for TIFF, its name and pages. acquisition_id is of MCD files; others have no use for it."""
    head, suffix = blob.read(0, 16), blob.name.lower().rpartition(".")[2]
    if head.startswith(b"\x89HDF\r\n\x1a\n"):
        return _hdf5(blob)
    if head.startswith(b"ZISRAWFILE"):
        return _czi(blob)
    if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        pages = tiff_pages(blob)
        if pages and (suffix == "qptiff" or "PerkinElmer-QPI" in text(pages[0], 270)):
            return _qptiff(blob, pages)
        if pages and is_ome_candidate(pages):
            return _ome(blob, pages)
        raise ValueError("no multiplex TIFF")
    if suffix == "mcd":
        return _mcd(blob, acquisition_id)
    raise ValueError("no multiplex container")


def planes(blob: Blob, acquisition_id: int | None = None, wanted: Callable[[int], bool] = lambda level: True) -> Iterator[tuple[int, str, int, np.ndarray]]:
    """(channel, name, level, plane) of the wanted levels, one plane at a time."""
    p = open_planes(blob, acquisition_id)
    for level in filter(wanted, range(len(p.levels))):
        for k, name in enumerate(p.names):
            c = k if p.indices is None else p.indices[name]
            yield c, name, level, p.plane(c, level)


# Suffixes of slides that vendors' libraries read; those that are plain tiled TIFF are read here too.
TIFF_SLIDES = ("svs", "svslide")


def accepted(blob: Blob) -> list[str]:
    """Formats whose probe accepts the file, and openslide for a tiled TIFF of its suffixes."""
    if blob.name.lower().rpartition(".")[2] in TIFF_SLIDES:
        try:
            pages = tiff_pages(blob)
            return ["openslide"] if pages and 324 in pages[0] else []
        except Exception:  # no TIFF
            return []
    try:
        found = open_planes(blob)
    except Exception:  # a file that a probe can't read is none of its format
        return []
    return [found.format_id] if found.format_id in ("ome_tiff", "hdf5", "ims") else []
