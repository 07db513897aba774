"""CZI: the subblock directory and the metadata document, read by range.

A file is segments, each led by 32 bytes: a name, and how many bytes are allocated and used.
Pixels are read of subblocks that are not compressed (or Zstandard, where that module is there);
JPEG goes to the caller's decoder.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .blob import Blob

_FILE = np.dtype([("major", "<i4"), ("minor", "<i4"), ("reserved", "V8"), ("primary", "V16"), ("own", "V16"), ("part", "<i4"), ("directory", "<i8"), ("metadata", "<i8")])
_ENTRY = np.dtype([("schema", "S2"), ("pixel_type", "<i4"), ("position", "<i8"), ("part", "<i4"), ("compression", "<i4"), ("pyramid", "u1"), ("spare", "V5"), ("dimensions", "<i4")])
_DIMENSION = np.dtype([("name", "S4"), ("start", "<i4"), ("size", "<i4"), ("coordinate", "<f4"), ("stored", "<i4")])
_SEGMENT = 32

# Pixel types that are read, as numpy types and samples.
PIXELS = {0: ("<u1", 1, "gray8"), 1: ("<u2", 1, "gray16"), 2: ("<f4", 1, "gray32float"), 3: ("<u1", 3, "bgr24"), 4: ("<u2", 3, "bgr48"), 9: ("<u1", 4, "bgra32")}
# Compressions of subblocks.
PLAIN, JPEG, ZSTD, ZSTD_HEADED = 0, 1, 5, 6
# Which fact of an OME document is which field. A fact is the names of the elements above, then an attribute.
OME_FACTS = {
    "Pixels@SizeC": "channel_count",
    "Pixels@Type": "pixel_type",
    "Pixels@PhysicalSizeX": "physical_pixel_sizes",
    "Pixels@PhysicalSizeY": "physical_pixel_sizes",
    "Pixels/Channel@Name": "channel_names",
    "Pixels/Channel@Fluor": "fluorophore_names",
    "Pixels/Channel@IlluminationType": "illumination_types",
    "Pixels/Channel@ExcitationWavelength": "excitation_wavelengths",
    "Pixels/Channel@EmissionWavelength": "emission_wavelengths",
}
# Words of an image document's text, all of which stand for a value of a field.
WORDS = (
    (("camera pixel type", "uint16"), "pixel_type", "uint16"),
    (("fluorescencedye",), "illumination_types", "Epifluorescence"),
    (("additionaldyeinformation",), "illumination_types", "Epifluorescence"),
)
# Dyes that are looked for in the text of a document that tells of fluorescence.
DYES = ("DAPI", "CD3", "FITC", "TRITC", "Cy3", "Cy5")
# What speaks for a family, as field and whole value.
EVIDENCE = (
    ("brightfield", "illumination_types", r"transmitted( light)?"),
    ("brightfield", "color_type", r"(bgr|rgb)24"),
    ("multiplex", "illumination_types", r".*fluores.*"),
    ("multiplex", "fluorophore_names", r".+"),
    ("multiplex", "excitation_wavelengths", r".*"),
    ("multiplex", "emission_wavelengths", r".*"),
)


@dataclass(frozen=True)
class Subblock:
    pixel_type: int
    position: int
    compression: int
    start: dict[str, int]
    size: dict[str, int]
    stored: dict[str, int]

    @property
    def full(self) -> bool:
        """Stored at its own size, so not of a pyramid level."""
        return all(self.size.get(d) == self.stored.get(d) for d in "XY")

    def of_channel(self, index: int) -> bool:
        return self.start.get("C", -1) == index or self.start.get("M", -1) == index


def directory(blob: Blob) -> list[Subblock]:
    if blob.read(0, 10) != b"ZISRAWFILE":
        raise ValueError("not a CZI file")
    at = int(blob.record(_SEGMENT, _FILE)["directory"])
    if blob.read(at, 15) != b"ZISRAWDIRECTORY":
        raise ValueError("no subblock directory")
    n = int.from_bytes(blob.read(at + _SEGMENT, 4), "little")
    at += _SEGMENT + 128
    raw, out, pos = blob.read(at, n * (_ENTRY.itemsize + 12 * _DIMENSION.itemsize)), [], 0
    for _ in range(n):
        block, pos = _entry(raw, pos)
        out.append(block)
    return out


def _entry(raw: bytes, pos: int) -> tuple[Subblock, int]:
    """The entry at pos, and where the next begins."""
    e = np.frombuffer(raw, _ENTRY, 1, pos)[0]
    d = np.frombuffer(raw, _DIMENSION, int(e["dimensions"]), pos + _ENTRY.itemsize)
    names = [x.decode().strip("\0 ") for x in d["name"].tolist()]
    return Subblock(int(e["pixel_type"]), int(e["position"]), int(e["compression"]), *(dict(zip(names, d[c].tolist(), strict=True)) for c in ("start", "size", "stored"))), pos + _ENTRY.itemsize + d.nbytes


def block_at(blob: Blob, position: int) -> Subblock:
    """The subblock of a segment, by the entry that the segment itself holds, so that one is read without the directory."""
    raw = blob.read(position + _SEGMENT + 16, _ENTRY.itemsize + 12 * _DIMENSION.itemsize)
    return _entry(raw, 0)[0]


def laid_out(blocks: list[Subblock]) -> Iterator[tuple[int, int, int, int, int, int, int, Subblock]]:
    """scene, order within it (from 1), z, x, y, width, height of the full-size subblocks of a picture's first channel and time, from the origin; of a scene those that come later lie above."""
    ox, oy = origin(blocks)
    shown = [b for b in blocks if b.full and b.size.get("X", 0) > 0 and b.size.get("Y", 0) > 0 and b.start.get("C", 0) == 0 and b.start.get("T", 0) == 0]
    shown.sort(key=lambda b: (b.start.get("S", 0), b.start.get("M", 0), b.position))
    for k, b in enumerate(shown, 1):
        yield b.start.get("S", 0), k, b.start.get("Z", 0), b.start.get("X", 0) - ox, b.start.get("Y", 0) - oy, b.size["X"], b.size["Y"], b


def origin(blocks: list[Subblock]) -> tuple[int, int]:
    """Least x and y of the subblocks that have a size."""
    sized = [b for b in blocks if b.size.get("X", 0) > 0 and b.size.get("Y", 0) > 0]
    return min((b.start.get("X", 0) for b in sized), default=0), min((b.start.get("Y", 0) for b in sized), default=0)


def stored(blob: Blob, block: Subblock) -> bytes:
    """A subblock's data as they lie in the file."""
    head = block.position + _SEGMENT
    meta, size = (int.from_bytes(blob.read(head + a, n), "little") for a, n in ((0, 4), (8, 8)))
    return blob.read(head + max(256, 16 + _ENTRY.itemsize + _DIMENSION.itemsize * len(block.size)) + meta, size)


def _unpacked(raw: bytes, compression: int) -> bytes:
    """Out of Zstandard; under a header that says so, low bytes of all samples come before the high ones."""
    import zstandard

    head = raw[: raw[0]] if compression == ZSTD_HEADED else b""
    out = zstandard.ZstdDecompressor().decompress(raw[len(head) :], max_output_size=1 << 31)
    if len(head) >= 3 and head[1] == 1 and head[2] & 1:
        out = np.frombuffer(out, np.uint8).reshape(2, -1).T.tobytes()
    return out


def colors(blob: Blob, block: Subblock) -> np.ndarray:
    """height x width x samples of a subblock, in the file's order of samples."""
    kind, samples, _ = PIXELS.get(block.pixel_type, (None, 0, ""))
    if kind is None:
        raise ValueError(f"CZI pixel type {block.pixel_type} is not read")
    if block.compression not in (PLAIN, ZSTD, ZSTD_HEADED):
        raise ValueError(f"CZI compression {block.compression} is not read")
    raw = stored(blob, block)
    raw = raw if block.compression == PLAIN else _unpacked(raw, block.compression)
    h, w = block.stored["Y"], block.stored["X"]
    return np.frombuffer(raw, kind, h * w * samples).reshape(h, w, samples)


def pixels(blob: Blob, block: Subblock) -> np.ndarray:
    """height x width of a subblock, the first sample of a colour one."""
    return colors(blob, block)[:, :, 0]


def picture(blob: Blob, block: Subblock) -> np.ndarray | bytes:
    """A subblock as red, green, blue (or grey); of JPEG its bytes."""
    if block.compression == JPEG:
        return stored(blob, block)
    found = colors(blob, block)
    return found[:, :, 2::-1] if found.shape[2] >= 3 else found


@dataclass
class Metadata:
    """What a document says, with a default for what it leaves out."""

    channel_count: int = 0
    pixel_type: str | None = None
    illumination_types: list[str] = field(default_factory=list)
    fluorophore_names: list[str] = field(default_factory=list)
    excitation_wavelengths: list[float] = field(default_factory=list)
    emission_wavelengths: list[float] = field(default_factory=list)
    channel_names: list[str] = field(default_factory=list)
    physical_pixel_sizes: list[float] = field(default_factory=list)

    def filled(self, other: Metadata) -> Metadata:
        """Field by field, the other's where this has none."""
        return Metadata(*(getattr(self, f) or getattr(other, f) for f in self.__dataclass_fields__))

    @property
    def color_type(self) -> str | None:
        """The pixel type, of images that may be a picture's three colours."""
        return self.pixel_type if self.channel_count <= 3 else None


def document(blob: Blob) -> str:
    at = int(blob.record(_SEGMENT, _FILE)["metadata"])
    if at <= 0 or blob.read(at, 14) != b"ZISRAWMETADATA":
        return ""
    n = int.from_bytes(blob.read(at + _SEGMENT, 4), "little")
    return blob.read(at + _SEGMENT + 256, n).decode("utf-8", "ignore")


@dataclass(frozen=True)
class Fact:
    """An attribute (name in small letters for images, as it is for OME) or, under no name, the text of an element."""

    element: int  # in document order
    parent: int
    path: str  # names of the elements from the root, namespaces aside
    name: str
    value: str


def facts(xml: str) -> list[Fact]:
    """Everything that a document states, in one pass; a ParseError where it is no XML."""
    root, out, n = ET.fromstring(xml), [], 0
    waiting = [(root, "", -1)]
    while waiting:
        e, above, parent = waiting.pop()
        path = f"{above}/{e.tag.rpartition('}')[2]}".lstrip("/")
        out += [Fact(n, parent, path, k, v) for k, v in e.attrib.items()]
        out += [Fact(n, parent, path, "", t) for t in (e.text,) if t is not None]
        out += [Fact(n, parent, path, "tail", c.tail) for c in e if c.tail]
        waiting += [(c, path, n) for c in reversed(e)]
        n += 1
    return out


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def described(xml: str, channels: int = 0) -> Metadata:
    """Of an OME document what OME_FACTS names of its first Pixels; of an image document what its words and distances tell. channels: by the subblocks."""
    try:
        told = facts(xml)
    except ET.ParseError:
        return Metadata()
    root = ET.fromstring(xml).tag.lower()
    return _of_image(told, channels) if root.endswith("imagedocument") else _of_ome(told)


def _of_ome(told: list[Fact]) -> Metadata:
    out = Metadata()
    first = min((f.element for f in told if f.path.endswith("Pixels")), default=-1)
    for f in told:
        if f.name and f.value and first in (f.element, f.parent):
            key = OME_FACTS.get(f"{'/'.join(f.path.split('/')[-1 if f.element == first else -2 :])}@{f.name}")
            if key == "channel_count":
                out.channel_count = int(f.value)
            elif key == "pixel_type":
                out.pixel_type = f.value
            elif key:
                getattr(out, key).append(f.value if key.endswith(("names", "types")) else float(f.value))
    return out


def _of_image(told: list[Fact], channels: int) -> Metadata:
    text = " ".join(f.value for f in told if f.name in ("", "tail")).lower()
    said = {key: value for words, key, value in WORDS if all(w in text for w in words)}
    dyes = [d for d in DYES if "illumination_types" in said and d.lower() in text]
    n = channels or len(dyes)
    aliases = [f"channel_{k}" for k in range(n)] if n > 1 else []
    light = [said["illumination_types"]] if "illumination_types" in said else ["Epifluorescence"] * bool(aliases)
    return Metadata(n, said.get("pixel_type"), light, dyes or aliases, channel_names=dyes or list(aliases), physical_pixel_sizes=_distances(told))


def _distances(told: list[Fact]) -> list[float]:
    """Of x and y the distance that a Distance element of that id states, by its own value, its text or its first child's, in this order; none unless both are numbers."""
    ids = {f.element: f.value.lower() for f in told if f.name.lower() == "id" and f.path.lower().endswith("distance")}
    ranked: dict[str, list[tuple[int, int, str]]] = {}
    for f in told:
        if f.element in ids and (f.name.lower() == "value" or not f.name):
            ranked.setdefault(ids[f.element], []).append((f.element, 0 if f.name else 1, f.value))
        elif f.parent in ids and f.element == f.parent + 1 and not f.name:
            ranked.setdefault(ids[f.parent], []).append((f.parent, 2, f.value))
    first = [_number(min(ranked[a])[2]) if a in ranked else None for a in "xy"]
    return [] if None in first else first


def family(m: Metadata) -> str:
    """brightfield or multiplex, by EVIDENCE; a ValueError where a document speaks for both, a LookupError where it does for neither."""
    held = lambda key: getattr(m, key) if isinstance(getattr(m, key), list) else [getattr(m, key) or ""]
    votes = sorted({of for of, key, form in EVIDENCE if any(re.fullmatch(form, str(v).strip().lower()) for v in held(key))})
    if len(votes) == 1:
        return votes[0]
    raise ValueError("the CZI metadata speaks for " + " and ".join(votes)) if votes else LookupError("nothing in the CZI metadata tells the slide's family")


def biomarkers(m: Metadata) -> list[str]:
    """Dyes, channel names and channel_<i> aliases, each once."""
    return list(dict.fromkeys([*m.fluorophore_names, *m.channel_names, *(f"channel_{k}" for k in range(m.channel_count))]))


def biomarker_indices(m: Metadata) -> dict[str, int]:
    """The index of each of biomarkers(m): a dye's, else a channel's, else an alias's; of doubled names the first."""
    out: dict[str, int] = {}
    for held in (m.fluorophore_names, m.channel_names, [f"channel_{k}" for k in range(m.channel_count)]):
        for k, name in enumerate(held):
            out.setdefault(name, k)
    return out


def overlapping(blocks: list[Subblock], channel: int, box: tuple[int, int, int, int], at: tuple[int, int]) -> Iterator[tuple[Subblock, tuple[int, int, int, int], tuple[int, int]]]:
    """Subblocks of a channel that meet box (x0, y0, x1, y1 from the origin, which is at): the common rectangle, and where the subblock begins."""
    ox, oy = at
    for b in blocks:
        if b.of_channel(channel) and b.full and b.size.get("X", 0) > 0 and b.size.get("Y", 0) > 0:
            x, y = b.start.get("X", 0) - ox, b.start.get("Y", 0) - oy
            cut = max(box[0], x), max(box[1], y), min(box[2], x + b.size["X"]), min(box[3], y + b.size["Y"])
            if cut[0] < cut[2] and cut[1] < cut[3]:
                yield b, cut, (x, y)
