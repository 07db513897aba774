"""MCD: imaging mass cytometry. Acquisitions are listed by an XML document at the end of the file; pixels are float records of all channels."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np

from .blob import Blob

#: Channels of a record that are no images: the place of the pixel.
PLACE = ("X", "Y", "Z")


@dataclass(frozen=True)
class Acquisition:
    id: int
    description: str
    width: int
    height: int
    pixel: tuple[float, float]
    start: int
    end: int
    columns: int  # of a record
    names: list[str]  # of images, by column; with their columns below
    labels: list[str]
    at: list[int]

    @property
    def biomarkers(self) -> list[str]:
        return [label or name for label, name in zip(self.labels, self.names, strict=True)]

    @property
    def metals(self) -> list[str]:
        return [re.sub(r"[^A-Za-z]", "", n) for n in self.names]

    @property
    def masses(self) -> list[str]:
        return [re.sub(r"[^0-9]", "", n) for n in self.names]


def document(blob: Blob, window: int = 1 << 20) -> str:
    """The last MCDSchema element, UTF-16 or UTF-8, looked for from the end in growing windows."""
    while True:
        tail = blob.read(max(0, blob.size - window), window)
        for code in ("utf-16-le", "utf-8"):
            first, last = tail.rfind("<MCDSchema".encode(code)), tail.rfind("</MCDSchema>".encode(code))
            if 0 <= first < last:
                return tail[first : last + len("</MCDSchema>".encode(code))].decode(code)
        if window >= blob.size:
            raise ValueError("no MCD document")
        window *= 8


def acquisitions(xml: str) -> list[Acquisition]:
    """Those of the first slide, in order."""
    root = ET.fromstring(xml)
    local = lambda e: e.tag.rpartition("}")[2]
    rows = {kind: [{local(c): (c.text or "").strip() for c in e} for e in root if local(e) == kind] for kind in ("Slide", "Panorama", "AcquisitionROI", "Acquisition", "AcquisitionChannel")}
    if not rows["Slide"]:
        raise ValueError("no slides")
    panoramas = {p.get("ID"): p.get("SlideID") for p in rows["Panorama"]}
    slide_of = {r.get("ID"): panoramas.get(r.get("PanoramaID")) for r in rows["AcquisitionROI"]}
    first = rows["Slide"][0].get("ID")
    out = []
    for a in rows["Acquisition"]:
        if slide_of.get(a.get("AcquisitionROIID"), first) not in (first, None):
            continue
        channels = sorted((int(c.get("OrderNumber") or 0), c.get("ChannelName", ""), c.get("ChannelLabel", "")) for c in rows["AcquisitionChannel"] if c.get("AcquisitionID") == a.get("ID"))
        images = [(k, name, label) for k, (_, name, label) in enumerate(channels) if name not in PLACE]
        number = lambda key, default: float(a[key]) if a.get(key) else default  # noqa: E731, B023
        out.append(Acquisition(
            int(a.get("ID") or 0), a.get("Description", ""), int(number("MaxX", 0)), int(number("MaxY", 0)), (number("AblationDistanceBetweenShotsX", 1.0), number("AblationDistanceBetweenShotsY", 1.0)),
            int(number("DataStartOffset", 0)), int(number("DataEndOffset", 0)), len(channels), [n for _, n, _ in images], [x for _, _, x in images], [k for k, _, _ in images],
        ))
    if not out:
        raise ValueError("no acquisitions")
    return out


def selected(found: list[Acquisition], wanted: int | None = None) -> Acquisition:
    """The one of an id, else the largest, of equal ones that of the greatest id."""
    if wanted is None:
        return max(found, key=lambda a: (a.width * a.height, a.id))
    for a in found:
        if a.id == wanted:
            return a
    raise ValueError(f"acquisition {wanted} is not in the file")


def plane(blob: Blob, a: Acquisition, channel: int, at_once: int = 1 << 16) -> np.ndarray:
    """height x width of one image, from records read some at a time."""
    out = np.zeros((a.height, a.width), np.float32)
    record = 4 * a.columns
    n = max(0, a.end - a.start) // record
    for first in range(0, n, at_once):
        raw = np.frombuffer(blob.read(a.start + first * record, record * min(at_once, n - first)), "<f4")
        raw = raw[: len(raw) // a.columns * a.columns].reshape(-1, a.columns)
        x, y = raw[:, 0].astype(np.int64), raw[:, 1].astype(np.int64)
        ok = (x >= 0) & (x < a.width) & (y >= 0) & (y < a.height)
        out[y[ok], x[ok]] = raw[ok, a.at[channel]]
    return out
