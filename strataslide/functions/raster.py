"""Rasters as numpy arrays: codec, crop, resize, colour; wrapped for Arrow batches where columns need them."""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
import zlib
from dataclasses import dataclass

import numpy as np

# --- PNG -------------------------------------------------------------------

_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(image: np.ndarray, level: int = 6) -> bytes:
    """8-bit grey, RGB or RGBA (height x width x channels) as PNG."""
    image = np.ascontiguousarray(image if image.ndim == 3 else image[:, :, None], np.uint8)
    h, w, c = image.shape
    rows = np.zeros((h, w * c + 1), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """8-bit grey, RGB or RGBA PNG without interlacing."""
    if not data.startswith(_PNG):
        raise ValueError("not a PNG")
    at, packed, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    w, h, depth, color, _, _, interlace = head
    c = {0: 1, 2: 3, 6: 4}.get(color)
    if depth != 8 or c is None or interlace:
        raise ValueError("this kind of PNG is not read")
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, w * c + 1)
    out = np.zeros((h, w, c), np.uint8)
    above = np.zeros((w, c), np.int32)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].reshape(w, c).astype(np.int32)
        if kind == 1:
            line = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            left, corner = np.zeros(c, np.int32), np.zeros(c, np.int32)
            for x in range(w):
                up = above[x]
                if kind == 3:
                    guess = (left + up) >> 1
                else:
                    p = left + up - corner
                    a, b, d = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
                left = line[x] = (line[x] + guess) & 255
                corner = up
        out[y] = above = line
    return out


def image_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) by the header of a PNG or JPEG; null for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 9 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's header
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        alone = kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD7  # filling and marks without a length
        at += (1 if kind == 0xFF else 2) if alone else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


# --- geometry ----------------------------------------------------------------


def crop(image: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return image[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]


def pad(image: np.ndarray, w: int, h: int, fill: int = 0) -> np.ndarray:
    """Bottom and right filled up to w x h."""
    out = np.full((h, w, *image.shape[2:]), fill, image.dtype)
    out[: image.shape[0], : image.shape[1]] = image[:h, :w]
    return out


def centred(image: np.ndarray, w: int, h: int, fill: int = 255) -> np.ndarray:
    """In the middle of w x h, which is no smaller."""
    out = np.full((h, w, *image.shape[2:]), fill, image.dtype)
    y, x = (h - image.shape[0]) // 2, (w - image.shape[1]) // 2
    out[y : y + image.shape[0], x : x + image.shape[1]] = image
    return out


def rgba(image: np.ndarray) -> np.ndarray:
    """Grey, RGB or RGBA to RGBA with full alpha."""
    image = image if image.ndim == 3 else image[:, :, None]
    if image.shape[2] == 4:
        return image
    color = np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image
    return np.concatenate([color, np.full((*color.shape[:2], 1), 255, np.uint8)], axis=2)


def shown(image: np.ndarray) -> np.ndarray:
    """Stored samples as RGBA: of 16 bits the upper eight; two are grey with one that is left out. A ValueError for other types."""
    if image.dtype.kind != "u" or image.dtype.itemsize > 2:
        raise ValueError(f"samples of type {image.dtype} are no picture's")
    image = image if image.dtype.itemsize == 1 else (image >> 8).astype(np.uint8)
    return rgba(image[:, :, :1] if image.shape[2] == 2 else image[:, :, :4])


def on_background(image: np.ndarray, background: tuple[int, int, int]) -> np.ndarray:
    """RGBA composed on an opaque colour, as RGB."""
    a = image[:, :, 3:].astype(np.uint32)
    mixed = image[:, :, :3] * a + np.array(background, np.uint32) * (255 - a)
    return ((mixed + 127) // 255).astype(np.uint8)


def swap_red_blue(image: np.ndarray) -> np.ndarray:
    return image[:, :, [2, 1, 0, *range(3, image.shape[2])]]


_KERNELS = {"lanczos": (3.0, lambda x: np.where(abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)), "bilinear": (1.0, lambda x: np.maximum(0, 1 - abs(x)))}


def _weights(n: int, m: int, kernel: str) -> np.ndarray:
    """m x n matrix that resamples n pixels to m; the kernel widens when shrinking."""
    radius, f = _KERNELS[kernel]
    scale = n / m
    wide = max(scale, 1.0)
    center = (np.arange(m) + 0.5) * scale
    x = (np.arange(n)[None, :] + 0.5 - center[:, None]) / wide
    w = np.where(abs(x) < radius, f(x), 0)
    return w / w.sum(axis=1, keepdims=True)


def weights_between(n: int, m: int, a: int, b: int, kernel: str) -> tuple[int, np.ndarray]:
    """(first, matrix): of the m x n matrix of weights the columns a to b, and of these the rows that reach them."""
    radius, f = _KERNELS[kernel]
    scale = n / m
    wide = max(scale, 1.0)
    reach = radius * wide
    first = max(0, int(np.floor((a - reach) / scale - 0.5)))
    last = min(m, int(np.ceil((b + reach) / scale + 0.5)) + 1)
    center = (np.arange(first, last) + 0.5) * scale
    low, high = max(0, int(center[0] - reach) - 1), min(n, int(center[-1] + reach) + 2)  # all that these rows reach
    x = (np.arange(low, high)[None, :] + 0.5 - center[:, None]) / wide
    w = np.where(abs(x) < radius, f(x), 0)
    return first, (w / w.sum(axis=1, keepdims=True))[:, a - low : b - low]


def resize(image: np.ndarray, w: int, h: int, kernel: str = "lanczos") -> np.ndarray:
    """Separable resampling to exactly w x h."""
    src = image if image.ndim == 3 else image[:, :, None]
    out = np.einsum("Yy,yxc->Yxc", _weights(src.shape[0], h, kernel), src.astype(float))
    out = np.einsum("Xx,yxc->yXc", _weights(src.shape[1], w, kernel), out)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8).reshape(h, w, *image.shape[2:])


def thumbnail(image: np.ndarray, w: int, h: int, kernel: str = "lanczos") -> np.ndarray:
    """Shrunk to fit w x h at its aspect; never enlarged."""
    ih, iw = image.shape[:2]
    scale = min(w / iw, h / ih, 1.0)
    return image if scale == 1.0 else resize(image, max(1, round(iw * scale)), max(1, round(ih * scale)), kernel)


# --- intensity ---------------------------------------------------------------


def to_uint8(plane: np.ndarray, bypass: bool = True, wide: type = np.float32) -> np.ndarray:
    """Min-max to 0..255, truncated; constant planes are 0; 8-bit planes pass if bypass."""
    if bypass and plane.dtype == np.uint8:
        return plane
    x = plane.astype(wide)
    low, high = x.min(initial=np.inf), x.max(initial=-np.inf)
    return np.zeros(plane.shape, np.uint8) if not high > low else ((x - low) / (high - low) * 255).astype(np.uint8)


def to_uint8_unit(plane: np.ndarray) -> np.ndarray:
    """As to_uint8, but 8-bit planes that are 0 or 1 are scaled, and others stretched."""
    return plane * 255 if plane.dtype == np.uint8 and plane.max(initial=0) <= 1 else to_uint8(plane, bypass=False, wide=np.float64)


@dataclass(frozen=True)
class ColorStyle:
    """Gamma, colour matrix and gains, in that order."""

    gamma: float = 1.0
    ccm: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    rgb_rate: tuple[float, ...] = (1.0, 1.0, 1.0)
    hsv_rate: tuple[float, ...] = (1.0, 1.0, 1.0)  # stated, never applied

    def apply(self, image: np.ndarray) -> np.ndarray:
        x = image[:, :, :3] / 255.0
        if self.gamma != 1.0:
            x = x**self.gamma
        x = x @ np.array(self.ccm).reshape(3, 3).T * np.array(self.rgb_rate)
        out = image.copy()
        out[:, :, :3] = np.clip(x * 255, 0, 255).astype(np.uint8)
        return out


def read_style(xml: str) -> ColorStyle:
    """A style from LUT XML; lists of the wrong length are left out."""
    root = ET.fromstring(xml)

    def floats(tag: str, n: int, default: tuple[float, ...]) -> tuple[float, ...]:
        at = root.find(tag)
        values = [] if at is None else [float(e.text) for e in at.iter("float") if e.text]
        return tuple(values) if len(values) == n else default

    gamma = root.findtext("gamma")
    return ColorStyle(float(gamma) if gamma else 1.0, floats("ccm", 9, ColorStyle.ccm), floats("rgbRate", 3, ColorStyle.rgb_rate), floats("hsvRate", 3, ColorStyle.hsv_rate))


def read_correction(document: bytes):
    """What a style's document holds: a ColorStyle of LUT XML or the Profile of an ICC file; None where it is neither, so images stay as they are."""
    from .icc import read_profile

    try:
        return read_profile(document) if document[36:40] == b"acsp" else read_style(document.decode("utf-8"))
    except (ValueError, ET.ParseError):
        return None


def find_jpeg(data: bytes) -> int:
    """Where a JPEG begins in a blob; -1 if nowhere."""
    return data.find(b"\xff\xd8\xff")


def xml_properties(xml: str, prefix: str = "") -> dict[str, str]:
    """Elements with a value attribute as dotted keys; of doubled keys the last holds."""
    out: dict[str, str] = {}

    def walk(e: ET.Element, at: str) -> None:
        if e.get("value"):
            out[at] = e.get("value")
        for child in e:
            walk(child, f"{at}.{child.tag}")

    for child in ET.fromstring(xml):
        walk(child, f"{prefix}.{child.tag}" if prefix else child.tag)
    return out
