"""Small containers, byte by byte."""

from strataslide.sinks.containers import czi, mcd, ome, tiff_pages

__all__ = ["czi", "mcd", "ome", "tiff_pages"]
