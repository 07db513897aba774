"""Writers: rasters as PNG files, Deep Zoom descriptors, stored images as they are."""

from .files import write_blobs, write_descriptors, write_png

__all__ = ["write_blobs", "write_descriptors", "write_png"]
