"""Whole-slide images as Spark tables: catalog, pyramid levels, tiles, regions and Deep Zoom."""
