"""Readers of slide containers as Spark data sources: spark.dataSource.register, then spark.read.format(...)."""

from .datasource import SlideMetadataSource, SlidePlanesSource, SlideTilesSource, register_sources

__all__ = ["SlideMetadataSource", "SlidePlanesSource", "SlideTilesSource", "register_sources"]
