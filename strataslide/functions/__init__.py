"""Scalar functions on columns, raster functions on arrays, codecs."""
