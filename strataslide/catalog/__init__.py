"""The format catalog: which reader a path belongs to, and what it can do."""

from .formats import FORMATS, catalog, default_biomarker_tokens, qptiff_semantics, register, resolve, slide_family, suffix, supports_biomarkers

__all__ = ["FORMATS", "catalog", "default_biomarker_tokens", "qptiff_semantics", "register", "resolve", "slide_family", "suffix", "supports_biomarkers"]
