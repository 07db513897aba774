"""What may be asked of a slide: families, levels and biomarkers, as error columns (null: it may)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UNKNOWN_BIOMARKER, UNSUPPORTED_OPERATION, VALUE, error

# Formats for which a level out of range is a blank region; others take it as an error.
BLANK_LEVELS = ("bif", "tmap")
# Formats that look at the upper bound only; a negative level counts from the last.
FROM_LAST = ("mds", "qptiff", "isyntax")


def family_error(family: Column, wanted: str) -> Column:
    """Regions are of brightfield slides, biomarkers of multiplex ones."""
    if wanted == "multiplex":
        message = F.format_string("Biomarker operations are not supported for %s slides", family)
    else:
        message = F.lit("Multiplex slides require an explicit biomarker; use read_biomarker_region()")
    return F.when(family != wanted, error(UNSUPPORTED_OPERATION, message))


def effective_level(level: Column, count: Column, format_id: Column) -> Column:
    """The level that is meant: of formats without a lower bound -1 is the last one, -2 the one before."""
    return F.when(format_id.isin(*FROM_LAST) & (level < 0) & (level >= -count), level + count).otherwise(level)


def out_of_range(level: Column, count: Column) -> Column:
    return (level < 0) | (level >= count)


def level_error(level: Column, count: Column, format_id: Column) -> Column:
    message = F.format_string("Level %d not available (0-%d)", level, count - 1)
    return F.when(out_of_range(effective_level(level, count, format_id), count) & ~format_id.isin(*BLANK_LEVELS), error(VALUE, message))


def biomarker_error(biomarker: Column, names: Column) -> Column:
    known = F.coalesce(F.array_contains(names, biomarker), F.lit(False))
    return F.when(~known, error(UNKNOWN_BIOMARKER, F.format_string("Biomarker '%s' not found", biomarker)))
