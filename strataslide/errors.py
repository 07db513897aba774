"""Classes of errors that come as rows: struct(class, message) beside what could not be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<class: string, message: string>"
# The classes.
UNSUPPORTED_OPERATION = "UnsupportedOperationError"
UNKNOWN_BIOMARKER = "UnknownBiomarkerError"
MISSING_DEFAULT = "MissingDefaultBiomarkerError"
VALUE = "ValueError"


def error(kind: str, message: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("class"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def first(*checks: tuple[Column, str, Column | str]) -> Column:
    """The error of the first check (condition, class, message) that holds, else null."""
    out = F.lit(None).cast(SCHEMA)
    for condition, kind, message in reversed(checks):
        out = F.when(condition, error(kind, message)).otherwise(out)
    return out
