"""Scalar functions of container metadata, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Micrometres in a unit of length.
UNITS_UM = {"um": 1.0, "micrometer": 1.0, "micrometre": 1.0, "nm": 0.001, "nanometer": 0.001, "nanometre": 0.001, "mm": 1000.0, "millimeter": 1000.0, "millimetre": 1000.0, "cm": 10000.0, "centimeter": 10000.0, "centimetre": 10000.0, "m": 1000000.0, "meter": 1000000.0, "metre": 1000000.0}
# Micrometres in a unit of TIFF resolution.
TIFF_UNITS_UM = {"inch": 25400.0, "cm": 10000.0}


def _of(table: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def micrometers(value: Column, unit: Column) -> Column:
    """A length in micrometres; both micro signs read as u, no unit is um, an unknown one gives null."""
    folded = F.translate(F.lower(F.trim(F.coalesce(unit, F.lit("um")))), "µμ", "uu")
    return value * _of(UNITS_UM, folded)


def tiff_mpp(num: Column, den: Column, unit: Column, default_unit: str | None = None) -> Column:
    """Micrometres per pixel from a resolution num / den per unit; null where either is not positive or the unit is unknown."""
    key = F.coalesce(F.lower(unit), F.lit(default_unit)) if default_unit else F.lower(unit)
    return F.when((num > 0) & (den > 0), _of(TIFF_UNITS_UM, key) / (num / den))


def ceil_div(a: Column, b: Column | int) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return F.floor((a + b - 1) / b).cast("long")


def trailing_integer(name: Column) -> Column:
    """The last white-space separated token as an integer, else null."""
    return F.regexp_extract(name, r"(\S+)\s*$", 1).try_cast("int")


def grid_coordinate(name: Column) -> Column:
    """struct(row_no, col) of r_c; null if it isn't two integers."""
    parts = F.split(name, "_")
    r, c = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.when((F.size(parts) == 2) & r.isNotNull() & c.isNotNull(), F.struct(r.alias("row_no"), c.alias("col")))


def tile_coordinate(name: Column) -> Column:
    """struct(level, x, y) of channel,flat,level,x,y or flat,level,x,y; else null."""
    parts = F.split(name, ",")
    at = lambda k: F.try_element_at(parts, F.size(parts) + k).try_cast("int")
    ok = F.size(parts).isin(4, 5) & at(-2).isNotNull() & at(-1).isNotNull() & at(0).isNotNull()
    return F.when(ok, F.struct(at(-2).alias("level"), at(-1).alias("x"), at(0).alias("y")))


def tile_coordinate_text(version: Column, level: Column, x: Column, y: Column) -> Column:
    """Five parts for versions that start with 2, else four."""
    tail = F.concat_ws(",", level.cast("string"), x.cast("string"), y.cast("string"))
    return F.when(F.startswith(version, F.lit("2")), F.concat(F.lit("0,0,"), tail)).otherwise(F.concat(F.lit("0,"), tail))


def tile_name(row: Column, col: Column) -> Column:
    return F.format_string("%04d_%04d", row, col)


def strip_scan_path(xml: Column) -> Column:
    return F.regexp_replace(xml, r"(?s)<ScanPath>.*?</ScanPath>", "")


def decode_utf16(data: Column) -> Column:
    """UTF-16LE bytes to text without trailing NULs."""
    return F.rtrim(F.decode(data, "UTF-16LE"), F.lit("\0"))


def property_xml(data: Column, is_base64: bool, keep_scan_path: bool = False) -> Column:
    """Property bytes to XML text: base64 and UTF-16LE undone, NULs and the declaration dropped."""
    text = decode_utf16(F.unbase64(data) if is_base64 else data)
    text = F.regexp_replace(text, r"^\s*<\?xml[^>]*\?>", "")
    return text if keep_scan_path else strip_scan_path(text)


def text_attribute(data: Column) -> Column:
    """Attribute bytes as UTF-8 without NULs and blanks at the ends."""
    return F.trim(F.decode(data, "UTF-8"), F.lit("\0 "))


def marker_names(markers: Column) -> Column:
    """Trimmed names, empty ones dropped."""
    return F.filter(F.transform(markers, lambda m: F.trim(m)), lambda m: m != "")


def has_evidence(values: Column, form: str) -> Column:
    """Some value, trimmed and in small letters, is wholly of a form (a regular expression)."""
    return F.exists(values, lambda v: F.lower(F.trim(v)).rlike(rf"\A(?:{form})\z"))


def czi_family(brightfield: Column, multiplex: Column) -> Column:
    """brightfield or multiplex by evidence; both, or neither, is an error."""
    return F.when(brightfield & ~multiplex, "brightfield").when(multiplex & ~brightfield, "multiplex").when(brightfield & multiplex, "error: ambiguous").otherwise("error: unknown")


def le_integer(data: Column, offset: int, n: int) -> Column:
    """An unsigned little-endian integer of n bytes (up to 7) at an offset."""
    return F.conv(_hex_le(data, offset, n), 16, 10).cast("long")


def _hex_le(data: Column, offset: int, n: int) -> Column:
    return F.concat(*[F.lpad(F.hex(F.substring(data, offset + 1 + k, 1)), 2, "0") for k in reversed(range(n))])


def magic_format(head: Column) -> Column:
    """The container that a file's first bytes name, else null."""
    start = lambda raw: F.substring(head, 1, len(raw)) == F.lit(raw)
    return (
        F.when(start(b"TMAP06"), "tmap06").when(start(b"TMAP07"), "tmap07").when(start(b"DPTWSI"), "dyj").when(start(b"BKIO"), "mdsx").when(start(b"\xd0\xcf\x11\xe0"), "mds")
        .when(start(b"SQLite format 3\0"), "ibl").when(start(b"PK\x03\x04"), "tron").when(start(b"II*\0") | start(b"MM\0*"), "tiff").when(start(b"II+\0") | start(b"MM\0+"), "bigtiff").when(start(b"\x89HDF\r\n\x1a\n"), "hdf5")
    )


def is_jpeg(data: Column) -> Column:
    return F.substring(data, 1, 2) == F.lit(b"\xff\xd8")


def color_hex(prop: Column) -> Column:
    return F.concat(F.lit("#"), F.coalesce(prop, F.lit("ffffff")))


def rgb_text(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("rgb(%d,%d,%d)", r, g, b)


def ome_channel_names(xml: Column) -> Column:
    """Names of the channels of an OME document's pixels, whatever its namespace."""
    return F.xpath(xml, F.lit("//*[local-name()='Pixels']/*[local-name()='Channel']/@Name"))
