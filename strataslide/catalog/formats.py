"""Formats as a dimension table, and resolving paths against it by join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "format_id string, extensions array<string>, priority int, slide_family string, has_probe boolean, available boolean, has_label_image boolean, has_associated_images boolean, has_deepzoom boolean, supports_biomarkers boolean, background string, level_rule string, dim_rule string"

# The catalog in its order (first match wins): id, extensions, family, probe,
# available without vendor libraries, label image, associated images, own Deep Zoom,
# biomarkers, background, best-level rule, dimension rule.
FORMATS = (
    ("czi", (".czi",), "czi", False, True, False, False, False, False, "zeros", "single", "single"),
    ("ome_tiff", (".tif", ".tiff"), "multiplex", True, True, False, False, True, True, "zeros", "single", "single"),
    ("mcd", (".mcd",), "multiplex", False, True, False, False, False, True, "zeros", "single", "single"),
    ("hdf5", (".h5", ".hdf5", ".h5ad"), "multiplex", True, True, False, False, False, True, "zeros", "single", "single"),
    ("ims", (".ims",), "multiplex", True, True, False, True, True, True, "zeros", "floor", "stored"),
    ("qptiff", (".qptiff",), "qptiff", False, True, False, True, True, True, "zeros", "floor", "stored"),
    ("kfb", (".kfb",), "brightfield", False, False, False, True, True, False, "white", "native", "stored"),
    ("tmap", (".tmap",), "brightfield", False, True, False, True, True, False, "grey", "prev", "ceil"),
    ("sdpc", (".sdpc", ".dyqx"), "brightfield", False, False, True, True, True, False, "white", "floor", "padded"),
    ("vsi", (".vsi",), "brightfield", False, False, False, True, False, False, "black", "single", "single"),
    ("mds", (".mds", ".mdsx"), "brightfield", False, True, False, True, True, False, "grey240", "floor", "grid"),
    ("tron", (".tron",), "brightfield", False, True, False, True, True, False, "white", "floor_monotone", "stored"),
    ("isyntax", (".isyntax",), "brightfield", False, False, False, True, True, False, "black", "floor", "stored"),
    ("dyj", (".dyj",), "brightfield", False, True, False, True, True, False, "transparent", "floor", "floor"),
    ("ibl", (".ibl",), "brightfield", False, True, False, True, True, False, "transparent", "floor", "floor_clamped"),
    ("zyp", (".zyp",), "brightfield", False, True, False, True, True, False, "white", "floor", "floor_clamped"),
    ("bif", (".bif",), "brightfield", False, True, False, True, True, False, "white", "prev", "stored"),
    ("openslide", (".svs", ".svslide", ".ndpi", ".vms", ".vmu", ".scn", ".mrxs"), "brightfield", False, False, False, True, False, False, "transparent", "native", "stored"),
    ("generic_tiff", (".tif", ".tiff"), "brightfield", False, True, False, False, False, False, "transparent", "single", "single"),
)


def catalog(spark: SparkSession) -> DataFrame:
    """The default catalog, a row a format."""
    return spark.createDataFrame([(f[0], list(f[1]), k, f[2], f[3], f[4], f[5], f[6], f[7], f[8], f[9], f[10], f[11]) for k, f in enumerate(FORMATS)], SCHEMA)


def register(formats: DataFrame, entry: DataFrame) -> DataFrame:
    """Upsert: an entry replaces that of its id and goes to the end."""
    last = formats.agg(F.coalesce(F.max("priority"), F.lit(-1)).alias("last"))
    moved = entry.crossJoin(F.broadcast(last)).withColumn("priority", (F.col("last") + 1 + F.row_number().over(_by_id()) - 1).cast("int")).drop("last")
    return formats.join(entry.select("format_id"), "format_id", "left_anti").unionByName(moved)


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("priority", "format_id")


def suffix(path: Column) -> Column:
    """The lower-cased last suffix of a path's name; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def resolve(paths: DataFrame, formats: DataFrame, path_col: str = "path", probes: str | None = None) -> DataFrame:
    """paths with format_id, format_label (the format's first extension), slide_family and error.

    probes: a column of the ids of formats whose probe accepts the file; formats with a probe
    need it. The first format in order wins; one that is not available is an error then.
    Every row stays, repeated ones too; columns of paths that are named as a result give way
    to it. Extensions are a few, so theirs is the side that is broadcast, and no path moves.
    """
    ext, ranked = fresh(paths, "ext"), fresh(paths, "ranked")
    entry = F.struct("priority", "format_id", F.element_at("extensions", 1).alias("format_label"), "slide_family", "has_probe", "available")
    known = formats.select(F.explode("extensions").alias(ext), entry.alias("entry")).groupBy(ext).agg(F.array_sort(F.collect_list("entry")).alias(ranked))
    accepted = lambda f: F.array_contains(F.col(probes), f["format_id"]) if probes else F.lit(False)
    found = paths.withColumn(ext, suffix(F.col(path_col))).join(F.broadcast(known), ext, "left")
    best = F.get(F.filter(F.coalesce(F.col(ranked), F.array()), lambda f: ~f["has_probe"] | F.coalesce(accepted(f), F.lit(False))), F.lit(0))
    found = found.withColumn(ranked, best)
    label = {c: F.col(ranked)[c].alias(c) for c in ("format_id", "format_label", "slide_family")}
    error = F.when(F.col(ranked).isNull(), "Unsupported file extension").when(~F.col(ranked)["available"], "Backend not available").alias("error")
    return found.select(*[c for c in paths.columns if c not in {*label, "error"}], *label.values(), error)


def supports_biomarkers(capability: Column, family: Column) -> Column:
    """By the format's own capability, or as the slide is a multiplex one."""
    return F.coalesce(capability, F.lit(False)) | F.coalesce(family == "multiplex", F.lit(False))


def qptiff_semantics(format_id: Column, family: Column) -> Column:
    """A qptiff slide's family; null for any other format."""
    return F.when(format_id == "qptiff", family)


# The words that mark a default display biomarker, by reader.
BIOMARKER_TOKENS = {
    "hdf5": ("DNA", "DAPI", "HISTONE"),
    "ims": ("DNA", "DAPI", "HISTONE", "HOECHST"),
    "ome_tiff": ("DAPI", "HISTONE"),
    "mcd": ("DNA", "IRIDIUM", "HISTONE"),
}


def default_biomarker_tokens(format_id: str) -> tuple[str, ...]:
    return BIOMARKER_TOKENS[format_id]


def slide_family(family: Column, markers: Column) -> Column:
    """A qptiff slide is brightfield if h&e or he is its only marker, else multiplex; others keep theirs."""
    only = F.lower(F.trim(F.try_element_at(markers, F.lit(1)))).isin("h&e", "he")
    return F.when(family == "qptiff", F.when((F.size(markers) == 1) & only, "brightfield").otherwise("multiplex")).otherwise(family)
