"""Catalog: resolving paths, registering formats, families."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FORMATS, catalog, register, resolve, slide_family, suffix
from .registry import query, table

_PATHS = "SELECT p_partkey AS slide_id, '/slides/' || p_name || CASE p_size % 9 WHEN 0 THEN '.SVS' WHEN 1 THEN '.ibl' WHEN 2 THEN '.tif' WHEN 3 THEN '.mdsx' WHEN 4 THEN '.h5' WHEN 5 THEN '.tar.zyp' WHEN 6 THEN '' WHEN 7 THEN '.xyz' ELSE '.tmap' END AS path FROM part"
_ROWS = ", ".join(f"('{f[0]}', '{e}', {k}, '{f[2]}', {f[3]}, {f[4]}, '{f[1][0]}')" for k, f in enumerate(FORMATS) for e in f[1])
_EXT = "regexp_extract(lower(path), '[^/](\\.[^./]+)$', 1)"


def _paths(spark, sf_dir):
    ends = (".SVS", ".ibl", ".tif", ".mdsx", ".h5", ".tar.zyp", "", ".xyz", ".tmap")
    end = F.element_at(F.array(*map(F.lit, ends)), (F.col("p_size") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), F.concat(F.lit("/slides/"), "p_name", end).alias("path"))


@query(f"WITH f(format_id, ext, priority, family, has_probe, available, label) AS (VALUES {_ROWS}), p AS (SELECT *, {_EXT} AS e, slide_id % 2 = 0 AS probed FROM ({_PATHS})), b AS (SELECT slide_id, arg_min(format_id, priority) AS format_id, arg_min(label, priority) AS format_label, arg_min(family, priority) AS slide_family, arg_min(available, priority) AS ok FROM p LEFT JOIN f ON p.e = f.ext AND (NOT has_probe OR probed) GROUP BY slide_id) SELECT slide_id, format_id, format_label, slide_family, CASE WHEN format_id IS NULL THEN 'Unsupported file extension' WHEN NOT ok THEN 'Backend not available' END AS error FROM b")
def catalog_resolve(spark, sf_dir):
    probed = F.when(F.col("slide_id") % 2 == 0, F.array(*[F.lit(f[0]) for f in FORMATS if f[3]])).otherwise(F.array().cast("array<string>"))
    return resolve(_paths(spark, sf_dir).withColumn("probed", probed), catalog(spark), probes="probed").select("slide_id", "format_id", "format_label", "slide_family", "error")


@query(f"WITH f(format_id, ext, priority, family, has_probe, available, label) AS (VALUES {_ROWS}), o AS (SELECT DISTINCT format_id, priority FROM f WHERE format_id <> 'ibl') SELECT format_id, CAST(priority AS INTEGER) AS priority FROM o UNION ALL SELECT 'ibl', {len(FORMATS)}")
def catalog_upsert(spark, sf_dir):
    formats = catalog(spark)
    return register(formats, formats.filter("format_id = 'ibl'")).select("format_id", "priority")


@query(f"SELECT slide_id, {_EXT} AS ext FROM ({_PATHS})")
def path_suffix(spark, sf_dir):
    return _paths(spark, sf_dir).select("slide_id", suffix(F.col("path")).alias("ext"))


@query("WITH m AS (SELECT slide_id, list(name ORDER BY channel_index) AS names FROM v_channels GROUP BY slide_id UNION ALL SELECT 1000 + n_nationkey, [CASE WHEN n_nationkey % 2 = 0 THEN ' H&E ' ELSE n_name END] FROM nation) SELECT slide_id, CASE WHEN len(names) = 1 AND lower(trim(names[1])) IN ('h&e', 'he') THEN 'brightfield' ELSE 'multiplex' END AS family FROM m")
def slide_families(spark, sf_dir):
    from ..operators.multiplex import biomarkers

    named = biomarkers(table(spark, sf_dir, "v_channels")).select("slide_id", F.col("biomarkers").alias("names"))
    single = table(spark, sf_dir, "nation").select((1000 + F.col("n_nationkey")).cast("long").alias("slide_id"), F.array(F.when(F.col("n_nationkey") % 2 == 0, " H&E ").otherwise(F.col("n_name"))).alias("names"))
    return named.unionByName(single).select("slide_id", slide_family(F.lit("qptiff"), F.col("names")).alias("family"))
