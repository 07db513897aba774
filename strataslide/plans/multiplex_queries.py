"""Channels, biomarkers and planes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import default_biomarker_tokens
from ..operators import multiplex as M
from .registry import query, table

_PX8 = "list_transform(px, lambda x: CASE WHEN {hi} > {lo} THEN CAST(floor((CAST(x AS DOUBLE) - {lo}) / ({hi} - {lo}) * 255) AS INTEGER) ELSE 0 END)"


@query(f"SELECT channel_index, array_to_string({_PX8.format(lo='lo', hi='hi')}, ',') AS px8 FROM (SELECT channel_index, px, CAST(list_min(px) AS DOUBLE) AS lo, CAST(list_max(px) AS DOUBLE) AS hi FROM v_planes)")
def minmax_uint8(spark, sf_dir):
    return table(spark, sf_dir, "v_planes").select("channel_index", F.array_join(F.transform(M.minmax_uint8(F.col("px")), lambda x: x.cast("string")), ",").alias("px8"))


@query(f"SELECT channel_index, array_to_string({_PX8.format(lo='lo', hi='hi')}, ',') AS px8 FROM (SELECT channel_index, px, CAST(min(list_min(px)) OVER (PARTITION BY slide_id) AS DOUBLE) AS lo, CAST(max(list_max(px)) OVER (PARTITION BY slide_id) AS DOUBLE) AS hi FROM v_planes)")
def minmax_scope_slide(spark, sf_dir):
    return M.minmax_by_slide(table(spark, sf_dir, "v_planes")).select("channel_index", F.array_join(F.transform("px8", lambda x: x.cast("string")), ",").alias("px8"))


@query("SELECT channel_index, len(s) AS n_px, round(list_sum(list_transform(s, lambda v: CAST(v AS DOUBLE))), 9) AS total FROM (SELECT channel_index, CASE WHEN channel_index % 11 < 8 THEN flatten(list_transform(range(2, 7), lambda r: px[r * 8 + channel_index % 11 + 1 : r * 8 + least(channel_index % 11 + 4, 8)])) ELSE list_transform(range(20), lambda q: 0.0) END AS s FROM v_planes)")
def plane_slice(spark, sf_dir):
    cut = M.plane_slice(F.col("px"), F.lit(8), F.lit(8), (F.col("channel_index") % 11).cast("int"), F.lit(2), F.lit(4), F.lit(5))
    return table(spark, sf_dir, "v_planes").withColumn("s", cut).select("channel_index", F.size("s").cast("long").alias("n_px"), F.round(F.aggregate("s", F.lit(0.0), lambda a, v: a + v.cast("double")), 9).alias("total"))


@query("SELECT slide_id, array_to_string(list(name ORDER BY channel_index), '|') AS biomarkers FROM v_channels GROUP BY slide_id")
def list_biomarkers(spark, sf_dir):
    return M.biomarkers(table(spark, sf_dir, "v_channels")).select("slide_id", F.array_join("biomarkers", "|").alias("biomarkers"))


@query("SELECT slide_id, arg_min(name, struct_pack(o := CASE WHEN regexp_matches(upper(name), 'DAPI|HISTONE') THEN 0 ELSE 1 END, i := channel_index)) AS default_biomarker FROM v_channels GROUP BY slide_id")
def default_biomarker(spark, sf_dir):
    return M.default_biomarker(table(spark, sf_dir, "v_channels"), default_biomarker_tokens("ome_tiff"))


@query("SELECT slide_id, name, max(channel_index) AS channel_index FROM v_channels GROUP BY slide_id, name")
def dict_last_wins(spark, sf_dir):
    return M.channel_lookup(table(spark, sf_dir, "v_channels"))


_CONV = "SELECT conv_id, list(role ORDER BY turn, role) AS fluor, list('ch' || CAST(turn % 3 AS VARCHAR) ORDER BY turn, role) AS names, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY conv_id"


def _conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"), F.count("*").cast("int").alias("n"))
    return c.select("conv_id", F.col("t.role").alias("fluor"), F.transform("t.turn", lambda t: F.concat(F.lit("ch"), (t % 3).cast("string"))).alias("names"), "n")


@query(f"SELECT conv_id, array_to_string(list(v ORDER BY pos), '|') AS biomarkers FROM (SELECT conv_id, v, min(pos) AS pos FROM (SELECT conv_id, unnest(u) AS v, unnest(range(len(u))) AS pos FROM (SELECT conv_id, list_concat(list_concat(fluor, names), list_transform(range(n), lambda i: 'channel_' || CAST(i AS VARCHAR))) AS u FROM ({_CONV}))) GROUP BY conv_id, v) GROUP BY conv_id")
def biomarker_union(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", F.array_join(M.union_names(F.col("fluor"), F.col("names"), F.col("n")), "|").alias("biomarkers"))


@query(f"SELECT conv_id, b AS biomarker, CAST(coalesce(CASE WHEN list_contains(fluor, b) THEN list_position(fluor, b) - 1 END, CASE WHEN list_contains(names, b) THEN list_position(names, b) - 1 END, CASE WHEN regexp_matches(b, '^channel_[0-9]+$') AND CAST(b[9:] AS BIGINT) < n THEN CAST(b[9:] AS BIGINT) END) AS INTEGER) AS channel_index FROM (SELECT *, unnest(['user', 'ch1', 'channel_2', 'channel_40', 'none']) AS b FROM ({_CONV}))")
def channel_index(spark, sf_dir):
    asked = _conversations(spark, sf_dir).withColumn("b", F.explode(F.array(*map(F.lit, ("user", "ch1", "channel_2", "channel_40", "none")))))
    return asked.select("conv_id", F.col("b").alias("biomarker"), M.channel_index(F.col("b"), F.col("fluor"), F.col("names"), F.col("n")).alias("channel_index"))


@query("SELECT slide_id, channel_index, CASE WHEN k > 1 THEN name || ' (' || CAST(k AS VARCHAR) || ')' ELSE name END AS label FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, name ORDER BY channel_index) AS k FROM v_channels)")
def label_suffix(spark, sf_dir):
    return M.suffixed_labels(table(spark, sf_dir, "v_channels")).select("slide_id", "channel_index", "label")


_FILES = "SELECT c_nationkey AS folder, c_custkey % 3 AS height, c_custkey % 2 AS width, 'u16' AS dtype, c_name AS path, c_mktsegment AS label FROM customer"


@query(f"SELECT path AS member, label, folder, n_anchors FROM (SELECT f.folder, f.label, f.path, count(*) AS n_anchors FROM (SELECT folder, height, width, dtype, label, min(path) AS path FROM ({_FILES}) GROUP BY ALL) f JOIN ({_FILES}) a ON a.folder = f.folder AND a.height = f.height AND a.width = f.width AND a.dtype = f.dtype GROUP BY ALL)")
def sibling_channels(spark, sf_dir):
    files = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS folder", "c_custkey % 3 AS height", "c_custkey % 2 AS width", "'u16' AS dtype", "c_name AS path", "c_mktsegment AS label")
    return M.sibling_anchors(files).groupBy(F.col("path").alias("member"), "label", "folder").agg(F.sum("n_anchors").alias("n_anchors"))


@query("SELECT vec_id, CASE WHEN instr(a, 'X') > 0 THEN s[instr(a, 'X')] END AS width, CASE WHEN instr(a, 'Y') > 0 THEN s[instr(a, 'Y')] END AS height FROM (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'CYX' WHEN 1 THEN 'YXS' WHEN 2 THEN 'YX' ELSE 'QZC' END AS a, [CAST(label AS BIGINT), vec_id, vec_id + 1] AS s FROM embeddings)")
def axes_dimensions(spark, sf_dir):
    axes = F.element_at(F.array(*map(F.lit, ("CYX", "YXS", "YX", "QZC"))), (F.col("vec_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", M.axes_dimensions(axes, F.array(F.col("label").cast("long"), "vec_id", F.col("vec_id") + 1)).alias("d"))
    return d.select("vec_id", "d.width", "d.height")


@query(f"SELECT folder, height, width, dtype, label, min(path) AS path FROM ({_FILES}) GROUP BY ALL")
def sibling_groups(spark, sf_dir):
    files = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS folder", "c_custkey % 3 AS height", "c_custkey % 2 AS width", "'u16' AS dtype", "c_name AS path", "c_mktsegment AS label")
    return M.sibling_groups(files)


_ORDERS = ("XYZCT", "XYCZT", "XYZTC", "XYTCZ", "XYCTZ", "XYTZC")


@query(f"SELECT p_partkey, CAST(c * CASE WHEN o IN ('XYZCT', 'XYZTC', 'XYTZC') THEN greatest(z, 1) ELSE 1 END * CASE WHEN o IN ('XYZTC', 'XYTCZ', 'XYTZC') THEN greatest(t, 1) ELSE 1 END AS BIGINT) AS page FROM (SELECT p_partkey, {list(_ORDERS)}[1 + p_partkey % 6] AS o, p_size % 5 AS z, p_size % 3 AS t, p_partkey % 7 AS c FROM part)")
def channel_pages(spark, sf_dir):
    order = F.element_at(F.array(*map(F.lit, _ORDERS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", M.channel_page(order, F.col("p_size") % 5, F.col("p_size") % 3, F.col("p_partkey") % 7).cast("long").alias("page"))
