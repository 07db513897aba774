"""Aggregates, ordered rules, top rows and scalars over metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metadata as A
from .registry import query, table


@query("SELECT slide_id, level, min(col) AS min_col, max(col) AS max_col, min(row_no) AS min_row, max(row_no) AS max_row, count(*) AS n_tiles FROM v_tiles GROUP BY slide_id, level")
def layer_extent(spark, sf_dir):
    return A.layer_extent(table(spark, sf_dir, "v_tiles"))


@query("SELECT * FROM v_tiles")
def tile_index(spark, sf_dir):
    return table(spark, sf_dir, "v_tiles")


@query("SELECT slide_id, scene_index, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1 FROM v_scenes GROUP BY slide_id, scene_index")
def scene_bbox(spark, sf_dir):
    return A.bounding_box(table(spark, sf_dir, "v_scenes"))


@query("SELECT s.slide_id, scene_index, x - ox AS x, y - oy AS y FROM v_scenes s JOIN (SELECT slide_id, min(x) AS ox, min(y) AS oy FROM v_scenes GROUP BY slide_id) o ON s.slide_id = o.slide_id")
def scene_rebase(spark, sf_dir):
    return A.rebased(table(spark, sf_dir, "v_scenes")).select("slide_id", "scene_index", "x", "y")


@query("SELECT slide_id, max(x) + 1280 AS width, max(y) + 1280 AS height FROM v_scenes GROUP BY slide_id")
def unified_extent(spark, sf_dir):
    return A.unified_extent(table(spark, sf_dir, "v_scenes"), 1280)


_ROI = "SELECT slide_id, scene_index AS level, x, y FROM v_scenes WHERE scene_index <> slide_id % 3 + 1"


@query(f"WITH t AS ({_ROI}), l AS (SELECT slide_id, unnest(range(4)) AS level FROM (SELECT DISTINCT slide_id FROM v_scenes)) SELECT l.slide_id, CAST(l.level AS INTEGER) AS level, coalesce(min(t.x), CAST(floor(coalesce(any_value(b.x), 0) / pow(2, l.level)) AS BIGINT)) AS roi_x, coalesce(min(t.y), CAST(floor(coalesce(any_value(b.y), 0) / pow(2, l.level)) AS BIGINT)) AS roi_y FROM l LEFT JOIN t ON l.slide_id = t.slide_id AND l.level = t.level LEFT JOIN (SELECT slide_id, min(x) AS x, min(y) AS y FROM t WHERE level = 0 GROUP BY slide_id) b ON l.slide_id = b.slide_id GROUP BY l.slide_id, l.level")
def roi_offset(spark, sf_dir):
    scenes = table(spark, sf_dir, "v_scenes")
    tiles = scenes.filter("scene_index <> slide_id % 3 + 1").select("slide_id", F.col("scene_index").alias("level"), "x", "y")
    levels = scenes.select("slide_id").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return A.roi_offset(tiles, levels)


@query("SELECT slide_id, level, sizes FROM (SELECT l_partkey AS slide_id, l_linenumber AS level, count(DISTINCT struct_pack(w := CAST(l_quantity AS INTEGER) % 2, h := 1)) AS sizes FROM lineitem GROUP BY l_partkey, l_linenumber) WHERE sizes > 1")
def consistent_dims(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS slide_id", "l_linenumber AS level", "CAST(l_quantity AS INT) % 2 AS width", "1 AS height")
    return A.inconsistent_levels(rows)


@query("SELECT l_suppkey AS file_id, l_linenumber AS candidate, count(*) FILTER (WHERE l_returnflag = 'A') AS n_valid, count(*) FILTER (WHERE l_returnflag = 'A') >= 3 AS accepted FROM lineitem GROUP BY l_suppkey, l_linenumber")
def vote_valid(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_id"), F.col("l_linenumber").alias("candidate"), "l_returnflag")
    return A.votes(rows, ("file_id", "candidate"), F.col("l_returnflag") == "A")


@query("SELECT user_id AS file_id, event_id AS record_no FROM events e WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id AND b.event_id <= e.event_id AND b.value > 440)")
def read_until_invalid(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("record_no"), "value")
    return A.until_invalid(rows, "file_id", "record_no", F.col("value") <= 440).select("file_id", "record_no")


@query("SELECT o_custkey AS slide_id, arg_max(o_orderkey, struct_pack(a := o_totalprice, b := o_orderkey)) AS acquisition_id FROM orders GROUP BY o_custkey")
def largest_acquisition(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS slide_id", "o_orderkey AS acquisition_id", "o_totalprice")
    return A.largest(rows, "slide_id", F.col("o_totalprice"), F.col("acquisition_id"), "acquisition_id")


@query("SELECT o_custkey AS slide_id, arg_max(o_orderkey, struct_pack(a := o_orderkey % 16 * 4, b := -o_orderkey)) AS scene_id FROM orders GROUP BY o_custkey")
def largest_scene(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS slide_id", "o_orderkey AS scene_id")
    return A.largest(rows, "slide_id", F.col("scene_id") % 16 * 4, -F.col("scene_id"), "scene_id")


@query("SELECT slide_id, arg_min(path, struct_pack(d := length(path) - length(replace(path, '/', '')), p := path)) AS best FROM (SELECT p_size AS slide_id, CASE WHEN p_partkey % 3 = 0 THEN 'a/b/' || p_name WHEN p_partkey % 3 = 1 THEN 'a/' || p_name ELSE 'layers/raw/x/' || p_name END AS path FROM part) GROUP BY slide_id")
def best_dataset(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, ("a/b/", "a/", "layers/raw/x/"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return A.best_dataset(table(spark, sf_dir, "part").select(F.col("p_size").alias("slide_id"), F.concat(head, "p_name").alias("path")), "slide_id", "path")


@query("SELECT slide_id, arg_min(n, struct_pack(o := CASE WHEN n = 'TimePoint 0' THEN 0 ELSE 1 END, n := n)) AS time_point FROM (SELECT o_custkey AS slide_id, 'TimePoint ' || CAST(o_orderkey % 12 AS VARCHAR) AS n FROM orders) GROUP BY slide_id")
def time_point(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("slide_id"), F.concat(F.lit("TimePoint "), (F.col("o_orderkey") % 12).cast("string")).alias("n"))
    return A.preferred_time_point(rows, "slide_id", "n")


@query("SELECT conv_id, CAST(place AS INTEGER) AS place, tok0, tok1 FROM (SELECT conv_id, row_number() OVER w - 1 AS place, text AS tok0, lead(text) OVER w AS tok1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE place % 2 = 0 AND tok1 IS NOT NULL")
def token_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("o", F.struct("turn", "role", "text"))
    return A.token_pairs(rows, "conv_id", "o", "text")


_TOKENS = "SELECT slide_id, place, CASE WHEN o_orderkey % 11 = 0 THEN 'x' WHEN place % 4 = 1 THEN 'StartPosition' WHEN place % 4 = 3 THEN 'DataLength' ELSE CAST(o_orderkey AS {text}) END AS name FROM (SELECT o_custkey % 50 AS slide_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS place FROM {orders})"
_FIVE = ", ".join(f"lead(name, {k}) OVER w AS t{k}" for k in range(1, 5))


@query(
    f"WITH RECURSIVE c AS (SELECT slide_id, place, name, CAST(t2 AS BIGINT) AS position, CAST(t4 AS BIGINT) AS length FROM (SELECT *, {_FIVE} FROM ({_TOKENS.format(text='VARCHAR', orders='orders')}) WINDOW w AS (PARTITION BY slide_id ORDER BY place)) WHERE t1 = 'StartPosition' AND t3 = 'DataLength' AND regexp_full_match(t2, '[0-9]+') AND regexp_full_match(t4, '[0-9]+')),"
    " n AS (SELECT a.slide_id, a.place, min(b.place) AS after FROM c a JOIN c b ON b.slide_id = a.slide_id AND b.place >= a.place + 5 GROUP BY ALL),"
    " walk AS (SELECT slide_id, min(place) AS place FROM c GROUP BY slide_id UNION ALL SELECT n.slide_id, n.after FROM walk JOIN n ON n.slide_id = walk.slide_id AND n.place = walk.place)"
    " SELECT slide_id, name, position, length FROM walk JOIN c USING (slide_id, place)"
)
def token_entries(spark, sf_dir):
    """Streams in which a value is also the next entry's name, so that entries overlap in chains."""
    tokens = spark.sql(_TOKENS.format(text="STRING", orders="{orders}"), orders=table(spark, sf_dir, "orders"))
    return A.greedy_entries(tokens, "slide_id", "place", "name")


_ASSOC = "SELECT slide_id, name, made FROM (SELECT p_partkey AS slide_id, CASE WHEN p_size % 4 = 0 THEN 'thumbnail' ELSE 'label' END AS name, false AS made FROM part UNION ALL SELECT p_partkey, 'thumbnail', true FROM part WHERE p_size % 4 <> 0 AND p_size % 3 <> 0)"


@query(_ASSOC)
def assoc_thumbnail_synth(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    images = p.select(F.col("p_partkey").alias("slide_id"), F.when(F.col("p_size") % 4 == 0, "thumbnail").otherwise("label").alias("name"))
    slides = p.select(F.col("p_partkey").alias("slide_id"), F.when(F.col("p_size") % 3 == 0, "multiplex").otherwise("brightfield").alias("slide_family"))
    return A.associated_images(images, slides)


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, event_type AS vendor, CAST(value AS VARCHAR) AS v FROM events")
def properties_map(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    base = F.create_map(F.lit("vendor"), F.col("event_type"), F.lit("v"), F.col("value").cast("string"))
    more = F.when(F.col("event_id") % 3 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("k"), F.get_json_object("props", "$.k")))
    m = e.select("event_id", F.map_concat(base, more).alias("p"))
    return m.select("event_id", F.try_element_at("p", F.lit("k")).alias("k"), F.element_at("p", "vendor").alias("vendor"), F.element_at("p", "v").alias("v"))


_UNIT = "CASE p_size % 7 WHEN 0 THEN 'nm' WHEN 1 THEN 'um' WHEN 2 THEN 'µm' WHEN 3 THEN 'μm' WHEN 4 THEN 'mm' WHEN 5 THEN 'parsec' ELSE NULL END"


@query(f"SELECT slide_id, round(p * CASE u WHEN 'nm' THEN 0.001 WHEN 'um' THEN 1.0 WHEN 'mm' THEN 1000.0 END, 6) AS um FROM (SELECT p_partkey AS slide_id, p_retailprice AS p, replace(replace(coalesce({_UNIT}, 'um'), 'µ', 'u'), 'μ', 'u') AS u FROM part)")
def unit_to_um(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), F.round(S.micrometers(F.col("p_retailprice"), F.expr(_UNIT)), 6).alias("um"))


@query("SELECT slide_id, round(CASE WHEN num > 0 THEN CASE u WHEN 'inch' THEN 25400.0 WHEN 'cm' THEN 10000.0 END / (num / 100.0) END, 9) AS mpp FROM (SELECT p_partkey AS slide_id, p_size - 3 AS num, CASE p_size % 3 WHEN 0 THEN 'inch' WHEN 1 THEN 'cm' END AS u FROM part)")
def tiff_mpp(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    unit = F.when(F.col("p_size") % 3 == 0, "inch").when(F.col("p_size") % 3 == 1, "cm")
    return p.select(F.col("p_partkey").alias("slide_id"), F.round(S.tiff_mpp(F.col("p_size") - 3, F.lit(100), unit), 9).alias("mpp"))


_COORD = "CASE l_linenumber % 4 WHEN 0 THEN '0,0,' || CAST(l_linenumber AS VARCHAR) || ',' || CAST(l_suppkey AS VARCHAR) || ',7' WHEN 1 THEN '0,2,' || CAST(l_suppkey AS VARCHAR) || ',9' WHEN 2 THEN 'a,b,c,d' ELSE '1,2' END"


@query(f"SELECT c AS coord, n, CASE WHEN k = 0 THEN CAST(p[3] AS INTEGER) WHEN k = 1 THEN CAST(p[2] AS INTEGER) END AS level, CASE WHEN k = 0 THEN CAST(p[4] AS INTEGER) WHEN k = 1 THEN CAST(p[3] AS INTEGER) END AS x, CASE WHEN k = 0 THEN CAST(p[5] AS INTEGER) WHEN k = 1 THEN CAST(p[4] AS INTEGER) END AS y FROM (SELECT c, count(*) AS n, any_value(k) AS k, string_split(c, ',') AS p FROM (SELECT {_COORD} AS c, l_linenumber % 4 AS k FROM lineitem) GROUP BY c)")
def coord_split(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.expr(_COORD.replace("VARCHAR", "STRING")).alias("coord")).groupBy("coord").agg(F.count("*").alias("n"))
    return c.withColumn("t", S.tile_coordinate(F.col("coord"))).select("coord", "n", "t.level", "t.x", "t.y")


@query("SELECT DISTINCT slide_id, level, col, row_no, printf('%04d_%04d', row_no, col) AS tile_name, CASE WHEN slide_id % 2 = 0 THEN '0,0,' ELSE '0,' END || CAST(level AS VARCHAR) || ',' || CAST(col AS VARCHAR) || ',' || CAST(row_no AS VARCHAR) AS coord FROM v_tiles")
def tile_names(spark, sf_dir):
    t = table(spark, sf_dir, "v_tiles")
    version = F.when(F.col("slide_id") % 2 == 0, "2.01").otherwise("1.10")
    return t.select("slide_id", "level", "col", "row_no", S.tile_name(F.col("row_no"), F.col("col")).alias("tile_name"), S.tile_coordinate_text(version, F.col("level"), F.col("col"), F.col("row_no")).alias("coord"))


@query("SELECT c_custkey, 'a' || c_name || 'z' AS xml FROM customer")
def scanpath_strip(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", S.strip_scan_path(F.concat(F.lit("a<ScanPath>x\ny"), "c_mktsegment", F.lit("</ScanPath>"), "c_name", F.lit("<ScanPath></ScanPath>z"))).alias("xml"))


@query("SELECT c_custkey, c_name AS name FROM customer")
def utf16_decode(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", S.property_xml(F.base64(F.encode(F.concat(F.lit('<?xml version="1.0"?>'), "c_name", F.lit("\0\0")), "UTF-16LE")), True).alias("name"))


@query("SELECT item_id, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN CAST(t AS INTEGER) END AS n FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN CAST(item_id AS VARCHAR) ELSE 'x' END AS t FROM benchmark)")
def trailing_integer(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    name = F.concat(F.lit("ResolutionLevel "), F.when(F.col("item_id") % 2 == 0, F.col("item_id").cast("string")).otherwise("x"))
    return b.select("item_id", S.trailing_integer(name).alias("n"))


@query("SELECT o_orderkey, o_orderkey AS le32 FROM orders")
def le_decode(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    big = F.lpad(F.hex("o_orderkey"), 8, "0")
    return o.select("o_orderkey", S.le_integer(F.unhex(F.concat(*[F.substring(big, 7 - 2 * k, 2) for k in range(4)])), 0, 4).alias("le32"))


@query("SELECT user_id AS slide_id, round(avg(value), 9) AS mpp FROM events WHERE event_type <> 'click' GROUP BY user_id")
def mean_of_available(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.filter("event_type <> 'click'").groupBy(F.col("user_id").alias("slide_id")).agg(F.round(F.avg("value"), 9).alias("mpp"))


_LUT = (0.9, 0.05, 0.05, 0.1, 0.8, 0.1, 0.02, 0.08, 0.9)


@query("SELECT l_partkey, l_linenumber, CAST(floor(least(greatest((0.9 * r + 0.05 * g + 0.05 * b) * 1.1, 0), 1) * 255) AS INTEGER) AS red, CAST(floor(least(greatest((0.1 * r + 0.8 * g + 0.1 * b) * 1.0, 0), 1) * 255) AS INTEGER) AS green, CAST(floor(least(greatest((0.02 * r + 0.08 * g + 0.9 * b) * 0.9, 0), 1) * 255) AS INTEGER) AS blue FROM (SELECT l_partkey, l_linenumber, l_partkey % 256 / 255.0 AS r, l_suppkey % 256 / 255.0 AS g, l_linenumber * 31 % 256 / 255.0 AS b FROM lineitem)")
def lut_color(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", (F.col("l_partkey") % 256 / F.lit(255.0)).alias("r"), (F.col("l_suppkey") % 256 / F.lit(255.0)).alias("g"), (F.col("l_linenumber") * 31 % 256 / F.lit(255.0)).alias("b"))

    def out(k: int, rate: float):
        a, b, c = _LUT[3 * k : 3 * k + 3]
        mixed = (a * F.col("r") + b * F.col("g") + c * F.col("b")) * rate
        return F.floor(F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")

    return p.select("l_partkey", "l_linenumber", out(0, 1.1).alias("red"), out(1, 1.0).alias("green"), out(2, 0.9).alias("blue"))


# A profile of three primaries and one gamma, as fixed-point numbers of 1/65536 and 1/256.
_PRIMARIES = ((39974, 13461, 10028), (20387, 41027, 9783), (2831, 11048, 39885))
_GAMMA = 563
_PER = 65536


def _profile() -> bytes:
    import struct

    curve = b"curv" + struct.pack(">xxxxIHxx", 1, _GAMMA)
    tags = [(b"rgb"[k : k + 1] + b"XYZ", b"XYZ " + struct.pack(">xxxx3i", *[row[k] for row in _PRIMARIES])) for k in range(3)] + [(c + b"TRC", curve) for c in (b"r", b"g", b"b")]
    table, body = struct.pack(">I", len(tags)), b""
    for name, held in tags:
        table += name + struct.pack(">II", 132 + 12 * len(tags) + len(body), len(held))
        body += held
    return (bytes(16) + b"RGB XYZ " + bytes(12) + b"acsp").ljust(128, b"\0") + table + body


def _icc_sql() -> str:
    import numpy as np

    from ..functions.icc import SRGB

    m = np.linalg.inv(SRGB) @ (np.array(_PRIMARIES) / _PER)
    light = [" + ".join(f"CAST({v!r} AS DOUBLE) * pow({c} / 255.0, {_GAMMA / 256})" for v, c in zip(row, "rgb", strict=True)) for row in m.tolist()]
    encode = "CAST(floor(255 * CASE WHEN least(greatest({0}, 0), 1) <= 0.0031308 THEN 12.92 * least(greatest({0}, 0), 1) ELSE 1.055 * pow(least(greatest({0}, 0), 1), 1 / CAST(2.4 AS DOUBLE)) - 0.055 END + 0.5) AS INTEGER)"
    colors = "SELECT r, g, b, count(*) AS n FROM (SELECT CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey * 3 % 256 AS INTEGER) AS g, CAST(l_linenumber * 31 % 256 AS INTEGER) AS b FROM lineitem) GROUP BY ALL"
    return f"SELECT r, g, b, n, {', '.join(f'{encode.format(f"({x})")} AS {name}' for x, name in zip(light, ('red', 'green', 'blue'), strict=True))} FROM ({colors})"


@query(_icc_sql())
def icc_color(spark, sf_dir):
    """Each colour of the table, once, from a profile's space to sRGB."""
    import numpy as np

    from ..functions.icc import read_profile

    profile = read_profile(_profile())

    def each(batches):
        for b in batches:
            image = np.stack([b[c].to_numpy() for c in "rgb"], 1).astype(np.uint8)[:, None, :]
            yield b.assign(**{name: profile.apply(image)[:, 0, k].astype(np.int32) for k, name in enumerate(("red", "green", "blue"))})

    at = table(spark, sf_dir, "lineitem").selectExpr("CAST(l_partkey % 256 AS INT) AS r", "CAST(l_suppkey * 3 % 256 AS INT) AS g", "CAST(l_linenumber * 31 % 256 AS INT) AS b")
    return at.groupBy("r", "g", "b").agg(F.count("*").alias("n")).mapInPandas(each, "r int, g int, b int, n long, red int, green int, blue int")


#: Step k gives a slide's k-th scene the first image that fits and no earlier scene has.
_MATCH = """SELECT slide_id, scene_index, image_index FROM (
    WITH RECURSIVE s AS (SELECT slide_id, list(struct_pack(i := scene_index, w := w, h := h) ORDER BY scene_index) AS scenes FROM (SELECT slide_id, scene_index, max(x) AS w, max(y) AS h FROM v_scenes GROUP BY slide_id, scene_index) GROUP BY slide_id),
    m AS (SELECT slide_id, list(struct_pack(i := image_index, w := w, h := h) ORDER BY image_index) AS images FROM (SELECT slide_id, x % 7 AS image_index, max(x) AS w, max(y) AS h FROM v_scenes GROUP BY slide_id, x % 7) GROUP BY slide_id),
    r AS (
        SELECT slide_id, 0 AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS image_index, scenes, images FROM s JOIN m USING (slide_id)
        UNION ALL
        SELECT slide_id, k, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, hit, scenes, images FROM (
            SELECT slide_id, k + 1 AS k, used, scenes, images, list_filter(images, lambda x: NOT list_contains(used, x.i) AND abs(x.w - scenes[k + 1].w) <= 512 AND abs(x.h - scenes[k + 1].h) <= 512)[1].i AS hit FROM r WHERE k < len(scenes)
        )
    )
    SELECT slide_id, scenes[k].i AS scene_index, image_index FROM r WHERE k > 0
)"""


@query(_MATCH)
def scene_image_match(spark, sf_dir):
    s = table(spark, sf_dir, "v_scenes").groupBy("slide_id", "scene_index").agg(F.max("x").cast("int").alias("w"), F.max("y").cast("int").alias("h"))
    i = table(spark, sf_dir, "v_scenes").groupBy("slide_id", (F.col("x") % 7).alias("image_index")).agg(F.max("x").cast("int").alias("iw"), F.max("y").cast("int").alias("ih"))
    return A.match_scenes(s, i)
