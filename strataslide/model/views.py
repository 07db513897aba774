"""Views that give the star-schema tables the shape of the data model.

Each view is a list of SQL expressions over one table, used as they are by Spark and by the
independent SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SELECT = {
    "v_slides": ("part", ["p_partkey AS slide_id", "CAST(1000 + p_partkey * 37 AS BIGINT) AS width", "CAST(500 + p_size * 211 AS BIGINT) AS height", "CAST(1 + p_size % 5 AS INT) AS level_count", "CAST(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 4 END AS INT) AS step"]),
    "v_requests": ("events", ["event_id AS request_id", "user_id AS slide_id", "CAST(floor(value * 4) AS BIGINT) AS x", "CAST(floor(value * 2) AS BIGINT) AS y", "CAST(64 + event_id % 7 * 32 AS INT) AS w", "CAST(64 + event_id % 5 * 32 AS INT) AS h", "CAST(1 + event_id % 20 AS DOUBLE) AS target_downsample"]),
    "v_channels": ("embeddings", ["CAST(label AS BIGINT) AS slide_id", "vec_id AS channel_index", "CASE WHEN vec_id % 11 = 0 THEN 'DAPI' WHEN vec_id % 7 = 0 THEN 'Histone H3' ELSE concat('CD', CAST(vec_id % 40 AS STRING)) END AS name"]),
    "v_planes": ("embeddings", ["vec_id AS channel_index", "label AS slide_id", "8 AS height", "8 AS width", "embedding AS px"]),
    "v_scenes": ("orders", ["o_custkey % 50 AS slide_id", "CAST(o_orderkey % 4 AS INT) AS scene_index", "CAST(floor(o_totalprice) AS BIGINT) % 4096 AS x", "o_orderkey % 2048 AS y", "CAST(128 AS INT) AS w", "CAST(96 AS INT) AS h"]),
    "v_tile_rows": ("lineitem", ["l_partkey % 150 AS slide_id", "CAST(l_linenumber % 3 AS INT) AS level", "CAST(l_suppkey % 16 AS INT) AS col", "CAST(CAST(l_quantity AS INT) % 16 AS INT) AS row_no", "l_orderkey AS data_offset"]),
}
_TILE_KEYS = ("slide_id", "level", "col", "row_no")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "v_tiles":
        from ..operators.metadata import last_wins

        return last_wins(view(spark, sf_dir, "v_tile_rows"), _TILE_KEYS, "data_offset")
    table, columns = _SELECT[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def view_sql(name: str) -> str:
    if name == "v_tiles":
        return f"SELECT {', '.join(_TILE_KEYS)}, CAST(max(data_offset) AS BIGINT) AS data_offset, CAST(count(*) AS BIGINT) AS n_records FROM ({view_sql('v_tile_rows')}) GROUP BY {', '.join(_TILE_KEYS)}"
    table, columns = _SELECT[name]
    return f"SELECT {', '.join(columns)} FROM {table}"


def with_views(sql: str) -> str:
    """sql, led by the definitions of the views it names."""
    used = [n for n in (*_SELECT, "v_tiles") if n in sql]
    if not used:
        return sql
    head = ", ".join(f"{n} AS ({view_sql(n)})" for n in used)
    text = sql.strip()
    if text[:5].upper() == "WITH ":
        return f"WITH {head}, {text[5:]}"
    return f"WITH {head} {text}"
