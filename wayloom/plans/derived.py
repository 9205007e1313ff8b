"""Map-like tables derived from the driver's tables by integer arithmetic, in Spark and in SQL alike.

Each is a SQL text that both engines run; Spark reads it through views named by the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (tables it reads, SQL)
DERIVED = {
    "places": (["part"], "SELECT p_partkey AS id, (p_partkey * 7919003 + 11) % 360000000 AS ilon, (p_partkey * 104729 + 7) % 160000000 + 10000000 AS ilat, p_name AS name, p_type AS kind, CAST(p_size % 20 + 1 AS INT) AS rank, CAST(p_partkey % 10 AS INT) AS zoom FROM part"),
    "points": (["customer"], "SELECT c_custkey AS id, (c_custkey * 6700417 + 31) % 360000000 AS ilon, (c_custkey * 92821 + 17) % 160000000 + 10000000 AS ilat, CAST(c_nationkey AS BIGINT) AS k FROM customer"),
    "anchors": (["supplier"], "SELECT s_suppkey AS id, (s_suppkey * 5915587 + 101) % 360000000 AS ilon, (s_suppkey * 99991 + 3) % 160000000 + 10000000 AS ilat FROM supplier"),
    "nodes": (["part"], "SELECT p_partkey AS id, p_partkey % 40 AS gx, CAST(floor(p_partkey / 40) AS BIGINT) AS gy, (p_partkey % 40) * 1000 + 320000000 AS ilon, CAST(floor(p_partkey / 40) AS BIGINT) * 1000 + 50000000 AS ilat, CAST(p_size AS BIGINT) AS size FROM part"),
    "streets": (["orders"], "SELECT o_orderkey AS id, o_orderkey % 40 AS gx, CAST(floor(o_orderkey / 40) AS BIGINT) AS gy FROM orders"),
    "ways": (["part"], "SELECT p_partkey AS wid, CASE WHEN p_partkey % 7 = 0 THEN 'motorway' WHEN p_partkey % 7 = 1 THEN 'primary' WHEN p_partkey % 7 = 2 THEN 'minor' WHEN p_partkey % 7 = 3 THEN 'path' WHEN p_partkey % 7 = 4 THEN 'service' WHEN p_partkey % 7 = 5 THEN 'rail' ELSE 'track_construction' END AS class, CASE WHEN p_partkey % 7 = 3 AND p_partkey % 3 = 0 THEN 'cycleway' WHEN p_partkey % 7 = 3 AND p_partkey % 3 = 1 THEN 'steps' WHEN p_partkey % 7 = 4 THEN 'alley' END AS subclass, CAST(p_partkey % 11 = 0 AS BOOLEAN) AS ramp, CAST(p_partkey % 3 - 1 AS INT) AS oneway, CASE WHEN p_partkey % 5 = 0 THEN 'bridge' WHEN p_partkey % 5 = 1 THEN 'tunnel' END AS brunnel, CASE WHEN p_partkey % 4 = 0 THEN 'gravel' WHEN p_partkey % 4 = 1 THEN ' ' END AS surface FROM part"),
    "way_nodes": (["lineitem"], "SELECT l_orderkey AS wid, CAST(l_linenumber AS BIGINT) AS pos, l_partkey AS nid FROM lineitem"),
    "fixes": (["events"], "SELECT user_id AS session, event_id, epoch_us(ts) // 1000 AS ms, (event_id * 31) % 201 - 100 AS dx, (event_id * 17) % 151 - 75 AS dy, CAST(floor(value) AS BIGINT) % 40 AS v FROM events"),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, sql = DERIVED[name]
    for t in tables:
        sql = sql.replace(f" FROM {t}", f" FROM {{{t}}}")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(sql.replace("epoch_us(ts) // 1000", "unix_micros(from_utc_timestamp(CAST(ts AS TIMESTAMP), current_timezone())) div 1000"), **frames)


def cte(*names: str) -> str:
    """The WITH clause of these tables, for DuckDB."""
    return ", ".join(f"{n} AS ({DERIVED[n][1]})" for n in names)
