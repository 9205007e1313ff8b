"""Queries of junction hints over routes made of all orders, whose lines are the ways not taken."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import hints
from wayloom.plans.registry import query

_WAYS = """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CAST(l_partkey * 53 % 357 - 178 AS DOUBLE) AS turn, CAST(18 + l_suppkey % 4 AS INT) AS prio, l_partkey % 7 = 0 AS link, l_partkey % 5 = 0 AS oneway, CAST(l_suppkey % 30 AS DOUBLE) AS factor FROM lineitem WHERE l_linenumber < 3"""
#: Every line is a way not taken.
_ALL_WAYS = _WAYS.removesuffix(" WHERE l_linenumber < 3")

#: The angles of other ways are counted from the side of the turn (near, far), as for a turn to the right.
_JUNCTIONS = f"""WITH b AS ({_WAYS}),
  o AS (SELECT o_custkey AS route, o_orderkey AS seq, CAST(o_orderkey * 37 % 359 - 179 AS DOUBLE) AS a, 18 + o_orderkey % 4 AS own, 18 + o_orderkey % 3 AS old, o_orderkey % 11 = 0 AS link, o_orderkey % 13 = 0 AS old_link, o_orderkey % 5 = 0 AS yields FROM orders),
  w AS (SELECT *, lag(yields) OVER (PARTITION BY route ORDER BY seq) AS before FROM o),
  j AS (SELECT route, seq, any_value(a) AS a, any_value(own) AS prio, any_value(old) AS old, any_value(least(own, old)) AS lesser, any_value(w.link) AS link, any_value(old_link) AS old_link, any_value(w.yields) OR coalesce(any_value(before), FALSE) AS yields, count(b.k) AS ways,
      coalesce(max(b.turn) FILTER (NOT oneway AND b.turn < a), -181) AS lo, coalesce(min(b.turn) FILTER (NOT oneway AND b.turn > a), 181) AS hi,
      coalesce(max(b.prio) FILTER (old_link OR NOT b.link), -1) AS above, coalesce(max(b.prio) FILTER (b.prio >= least(own, old) AND NOT oneway AND abs(b.turn) - abs(a) <= 80), -1) AS rival, coalesce(bool_or(b.link), FALSE) AS links,
      min(b.turn) FILTER (b.prio >= least(own, old) AND NOT oneway AND abs(b.turn) - abs(a) <= 80) AS leftmost, max(b.turn) FILTER (b.prio >= least(own, old) AND NOT oneway AND abs(b.turn) - abs(a) <= 80) AS rightmost,
      list({{'t': abs(b.turn), 'good': factor < 20, 'no': b.prio >= least(own, old) AND (oneway OR abs(b.turn) - abs(a) > 80)}} ORDER BY n, p, s) FILTER (b.k IS NOT NULL) AS each
    FROM w LEFT JOIN b ON b.k = seq GROUP BY route, seq),
  t AS (SELECT *, coalesce(list_reduce(list_prepend(180.0::DOUBLE, list_transform(each, lambda e: e.t + CASE WHEN e.good THEN 1000 ELSE 3000 END + CASE WHEN e.no THEN 5000 ELSE 0 END)),
        lambda m, e: CASE WHEN e % 5000 < 2000 AND e % 1000 < m THEN e % 1000 WHEN e >= 5000 AND m = 180 THEN abs(a) ELSE m END), 180) AS straight, CASE WHEN a < 0 THEN -hi ELSE lo END AS near, CASE WHEN a < 0 THEN -lo ELSE hi END AS far, abs(a) AS s, a < 0 AS l FROM j),
  c AS (SELECT *, (abs(a) > 35 AND ways > 0) OR (above > lesser AND NOT (old_link AND NOT link)) OR rival > prio OR s >= 179 OR (NOT (link AND NOT old_link) AND links AND s > 5) OR (link AND NOT old_link AND NOT links AND s < 5)
        OR (prio = old AND straight <> 180 AND straight < 35) OR (yields AND ways > 0 AND rival <= prio) AS always,
      CASE WHEN s >= 179 AND lo = -181 AND hi = 181 THEN 'TU' WHEN s < 5 OR (l AND s = 5) THEN CASE WHEN lo > -30 THEN 'KR' WHEN hi < 30 THEN 'KL' ELSE 'C' END
        WHEN s > 159 OR (s = 159 AND NOT l) THEN CASE WHEN l THEN 'TLU' ELSE 'TRU' END
        WHEN s < 21 OR (l AND s = 21) THEN CASE WHEN near > -45 THEN CASE WHEN far > 100 THEN CASE WHEN l THEN 'TSLL' ELSE 'TSLR' END WHEN l THEN 'KL' ELSE 'KR' END WHEN near < -55 AND far < 35 THEN CASE WHEN l THEN 'KR' ELSE 'KL' END ELSE 'C' END
        ELSE CASE WHEN s < 45 OR (l AND s = 45) THEN 'TSL' WHEN s > 135 OR (s = 135 AND NOT l) OR (s > 95 AND near > 30 AND far > 180) THEN 'TSH' WHEN s < 85 AND near < 10 AND far < 180 THEN 'TSL' WHEN s > 110 THEN 'TSH' WHEN s < 60 THEN 'TSL' ELSE 'T' END || CASE WHEN l THEN 'L' ELSE 'R' END END AS command FROM t)
SELECT route, seq, always OR rival >= lesser AS hint, NOT always AND command = 'C' AS real, CASE WHEN s > 5 AND leftmost > a AND leftmost < a + 45 - least(a, 0) THEN 'KL' WHEN s > 5 AND rightmost < a AND rightmost > a - 45 - greatest(a, 0) THEN 'KR' ELSE command END AS command FROM c"""


def _nodes(spark, sf_dir, lines: str = _WAYS):
    lines = spark.sql(lines.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    way = F.struct("n", "p", "s", F.struct("turn", "prio", "link", "oneway", "factor", (~F.col("oneway")).alias("car")).alias("way"))
    bad = lines.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(way)), lambda x: x["way"]).alias("bad"))
    k = F.col("o_orderkey")
    nodes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("route"), k.alias("seq"), (k * 37 % 359 - 179).cast("double").alias("angle"), (k % 50 + 1).cast("double").alias("metres"), (18 + k % 4).cast("int").alias("prio"), (18 + k % 3).cast("int").alias("old_prio"),
        (k % 11 == 0).alias("link"), (k % 13 == 0).alias("old_link"), (k % 17 == 0).alias("roundabout"), (k % 5 == 0).alias("give_way"), F.lit(False).alias("beeline"),
    )
    return nodes.join(bad, nodes.seq == bad.k, "left").drop("k")


@query("hint_junctions", _JUNCTIONS)
def hint_junctions(spark, sf_dir):
    return hints.junctions(_nodes(spark, sf_dir)).select("route", "seq", "hint", "real", "command")


@query("hint_routes")
def hint_routes(spark, sf_dir):
    return hints.route_hints(_nodes(spark, sf_dir, _ALL_WAYS)).select("route", "seq", "command", F.round("angle", 6).alias("angle"), "exit", F.round("metres", 6).alias("metres"))
