"""Registered queries that build and clean a road graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import graph
from wayloom.plans.derived import cte, derived
from wayloom.plans.registry import query

_TILES = "nt AS (SELECT id AS nid, CAST(floor(gx / 8) * 10 + floor(gy / 8) AS BIGINT) AS tile FROM nodes)"


def _tiles(spark, sf_dir):
    return derived(spark, sf_dir, "nodes").select(F.col("id").alias("nid"), (F.floor(F.col("gx") / 8) * 10 + F.floor(F.col("gy") / 8)).cast("long").alias("tile"))


def _way_nodes(spark, sf_dir):
    return derived(spark, sf_dir, "way_nodes")


@query("graph_way_fanout", f"WITH {cte('way_nodes', 'nodes')}, {_TILES} SELECT DISTINCT wid, tile FROM way_nodes JOIN nt USING (nid)")
def fanout(spark, sf_dir):
    return graph.way_tiles(_way_nodes(spark, sf_dir), _tiles(spark, sf_dir))


_UNIQUE = "wn AS (SELECT wid, pos, min(nid) AS nid FROM way_nodes GROUP BY ALL)"


@query("graph_border_nodes", f"WITH {cte('way_nodes', 'nodes')}, {_TILES}, {_UNIQUE}, s AS (SELECT nid, tile, lag(tile) OVER w AS a, lead(tile) OVER w AS b FROM wn JOIN nt USING (nid) WINDOW w AS (PARTITION BY wid ORDER BY pos)) SELECT DISTINCT nid FROM s WHERE a <> tile OR b <> tile")
def border(spark, sf_dir):
    return graph.border_nodes(_way_nodes(spark, sf_dir).groupBy("wid", "pos").agg(F.min("nid").alias("nid")), _tiles(spark, sf_dir))


@query("graph_collapse_repeats", f"WITH {cte('way_nodes')}, wn AS (SELECT wid, pos, min(nid) % 3 AS nid FROM way_nodes GROUP BY wid, pos), s AS (SELECT *, lag(nid) OVER (PARTITION BY wid ORDER BY pos) AS b FROM wn) SELECT wid, pos, nid FROM s WHERE b IS NULL OR b <> nid")
def collapse(spark, sf_dir):
    return graph.collapse_repeats(_way_nodes(spark, sf_dir).groupBy("wid", "pos").agg((F.min("nid") % 3).alias("nid")))


@query("graph_node_retention", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_partkey * 7 FROM lineitem) OR o_orderkey % 50 > 45")
def retention(spark, sf_dir):
    nodes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 50 > 45).alias("described"))
    return graph.retained(nodes, _way_nodes(spark, sf_dir).select("wid", (F.col("nid") * 7).alias("nid"))).select("id")


@query("graph_pseudo_tags", "SELECT p_partkey AS wid, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'primary' END AS highway, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 3 = 0 THEN '5' ELSE CASE WHEN p_partkey % 2 = 0 THEN '1' END END AS noise FROM part")
def pseudo_tags(spark, sf_dir):
    key, part = F.col("p_partkey"), spark.read.parquet(f"{sf_dir}/part.parquet")
    tags = F.map_filter(F.create_map(F.lit("highway"), F.when(key % 4 != 0, "primary"), F.lit("noise"), F.when(key % 2 == 0, "1")), lambda k, v: v.isNotNull())
    extra = part.where(key % 3 == 0).select(key.alias("wid"), F.create_map(F.lit("noise"), F.lit("5")).alias("more"))
    return graph.with_pseudo_tags(part.select(key.alias("wid"), tags.alias("tags")), extra).select("wid", F.col("tags")["highway"].alias("highway"), F.col("tags")["noise"].alias("noise"))


_REL = "rel AS (SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 2 = 0 THEN 'bicycle' ELSE 'hiking' END AS route, 'n' || o_custkey % 3 AS network, o_orderkey % 5 = 0 AS proposed FROM orders)"


def _relations(spark, sf_dir):
    key = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("rid"), F.when(key % 2 == 0, "bicycle").otherwise("hiking").alias("route"), F.concat(F.lit("n"), (F.col("o_custkey") % 3).cast("string")).alias("network"), (key % 5 == 0).alias("proposed"))
    ways = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("rid")).agg(F.collect_list("l_partkey").alias("ways"))
    return o.join(ways, "rid")


@query("graph_relation_tags", f"WITH {_REL} SELECT l_partkey AS wid, 'route_' || route || '_' || network AS key, CAST(min(CASE WHEN proposed THEN 3 ELSE 2 END) AS INT) AS value FROM rel JOIN lineitem ON l_orderkey = rid GROUP BY ALL")
def relation_tags(spark, sf_dir):
    return graph.network_tags(_relations(spark, sf_dir))


@query("graph_relation_stats", f"WITH {_REL} SELECT network, count(DISTINCT rid) AS relations, count(*) AS ways FROM rel JOIN lineitem ON l_orderkey = rid GROUP BY 1")
def relation_stats(spark, sf_dir):
    return _relations(spark, sf_dir).groupBy("network").agg(F.count(F.lit(1)).alias("relations"), F.sum(F.size("ways")).cast("long").alias("ways"))


_ENDS = "ends AS (SELECT p_partkey AS wid, p_partkey % 50 AS f, (p_partkey * 7 + 3) % 50 AS l FROM part)"


@query("graph_restrictions", f"WITH {_ENDS} SELECT l_orderkey * 10 + l_linenumber AS rid, l_partkey AS from_wid, l_suppkey AS to_wid, l_orderkey % 50 AS via, NOT (l_orderkey % 50 IN (a.f, a.l) AND l_orderkey % 50 IN (b.f, b.l)) AS bad FROM lineitem JOIN ends a ON a.wid = l_partkey JOIN ends b ON b.wid = l_suppkey")
def restrictions(spark, sf_dir):
    key = F.col("p_partkey")
    ends = spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("wid"), (key % 50).alias("first"), ((key * 7 + 3) % 50).alias("last"))
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rid"), F.lit("no").alias("kind"), F.col("l_partkey").alias("from_wid"), F.array("l_suppkey").alias("to_wids"), (F.col("l_orderkey") % 50).alias("via"))
    return graph.resolved_restrictions(r, ends).drop("kind")


_TURNS = """t AS (SELECT DISTINCT l_partkey AS via, l_suppkey % 6 AS from_n, l_orderkey % 6 AS to_n FROM lineitem),
  r AS (SELECT c_custkey // 2 AS via, c_custkey // 2 % 6 AS from_n, c_custkey * 5 % 6 AS to_n, c_custkey % 4 = 0 AS o FROM customer WHERE c_custkey % 3 <> 1)"""


@query("graph_turn_restrictions", f"WITH {_TURNS} SELECT t.via, t.from_n, t.to_n, NOT coalesce(bool_or(r.o AND r.to_n = t.to_n), false) AND (coalesce(bool_or(r.o), false) OR coalesce(bool_or(NOT r.o AND r.to_n = t.to_n), false)) AS forbidden FROM t LEFT JOIN r ON t.via = r.via AND t.from_n = r.from_n GROUP BY ALL")
def turn_restrictions(spark, sf_dir):
    k = F.col("c_custkey")
    turns = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("via"), (F.col("l_suppkey") % 6).alias("from_n"), (F.col("l_orderkey") % 6).alias("to_n")).distinct()
    r = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.floor(k / 2).alias("via"), (F.floor(k / 2) % 6).alias("from_n"), (k * 5 % 6).alias("to_n"), (k % 4 == 0).alias("only"), F.when(k % 3 == 1, 2).otherwise(0).alias("exceptions"))
    return graph.forbidden_turns(turns, r, 2)


_PTS = "p AS (SELECT c_custkey AS id, c_custkey % 17 AS part, c_custkey * 7919 % 20011 AS x, c_custkey * c_custkey * 31 % 20021 AS y FROM customer)"


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), (k % 17).alias("part"), (k * 7919 % 20011).alias("x"), (k * k * 31 % 20021).alias("y"))


_NEAR = f"{_PTS}, e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND a.part <> b.part AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 300 * 300)"


@query("graph_endpoint_pairs", f"WITH {_NEAR} SELECT a, b FROM e")
def endpoint_pairs(spark, sf_dir):
    return graph.near_pairs(_points(spark, sf_dir), 300)


@query("graph_components", f"WITH RECURSIVE {_NEAR}, s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), c(node, r) AS (SELECT DISTINCT a, a FROM s UNION SELECT c.node, s.b FROM c JOIN s ON c.r = s.a) SELECT node, min(r) AS component FROM c GROUP BY 1")
def components(spark, sf_dir):
    return graph.near_components(_points(spark, sf_dir), 300)


@query("graph_contraction", """WITH z AS (SELECT max(o_orderkey) + 1 AS n FROM orders), g AS (SELECT o_orderkey AS k, n FROM orders, z), c AS (SELECT k AS a, k + 10 AS b, n FROM g WHERE k % 10 IN (0, 9) AND k + 10 < n)
  SELECT k AS a, k + 9 AS b, CAST(9 * 100 AS BIGINT) AS metres, CAST(8 AS BIGINT) AS inner FROM g WHERE k % 10 = 0 AND k NOT IN (0, n - 10) UNION ALL
  SELECT a, b, CAST(250 AS BIGINT), CAST(0 AS BIGINT) FROM c WHERE a NOT IN (0, 9) AND b NOT IN (n - 10, n - 1) UNION ALL SELECT 10, 19, 900 + 500, 10 UNION ALL SELECT n - 20, n - 11, 900 + 500, 10 FROM z""".replace(" AS inner", ' AS "inner"'))
def contraction(spark, sf_dir):
    """A ladder of all orders: rungs of ten nodes, 100 apart, their ends linked to the next rung's."""
    g = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    rows = g.where("k % 10 <> 9").selectExpr("k as a", "k + 1 as b", "100L as metres")
    sides = g.where("k % 10 in (0, 9)").selectExpr("k as a", "k + 10 as b", "250L as metres").join(g.select(F.col("k").alias("b")), "b", "left_semi").select("a", "b", "metres")
    return graph.contracted(rows.union(sides))


@query("graph_link_merge", "SELECT l_partkey AS src, l_suppkey AS dst, coalesce(min(l_returnflag || l_linestatus) FILTER (l_linenumber % 2 = 0), min(l_returnflag || l_linestatus)) AS tags FROM lineitem GROUP BY ALL")
def link_merge(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return graph.merged_links(li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_linenumber") % 2 != 0).alias("backward"), F.concat("l_returnflag", "l_linestatus").alias("tags")))


_DELTA = "a AS (SELECT p_partkey AS id, p_size AS v FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 7 <> 0)"


def _versions(spark, sf_dir):
    k, part = F.col("p_partkey"), spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.where(k % 5 != 0).select(k.alias("id"), F.col("p_size").alias("v")), part.where(k % 7 != 0).select(k.alias("id"), F.when(k % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("v"))


@query("graph_delta", f"WITH {_DELTA} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.v = b.v THEN 'kept' ELSE 'changed' END AS status, b.v AS v FROM a FULL JOIN b ON a.id = b.id")
def delta(spark, sf_dir):
    return graph.delta(*_versions(spark, sf_dir), "id", "v")


@query("graph_delta_apply", f"WITH {_DELTA} SELECT id, v FROM b")
def delta_apply(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return graph.apply_delta(old, graph.delta(old, new, "id", "v"), "id", "v")


_AWAY = "CASE WHEN {0} % 1000000 < 500000 THEN 1 ELSE -1 END"


@query("graph_unique_positions", f"WITH n AS (SELECT c_custkey AS id, c_custkey % 90 * 700000 + c_custkey % 3 AS x, c_custkey % 40 * 900000 + 5 AS y FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY id) - 1 AS r FROM n), t AS (SELECT *, CAST(floor((sqrt(8.0 * r + 1) - 1) / 2) AS BIGINT) AS u FROM r) SELECT id, CAST(x + (r - u * (u + 1) // 2) * {_AWAY.format('x')} AS BIGINT) AS ilon, CAST(y + u * {_AWAY.format('y')} AS BIGINT) AS ilat FROM t")
def unique_positions(spark, sf_dir):
    k = F.col("c_custkey")
    nodes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), (k % 90 * 700_000 + k % 3).alias("ilon"), (k % 40 * 900_000 + 5).alias("ilat"))
    return graph.unique_positions(nodes)


@query("graph_simplified")
def simplified(spark, sf_dir):
    w = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("p"))
    return graph.simplified(w.select("id", F.transform("p", lambda p: p["l_linenumber"] * 10.0).alias("xs"), F.transform("p", lambda p: p["l_quantity"] / 50).alias("ys")))


@query("graph_segment_cells", "SELECT c_custkey AS id, r AS cy, CAST(3 AS BIGINT) AS cx FROM (SELECT c_custkey, unnest(range(c_custkey % 40, c_custkey % 40 + 6)) AS r FROM customer)")
def segment_cells(spark, sf_dir):
    k = F.col("c_custkey")
    ys = k % 40 * 1000 + 500
    cells = graph.segment_cells(F.lit(3200).cast("long"), ys, F.lit(3700).cast("long"), ys + 5000, 1000)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), F.explode(cells).alias("c")).select("id", "c.cx", "c.cy")
