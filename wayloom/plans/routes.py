"""Registered queries that match, route, sum up and announce."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import graph, hints, routing
from wayloom.plans.derived import cte, derived
from wayloom.plans.registry import query

_SEG = "s AS (SELECT p_partkey AS sid, p_partkey * 7919 % 20011 AS ax, p_partkey * p_partkey * 31 % 20021 AS ay, p_partkey * 7919 % 20011 + p_partkey % 400 - 200 AS bx, p_partkey * p_partkey * 31 % 20021 + p_partkey * 3 % 300 - 150 AS b_y FROM part)"
_PNT = "p AS (SELECT c_custkey AS id, c_custkey * 6151 % 20011 AS x, c_custkey * c_custkey * 17 % 20021 AS y, c_custkey * 13 % 360 AS heading FROM customer)"
_MATCH = """t AS (SELECT id, sid, x, y, heading, ax, ay, bx, b_y, CASE WHEN bx <> ax OR b_y <> ay THEN least(greatest(CAST((x - ax) * (bx - ax) + (y - ay) * (b_y - ay) AS DOUBLE) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)), 0), 1) ELSE 0.0 END AS t FROM p, s),
  d AS (SELECT id, sid, CAST(floor(sqrt(pow(ax + (bx - ax) * t - x, 2) + pow(ay + (b_y - ay) * t - y, 2)) + 0.5) AS BIGINT) AS metres, heading, CASE WHEN degrees(atan2(bx - ax, b_y - ay)) < 0 THEN degrees(atan2(bx - ax, b_y - ay)) + 360 ELSE degrees(atan2(bx - ax, b_y - ay)) END AS dir FROM t),
  f AS (SELECT id, sid, metres, CAST(floor(CASE WHEN abs(dir - heading) > 180 THEN 360 - abs(dir - heading) ELSE abs(dir - heading) END + 0.5) AS BIGINT) AS off FROM d)"""


def _plane(spark, sf_dir):
    k, c = F.col("p_partkey"), F.col("c_custkey")
    ax, ay = k * 7919 % 20011, k * k * 31 % 20021
    s = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("sid"), ax.alias("ax"), ay.alias("ay"), (ax + k % 400 - 200).alias("bx"), (ay + k * 3 % 300 - 150).alias("by"))
    p = spark.read.parquet(f"{sf_dir}/customer.parquet").select(c.alias("id"), (c * 6151 % 20011).alias("x"), (c * c * 17 % 20021).alias("y"), (c * 13 % 360).alias("heading"))
    return p, s


@query("match_waypoints", f"WITH {_SEG}, {_PNT}, {_MATCH}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY metres, off, sid) AS INT) AS nth FROM f WHERE metres <= 250) SELECT id, sid, metres, off, nth FROM n WHERE nth <= 5")
def match_waypoints(spark, sf_dir):
    return routing.matches(*_plane(spark, sf_dir), 250)


@query("match_growing_rings", f"WITH {_SEG}, {_PNT}, {_MATCH}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, off, sid) AS nth FROM f WHERE metres <= 1000) SELECT id, sid, metres, CAST(CASE WHEN metres <= 250 THEN 250 ELSE 1000 END AS INT) AS reach FROM n WHERE nth = 1")
def match_rings(spark, sf_dir):
    return routing.match_in_rings(*_plane(spark, sf_dir), [250, 1000])


@query("poi_bbox", f"WITH {cte('places')} SELECT id FROM places WHERE ilon BETWEEN 100000000 AND 200000000 AND ilat BETWEEN 50000000 AND 120000000 AND kind = 'ECONOMY' AND zoom < 8 ORDER BY id LIMIT 100")
def poi_bbox(spark, sf_dir):
    box = derived(spark, sf_dir, "places").where("ilon between 100000000 and 200000000 and ilat between 50000000 and 120000000")
    return box.where("kind = 'ECONOMY' and zoom < 8").select("id").orderBy("id").limit(100)  # the limit is the query's own


@query("poi_rules", f"WITH {cte('places')} SELECT id, 'rare' AS rule FROM places WHERE kind = 'ECONOMY' AND rank = 3 UNION ALL SELECT id, 'any' FROM places WHERE kind = 'SMALL'")
def poi_rules(spark, sf_dir):
    tags = derived(spark, sf_dir, "places").select("id", F.create_map(F.lit("kind"), F.col("kind"), F.lit("rank"), F.col("rank").cast("string")).alias("tags"))
    rules = spark.createDataFrame([("rare", "kind", "ECONOMY", {"rank": "3"}), ("any", "kind", "SMALL", {})], "rule string, key string, value string, extra map<string,string>")
    each = tags.select("id", "tags", F.explode("tags").alias("key", "value"))
    return each.join(F.broadcast(rules), ["key", "value"]).where(F.forall(F.map_entries("extra"), lambda e: F.col("tags")[e["key"]] == e["value"])).select("id", "rule")  # rules: a few rows of a file


def _grid(spark, sf_dir):
    """Edges of a street grid 40 nodes wide and as long as there are orders (the last row may be short), both ways, 100 each; cells of 8 x 8 nodes."""
    n = derived(spark, sf_dir, "streets")
    there = n.select(F.col("id").alias("b"))
    right = n.where("gx < 39").selectExpr("id as a", "id + 1 as b", "gx as ax", "gy as ay", "gx + 1 as bx", "gy as by")
    up = n.selectExpr("id as a", "id + 40 as b", "gx as ax", "gy as ay", "gx as bx", "gy + 1 as by")
    one = right.union(up).join(there, "b", "left_semi").select("a", "b", "ax", "ay", "bx", "by")
    both = one.union(one.selectExpr("b", "a", "bx", "by", "ax", "ay"))
    return both.select("a", "b", F.lit(100.0).alias("cost"), "ax", "ay", "bx", "by", F.floor(F.col("ax") / 8).alias("cx"), F.floor(F.col("ay") / 8).alias("cy"))


def _requests(spark, sf_dir):
    """A trip for each supplier, from anywhere in the grid to a place up to 700 nodes (18 rows) on, or back near the grid's end."""
    k, n = F.col("s_suppkey"), F.col("n")
    nodes = derived(spark, sf_dir, "streets").agg(F.count(F.lit(1)).alias("n"))
    asked = spark.read.parquet(f"{sf_dir}/supplier.parquet").crossJoin(F.broadcast(nodes))  # one row
    r = asked.select(k.alias("rid"), (k * 379 % n).alias("start"), (k * 613 % 700).alias("far"), "n")
    r = r.select("rid", "start", F.when(F.col("start") + F.col("far") < n, F.col("start") + F.col("far")).otherwise(F.col("start") - F.col("far")).alias("goal"))
    cell = lambda n: (F.floor(F.col(n) % 40 / 8), F.floor(F.floor(F.col(n) / 40) / 8))
    return r.select("rid", "start", "goal", cell("start")[0].alias("x1"), cell("goal")[0].alias("x2"), cell("start")[1].alias("y1"), cell("goal")[1].alias("y2"))


_ASK = """z AS (SELECT count(*) AS n FROM orders), q AS (SELECT s_suppkey AS rid, s_suppkey * 379 % n AS a, s_suppkey * 613 % 700 AS far, n FROM supplier, z),
  g AS (SELECT rid, a, CASE WHEN a + far < n THEN a + far ELSE a - far END AS b FROM q), m AS (SELECT rid, a, b, abs(a % 40 - b % 40) AS dx, abs(a // 40 - b // 40) AS dy FROM g)"""


@query("route_shortest", f"WITH {_ASK} SELECT rid, CAST((dx + dy) * 100 + CASE WHEN dx > 0 AND dy > 0 THEN 30 ELSE 0 END AS BIGINT) AS cost, dx + dy AS steps FROM m")
def route_shortest(spark, sf_dir):
    found = routing.routes(_requests(spark, sf_dir), _grid(spark, sf_dir), 1, turn_cost=30.0, coefficient=100.0)
    return found.groupBy("rid").agg(F.max("cost").cast("long").alias("cost"), (F.max("seq").cast("long")).alias("steps"))


@query("route_alternatives")
def route_alternatives(spark, sf_dir):
    return routing.routes(_requests(spark, sf_dir), _grid(spark, sf_dir), 1, alternatives=2, coefficient=100.0).groupBy("rid", "alternative").agg(F.max("cost").alias("cost"), F.count(F.lit(1)).alias("nodes"))


@query("route_restricted", f"WITH {_ASK} SELECT rid, CAST((dx + dy) * 100 AS BIGINT) AS cost FROM m")
def route_restricted(spark, sf_dir):
    """No turn from the right-hand way up at every 97th node: there is always another path as short."""
    turns = derived(spark, sf_dir, "streets").where("gx between 1 and 38 and gy >= 1 and id % 97 = 0").selectExpr("id - 1 as from_n", "id as via", "id + 40 as to_n")
    found = routing.routes(_requests(spark, sf_dir), _grid(spark, sf_dir), 1, restrictions=turns, coefficient=100.0)
    return found.groupBy("rid").agg(F.max("cost").cast("long").alias("cost"))


@query("route_detours", f"""WITH {cte('way_nodes')}, e AS (SELECT wid, nid AS a, lead(nid) OVER (PARTITION BY wid ORDER BY pos, nid) AS b FROM way_nodes), r AS (SELECT DISTINCT wid, a, b FROM e WHERE b IS NOT NULL), n AS (SELECT wid, a AS x FROM r UNION SELECT wid, b FROM r), l AS (SELECT DISTINCT a, b FROM r),
  d AS (SELECT n.wid, l.a, l.b FROM n JOIN l ON n.x = l.a ANTI JOIN r ON r.wid = n.wid AND r.a = l.a AND r.b = l.b) SELECT wid, count(*) AS detours, min(b) AS first_b, max(b) AS last_b FROM d GROUP BY wid""")
def route_detours(spark, sf_dir):
    """Of every way, taken as a route: the links that leave it at one of its nodes, summed up."""
    from pyspark.sql import Window

    e = derived(spark, sf_dir, "way_nodes").select("wid", F.col("nid").alias("a"), F.lead("nid").over(Window.partitionBy("wid").orderBy("pos", "nid")).alias("b")).where("b is not null")
    r = e.distinct()
    return routing.links_away(r)


@query("track_totals", "SELECT l_orderkey AS track, CAST(sum(floor(l_quantity)) AS BIGINT) AS metres, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS cost, count(*) AS links FROM lineitem GROUP BY 1")
def track_totals(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy(F.col("l_orderkey").alias("track")).agg(F.sum(F.floor("l_quantity")).cast("long").alias("metres"), F.sum(F.floor("l_extendedprice")).cast("long").alias("cost"), F.count(F.lit(1)).alias("links"))


@query("track_ascend")
def track_ascend(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("track")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.floor("l_quantity").alias("h")))).alias("p"))
    heights = F.transform("p", lambda x: x["h"])
    plain = F.floor((F.element_at(heights, 1) - F.element_at(heights, -1)) * -0.25 + 0.5).cast("long")
    return li.select("track", routing.ascend(heights).alias("ascend"), plain.alias("plain"))


@query("track_reduced_mean", "WITH c AS (SELECT l_suppkey AS k, l_quantity AS v, l_discount + 0.01 AS w FROM lineitem), s AS (SELECT k, v, sum(w) AS w FROM c GROUP BY k, v), u AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v) AS upto, sum(w) OVER (PARTITION BY k) AS total FROM s), p AS (SELECT k, v, greatest(0, least(upto, total * 0.75) - greatest(upto - w, total * 0.25)) AS p FROM u) SELECT k, CAST(floor(sum(v * p) / sum(p) * 1000 + 0.5) AS BIGINT) AS mean FROM p GROUP BY k")
def reduced_mean(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"), (F.col("l_discount") + 0.01).alias("w")).groupBy("k", "v").agg(F.sum("w").alias("w"))
    return routing.reduced_mean(li, "k", "v", "w", 0.5).select("k", F.floor(F.col("mean") * 1000 + 0.5).cast("long").alias("mean"))


_HEIGHT = "h AS (SELECT l_orderkey AS track, l_linenumber AS seq, l_linenumber * 100.0 AS metres, CASE WHEN l_linenumber % 3 <> 2 THEN l_quantity END AS height FROM lineitem)"


@query("track_elevation_fill", f"""WITH {_HEIGHT}, u AS (SELECT track, seq, min(metres) AS metres, min(height) AS height FROM h GROUP BY ALL), k AS (SELECT *, last_value(CASE WHEN height IS NOT NULL THEN metres END IGNORE NULLS) OVER b AS am, last_value(height IGNORE NULLS) OVER b AS ah, first_value(CASE WHEN height IS NOT NULL THEN metres END IGNORE NULLS) OVER f AS bm, first_value(height IGNORE NULLS) OVER f AS bh
  FROM u WINDOW b AS (PARTITION BY track ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY track ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT track, seq, CAST(floor(coalesce(height, ah + (bh - ah) * CASE WHEN bm > am THEN (metres - am) / (bm - am) ELSE 0 END) * 1000 + 0.5) AS BIGINT) AS height FROM k""")
def elevation_fill(spark, sf_dir):
    n = F.col("l_linenumber")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("track"), n.alias("seq")).agg(F.min("l_quantity").alias("q"))
    pts = li.select("track", "seq", (F.col("seq") * 100.0).alias("metres"), F.when(F.col("seq") % 3 != 2, F.col("q")).alias("height"))
    return routing.filled_elevation(pts).select("track", "seq", F.floor(F.col("height") * 1000 + 0.5).cast("long").alias("height"))


@query("hint_commands", """SELECT o_orderkey AS id, CASE WHEN a < -159 THEN 'TLU' WHEN a < -135 THEN 'TSHL' WHEN a < -110 THEN 'TSHL' WHEN a < -60 THEN 'TL' WHEN a < -45 THEN CASE WHEN a > -60 THEN 'TSLL' ELSE 'TL' END WHEN a < -21 THEN 'TSLL' WHEN a < -5 THEN 'C' WHEN a < 5 THEN 'C' WHEN a < 21 THEN 'C' WHEN a < 45 THEN 'TSLR' WHEN a < 60 THEN 'TSLR' WHEN a <= 110 THEN 'TR' WHEN a < 135 THEN 'TSHR' WHEN a < 159 THEN 'TSHR' ELSE 'TRU' END AS command FROM (SELECT o_orderkey, o_orderkey % 357 - 178 AS a FROM orders)""")
def hint_commands(spark, sf_dir):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("id"), hints.turn_command(k % 357 - 178, F.lit(-180.5), F.lit(180.5)).alias("command"))


@query("hint_shown", "SELECT o_orderkey AS id, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'TURN_SLIGHT_LEFT' WHEN 1 THEN 'U_TURN' WHEN 2 THEN 'ARRIVE' END AS shown FROM orders")
def hint_shown(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    command = F.when(k == 0, "TSLL").when(k == 1, "TU").when(k == 2, "END").otherwise("BL")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), routing.shown_command(command).alias("shown"))


@query("energy_speed")
def energy_speed(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 9 * 0.01).alias("i"))
    s = s.withColumn("v", routing.speed_of_power(F.lit(100.0), F.lit(90.0), F.col("i")))
    watts = 0.225 * F.col("v") * F.col("v") * F.col("v") + 90 * 9.81 * (0.01 + F.col("i")) * F.col("v")
    return s.select("id", F.round("v", 6).alias("speed"), (F.abs(watts - 100) < 0.5).alias("balanced"))


@query("route_islands", "SELECT o_orderkey // 200 * 200 AS component, count(*) AS nodes FROM orders GROUP BY 1")
def route_islands(spark, sf_dir):
    """The grid without the links between every fifth row and the next."""
    found = graph.components(_grid(spark, sf_dir).where("floor(ay / 5) = floor(by / 5)").select("a", "b"))
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
