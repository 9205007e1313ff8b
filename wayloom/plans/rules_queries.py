"""Registered queries over road tags and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import tags as T
from wayloom.plans import rules
from wayloom.plans.derived import cte, derived
from wayloom.plans.registry import query

_ROAD = """r AS (SELECT *, CASE WHEN subclass = 'construction' OR class LIKE '%_construction' THEN NULL WHEN class IN ('motorway', 'primary') AND ramp THEN class || '_link' WHEN class IN ('motorway', 'primary', 'service') THEN class
  WHEN class = 'minor' THEN 'residential' WHEN class = 'path' THEN coalesce(subclass, 'path') END AS highway FROM ways)"""


def tagged(spark, sf_dir):
    """ways(wid, tags): roads only."""
    w = derived(spark, sf_dir, "ways")
    made = T.road_tags(F.col("class"), F.col("subclass"), F.col("ramp"), F.col("subclass"), F.col("oneway"), F.col("brunnel"), {"surface": F.col("surface")})
    return w.select("wid", made.alias("tags")).where("tags is not null")


@query("tags_synthesis", f"WITH {cte('ways')}, {_ROAD} SELECT wid, highway, CASE WHEN class = 'service' THEN subclass END AS service, CASE oneway WHEN 1 THEN 'yes' WHEN -1 THEN '-1' END AS oneway, CASE WHEN brunnel = 'bridge' THEN 'yes' END AS bridge, CASE WHEN brunnel = 'tunnel' THEN 'yes' END AS tunnel, CASE WHEN trim(surface) <> '' THEN surface END AS surface FROM r WHERE highway IS NOT NULL")
def synthesis(spark, sf_dir):
    keys = ("highway", "service", "oneway", "bridge", "tunnel", "surface")
    return tagged(spark, sf_dir).select("wid", *(F.col("tags")[k].alias(k) for k in keys))


@query("tags_known_class", f"WITH {cte('ways')} SELECT class, count(*) AS n, bool_and(class NOT LIKE 'x%') AS known FROM ways GROUP BY class")
def known(spark, sf_dir):
    return derived(spark, sf_dir, "ways").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.bool_and(T.known_class(F.col("class"))).alias("known"))


@query("tags_histogram", f"WITH {cte('ways')}, {_ROAD}, k AS (SELECT 'highway' AS key, highway AS value FROM r WHERE highway IS NOT NULL UNION ALL SELECT 'oneway', CASE oneway WHEN 1 THEN 'yes' ELSE '-1' END FROM r WHERE highway IS NOT NULL AND oneway <> 0) SELECT key, value, count(*) AS n FROM k GROUP BY ALL")
def histogram(spark, sf_dir):
    return tagged(spark, sf_dir).select(F.explode("tags").alias("key", "value")).where("key in ('highway', 'oneway')").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


@query("tags_units", "SELECT p_partkey AS id, CASE WHEN v IS NULL THEN 0 ELSE CAST(floor(floor(v * 10 + 0.5) / 10 * 100 + 1e-9) AS INT) + 1000 END AS stored FROM (SELECT p_partkey, CASE CAST(p_partkey % 7 AS INT) WHEN 0 THEN p_size * 0.3048 + 6 * 0.0254 WHEN 1 THEN p_size * 1.609344 WHEN 2 THEN p_size / 100 WHEN 3 THEN p_size * 1.852 WHEN 4 THEN p_size + 0.5 WHEN 5 THEN p_size END AS v FROM part)")
def units(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.col("p_partkey") % 7
    text = F.when(key == 0, F.concat(size, F.lit(" ft 6in"))).when(key == 1, F.concat(size, F.lit("MPH"))).when(key == 2, F.concat(size, F.lit(" cm"))).when(key == 3, F.concat(size, F.lit("knots")))
    text = text.when(key == 4, F.concat(size, F.lit(",5"))).when(key == 5, F.concat(size, F.lit("-99 m"))).otherwise("none")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), T.stored_number(T.metric(text)).alias("stored"))


_COST = """CASE WHEN highway IN ('path', 'footway', 'cycleway', 'steps', 'pedestrian', 'track') OR oneway = {bad} THEN 10000 ELSE
  CASE WHEN highway = 'motorway' THEN 1.0 WHEN highway = 'primary' THEN 1.15 WHEN highway = 'residential' THEN 2.0 WHEN highway = 'service' THEN 3.0 WHEN highway LIKE '%_link' THEN 1.3 ELSE 10.0 END + CASE WHEN surface = 'gravel' THEN {extra} ELSE 0.0 END END"""


def _milli(c):
    return F.floor(c.cast("double") * 1000 + 0.5).cast("long")


@query("rules_costfactor", f"WITH {cte('ways')}, {_ROAD} SELECT wid, CAST(floor(({_COST.format(bad=-1, extra=1.5)}) * 1000 + 0.5) AS BIGINT) AS cost, CAST(floor(({_COST.format(bad=1, extra=1.5)}) * 1000 + 0.5) AS BIGINT) AS cost_back FROM r WHERE highway IS NOT NULL")
def costfactor(spark, sf_dir):
    return rules.evaluate(tagged(spark, sf_dir), rules.CAR, ["costfactor"]).select("wid", _milli(F.col("costfactor")).alias("cost"), _milli(F.col("costfactor_back")).alias("cost_back"))


@query("rules_overrides", f"WITH {cte('ways')}, {_ROAD} SELECT wid, CAST(floor(({_COST.format(bad=-1, extra=0.0)}) * 1000 + 0.5) AS BIGINT) AS cost FROM r WHERE highway IS NOT NULL")
def overrides(spark, sf_dir):
    return rules.evaluate(tagged(spark, sf_dir), rules.CAR, ["costfactor"], {"avoid_unpaved": 0.0}).select("wid", _milli(F.col("costfactor")).alias("cost"))


@query("rules_routable", f"WITH {cte('ways')}, {_ROAD} SELECT wid FROM r WHERE highway IS NOT NULL AND least({_COST.format(bad=-1, extra=1.5)}, {_COST.format(bad=1, extra=1.5)}) < 10000")
def routable(spark, sf_dir):
    return rules.evaluate(tagged(spark, sf_dir), rules.CAR, ["costfactor"]).where("least(costfactor, costfactor_back) < 10000").select("wid")


@query("rules_access_type", f"WITH {cte('ways')}, {_ROAD} SELECT wid, CASE WHEN least({_COST.format(bad=-1, extra=1.5)}, {_COST.format(bad=1, extra=1.5)}) < 9999 THEN 2 ELSE 1 END AS access FROM r WHERE highway IS NOT NULL")
def access_type(spark, sf_dir):
    costs = rules.evaluate(tagged(spark, sf_dir), rules.CAR, ["costfactor"])
    return costs.select("wid", F.when(F.least("costfactor", "costfactor_back") < 9999, 2).otherwise(1).alias("access"))


@query("rules_node_context", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 1000000 WHEN p_partkey % 5 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 900 END ELSE 0 END AS cost FROM part")
def node_context(spark, sf_dir):
    key = F.col("p_partkey")
    way = F.create_map(F.lit("highway"), F.when(key % 2 == 0, "motorway").otherwise("primary"))
    node = F.map_filter(F.create_map(F.lit("barrier"), F.when(key % 5 == 0, "gate"), F.lit("highway"), F.when(key % 5 == 1, "traffic_signals")), lambda k, v: v.isNotNull())
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(key.alias("id"), way.alias("way"), node.alias("node"))
    foreign = rules.compile_rules(rules.CAR, "way", F.col("way"))
    cost = rules.compile_rules(rules.CAR, "node", F.col("node"), foreign=foreign)["initialcost"]
    return part.select("id", cost.cast("int").alias("cost"))


@query("tags_restriction_exceptions", "SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END AS INT) AS bits FROM orders")
def exceptions(spark, sf_dir):
    key = F.col("o_orderkey")
    text = F.concat_ws(";", F.when(key % 3 == 0, "bicycle"), F.when(key % 2 == 0, "motorcar"), F.lit("psv"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("id"), T.restriction_exceptions(text).alias("bits"))
