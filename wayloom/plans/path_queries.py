"""Queries of routes with path-dependent costs, each over the tables as a whole, with SQL that lists all paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import path_costs
from wayloom.operators.shared import cut
from wayloom.plans import rules
from wayloom.plans.derived import cte, derived
from wayloom.plans.registry import query

#: A profile of our own with hills, turns and changes of road class.
HILLS = """
---context:way
assign costfactor switch highway=primary 1.125 switch highway=secondary 1.25 switch highway=tertiary 1.5 2
assign uphillcostfactor switch highway=residential 3 0
assign uphillcost switch highway=primary 40 80
assign downhillcost 60
assign uphillmaxslope 5
assign uphillmaxslopecost 160
assign uphillcutoff 1.5
assign downhillcutoff 1.5
assign turncost switch highway=primary 20 90
assign initialclassifier switch highway=primary 1 switch highway=secondary 2 3
assign initialcost switch highway=primary 150 40
"""
OUTPUTS = ["costfactor", "uphillcostfactor", "uphillcost", "downhillcost", "uphillmaxslope", "uphillmaxslopecost", "uphillcutoff", "downhillcutoff", "turncost", "initialclassifier", "initialcost"]

#: Blocks of 4 x 5 streets, one way to the right and up, with a bend in each link. Heights: of every node, of some bends.
_LINKS = """n AS (SELECT id, id // 20 AS blk, id % 5 * 100 AS x, (id % 20) // 5 * 100 AS y, CAST(id * 37 % 53 AS DOUBLE) AS h FROM streets),
  w AS (SELECT blk FROM n GROUP BY blk HAVING count(*) = 20),
  l AS (SELECT p.blk, p.id AS a, q.id AS b, p.x AS ax, p.y AS ay, p.h AS ah, q.x AS bx, q.y AS "by", q.h AS bh,
      CAST((p.x + q.x) / 2 AS BIGINT) + (p.id * 7 + q.id) % 3 * 15 AS mx, CAST((p.y + q.y) / 2 AS BIGINT) - (p.id + q.id * 5) % 3 * 15 AS my, CASE WHEN (p.id + q.id) % 4 <> 0 THEN (p.h + q.h) / 2 + p.id % 7 END AS mh,
      (p.id * 13 + q.id * 7) % 4 AS kind, CASE WHEN q.id % 11 = 0 THEN 25 ELSE 0 END AS nodecost
    FROM n p JOIN w USING (blk) JOIN n q ON q.blk = p.blk AND (q.id = p.id + 5 OR (q.id = p.id + 1 AND p.id % 5 < 4)))"""


def _links(spark, sf_dir, outputs=OUTPUTS):
    streets = derived(spark, sf_dir, "streets").select("id")
    text = _LINKS.replace('"by"', "by").replace("FROM streets", "FROM {streets}").replace("id // 20", "id div 20").replace("(id % 20) // 5", "((id % 20) div 5)")
    # the same pairs by an equi join on the other end: a block's nodes need not all meet each other
    text = text.replace("FROM n p", "FROM (SELECT *, explode(array_compact(array(id + 5, CASE WHEN id % 5 < 4 THEN id + 1 END))) AS there FROM n) p")
    text = text.replace("JOIN n q ON q.blk = p.blk AND (q.id = p.id + 5 OR (q.id = p.id + 1 AND p.id % 5 < 4))", "JOIN n q ON q.id = p.there AND q.blk = p.blk")
    links = cut(spark.sql(f"WITH {text} SELECT * FROM l", streets=streets))
    highway = F.element_at(F.array(*map(F.lit, ("primary", "secondary", "tertiary", "residential"))), (F.col("kind") + 1).cast("int"))
    point = lambda p: F.struct(F.col(f"{p}x").cast("double").alias("x"), F.col(f"{p}y").cast("double").alias("y"), F.col(f"{p}h").alias("h"))
    links = links.withColumn("tags", F.create_map(F.lit("highway"), highway)).withColumn("shape", F.array(point("a"), point("m"), point("b")))
    return rules.evaluate(links, HILLS, outputs).select("a", "b", "shape", "nodecost", *outputs, F.col("blk").alias("cx"), F.lit(0).alias("cy"), "blk")


def _sql(banned: str) -> str:
    by_kind = lambda *v: "CASE kind " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(v)) + " END"
    sections = """e AS (SELECT *, {cf} AS cf, {up} AS upf, {rate} AS rate, {turn} AS turn, {cls} AS cls, {first} AS first FROM l),
  s AS (SELECT blk, a, b, 1 AS k, mx - ax AS dx, my - ay AS dy, ah AS h0, mh AS h, cf, upf, rate, turn, cls, first, 0 AS nodecost FROM e
    UNION ALL SELECT blk, a, b, 2, bx - mx, "by" - my, ah, bh, cf, upf, rate, turn, cls, first, nodecost FROM e)""".format(
        cf=by_kind(1.125, 1.25, 1.5, 2.0), up=by_kind(1.125, 1.25, 1.5, 3.0), rate=by_kind(25000.0, 12500.0, 12500.0, 12500.0), turn=by_kind(20, 90, 90, 90), cls=by_kind(1, 2, 3, 3), first=by_kind(150, 40, 40, 40)
    )
    return f"""WITH RECURSIVE {cte('streets')}, {_LINKS}, {sections},
  p AS (
  SELECT blk, blk * 20 AS b, CAST(NULL AS BIGINT) AS a, 2 AS k, CAST(NULL AS DOUBLE) AS px, CAST(NULL AS DOUBLE) AS py, CAST(NULL AS DOUBLE) AS h, 0.0::DOUBLE AS down, 0.0::DOUBLE AS up, 0 AS cls, 0.0::DOUBLE AS cost FROM w
  UNION ALL
  SELECT blk, b, a, k, dx, dy, h2, CASE WHEN d > 5e6 THEN least(d, 10e6) ELSE greatest(d, 0) END, CASE WHEN u > 5e6 THEN least(u, 10e6) ELSE greatest(u, 0) END, cls,
    cost + nodecost + CASE WHEN k = 1 AND was > 0 AND was <> cls THEN first ELSE 0 END
      + trunc(trunc(coalesce(1 - (px * dx + py * dy) / (sqrt(px * px + py * py) * sqrt(dx * dx + dy * dy)), 0) * turn + 0.2) + greatest(d - 10e6, 0) / 16666
        + least(greatest(u - 10e6, 0), m * 50000) / rate + (greatest(u - 10e6, 0) - least(greatest(u - 10e6, 0), m * 50000)) / 6250
        + m * (CASE WHEN u > 5e6 THEN upf ELSE 0 END + cf * (1 - (u > 5e6)::INT - (d > 5e6)::INT) + CASE WHEN d > 5e6 THEN cf ELSE 0 END) + 0.5)
  FROM (SELECT *, trunc(down - climb - m * 15000) AS d, trunc(up + climb - m * 15000) AS u FROM (
    SELECT s.blk, s.a, s.b, s.k, CAST(s.dx AS DOUBLE) AS dx, CAST(s.dy AS DOUBLE) AS dy, s.cf, s.upf, s.rate, s.turn, s.cls, s.first, s.nodecost, p.px, p.py, p.cls AS was, p.down, p.up, p.cost,
      floor(sqrt(CAST(s.dx * s.dx + s.dy * s.dy AS DOUBLE))) AS m, coalesce(s.h, p.h, s.h0) AS h2, trunc(1e6 * (coalesce(s.h, p.h, s.h0) - coalesce(p.h, s.h0))) AS climb
    FROM p JOIN s ON s.blk = p.blk AND ((p.k = 1 AND s.k = 2 AND s.a = p.a AND s.b = p.b) OR (p.k = 2 AND s.k = 1 AND s.a = p.b{banned})))))
  SELECT blk AS rid, CAST(min(cost) AS BIGINT) AS cost FROM p WHERE k = 2 AND b = blk * 20 + 19 GROUP BY blk"""


def _found(spark, sf_dir, restrictions=None):
    links = _links(spark, sf_dir)
    blocks = links.groupBy(F.col("blk").alias("rid")).agg(F.min("a").alias("start"), F.max("b").alias("goal"))
    asked = blocks.select("rid", "start", "goal", F.col("rid").alias("x1"), F.col("rid").alias("x2"), F.lit(0).alias("y1"), F.lit(0).alias("y2"))
    found = path_costs.path_routes(asked, links, 0, restrictions, least=1.0)
    return found.groupBy("rid").agg(F.max("cost").alias("cost"))


@query("route_path_costs", _sql(""))
def route_path_costs(spark, sf_dir):
    """Through each block from its first node to its last: turns, hills with buffers, classes, node costs."""
    return _found(spark, sf_dir)


@query("route_path_restricted", _sql(" AND NOT (p.a IS NOT NULL AND p.a = p.b - 1 AND s.b = p.b + 5 AND p.b % 3 <> 0)"))
def route_path_restricted(spark, sf_dir):
    """The same without turns from the right-hand way up, but at every third node."""
    node = F.col("id")
    turns = derived(spark, sf_dir, "streets").where(node % 3 != 0).select((node - 1).alias("from_n"), node.alias("via"), (node + 5).alias("to_n"))
    return _found(spark, sf_dir, turns)
