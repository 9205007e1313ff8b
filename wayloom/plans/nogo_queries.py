"""Queries of areas that edges run through, and of routes that avoid them, over the blocks of streets."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import nogos, path_costs
from wayloom.plans.derived import cte
from wayloom.plans.path_queries import _LINKS, _links
from wayloom.plans.registry import query

#: A box in each block, wide or high by its number; every seventh forbids.
_BOXES = "r AS (SELECT blk AS aid, blk * 1000 + blk % 5 * 60 + 25 AS x0, blk * 1000 + blk % 5 * 60 + 85 + blk % 3 * 40 AS x1, blk % 4 * 50 - 10 AS y0, blk % 4 * 50 + 40 + blk % 7 * 20 AS y1, CASE WHEN blk % 7 <> 0 THEN blk % 3 + 0.5 END AS weight FROM w)"


def _with_costs(spark, sf_dir):
    links = _links(spark, sf_dir)
    shift = F.transform("shape", lambda p: p.withField("x", p["x"] + F.col("blk") * 1000))
    b = F.col("blk")
    blocks = links.select("blk").distinct()
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0 = b * 1000 + b % 5 * 60 + 25, b % 4 * 50 - 10
    x1, y1 = x0 + 60 + b % 3 * 40, y0 + 50 + b % 7 * 20
    areas = blocks.select(b.alias("aid"), F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("points"), F.lit(None).cast("double").alias("radius"), F.lit(True).alias("closed"), F.when(b % 7 != 0, b % 3 + 0.5).cast("double").alias("weight"))
    return nogos.with_area_costs(links.withColumn("shape", shift), areas, 500.0)


@query("nogo_edge_costs", f"""WITH {cte('streets')}, {_LINKS}, {_BOXES},
  s AS (SELECT blk, a, b, blk * 1000 + ax AS px, ay AS py, blk * 1000 + mx AS qx, my AS qy FROM l UNION ALL SELECT blk, a, b, blk * 1000 + mx, my, blk * 1000 + bx, "by" FROM l),
  t AS (SELECT a, b, weight, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) AS len,
      CASE WHEN qx = px THEN CASE WHEN px BETWEEN x0 AND x1 THEN 0 ELSE 2 END ELSE least((x0 - px) / (qx - px), (x1 - px) / (qx - px)) END AS tx, CASE WHEN qx = px THEN CASE WHEN px BETWEEN x0 AND x1 THEN 1 ELSE -1 END ELSE greatest((x0 - px) / (qx - px), (x1 - px) / (qx - px)) END AS ux,
      CASE WHEN qy = py THEN CASE WHEN py BETWEEN y0 AND y1 THEN 0 ELSE 2 END ELSE least((y0 - py) / (qy - py), (y1 - py) / (qy - py)) END AS ty, CASE WHEN qy = py THEN CASE WHEN py BETWEEN y0 AND y1 THEN 1 ELSE -1 END ELSE greatest((y0 - py) / (qy - py), (y1 - py) / (qy - py)) END AS uy
    FROM s JOIN r ON r.aid = s.blk),
  i AS (SELECT a, b, weight, greatest(0, least(ux, uy, 1) - greatest(tx, ty, 0)) * len AS inside FROM t)
  SELECT a, b, CASE WHEN bool_or(weight IS NULL AND inside > 0) THEN -1000 ELSE CAST(floor(coalesce(sum(weight * inside), 0) * 1000 + 0.5) AS BIGINT) END AS cost FROM i GROUP BY a, b""")
def nogo_edge_costs(spark, sf_dir):
    return _with_costs(spark, sf_dir).select("a", "b", F.floor(F.col("areacost") * 1000 + 0.5).cast("long").alias("cost"))


@query("route_around_areas")
def route_around_areas(spark, sf_dir):
    """The routes of route_path_costs with the boxes in their way."""
    links = _with_costs(spark, sf_dir)
    blocks = links.groupBy(F.col("blk").alias("rid")).agg(F.min("a").alias("start"), F.max("b").alias("goal"))
    asked = blocks.select("rid", "start", "goal", F.col("rid").alias("x1"), F.col("rid").alias("x2"), F.lit(0).alias("y1"), F.lit(0).alias("y2"))
    return path_costs.path_routes(asked, links, 0, least=1.0).groupBy("rid").agg(F.max("cost").alias("cost"), F.count(F.lit(1)).alias("nodes"))
