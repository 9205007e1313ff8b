"""Queries of routes with momentum, over the tables as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import kinematics
from wayloom.plans.path_queries import _links
from wayloom.plans.registry import query


@query("route_kinematic")
def route_kinematic(spark, sf_dir):
    """Through each block from its first node to its last: cost, seconds and joules of a car. A road's class gives its speed and rank; SQL can't follow the energy, a step-by-step twin tests it."""
    links = _links(spark, sf_dir, ["costfactor", "initialclassifier"])
    of = lambda *v: F.element_at(F.array(*(F.lit(float(x)) for x in v)), F.col("initialclassifier").cast("int"))
    ways = links.select("a", "b", "shape", "cx", "cy", "blk", "nodecost", of(100, 70, 50).alias("maxspeed"), of(24, 20, 12).alias("priority"), (F.col("costfactor") == 2).alias("residential"))
    blocks = ways.groupBy(F.col("blk").alias("rid")).agg(F.min("a").alias("start"), F.max("b").alias("goal"))
    asked = blocks.select("rid", "start", "goal", F.col("rid").alias("x1"), F.col("rid").alias("x2"), F.lit(0).alias("y1"), F.lit(0).alias("y2"))
    found = kinematics.kinematic_routes(asked, ways, 0)
    return found.groupBy("rid").agg(F.max("cost").alias("cost"), F.round(F.max("seconds"), 3).alias("seconds"), F.round(F.max_by("joules", "seq"), 1).alias("joules"))
