"""Lengths inside areas against many points along a segment, and what areas do to edges and waypoints."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.operators import nogos

POINT = "struct<x: double, y: double>"


def inside(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def test_length_inside_polygons_equals_sampling(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randrange(3, 9)))
        ring = [(rng.uniform(20, 100) * math.cos(t), rng.uniform(20, 100) * math.sin(t)) for t in turns]  # a star, seldom convex
        rows.append((i, *(rng.uniform(-120, 120) for _ in range(4)), ring))
    df = spark.createDataFrame(rows, f"i int, ax double, ay double, bx double, by double, ring array<{POINT}>")
    got = {r.i: r.n for r in df.select("i", nogos.inside_polygon(*(F.col(c) for c in ("ax", "ay", "bx", "by", "ring"))).alias("n")).collect()}
    steps = 4000
    for i, ax, ay, bx, by, ring in rows:
        n = sum(inside(ring, ax + (bx - ax) * (k + 0.5) / steps, ay + (by - ay) * (k + 0.5) / steps) for k in range(steps))
        assert got[i] == pytest.approx(math.dist((ax, ay), (bx, by)) * n / steps, abs=0.5)
    assert sum(v > 0 for v in got.values()) > 25


def test_areas_on_edges_and_waypoints(spark):
    box = lambda x, y, n: [(float(x), float(y)), (float(x + n), float(y)), (float(x + n), float(y + n)), (float(x), float(y + n))]
    areas = [
        (1, box(10, -5, 20), None, True, 2.0), (2, [(100.0, 0.0)], 10.0, True, 1.0), (3, [(200.0, -50.0), (200.0, 50.0)], None, False, 7.0), (4, box(300, -5, 10), None, True, None), (5, [(0.0, -50.0), (400.0, -50.0)], None, False, None),
        (6, box(40, 0, 5), None, True, 3.0), (7, [], None, True, None), (8, [(500.0, 0.0)], None, False, None),
    ]
    line = lambda *p: [(float(x), float(y)) for x, y in p]
    edges = [
        (1, line((0, 0), (50, 0)), 40.0 + 15.0), (2, line((90, 0), (120, 0)), 20.0), (3, line((0, 0), (95, 0), (105, 0)), 40.0 + 15.0 + 5.0 + 10.0), (4, line((190, 0), (210, 0), (190, 10)), 14.0), (5, line((290, 0), (320, 0)), -1.0), (6, line((5, -60), (5, -40)), -1.0),
        (7, line((0, 900), (50, 900)), 0.0), (8, line((3, 3)), 0.0), (9, line((12, 0), (12, 0)), 0.0), (1, line((0, 0), (50, 0)), 55.0),
    ]
    nogo = spark.createDataFrame(areas, nogos.AREAS)
    df = spark.createDataFrame([(i, s, "clash") for i, s, _ in edges], f"i int, shape array<{POINT}>, aid string")
    for size in (7.0, 1000.0):
        got = sorted((r.i, round(r.areacost, 6)) for r in nogos.with_area_costs(df, nogo, size).collect())
        assert got == sorted((i, c) for i, _, c in edges)
    assert nogos.with_area_costs(df, nogo.limit(0), 50.0).where("areacost <> 0").count() == 0
    at = spark.createDataFrame([(15.0, 0.0), (104.0, 3.0), (200.0, 10.0), (600.0, 0.0), (None, 1.0)], "x double, y double")
    assert sorted(r.aid for r in nogos.usable_areas(nogo, at, 25.0).collect()) == [4, 5, 6, 7, 8]


def test_ways_of_one_set_of_tags_stay_in_many_tasks(spark, monkeypatch):
    from wayloom.plans import rules

    kinds = F.element_at(F.array(*map(F.lit, ("primary", "secondary", "tertiary", "service"))), (F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 4) + 1).cast("int"))
    ways = spark.range(0, 4000, 1, 8).select("id", F.when(F.col("id") % 100 < 98, F.create_map(F.lit("highway"), kinds)).alias("tags"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = rules.evaluate(ways, rules.CAR, ["costfactor"])
        held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(held) == 3920 and max(held) < 1000
        want = sorted((r.id, r.costfactor, r.costfactor_back) for r in out.collect())
        monkeypatch.setattr(rules, "FREQUENT", 2)
        assert sorted((r.id, r.costfactor, r.costfactor_back) for r in rules.evaluate(ways, rules.CAR, ["costfactor"]).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
