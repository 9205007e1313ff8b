"""Circles round polygons, directions and points of round trips, against plain geometry."""

import math
import random

import numpy as np
import pytest

from wayloom.operators import round_trips

START = "id long, ilon long, ilat long, radius double, height double"
WAY = "ilon long, ilat long, height double, forest boolean, river boolean"


def test_circles_hold_their_points_and_are_small():
    r = random.Random(5)
    for _ in range(300):
        n = r.choice([1, 2, 3, 8, 40])
        x0, y0, size = r.randrange(10**6, 3 * 10**8), r.randrange(2 * 10**7, 15 * 10**7), r.choice([1, 3, 500, 200_000])
        xs, ys = np.array([x0 + r.randrange(-size, size + 1) for _ in range(n)]), np.array([y0 + r.randrange(-size, size + 1) for _ in range(n)])
        x, y, radius = round_trips.circle_round(xs, ys)
        kx, ky = round_trips._metres_of_unit(y)
        far = np.hypot((xs - x) * kx, (ys - y) * ky).max()
        assert far <= radius
        # no circle is smaller than half the largest distance of two points
        apart = max(math.hypot((a - c) * kx, (b - d) * ky) for a, b in zip(xs, ys) for c, d in zip(xs, ys))
        assert radius <= apart / math.sqrt(3) * 1.05 + 2


def test_circles_of_rows(spark):
    rings = [(1, [(10, 90_000_000), (10, 90_000_000)]), (2, []), (3, None), (4, [(0, 90_000_000), (None, 5), (2000, 90_000_000)])]
    got = {r.id: r for r in round_trips.bounding_circles(spark.createDataFrame(rings, "id long, ring array<struct<x long, y long>>")).collect()}
    assert (got[1].x, got[1].y, got[1].radius) == (10, 90_000_000, 1.0)
    assert got[2].x is None and got[3].radius is None
    assert got[4].x in (1000, 1001) and got[4].radius == pytest.approx(111.3 * 1.001 + 1, abs=0.3)
    p = spark.createDataFrame([(0, 90_000_000, 1000, 90_000_000, 112.0), (0, 90_000_000, 1000, 90_000_000, 110.0)], "x long, y long, cx long, cy long, r double")
    assert [v[0] for v in p.select(round_trips.inside(p.x, p.y, p.cx, p.cy, p.r)).collect()] == [True, False]


def test_directions(spark):
    """Ways in a ring around each start; the share decides, not the number."""
    at = lambda lon, lat, deg, units=8000: (lon + int(units * math.sin(math.radians(deg))), lat + int(units * math.cos(math.radians(deg))))
    rows, lat = [], 90_000_000
    for deg, flat, forest in ((90, 1, 3), (180, 9, 0), (270, 3, 2), (0, 0, 1)):
        for k in range(10):
            rows.append((*at(5_000_000, lat, deg + k - 5), 100.0 if k < flat else 400.0, k < forest, deg == 0))
    rows += [(*at(5_000_000, lat, 90), 100.0, False, False)] * 5  # more flat ways in the east, but a lesser share
    starts = spark.createDataFrame([(1, 5_000_000, lat, 1500.0, 120.0), (2, 250_000_000, lat, 1500.0, 0.0)], START)
    ways = spark.createDataFrame(rows, WAY)
    of = lambda by, **o: {r.id: r.direction for r in round_trips.directions(starts, ways, by, 20_000, **o).collect()}
    assert of("flat") == {1: 180, 2: 90}
    assert of("forest")[1] == 90  # 3 of 15 and 2 of 10 are equal shares, the east comes first
    assert of("river") == {1: 360, 2: 90}
    spread = of("flat", seed=3)
    assert spread == of("flat", seed=3) and 150 <= spread[1] < 210 and 60 <= spread[2] < 120


def test_points_lie_on_the_half_circle_ahead(spark):
    starts = spark.createDataFrame([(1, 5_000_000, 90_000_000, 1500.0, 90.0)], "id long, ilon long, ilat long, radius double, direction double")
    p = [(r.ilon - 5_000_000, r.ilat - 90_000_000) for r in round_trips.trip_points(starts).orderBy("seq").collect()]
    assert p[0] == p[5] == (0, 0) and len(p) == 6
    assert all(math.hypot(x * 0.1113, y * 0.1106) == pytest.approx(1500, rel=0.01) and x > 0 for x, y in p[1:5])
    assert p[1][1] > p[2][1] > 0 > p[3][1] > p[4][1]
    back = round_trips.trip_points(starts, same_way_back=True).orderBy("seq").collect()
    assert len(back) == 2 and back[1].ilat == 90_000_000 and back[1].ilon > 5_013_000


def test_directions_count_by_squares(spark, monkeypatch):
    """Squares of many ways are split, borders of triangles count, and no row is a pair of a start and a way."""
    r = random.Random(9)
    starts = [(k, r.randrange(4_990_000, 5_010_000), r.randrange(59_990_000, 60_010_000), r.choice([0.0, 900.0, 1500.0]), float(r.randrange(300))) for k in range(12)]
    ways = [(r.randrange(4_970_000, 5_030_000) // 500 * 500, r.randrange(59_970_000, 60_030_000) // 500 * 500, float(r.randrange(300)), r.random() < 0.3, r.random() < 0.3) for _ in range(400)] + [(s[1], s[2], s[4], True, False) for s in starts]
    from pyspark.sql import functions as F
    from wayloom.functions import geo
    from wayloom.operators.areas import in_polygon

    frame, around = spark.createDataFrame(starts, START), spark.createDataFrame(ways, WAY)
    corner = lambda a: F.struct(*(c.alias(n) for n, c in zip("xy", geo.destination(F.col("a.ilon"), F.col("a.ilat"), F.col("radius") * 1.5, F.lit(float(a))))))
    expected = {}
    for d in (90, 180, 270, 360):
        ring = F.array(F.struct(F.col("a.ilon").alias("x"), F.col("a.ilat").alias("y")), corner(d - 45), corner((d + 45) % 360))
        pairs = frame.alias("a").crossJoin(around.alias("w")).where(in_polygon(F.col("w.ilon"), F.col("w.ilat"), ring))
        for row in pairs.groupBy("id").agg((F.count_if(F.abs(F.col("w.height") - F.col("a.height")) < 50) * 100.0 / F.count(F.lit(1))).cast("int").alias("share")).collect():
            expected.setdefault(row.id, {})[d] = row.share
    monkeypatch.setattr(round_trips, "LOT", 7)
    found = round_trips.directions(frame, around, "flat", 15_000)
    assert {row.id: row.direction for row in found.collect()} == {k: max((90, 180, 270, 360), key=lambda d: (expected[k].get(d, 0), -d)) for k in range(12)}
    assert "CoGroup" in found._jdf.queryExecution().toString()


def test_circles_side_by_side_are_those_one_by_one():
    r = random.Random(11)
    rings = []
    for n in [1, 2, 3, 8, 40, 1, 7] * 40:
        x0, y0, size = r.randrange(10**6, 3 * 10**8), r.randrange(2 * 10**7, 15 * 10**7), r.choice([1, 3, 500, 200_000])
        rings.append([(x0 + r.randrange(-size, size + 1), y0 + r.randrange(-size, size + 1)) for _ in range(n)])
    xs, ys = (np.array([p[i] for ring in rings for p in ring]) for i in (0, 1))
    starts = np.cumsum([0] + [len(ring) for ring in rings[:-1]])
    found = list(zip(*(v.tolist() for v in round_trips.circles_round(xs, ys, starts))))
    assert found == [round_trips.circle_round(*(np.array([p[i] for p in ring]) for i in (0, 1))) for ring in rings]
