"""Routes with momentum against a plain twin that walks every way of small graphs step by step."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.functions.geo import turn, turn_angle
from wayloom.operators import kinematics
from wayloom.operators.kinematics import Vehicle, braking_speed, kinematic_routes, rolled

CAR = Vehicle()


def twin_turn(a, b, c):
    """Degrees to the right from the step a-b to the step b-c."""
    d = math.degrees(math.atan2(b[0] - a[0], b[1] - a[1])), math.degrees(math.atan2(c[0] - b[0], c[1] - b[1]))
    return (d[1] - d[0] + 180) % 360 - 180


def twin_brake(limit, car):
    power, e = car.balance + car.standby, car.efficiency
    f = lambda v: power / v + car.air * e * v * v
    target, v = f(limit) + (1 - e) * car.roll, 0.8 * limit
    for _ in range(5):
        v -= (f(v) - target) / (2 * e * car.air * v - power / v**2)
    return v


def twin_walk(edges, nodes, car):
    """(cost, seconds, joules) of a walk. edges: {(a, b): dict}."""
    cost = seconds = joules = energy = 0.0
    bends, height, last = {-1: 0.0, 1: 0.0}, None, None
    for a, b in zip(nodes, nodes[1:]):
        e = edges[a, b]
        shape = e["shape"]
        height = shape[0][2] if height is None else height
        limit = min(e["maxspeed"], car.top) / 3.6
        for k in range(1, len(shape)):
            p, q = shape[k - 1], shape[k]
            metres, pause, cap = float(int(math.dist(p[:2], q[:2]))), 0.0, 1e9
            if last is not None:
                angle = twin_turn(last, p, q)
                bends[-1 if angle < 0 else 1] += abs(angle)
                worst = max(bends.values())
                curve = 200 / worst if worst > 10 else 20.0
                bends = {s: v * math.exp(-metres / (curve * car.decay)) for s, v in bends.items()}
                cap = curve if curve < 20 else cap
                if k == 1:
                    was = edges[nodes[nodes.index(a) - 1], a]
                    for (x, y), o in edges.items():
                        if x != a or y == nodes[nodes.index(a) - 1] or o["link"] != e["link"]:
                            continue
                        cap = min(cap, 13.0) if o["residential"] else cap
                        if o["priority"] > e["priority"] or (o["priority"] == e["priority"] and e["priority"] < 20):
                            side = twin_turn(last, p, o["shape"][1]) - angle
                            cap = min(cap, 12 / 3.6) if 40 < abs(side) < 140 else cap
                    if (was["priority"] < 20) != (e["priority"] < 20):
                        pause, cap = pause + 10, 0.0
                    if was["priority"] != e["priority"] and e["link"]:
                        pause += 2
                energy = min(energy, car.weight * cap**2 / 2)
            h = height if q[2] is None else q[2]
            air = car.air * (1 - 0.0001375 * ((100 if h is None else h) - 100))
            slope = 0.0 if h is None or height is None else (h - height) * car.weight * 9.81 / metres
            energy, time, lost = rolled(energy, metres, slope, air, car.weight * limit**2 / 2, car.weight * twin_brake(limit, car) ** 2 / 2, car)
            seconds, joules = seconds + time + pause, joules + lost + metres * slope
            cost += int((car.balance * (time + pause) + lost) / car.unit)
            height, last = h, p
        cost += e["nodecost"]
    return cost, seconds, joules


def fine(energy, metres, slope, air, fastest, slowest, car, n=200_000):
    """Small steps of the same balance of forces."""
    x, seconds = metres / n, 0.0
    for _ in range(n):
        v = math.sqrt(2 * energy / car.weight)
        if energy >= fastest:
            seconds += x / v
            continue
        pull = car.roll + air * v * v + slope + max(0.0, (car.recup if energy < slowest else 0.0) - slope)
        after = min(energy + pull * x, fastest)
        seconds += 2 * x / (v + math.sqrt(2 * after / car.weight))
        energy = after
    return energy, seconds


def test_rolling_is_the_limit_of_small_steps():
    for slope in (-300.0, 0.0, 250.0):
        top, low = 820 * 20.0**2, 820 * 12.0**2
        got = rolled(820 * 4.0, 700.0, slope, 0.4, top, low, CAR)
        energy, seconds = fine(820 * 4.0, 700.0, slope, 0.4, top, low, CAR)
        assert got[0] == pytest.approx(energy, rel=1e-3)
        assert got[1] == pytest.approx(seconds, rel=0.03)  # time is by the first force of a step


def test_braking_speed(spark):
    limits = [5.0, 13.9, 22.2]
    got = spark.createDataFrame([(v,) for v in limits], "v double").select(braking_speed(F.col("v"), CAR)).collect()
    assert [r[0] for r in got] == pytest.approx([twin_brake(v, CAR) for v in limits])


def graph(seed):
    """A grid of 3 x 3, one way to the right and up, with bends, heights that may be missing, and kinds of roads."""
    r, at = random.Random(seed), {}
    for n in range(9):
        at[n] = (n % 3 * 120.0 + r.randrange(-20, 20), n // 3 * 120.0 + r.randrange(-20, 20), r.choice([None, *map(float, range(90, 130))]))
    edges = {}
    for n in range(9):
        for m in [n + 3] * (n < 6) + [n + 1] * (n % 3 < 2):
            bend = [((at[n][0] + at[m][0]) / 2 + r.randrange(-30, 30), (at[n][1] + at[m][1]) / 2 + r.randrange(-30, 30), r.choice([None, 100.0, 110.0]))] if r.random() < 0.6 else []
            edges[n, m] = {"shape": [at[n], *bend, at[m]], "maxspeed": r.choice([30.0, 50.0, 100.0]), "priority": float(r.choice([10, 18, 22, 26])), "link": r.random() < 0.3, "residential": r.random() < 0.3, "nodecost": r.choice([0, 40])}
    return edges


def walks(edges, node, goal):
    if node == goal:
        return [[node]]
    return [[node, *w] for a, b in edges if a == node for w in walks(edges, b, goal)]


def test_routes_equal_the_cheapest_of_all_walks(spark):
    rows, asked, best = [], [], {}
    for g in range(12):
        edges = graph(g)
        best[g] = min((*twin_walk(edges, w, CAR), w) for w in walks(edges, 0, 8))
        asked.append((g, g * 10, g * 10 + 8, g, 0, g, 0))
        rows += [(g * 10 + a, g * 10 + b, e["shape"], g, 0, e["maxspeed"], e["priority"], e["link"], e["residential"], e["nodecost"]) for (a, b), e in edges.items()]
    ways = spark.createDataFrame(rows, "a long, b long, shape array<struct<x double, y double, h double>>, cx long, cy long, maxspeed double, priority double, link boolean, residential boolean, nodecost int")
    requests = spark.createDataFrame(asked, "rid long, start long, goal long, x1 long, y1 long, x2 long, y2 long")
    got = {}
    for r in kinematic_routes(requests, ways, 0, drop=math.inf).orderBy("rid", "seq").collect():
        got.setdefault(r["rid"], []).append(r)
    assert set(got) == set(best)
    for g, (cost, seconds, joules, walk) in best.items():
        assert got[g][-1]["cost"] == pytest.approx(cost, abs=3)
        if [r["node"] - g * 10 for r in got[g]] == walk:
            assert (got[g][-1]["seconds"], got[g][-1]["joules"]) == pytest.approx((seconds, joules), rel=1e-3)  # the library's angles are a polynomial's
    # with the rule that drops dear states, costs are those of a walk still, and hardly ever higher
    dropped = {r["rid"]: r["cost"] for r in kinematic_routes(requests, ways, 0).groupBy("rid").agg({"cost": "max"}).withColumnRenamed("max(cost)", "cost").collect()}
    assert all(dropped[g] >= best[g][0] - 3 for g in best) and sum(dropped[g] > best[g][0] + 3 for g in best) <= 2


def test_closed_ways_and_nowhere(spark):
    shape = [(0.0, 0.0, None), (100.0, 0.0, None)]
    ways = spark.createDataFrame([(1, 2, shape, 0, 0, 50.0, 10.0, 1.0), (2, 3, shape, 0, 0, 50.0, 10.0, 10000.0), (5, 6, shape, 0, 0, 0.0, 10.0, 1.0)], "a long, b long, shape array<struct<x double, y double, h double>>, cx int, cy int, maxspeed double, priority double, costfactor double")
    requests = spark.createDataFrame([(1, 1, 2, 0, 0, 0, 0), (2, 1, 3, 0, 0, 0, 0), (3, 5, 6, 0, 0, 0, 0), (4, 1, 1, 0, 0, 0, 0)], "rid long, start long, goal long, x1 int, y1 int, x2 int, y2 int")
    got = kinematic_routes(requests, ways, 0).groupBy("rid").count().collect()
    assert {r["rid"]: r["count"] for r in got} == {1: 2, 4: 1}


def test_turns_bound_once_equal_turns(spark):
    steps = spark.range(3000).select(*(F.round(F.randn(k) * 2).alias(c) for k, c in enumerate("abcd")))
    a, b, c, d = map(F.col, "abcd")
    inside = F.element_at(F.transform(F.array("a"), lambda x: turn_angle(x, b, c, d)), 1)
    got = steps.select(turn(a, b, c, d)[0].alias("plain"), inside.alias("inside"))
    assert got.where("not (plain <=> inside)").count() == 0
    # an expression in which each step is written once, not once for each of its uses
    assert len(got.select("inside")._jdf.queryExecution().optimizedPlan().toString()) < 10_000


def test_a_second_search_works_out_nothing_anew(monkeypatch):
    calls, plain = [], kinematics.driven
    monkeypatch.setattr(kinematics, "driven", lambda *args: calls.append(args) or plain(*args))
    out = {n: [(m, [820 * 14.0**2, 820 * 10.0**2, 0.0, 0.0, 1e9], [(100.0, 0.0, math.nan)], {}) for m in (2 * n + 1, 2 * n + 2)] for n in range(7)}
    begin = kinematics.Reached(0, kinematics.State(), {})
    first = kinematics.fastest_path(out, begin, 9, set(), CAR)
    n = len(calls)
    assert first[1] == [0, 1, 4, 9] and n
    assert kinematics.fastest_path(out, begin, 9, set(), CAR, limit=first[0].cost) == first and len(calls) == n
