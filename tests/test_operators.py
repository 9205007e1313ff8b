"""Operators that SQL can't express, against small brute-force versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.functions import names, tags
from wayloom.operators import graph, regions, routing, tracks
from wayloom.plans import rules
from wayloom.streaming import fusion


def test_dijkstra_with_turns_and_restrictions():
    edges = [(a, b, 10.0, *d) for a, b, d in [(0, 1, (1, 0)), (1, 2, (1, 0)), (2, 5, (0, 1)), (0, 3, (0, 1)), (3, 4, (1, 0)), (4, 5, (1, 0)), (1, 4, (0, 1))]]
    places = {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (0, 1), 4: (1, 1), 5: (2, 1)}
    cost, path = routing.search(edges, 0, 5, 5.0, set(), {}, places, 0.0)
    assert cost == 35 and path in ([0, 1, 2, 5], [0, 3, 4, 5])
    cost, path = routing.search(edges, 0, 5, 5.0, {(1, 2, 5)}, {}, places, 9.0)
    assert path == [0, 3, 4, 5]
    assert routing.search(edges, 5, 0, 0.0, set(), {}, places, 0.0) is None


def test_routes_leave_their_box_where_that_is_cheaper(spark):
    """A wall with a gate far away, an island, dear streets, restrictions and a request that stays where it is: costs as by relaxing all edges of the whole graph."""
    random.seed(9)
    node = lambda x, y: y * 30 + x
    edges = []
    for x in range(30):
        for y in range(30):
            for x2, y2 in ((x + 1, y), (x, y + 1)):
                if x2 > 29 or y2 > 29 or (x, x2) == (14, 15) and y != 27 or (x2 >= 26 and y2 >= 26) != (x >= 26 and y >= 26):
                    continue
                for ax, ay, bx, by in ((x, y, x2, y2), (x2, y2, x, y)):
                    edges.append((node(ax, ay), node(bx, by), 10.0 + random.choice([0, 0, 5, 200]), ax, ay, bx, by, ax // 5, ay // 5))
    turns = [(e[0], e[1], f[1]) for e in edges for f in edges if e[1] == f[0] and random.random() < 0.02]
    asked = [(k, random.randrange(900), random.randrange(900)) for k in range(12)] + [(50, node(13, 2), node(16, 2)), (51, 5, 5), (52, 0, node(28, 28)), (53, 9999, 9999)]
    at = lambda n: (n % 30 // 5, n // 150)
    barred, want, after = set(turns), {}, {}
    for e in edges:
        after.setdefault(e[0], []).append(e)
    for rid, start, goal in asked:
        best = {(-1, start): 0.0}
        work = [(-1, start)]
        while work:
            before, here = work.pop(0)
            for e in after.get(here, ()):
                cost = best[before, here] + e[2]
                if e[1] != before and (before, here, e[1]) not in barred and cost < best.get((here, e[1]), math.inf):
                    best[here, e[1]] = cost
                    work.append((here, e[1]))
        costs = [c for (_, n), c in best.items() if n == goal]
        if costs:
            want[rid] = min(costs)
    requests = spark.createDataFrame([(k, a, b, *at(a), *at(b)) for k, a, b in asked], "rid long, start long, goal long, x1 long, x2 long, y1 long, y2 long").selectExpr("rid", "start", "goal", "x1", "x2 as y1", "y1 as x2", "y2")
    graph_edges = spark.createDataFrame(edges, "a long, b long, cost double, ax long, ay long, bx long, by long, cx long, cy long")
    banned = spark.createDataFrame(turns, "from_n long, via long, to_n long")
    for coefficient in (0.0, 10.0):
        got = routing.routes(requests, graph_edges, 0, restrictions=banned, coefficient=coefficient).groupBy("rid").agg(F.max("cost").alias("c")).collect()
        assert {r.rid: r.c for r in got} == want
    assert 52 not in want and want[51] == 0 and 50 in want
    several = routing.routes(requests, graph_edges, 0, restrictions=banned, alternatives=2).where("seq = 0").collect()
    assert {r.rid: r.cost for r in several if r.alternative == 0} == want
    for rid in want:
        costs = [r.cost for r in sorted(several, key=lambda r: r.alternative) if r.rid == rid]
        assert len(costs) == 3 and costs == sorted(costs)


def test_ascend_fold(spark):
    def plain(hs, band=10.0):
        buffer, up, last = 0.0, 0.0, None
        for h in hs:
            buffer += (last - h) * -0.25 if last is not None else 0.0
            if buffer > 0:
                up, buffer = up + buffer, 0.0
            elif buffer < -band:
                buffer = -band
            last = h
        return math.floor(up + 0.5)

    random.seed(4)
    rows = [(i, [random.randrange(0, 400) for _ in range(random.randrange(1, 30))]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, h array<int>")
    got = dict(df.select("id", routing.ascend(F.col("h"))).collect())
    assert got == {i: plain(h) for i, h in rows}


def test_unique_positions(spark, monkeypatch):
    """As if nodes came one by one: crowds whose triangles overlap, across the edges of cells and degrees, in small chunks."""
    monkeypatch.setattr(graph, "PER_CHUNK", 3)
    rng = random.Random(6)
    spots = [(1_000_005, 2_000_005)] * 3 + [(999_999, 2_000_005), (1_000_006, 2_000_007), (1_499_999, 2_500_000), (1_500_000, 2_499_999), (1_500_001, 2_499_998), (100_000, 99_999), (7, 7)]
    rows = [(i, *spots[rng.randrange(len(spots))]) for i in rng.sample(range(1000), 50)] + [(2000, None, 5)]
    rows += [(3000 + k, 1_000_005 + k % 3, 2_000_005 + k // 3) for k in range(9)]
    taken, want = set(), {}
    for i, x, y in sorted(r for r in rows if r[1] is not None):
        ux, uy = (1 if v % 1_000_000 < 500_000 else -1 for v in (x, y))
        at = next((x + c * ux, y + r * uy) for r in range(100) for c in range(r + 1) if (x + c * ux, y + r * uy) not in taken)
        taken.add(at)
        want[i] = at
    nodes = spark.createDataFrame(rows, "id long, ilon long, ilat long")
    assert {r.id: (r.ilon, r.ilat) for r in graph.unique_positions(nodes).collect()} == want
    assert not graph.unique_positions(nodes.limit(0)).collect()


def test_nearest_region_of_many_centres(spark):
    world = regions.WORLD
    centres = spark.range(12_000).selectExpr("id", "id * 5915587 % 360000000 as ilon", "id * 99991 % 160000000 + 10000000 as ilat")
    rows = [(i, i * 7_654_321 % world, i * 8_765_432 % 180_000_000) for i in range(60)] + [(60, 0, 90_000_000), (61, world - 1, 90_000_000), (61, None, 5)]
    spots = centres.collect()

    def far(x, y, c):
        dx = (x - c.ilon + world // 2) % world - world // 2
        return dx * dx + (y - c.ilat) ** 2, c.id

    got = regions.nearest_region(spark.createDataFrame(rows, "id long, ilon long, ilat long"), centres).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, None if x is None else min(far(x, y, c) for c in spots)[1])) for i, x, y in rows)
    few = spark.createDataFrame([(7, 1, 170_000_000), (3, world - 1, 170_000_000)], "id long, ilon long, ilat long")
    assert {tuple(r) for r in regions.nearest_region(spark.createDataFrame([(1, 0, 0), (2, 179_999_999, 0)], "id long, ilon long, ilat long"), few).collect()} == {(1, 3), (2, 7)}


def test_simplified(spark):
    paths = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0], [0.0, 0.1, 0.0, 5.0]), (2, [0.0, 1.0, 2.0], [0.0, 0.4, 0.0])], "id int, xs array<double>, ys array<double>")
    assert dict(graph.simplified(paths.withColumn("id", F.col("id").cast("long"))).collect()) == {1: [0, 2, 3], 2: [0, 1, 2]}


def test_contraction_keeps_kept_nodes(spark):
    edges = spark.createDataFrame([(i, i + 1, 10) for i in range(5)], "a long, b long, metres long")
    assert [tuple(r) for r in graph.contracted(edges).collect()] == [(0, 5, 50, 4)]
    kept = spark.createDataFrame([(3,)], "node long")
    assert sorted(tuple(r) for r in graph.contracted(edges, kept).collect()) == [(0, 3, 30, 2), (3, 5, 20, 1)]


def test_contraction_keeps_rings_and_edges_side_by_side(spark):
    """As by taking out passed-through nodes one by one."""
    rng = random.Random(8)
    edges = [(0, 1, 1), (1, 2, 2), (2, 0, 4), (5, 5, 7), (6, 7, 1), (6, 7, 2), (8, 9, 1), (8, 9, 2), (9, 10, 3), (10, 8, 5), (11, 12, 1), (12, 12, 2)]
    edges += [(20 + rng.randrange(40), 20 + rng.randrange(40), rng.randrange(1, 9)) for _ in range(45)]
    left, done = [(a, b, m, 0) for a, b, m in edges], False
    while not done:
        done = True
        for node in range(60, -1, -1):  # the least node of a ring stays
            at = [e for e in left if node in e[:2]]
            if len(at) == 2 and all(e[0] != e[1] for e in at):
                for e in at:
                    left.remove(e)
                x, y = (e[0] if e[1] == node else e[1] for e in at)
                left.append((x, y, at[0][2] + at[1][2], at[0][3] + at[1][3] + 1))
                done = False
                break
    want = sorted((min(a, b), max(a, b), m, n) for a, b, m, n in left)
    got = graph.contracted(spark.createDataFrame(edges, "a long, b long, metres long"))
    assert sorted(map(tuple, got.collect())) == want


def test_rule_language(spark):
    text = "---context:global\nassign g 2\n---context:way\nassign a = if and highway=x|y not oneway= then multiply g 3 else max 1 v:maxspeed\nassign a2 sub a 1 # note\n"
    rows = spark.createDataFrame([({"highway": "x", "oneway": "no"},), ({"highway": "z", "maxspeed": "30 mph"},), ({},)], "tags map<string,string>")
    c = rules.compile_rules(text, "way", F.col("tags"))
    got = [tuple(r) for r in rows.select(c["a"], c["a2"]).collect()]
    assert got[0] == (6.0, 5.0) and got[1][0] == pytest.approx(48.3) and math.isnan(got[2][0])
    with pytest.raises(rules.RuleError):
        rules.compile_rules("---context:way\nassign b nothing", "way", F.col("tags"))
    with pytest.raises(rules.RuleError):
        rules.compile_rules("---context:global\nassign g 1\n---context:way\nassign g 2", "way", F.col("tags"))


def test_overrides_replace_the_first_assignment_only(spark):
    text = "---context:way\nassign a 1\nassign b a\nassign a 2\n"
    c = rules.compile_rules(text, "way", F.create_map(), {"a": 9.0})
    assert tuple(spark.range(1).select(c["a"], c["b"]).first()) == (2.0, 9.0)


def test_units(spark):
    cases = {"12'6\"": 3.8, "4 m": 4.0, "10 mph": 16.1, "~3,5": 3.5, "2-3 m": 2.0, "none": None, "150 cm": 1.5, "1 fathom": 1.8}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.n for r in df.select("v", tags.metric(F.col("v")).alias("n")).collect()} == cases


def test_names(spark):
    df = spark.createDataFrame([(" 12A ", "", "HARBOUR  st"), ("7", "3", "nsw ROAD 3RD")], "n string, u string, s string")
    assert [r[0] for r in df.select(names.address_name(F.col("n"), F.col("u"), F.col("s"))).collect()] == ["12A Harbour St", "3/7 NSW Road 3RD"]
    assert names.query_tokens('north-west "port*') == [["north", "west"], ["port"]]


def test_route_progress(spark):
    """As by walking along the route with all legs at hand: loops, stops, fixes off the route, a session without a route."""
    rng = random.Random(4)
    points, fixes = [], []
    for s in range(4):
        x = y = 0.0
        for k in range(25):
            points.append((s, k, x, y, k in (8, 9, 17), k % 4 == 3))
            x, y = x + rng.choice([30.0, 60.0, 0.0, -20.0]), y + rng.choice([40.0, 0.0, -10.0])
        fixes += [(s, 1000 * i, i, p[2] + rng.uniform(-9, 9) + (90 if i % 23 in (4, 5, 6, 7) else 0), p[3] + rng.uniform(-9, 9)) for i, p in enumerate(q for q in points if q[0] == s for _ in range(3))]
    fixes.append((9, 0, 0, 0.0, 0.0))
    want = []
    for s in range(4):
        route = [p for p in points if p[0] == s]
        cum = [0.0]
        for p, q in zip(route, route[1:]):
            cum.append(cum[-1] + math.hypot(q[2] - p[2], q[3] - p[3]))
        halts, turns = [k for k, p in enumerate(route) if p[4]], [cum[k] for k, p in enumerate(route) if p[5]]
        done = turn = streak = 0
        arrived = False
        for _, ms, event, x, y in (f for f in fixes if f[0] == s):
            best = None
            for k in range(([0] + halts)[done], (halts + [24])[done]):
                (ax, ay), (bx, by) = route[k][2:4], route[k + 1][2:4]
                size = (bx - ax) ** 2 + (by - ay) ** 2
                t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size)) if size else 0
                here = (math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)), cum[k] + t * math.sqrt(size))
                best = here if best is None or here[0] < best[0] - 1e-9 else best
            off, along = best
            streak = streak + 1 if off > 40 else 0
            turn = max(turn, sum(a - along <= 15 for a in turns))
            while off <= 40 and done < len(halts) and along >= cum[halts[done]] - 15:
                done += 1
            now = off <= 40 and not arrived and done == len(halts) and cum[-1] - along <= 15
            arrived |= now
            want.append((s, ms, event, round(along, 4), round(off, 4), turn, done, streak, streak >= 3 and not arrived, now))
    rows = tracks.route_progress(spark.createDataFrame(fixes, "session long, ms long, event_id long, x double, y double"), spark.createDataFrame(points, "route long, seq long, x double, y double, stop boolean, turn boolean")).collect()
    got = sorted((r.session, r.ms, r.event_id, round(r.along, 4), round(r.off, 4), r.turn, r.stops, r.streak, r.recalc, r.arrived) for r in rows)
    assert got == sorted(want) and any(r[-2] for r in got) and any(r[-1] for r in got)


def test_fixes_meet_the_leg_they_are_on_alone(spark):
    """A route of many legs: no fix is joined with its route's geometry, whose size would then be paid for each fix."""
    n = 300
    points = [(1, k, 50.0 * k, 0.0, k % 3 == 2, False) for k in range(n)]
    fixes = [(1, 1000 * k, k, 50.0 * k, 3.0) for k in range(n)]
    out = tracks.route_progress(spark.createDataFrame(fixes, "session long, ms long, event_id long, x double, y double"), spark.createDataFrame(points, "route long, seq long, x double, y double, stop boolean, turn boolean"))
    assert "Join" not in out._jdf.queryExecution().toString()
    got = sorted((r.event_id, r.along, r.off, r.stops, r.remaining, r.arrived) for r in out.collect())
    assert got == [(k, 50.0 * k, 3.0, (k + 1) // 3, 50.0 * (n - 1 - k), k == n - 1) for k in range(n)]


FIXES = "session long, ms long, x double, y double, speed double, accuracy double"


def test_fusion_stream_equals_batch(spark, tmp_path):
    """Fixes that come out of order, across micro-batches too, give what the batch gives, as far as the watermark has come."""
    rng = random.Random(2)
    rows = [(s, 1_000_000 + 1000 * k + s, float(k * 10 + rng.random()), float(s), 8.0 if k % 7 else 0.0, 5.0 + k % 3 * 30) for s in range(5) for k in range(60)]
    for n in range(3):
        # some fixes come with the file after theirs, up to three seconds behind others
        part = [r for r in rows if min(2, ((k := r[1] // 1000 - 1000) + (3 if (k + r[0]) % 4 == 0 else 0)) // 20) == n]
        rng.shuffle(part)
        spark.createDataFrame(part, FIXES).withColumn("at", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{FIXES}, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = fusion.fuse_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    want = fusion.fuse(spark.createDataFrame(rows, FIXES)).where(F.col("ms") < max(r[1] for r in rows) - 10_000).collect()
    assert len(want) > 200 and sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want))


def fused_by_hand(*fixes):
    """(x, speed, mode, accepted) after each fix (seconds, x, speed, accuracy)."""
    state, out = fusion.START, []
    for t, x, speed, accuracy in fixes:
        state, row = fusion.step(state, int(t * 1000), float(x), 0.0, float(speed), float(accuracy))
        out.append((round(row[1], 6), row[3], row[4], row[5]))
    return out


def test_fusion_modes():
    walk = fused_by_hand((0, 0, 1.5, 5), (1, 3, 3, 5), (2, 6, 3, 5), (3, 6.1, 0.2, 5), (6, 6.2, 0.2, 5), (7, 7, 1.5, 5))
    assert [r[2] for r in walk] == ["WALKING", "WALKING", "DRIVING", "DRIVING", "STILL", "WALKING"]
    assert [r[2] for r in fused_by_hand((0, 0, 1, 5), (1, 1, 3, 5), (2, 2, 1, 5), (3, 3, 3, 5), (4, 4, 3, 5))] == ["WALKING"] * 4 + ["DRIVING"]
    assert fused_by_hand((0, 0, 0, 5))[0][2] == "STILL"


def test_fusion_blends_jumps_and_damps():
    # driving at 10 m/s a fix 3 m ahead of the expected place moves the estimate by 15 % of that
    driving = (0.0, 0.0, 1.0, 0.0, 10.0, 0, 0.0, 0.0, False, "DRIVING", "", -1)
    assert math.isclose(fusion.step(driving, 1000, 13.0, 0.0, 10.0, 15.0)[1][1], 10.45)
    assert math.isclose(fusion.step(driving, 1000, 25.0, 0.0, 10.0, 15.0)[1][1], 17.5)
    assert fused_by_hand((0, 0, 10, 15), (1, 70, 10, 15))[-1] == (70.0, 10.0, "DRIVING", True)
    # a poor fix far off never jumps: half of the way at 100 m
    assert fused_by_hand((0, 0, 1, 5), (1, 300, 1, 100))[-1][0] == 150.0
    # standing: 30 % of the way to each fix, however far it lies
    assert fused_by_hand((0, 0, 0, 5), (1, 4, 0, 5), (2, 40, 0, 5))[-1][0] == round(1.2 + 0.3 * 38.8, 6)
    # no speed: that from the last fix; no accuracy: 30 m
    assert fused_by_hand((0, 0, 5, 5), (2, 20, math.nan, math.nan))[-1][1:] == (10.0, "DRIVING", True)


def test_ticks(spark):
    fixes = [(1, 0, 0.0, 0.0, 10.0, 5.0), (1, 1000, 10.0, 0.0, 10.0, 5.0), (1, 2500, 2000.0, 0.0, 10.0, 5.0), (2, 50, 1.0, 1.0, 0.0, 5.0)]
    got = {(r.session, r.ms): r for r in fusion.ticks(fusion.fuse(spark.createDataFrame(fixes, FIXES)), 500).collect()}
    x1 = got[1, 1000].x
    assert sorted(k[1] for k in got if k[0] == 1) == list(range(0, 22_501, 500)) and [got[1, ms].since for ms in (1000, 1500, 2000, 2500, 3000)] == [0, 1, 2, 0, 1]
    # the doubted fix at 2.5 s moves nothing but keeps the signal fresh
    assert all(math.isclose(got[1, 1000 + ms].x, x1 + 10 * fusion.coast(ms / 1000)) for ms in range(0, 21_500, 500))
    assert math.isclose(got[1, 6000].speed, 5.0) and got[1, 12_000].fresh and not got[1, 12_500].fresh
    assert [(r.ms, r.x, r.since) for r in sorted((r for r in got.values() if r.session == 2), key=lambda r: r.ms)][:2] == [(500, 1.0, 1), (1000, 1.0, 2)]


def test_fusion_goes_on_across_batches_of_a_session(spark):
    rng = random.Random(2)
    rows = [(i % 7 % 3, i * 500, rng.random() * 300, rng.random() * 300, rng.random() * 4, 5.0) for i in range(400)]
    df = spark.createDataFrame(rows, "session long, ms long, x double, y double, speed double, accuracy double")
    states, want = {}, []
    for session, *fix in rows:
        states[session], out = fusion.step(states.get(session, fusion.START), *fix)
        want.append((session, *out))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 16)
    try:
        fused = fusion.fuse(df)
        assert sorted(map(tuple, fused.collect())) == sorted(want)
        assert "FlatMapGroups" not in fused._jdf.queryExecution().toString()  # no session is held in one frame
    finally:
        spark.conf.unset(key)


def test_fusion_doubts_a_far_fix_once():
    s, _ = fusion.step(fusion.START, 0, 0.0, 0.0, 0.0, 5.0)
    s, out = fusion.step(s, 1000, 500.0, 0.0, 0.0, 5.0)
    assert not out[5] and out[1] == 0.0
    s, out = fusion.step(s, 2000, 500.0, 0.0, 1.0, 5.0)
    assert out[5] and out[1] == 500.0


def test_nearest_chunks_first(spark):
    tiles = spark.createDataFrame([(x, y) for x in range(60, 70) for y in range(30, 37)], "x long, y long")
    seen = [(r.cx, r.cy, r.x, r.y) for r in regions.nearest_first(tiles, 7, (10.0, 80.0), 4).collect()]
    assert len(set(seen)) == len(seen) == 70
    chunks = list(dict.fromkeys((cx, cy) for cx, cy, *_ in seen))
    # tile 64 begins at 0 degrees east; the anchor lies to the north of all
    assert chunks[0][1] == 0 and {c[1] for c in chunks[:3]} == {0} and {c[1] for c in chunks[3:]} == {1}
    assert [r[2:] for r in seen[:5]] == sorted(r[2:] for r in seen[:5])
    plain = [(r.cx, r.cy) for r in regions.nearest_first(tiles, 7, None, 4).collect()]
    assert plain == sorted(plain)
    assert regions.nearest_first(tiles.limit(0), 7, (0.0, 0.0)).count() == 0


def test_about_turns_fall_on_the_side_of_unscaled_steps(spark):
    """Steps straight back: which side they count as is a matter of the last bits, which a scale by 1e-3 would change."""
    import math

    from wayloom.operators import tracks

    steps = [(139950320, -1320, 1400, 3960, -4200), (140021160, -700, -900, 2100, 2700), (139974380, 1320, 440, -3960, -1320), (139944160, -1860, -1400, 5580, 4200), (139941500, 1320, 1260, -3960, -3780), (140026440, 1700, -1360, -5100, 4080)]
    paths = [(t, [(190_000_000 - dx, y - dy), (190_000_000, y), (190_000_000 + ex, y + ey)]) for t, (y, dx, dy, ex, ey) in enumerate(steps)]
    points = spark.createDataFrame([(t, k, x, y) for t, p in paths for k, (x, y) in enumerate(p, 1)], "track long, seq long, ilon long, ilat long")
    got = {r.track: r.angle for r in tracks.segments(points).where("seq = 3").collect()}
    for t, p in paths:
        (x2, y2), (x1, y1), (x0, y0) = p
        f = math.radians(math.floor(y1 / 100000) / 10 + 0.05 - 90)
        kx, ky = 111.41513 * math.cos(f) - 0.09455 * math.cos(3 * f) + 0.00012 * math.cos(5 * f), 111.13209 - 0.56605 * math.cos(2 * f) + 0.0012 * math.cos(4 * f)
        ux, uy, vx, vy = (x1 - x2) * kx, (y1 - y2) * ky, (x0 - x1) * kx, (y0 - y1) * ky
        assert round(got[t]) == (-180 if uy * vx - ux * vy < 0 else 180), p


def test_matches_look_near_first_where_segments_are_dense(spark, monkeypatch):
    """Growing reach gives what one look over the whole reach does, in and beside a dense place; laid segments are never broadcast."""
    import random

    r = random.Random(4)
    at = lambda: (r.randint(0, 60), r.randint(0, 60)) if r.random() < 0.9 else (r.randint(-400, 900), r.randint(-400, 900))
    segments = [(i, x, y, x + r.randint(-40, 40), y + r.randint(-40, 40)) for i, (x, y) in enumerate(at() for _ in range(400))]
    points = [(i, *at(), r.randint(0, 359)) for i in range(150)]
    s, p = spark.createDataFrame(segments, "sid long, ax long, ay long, bx long, by long"), spark.createDataFrame(points, "id long, x long, y long, heading long")
    monkeypatch.setattr(routing, "PER_CELL", 10**9)
    whole = sorted(map(tuple, routing.matches(p, s, 200).collect()))
    rings = sorted(map(tuple, routing.match_in_rings(p, s, [50, 200]).collect()))
    assert "BroadcastHashJoin" not in routing.matches(p, s, 200)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(routing, "PER_CELL", 2)
    assert sorted(map(tuple, routing.matches(p, s, 200).collect())) == whole
    assert sorted(map(tuple, routing.match_in_rings(p, s, [50, 200]).collect())) == rings


def test_dense_segments_are_not_laid_in_ever_smaller_cells(spark, monkeypatch):
    """Long segments, close together, with few points: cells of a unit would hold each segment hundreds of times."""
    looked = []

    def near(points, segments, reach, kept):
        looked.append(reach)
        return points.limit(0).selectExpr("id", "id as sid", "id as metres", "id as off", "cast(id as int) as nth")

    monkeypatch.setattr(routing, "_near", near)
    i = F.col("id")
    segments = spark.range(300_000).select(i.alias("sid"), (i * 7919 % 1009).alias("ax"), (i * 104729 % 1013).alias("ay"), (i * 7919 % 1009 + i % 200).alias("bx"), (i * 104729 % 1013 + i % 150).alias("by"))
    points = spark.range(200).select("id", (i * 37 % 1000).alias("x"), (i * 91 % 1000).alias("y"), i.alias("heading"))
    routing.matches(points, segments, 60, 1)
    assert looked[0] >= 15


def test_neighbouring_requests_share_the_edges_of_their_corridors(spark):
    """An edge travels once a chunk of requests, not once a request; goals that can't be reached end after all."""
    import pandas as pd

    edges = spark.range(400).selectExpr("id as a", "id + 1 as b", "id div 10 as cx", "0 as cy", "true as on", "cast(null as array<long>) as banned")
    asked = spark.range(40).selectExpr("id as rid", "id * 10 as start", "id * 10 + 5 as goal", "id as x1", "id as x2", "0 as y1", "0 as y2")

    def run(chunk, frame):
        return pd.DataFrame([(r, len(chunk), len(frame)) for r, _, _ in chunk], columns=["rid", "n", "edges"])

    got = routing.in_corridors(asked, edges, 0, run, "rid long, n long, edges long", "edges").collect()
    assert sorted(r.rid for r in got) == list(range(40)) and sum(r.edges / r.n for r in got) <= 800 and max(r.n for r in got) > 1

    def never(chunk, frame):
        return pd.DataFrame([(r, -1) for r, _, _ in chunk], columns=["rid", "edges"])

    apart = edges.where("a <> 205")
    far = spark.createDataFrame([(1, 200, 210, 20, 21, 0, 0)], "rid long, start long, goal long, x1 long, x2 long, y1 long, y2 long")
    assert routing.in_corridors(far, apart, 0, never, "rid long, edges long", "edges").count() == 0


def test_links_away_are_told_without_pairs_of_ways_and_links(spark):
    import random

    r = random.Random(7)
    rows = sorted({(r.randint(0, 30), r.choice([1, 1, 1, r.randint(0, 12)]), r.randint(0, 12)) for _ in range(300)})
    links = {(a, b) for _, a, b in rows}
    want = []
    for w in {w for w, _, _ in rows}:
        own = {(a, b) for v, a, b in rows if v == w}
        away = [b for a, b in links - own if a in {n for link in own for n in link}]
        if away:
            want.append((w, len(away), min(away), max(away)))
    df = routing.links_away(spark.createDataFrame(rows, "wid long, a long, b long"))
    assert sorted(map(tuple, df.select("wid", "detours", "first_b", "last_b").collect())) == sorted(want)
    assert "LeftAnti" not in df._jdf.queryExecution().optimizedPlan().toString()
