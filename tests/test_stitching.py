"""Stitching against a walk from end to end, and dates of merging against a union-find in order."""

import random

import pytest

from wayloom.operators import stitching


class Sets:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.get(x, x) != x:
            x = self.parent[x]
        return x

    def union(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def plain_stitched(fragments, places, limit):
    """One end after the other, one segment after the other."""
    sets, put, seen = Sets(), [], set()
    for fid in sorted(fragments):
        for nid in (fragments[fid][0], fragments[fid][-1]):
            if nid in seen:
                continue
            seen.add(nid)
            x, y = places[nid]
            spliced = set()
            for other in sorted(fragments):
                nodes = fragments[other]
                for k, (a, b) in enumerate(zip(nodes, nodes[1:])):
                    if a == b or nid in (a, b):
                        continue
                    (ax, ay), (bx, by) = places[a], places[b]
                    if (x - ax) ** 2 + (y - ay) ** 2 < limit**2:
                        sets.union(nid, a)
                    elif (x - bx) ** 2 + (y - by) ** 2 < limit**2:
                        sets.union(nid, b)
                    else:
                        length = (bx - ax) ** 2 + (by - ay) ** 2
                        t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length)) if length else 0.0
                        if (ax + t * (bx - ax) - x) ** 2 + (ay + t * (by - ay) - y) ** 2 < limit**2 and other not in spliced:
                            if sets.find(nid) not in {sets.find(n) for n in nodes}:
                                put.append((other, k, t, nid))
                                spliced.add(other)
    out = []
    for fid, nodes in fragments.items():
        rows = sorted([(k, -1.0, sets.find(n)) for k, n in enumerate(nodes)] + [(k, t, sets.find(n)) for f, k, t, n in put if f == fid])
        kept = [n for i, (_, _, n) in enumerate(rows) if i == 0 or rows[i - 1][2] != n]
        out += [(fid, k, n) for k, n in enumerate(kept)]
    return out, put


def linework(rng, n, span, limit):
    places, fragments, nid = {}, {}, 0
    for fid in range(n):
        x, y = rng.randrange(span), rng.randrange(span)
        nodes = []
        for _ in range(rng.randrange(2, 6)):
            if places and rng.random() < 0.15:
                node = rng.choice(list(places))
                x, y = places[node]
            else:
                node, nid = nid, nid + 1
                if places and rng.random() < 0.5:  # close to something
                    px, py = rng.choice(list(places.values()))
                    x, y = px + rng.randrange(-limit, limit + 1), py + rng.randrange(-limit, limit + 1)
                else:
                    x, y = x + rng.randrange(-60, 61), y + rng.randrange(-60, 61)
                places[node] = (x, y)
            nodes.append(node)
        fragments[fid] = nodes
    return fragments, places


@pytest.mark.parametrize("seed, n, span", [(1, 60, 500), (2, 40, 120), (3, 25, 40)])
def test_stitching_equals_a_walk(spark, seed, n, span):
    limit = 12
    fragments, places = linework(random.Random(seed), n, span, limit)
    rows = [(f, k, nid) for f, nodes in fragments.items() for k, nid in enumerate(nodes)]
    got, put = stitching.stitched(spark.createDataFrame(rows, "fid long, k long, nid long"), spark.createDataFrame([(i, *p) for i, p in places.items()], "nid long, x long, y long"), limit)
    want, wanted = plain_stitched(fragments, places, limit)
    assert wanted and sorted((r.fid, r.k, r.nid) for r in put.collect()) == sorted((f, k, nid) for f, k, _, nid in wanted)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("fan", [2, 16])
def test_connections_before_a_date(spark, fan):
    rng = random.Random(5)
    edges = [(a, b, (k, 0)) for k, (a, b) in enumerate(rng.sample([(a, b) for a in range(60) for b in range(a)], 70))]
    asked = [(q, rng.randrange(60), rng.randrange(60), (rng.randrange(70), 1)) for q in range(150)] + [(1, 0, 1, (99, 0)), (900, 0, 777, (99, 0))]
    want = set()
    for q, a, b, date in asked:
        sets = Sets()
        for u, v, when in edges:
            if when < date:
                sets.union(u, v)
        want |= {q} if sets.find(a) == sets.find(b) else set()
    dates = "time struct<u: long, v: long>"
    got = stitching.connected_before(spark.createDataFrame(edges, f"a long, b long, {dates}"), spark.createDataFrame(asked, f"q long, a long, b long, {dates}"), fan)
    assert sorted(r.q for r in got.collect()) == sorted(want)


def test_nothing_to_stitch(spark):
    none = spark.createDataFrame([], "fid long, k long, nid long"), spark.createDataFrame([], "nid long, x long, y long")
    got, put = stitching.stitched(*none, 5)
    assert got.count() == put.count() == 0


def test_stitched_query_equals_a_walk(spark):
    from wayloom.plans.stitch_queries import graph_stitched

    data = "/root/testdata/sf0.001"
    keys = [r.c_custkey for r in spark.read.parquet(f"{data}/customer.parquet").select("c_custkey").collect()]
    fragments = {c: [c * 4 + k for k in range(4)] for c in keys}
    places = {c * 4 + k: (c % 40 * 60 + k * 25 + c * (k + 1) * 13 % 11, c // 40 * 40 + c * (k * 3 + 1) * 7 % 23) for c in keys for k in range(4)}
    want, put = plain_stitched(fragments, places, 12)
    nodes = {}
    for fid, _, nid in want:
        nodes.setdefault(fid, []).append(str(nid))
    assert put and {r.fid: r.nodes for r in graph_stitched(spark, data).collect()} == {f: ",".join(n) for f, n in nodes.items()}


def test_an_end_finds_what_is_near_in_its_own_cell(spark):
    """Segments are laid once in each cell they come near, so that no end has to look around and no pair is met twice."""
    rng = random.Random(8)
    limit, size = 12, 48
    segments = [(i, *(rng.randrange(-150, 150) for _ in range(4))) for i in range(150)] + [(150, 5, -90, 5, 70), (151, -90, 48, 96, 48), (152, 47, 47, 47, 47)]
    cells = stitching._laid_near(spark.createDataFrame(segments, "i long, ax long, ay long, bx long, by long"), limit, size).select("i", "cx", "cy").collect()
    laid = {tuple(r) for r in cells}
    assert len(laid) == len(cells)
    near = 0
    for i, ax, ay, bx, by in segments:
        for _ in range(60):
            t = rng.random()
            x, y = round(ax + t * (bx - ax)) + rng.randrange(-limit, limit + 1), round(ay + t * (by - ay)) + rng.randrange(-limit, limit + 1)
            length = (bx - ax) ** 2 + (by - ay) ** 2
            u = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length)) if length else 0.0
            if (ax + u * (bx - ax) - x) ** 2 + (ay + u * (by - ay) - y) ** 2 < limit**2:
                near += 1
                assert (i, x // size, y // size) in laid
    assert near > 5000
    assert max(sum(c[0] == i for c in laid) for i, *_ in segments) < 40


def test_what_grows_is_not_broadcast(spark, monkeypatch):
    plans, plain = [], stitching.cut
    told = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())
    monkeypatch.setattr(stitching, "cut", lambda df: told(df) or plain(df))
    fragments, places = linework(random.Random(3), 6, 60, 12)
    rows = [(f, k, n) for f, nodes in fragments.items() for k, n in enumerate(nodes)]
    out, put = stitching.stitched(spark.createDataFrame(rows, "fid long, k long, nid long"), spark.createDataFrame([(n, *xy) for n, xy in places.items()], "nid long, x long, y long"), 12)
    told(out)
    # only the numbers of rows before each partition are (a row a partition)
    assert len(plans) > 5 and [p for p in plans if "BroadcastHashJoin" in p and "_before" not in p] == []
