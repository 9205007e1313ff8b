"""Cut links against taking each link out of the graph in turn."""

import random

import pytest

from wayloom.operators import peninsulas


def reach(links, start):
    seen, todo = set(start), list(start)
    while todo:
        n = todo.pop()
        for a, b in links:
            for x, y in ((a, b), (b, a)):
                if x == n and y not in seen:
                    seen.add(y)
                    todo.append(y)
    return seen


def pruned(links, gates):
    """Leaves that are no gates, again and again, where a gate is."""
    near, left = reach(links, gates), set(links)
    while True:
        degree = {}
        for a, b in left:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        gone = {(a, b) for a, b in left if any(degree[n] == 1 and n not in gates and n in near for n in (a, b))}
        if not gone:
            return set(links) - left
        left -= gone


def plain(links, gates):
    whole = reach(links, gates)
    return {(a, b) for a, b in links if a in whole and not {a, b} <= reach([e for e in links if e != (a, b)], gates)}


@pytest.mark.parametrize("seed", range(30))
def test_one_cell(seed):
    rng = random.Random(seed)
    n = rng.randrange(3, 14)
    links = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randrange(2, 2 * n))})
    gates = set(rng.sample(range(n), rng.randrange(0, 4)))
    cut, reached = peninsulas._cut_links(links, gates, False)
    assert cut == plain(links, gates) and reached == reach([e for e in links if e not in cut], gates)
    assert peninsulas._cut_links(links, gates, True)[0] == pruned(links, gates)


def test_a_long_chain_needs_no_recursion():
    links = [(i, i + 1) for i in range(50_000)]
    assert len(peninsulas._cut_links(links, {0}, False)[0]) == 50_000 and not peninsulas._cut_links(links, {0, 50_000}, False)[0]


def test_cells_side_by_side(spark):
    rng = random.Random(77)
    nodes = [(i, i // 9) for i in range(90)]
    links = [(a, b) for a, b in (rng.sample(range(90), 2) for _ in range(400)) if a // 9 == b // 9 or rng.random() < 0.03]
    more = [(b, a) for a, b in links[:20]] + links[:5] + [(3, 3), (4, None), (None, 5), (5, 7000)]
    got = {(r.a, r.b): (r.cut, r.reached) for r in peninsulas.peninsulas(spark.createDataFrame(links + more, "a long, b long"), spark.createDataFrame(nodes, "node long, cell long")).collect()}
    simple = {(min(e), max(e)) for e in links}
    gates = {n for a, b in simple if a // 9 != b // 9 for n in (a, b)}
    want = {e: (False, True) for e in simple if e[0] // 9 != e[1] // 9}
    for cell in range(10):
        own = sorted(e for e in simple if e[0] // 9 == e[1] // 9 == cell)
        at = {g for g in gates if g // 9 == cell}
        cut = plain(own, at)
        near = reach([e for e in own if e not in cut], at)
        want |= {e: (e in cut, set(e) <= near) for e in own}
    assert got == want
    empty = spark.createDataFrame([], "a long, b long")
    assert peninsulas.peninsulas(empty, spark.createDataFrame(nodes, "node long, cell long")).count() == 0
