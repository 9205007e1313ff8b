"""Links of a cell's road graph behind which nothing leads out of the cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.operators.shared import by_groups


def _cut_links(links: list[tuple[int, int]], gates: set[int], trees_only: bool) -> tuple[set[tuple[int, int]], set[int]]:
    """(links to cut, nodes that gates still reach) of a simple graph, by one walk in depth from the gates, which count as one node.

    A link down the walk is cut if nothing below it links to a node met before the link's upper end, and no gate lies below."""
    around: dict[int, list[int]] = {}
    for a, b in links:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    number, low, cut = dict.fromkeys(gates, 0), {}, set()
    for gate in sorted(gates & around.keys()):
        low[gate] = 0
        path, left = [gate], [iter(around[gate])]
        while path:
            node = path[-1]
            above = path[-2] if len(path) > 1 else None
            for to in left[-1]:
                if to == above:
                    continue
                if to not in number:  # other gates are met, not walked through
                    number[to] = low[to] = len(number) + 1
                    path.append(to)
                    left.append(iter(around[to]))
                    break
                low[node] = min(low[node], 0 if trees_only else number[to])
            else:
                path.pop()
                left.pop()
                if path:
                    if low[node] > number[path[-1]]:
                        cut.add((min(node, path[-1]), max(node, path[-1])))
                    else:
                        low[path[-1]] = min(low[path[-1]], low[node])
    reached, todo = set(gates), list(gates)
    while todo:
        node = todo.pop()
        for to in around.get(node, ()):
            if to not in reached and (min(node, to), max(node, to)) not in cut:
                reached.add(to)
                todo.append(to)
    return cut, reached


def peninsulas(links: DataFrame, cells: DataFrame, trees_only: bool = False) -> DataFrame:
    """links(a, b), cells(node, cell) -> (a, b, cut, reached), a < b: whether a link is cut, and whether its ends can still be reached from outside their cell.

    Nodes with a link into another cell are the gates of their cell, and links between cells are never cut. A link inside a cell is cut where it is the
    only way to what lies behind it and no gate does; with trees_only, only where no ring lies behind it either. So no way from
    one cell to another is lost, and what is cut off can only hold the start or goal of a route. Cells are searched side by side, each in one task: a cell is a
    tile of a fixed small size, as those that vector tiles and graph buckets are cut into, so its links are bounded by the land and not by the input. Loops, repeated
    links and links with nulls don't count; nodes without a cell drop out; parts of a cell without a gate aren't reached, and none of their links is cut."""
    of = lambda end: cells.select(F.col("node").alias(end), F.col("cell").alias(f"_{end}"))
    simple = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    placed = simple.join(of("a"), "a").join(of("b"), "b")
    away = placed.where("_a <> _b")
    gates = away.select("a").union(away.select("b")).distinct().withColumnRenamed("a", "gate")
    flag = lambda end: gates.select(F.col("gate").alias(end), F.lit(True).alias(f"{end}_gate"))
    inside = placed.where("_a = _b").join(flag("a"), "a", "left").join(flag("b"), "b", "left")

    def run(rows: list[dict]) -> list[tuple]:
        pairs = [(r["a"], r["b"]) for r in rows]
        at = {r[end] for r in rows for end in "ab" if r[f"{end}_gate"]}
        cut, reached = _cut_links(pairs, at, trees_only)
        return [(a, b, (a, b) in cut, a in reached and b in reached) for a, b in pairs]

    no = F.lit(False)
    found = by_groups(inside.select(F.col("_a").alias("cell"), "a", "b", F.coalesce("a_gate", no).alias("a_gate"), F.coalesce("b_gate", no).alias("b_gate")), "cell", [], run, "a long, b long, cut boolean, reached boolean")
    return found.union(away.select("a", "b", F.lit(False), F.lit(True)))
