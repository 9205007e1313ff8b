"""Queries of peninsulas in a grid of streets that lacks many links, in cells of 40 nodes, with SQL that takes out each link in turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import peninsulas
from wayloom.plans.derived import cte, derived
from wayloom.plans.registry import query

#: Links of the grid to the right and up that exist; cells are 8 x 5 nodes.
_LINKS = "n AS (SELECT id, gx // 8 * 100000 + gy // 5 AS cell FROM streets), l AS (SELECT p.id AS a, q.id AS b, p.cell AS ca, q.cell AS cb FROM n p JOIN n q ON (q.id = p.id + 1 AND p.id % 40 < 39 AND p.id * 7919 % 13 < 7) OR (q.id = p.id + 40 AND p.id * 104729 % 11 < 6))"
_WITHOUT = """g AS (SELECT a AS gate, ca AS cell FROM l WHERE ca <> cb UNION SELECT b, cb FROM l WHERE ca <> cb),
  i AS (SELECT a, b, ca AS cell FROM l WHERE ca = cb), s AS (SELECT a AS u, b AS v, cell FROM i UNION ALL SELECT b, a, cell FROM i),
  w AS (SELECT a, b, cell FROM i UNION ALL SELECT -1, -1, cell FROM (SELECT DISTINCT cell FROM i)),
  r AS (SELECT w.a, w.b, w.cell, gate AS node FROM w JOIN g USING (cell) UNION SELECT r.a, r.b, r.cell, s.v FROM r JOIN s ON s.cell = r.cell AND s.u = r.node AND NOT (least(s.u, s.v) = r.a AND greatest(s.u, s.v) = r.b)),
  k AS (SELECT i.a, i.b, EXISTS (SELECT 1 FROM r WHERE r.a = -1 AND r.cell = i.cell AND r.node = i.a) AND NOT (EXISTS (SELECT 1 FROM r WHERE r.a = i.a AND r.b = i.b AND r.node = i.a) AND EXISTS (SELECT 1 FROM r WHERE r.a = i.a AND r.b = i.b AND r.node = i.b)) AS cut, i.cell FROM i)"""


@query("graph_peninsulas", f"WITH RECURSIVE {cte('streets')}, {_LINKS}, {_WITHOUT} SELECT a, b, cut FROM k UNION ALL SELECT a, b, FALSE FROM l WHERE ca <> cb")
def graph_peninsulas(spark, sf_dir):
    return peninsulas.peninsulas(*_graph(spark, sf_dir)).select("a", "b", "cut")


@query("graph_tree_peninsulas")
def graph_tree_peninsulas(spark, sf_dir):
    return peninsulas.peninsulas(*_graph(spark, sf_dir), trees_only=True)


def _graph(spark, sf_dir):
    nodes = derived(spark, sf_dir, "streets").select("id", "gx", "gy")
    k, there = F.col("id"), nodes.select(F.col("id").alias("b"))
    right = nodes.where((k % 40 < 39) & (k * 7919 % 13 < 7)).select(k.alias("a"), (k + 1).alias("b"))
    up = nodes.where(k * 104729 % 11 < 6).select(k.alias("a"), (k + 40).alias("b"))
    cells = nodes.select(k.alias("node"), (F.floor(F.col("gx") / 8) * 100000 + F.floor(F.col("gy") / 5)).alias("cell"))
    return right.union(up).join(there, "b", "left_semi").select("a", "b"), cells
