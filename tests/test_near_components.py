"""Components of near points against those of their pairs."""

import random

import pytest

from wayloom.operators import graph


@pytest.mark.parametrize("n, parts, width", [(120, 2, 400), (250, 40, 300), (150, 1, 100), (200, 3, 120)])
def test_near_components_are_those_of_the_pairs(spark, n, parts, width):
    r = random.Random(n)
    rows = [(k, r.randrange(parts), r.randrange(-width, width), r.randrange(width)) for k in range(n)]
    # a cell holds one part alone here and there, and places repeat
    rows += [(n + k, rows[k][1], rows[k][2], rows[k][3]) for k in range(10)]
    points = spark.createDataFrame(rows, "id long, part long, x long, y long")
    of = lambda df: {row.node: row.component for row in df.collect()}
    assert of(graph.near_components(points, 25)) == of(graph.components(graph.near_pairs(points, 25)))


def test_cells_of_one_part_stay_apart_unless_another_part_is_near(spark):
    rows = [(1, 0, 1, 1), (2, 0, 2, 2), (3, 1, 20, 1), (4, 1, 24, 1), (5, 0, 90, 1)]
    points = spark.createDataFrame(rows, "id long, part long, x long, y long")
    assert {row.node: row.component for row in graph.near_components(points, 21).collect()} == {1: 1, 2: 1, 3: 1}


def test_boxes_after_one_that_holds_the_cell_dont_travel(spark, monkeypatch):
    from wayloom.operators import regions

    kept = []
    monkeypatch.setattr(regions, "cut", lambda df: kept.append(df.count()) or df)
    boxes = spark.createDataFrame([(k, 1_000_000 if k == 2 else -1, 5_000_001, -1, 5_000_001) for k in range(2, 40)], "rid long, west long, east long, south long, north long")
    points = spark.createDataFrame([(1, 10, 10), (2, 4_000_000, 10), (3, 6_000_000, 10)], "id long, ilon long, ilat long")
    assert {r.id: r.rid for r in regions.first_region(points, boxes).collect()} == {1: 3, 2: 2}
    # 37 boxes in 12 cells and one in 6; in cell (0, 0), on both sides of the date line, the 36 after the first whole one go
    assert kept == [37 * 12 + 6 - 2 * 36]


def test_groups_come_whole_and_sorted_whatever_the_batches(spark):
    from wayloom.operators.shared import by_groups

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = spark.createDataFrame([(g, k) for g in range(7) for k in reversed(range(g + 1))], "g long, k long")
        found = by_groups(rows, "g", ["k"], lambda rows: [(rows[0]["g"], ",".join(str(r["k"]) for r in rows))] if rows[0]["g"] != 3 else [], "g long, ks string")
        assert {r.g: r.ks for r in found.collect()} == {g: ",".join(map(str, range(g + 1))) for g in range(7) if g != 3}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
