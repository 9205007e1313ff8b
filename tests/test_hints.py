"""Commands and hints against cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from wayloom.operators import hints

L, R = hints.NO_LEFT, hints.NO_RIGHT

# angle, next way to the left, next way to the right, command
COMMANDS = [
    (0, L, R, "C"), (0, -29, R, "KR"), (0, -31, R, "C"), (0, L, 29, "KL"), (0, -20, 20, "KR"), (-4.9, L, 29, "KL"), (-5, -90, 40, "C"), (-5.1, -90, 40, "KL"), (-5.1, -101, 40, "TSLL"), (5, -90, 40, "C"), (5, -44, 101, "TSLR"), (5, -44, 100, "KR"),
    (20, -56, 34, "KL"), (20, -55, 34, "C"), (20, -90, 90, "C"), (21, L, R, "TSLR"), (-21, L, R, "C"), (-21, -30, 60, "KR"), (-21.5, L, R, "TSLL"), (-10, -34, 56, "KR"), (-10, -100, 44, "KL"), (-10, -101, 44, "TSLL"), (-10, -101, 90, "C"),
    (44, L, R, "TSLR"), (45, L, R, "TSLR"), (59, L, R, "TSLR"), (60, L, R, "TR"), (90, 0, R, "TR"), (84, 0, 120, "TSLR"), (86, 0, 120, "TR"), (84, 11, 120, "TR"), (100, 31, R, "TSHR"), (100, 31, 170, "TR"), (111, L, R, "TSHR"), (110, L, R, "TR"),
    (-45, L, R, "TSLL"), (-60, L, R, "TL"), (-90, L, 0, "TL"), (-84, -120, 0, "TSLL"), (-100, L, -31, "TSHL"), (-100, L, 20, "TL"), (-111, L, R, "TSHL"), (-135, L, R, "TSHL"), (-136, -170, 0, "TSHL"), (-159, L, R, "TSHL"), (-160, L, R, "TLU"),
    (134, L, R, "TSHR"), (135, 0, R, "TSHR"), (158, L, R, "TSHR"), (159, L, R, "TRU"), (178, L, R, "TRU"), (179.5, L, R, "TU"), (180, 0, R, "TRU"), (-180, L, R, "TU"), (-180, -170, 90, "TLU"),
]


def test_commands(spark):
    df = spark.createDataFrame([(float(a), float(b), float(c), w) for a, b, c, w in COMMANDS], "a double, l double, h double, want string")
    got = df.select("a", "l", "h", "want", hints.turn_command(F.col("a"), F.col("l"), F.col("h")).alias("got"), hints.turn_command(F.col("a"), F.col("l"), F.col("h"), F.lit("KR")).alias("kept")).collect()
    assert [r for r in got if r.want != r.got] == []
    assert [r for r in got if r.kept != ("KR" if -45 <= r.a < -21 else r.got)] == []
    assert {w for *_, w in COMMANDS} == {"C", "KL", "KR", "TSLL", "TL", "TSHL", "TLU", "TSLR", "TR", "TSHR", "TRU", "TU"}


def node(seq, angle=0.0, metres=100.0, bad=(), route=1, **more):
    row = dict(route=route, seq=seq, angle=float(angle), metres=float(metres), prio=20, old_prio=20, link=False, old_link=False, roundabout=False, give_way=False, beeline=False) | more
    ways = [dict(turn=float(t), prio=20, link=False, oneway=False, factor=1.0, car=True) | w for t, w in bad]
    return (*row.values(), [tuple(w.values()) for w in ways])


def of(spark, nodes, **how):
    return [(r.seq, r.command, r.angle, r.exit, r.metres) for r in sorted(hints.route_hints(spark.createDataFrame(nodes, hints.NODES), **how).collect(), key=lambda r: (r.route, r.seq))]


W = lambda turn, **more: (turn, more)


@pytest.mark.parametrize(
    "nodes, want",
    [
        ([node(0), node(1, 90), node(2)], []),  # a bend without other ways
        ([node(0), node(1, 90, bad=[W(0)]), node(2)], [(1, "TR", 90.0, 0, 100.0)]),
        ([node(0), node(1, -90, bad=[W(0), W(90)]), node(2)], [(1, "TL", -90.0, 0, 100.0)]),
        ([node(0), node(1, 2, bad=[W(90)]), node(2)], []),  # straight on, a side way of the same class, at right angles
        ([node(0), node(1, 2, bad=[W(-20)]), node(2)], [(1, "KR", 2.0, 0, 100.0)]),  # a fork
        ([node(0), node(1, 0, bad=[W(90, prio=25)]), node(2)], [(1, "C", 0.0, 0, 100.0)]),  # the better road turns off
        ([node(0), node(1, 0, bad=[W(90, prio=5)]), node(2)], []),
        ([node(0), node(1, 30, bad=[W(0, prio=5)]), node(2)], [(1, "TSLR", 30.0, 0, 100.0)]),  # a lesser way lies straighter
        ([node(0), node(1, 30, bad=[W(0, prio=5, oneway=True, factor=99.0)]), node(2)], []),
        ([node(0), node(1, 3, bad=[W(90, prio=20)], give_way=True), node(2)], [(1, "C", 3.0, 0, 100.0)]),
        ([node(0, give_way=True), node(1, 3, bad=[W(90, prio=20)]), node(2)], [(1, "C", 3.0, 0, 100.0)]),
        ([node(0), node(1, 180), node(2)], [(1, "TU", 180.0, 0, 100.0)]),
        ([node(0), node(1, 50, 6, bad=[W(0)]), node(2, 45, 50), node(3)], [(1, "TR", 95.0, 0, 156.0 - 6)]),  # a bend right after belongs to it
        ([node(0), node(1, 40, 1, bad=[W(0)]), node(2, 40, 80, bad=[W(0)]), node(3)], [(1, "TR", 80.0, 0, 81.0)]),  # two turns within 2 m
        ([node(0, beeline=True), node(1)], [(0, "BL", 0.0, 0, 0.0)]),
    ],
)
def test_hints_by_hand(spark, nodes, want):
    assert [(s, c, a) for s, c, a, _, _ in of(spark, nodes)] == [(s, c, a) for s, c, a, _, _ in want]


def test_giving_way_is_for_vehicles(spark):
    nodes = [node(0), node(1, 3, bad=[W(90)], give_way=True), node(2)]
    assert of(spark, nodes, on_foot=True) == []


def test_roundabout_exits_and_distances(spark):
    ring = dict(roundabout=True)
    third = [
        node(0), node(1, 30, 20, bad=[W(-60, oneway=True, factor=99.0)]),  # onto the ring
        node(2, -40, 30, bad=[W(40)], **ring), node(3, -40, 30, bad=[W(40)], **ring), node(4, -40, 30, **ring),  # two exits are passed, a bend
        node(5, 35, 60, bad=[W(-45)], **ring), node(6, 0, 80), node(7, 90, 70, bad=[W(0)]), node(8),
    ]
    got = of(spark, third)
    assert [(s, c, e) for s, c, _, e, _ in got] == [(1, "RNDB", 3), (7, "TR", 0)]
    assert got[0][2] == pytest.approx(-40 * 3 - 45) and got[0][4] == pytest.approx(20 + 30 * 3 + 60 + 80)
    other = [node(0, route=2), node(1, -30, 20, route=2), node(2, 40, 30, bad=[W(-40, car=False)], route=2, **ring), node(3, 35, 60, bad=[W(60)], route=2, **ring), node(4, route=2)]
    both = of(spark, third + other)
    assert both[:2] == got and [(s, c, e) for s, c, _, e, _ in both[2:]] == [(1, "RNLB", -1)]


def test_hints_of_no_routes(spark):
    assert hints.route_hints(spark.createDataFrame([], hints.NODES)).count() == 0
    nothing = spark.createDataFrame([(*node(0)[:-1], None), (*node(1, 180.0)[:-1], None)], hints.NODES)
    assert [r.command for r in hints.route_hints(nothing).collect()] == ["TU"]


def test_routes_meet_the_ways_of_all_lines(spark, tmp_path):
    from wayloom.plans.hint_queries import hint_routes

    spark.createDataFrame([(10, 1)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(10, 1, 1, 5)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    angle = 10 * 37 % 359 - 179  # -168: only where there is another way does it need a hint
    assert [(r.route, r.seq, r.angle) for r in hint_routes(spark, str(tmp_path)).collect()] == [(1, 10, float(angle))]


def test_nested_columns_as_rows(spark):
    import pyarrow as pa

    from wayloom.operators.shared import plain

    way = pa.struct([("turn", pa.float64()), ("car", pa.bool_())])
    ways = [[{"turn": 1.5, "car": True}, {"turn": None, "car": False}], [], None, [None], [{"turn": -2.0, "car": None}]]
    for column in (pa.array(ways, pa.list_(way)), pa.array(ways, pa.list_(way))[1:], pa.array([1, None, 3]), pa.array([1, 2]), pa.array(["a", None]), pa.array([True, False]), pa.array([[[1], []], None, [[2, 3]]], pa.list_(pa.list_(pa.int64()))), pa.array([], pa.list_(way))):
        assert plain(column) == column.to_pylist()
