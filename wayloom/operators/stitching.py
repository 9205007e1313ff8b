"""Loose ends of fragments of ways joined to what they nearly touch, as if one end after the other had been looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.operators.shared import components, cut


#: What grows with the graph is joined by a merge: a table's size tells nothing of the rows made of it, and as a broadcast they would all pass through the driver.
GROWS = "merge"
#: Parts that a span of dates is split into, a level.
FAN = 16


def _numbered(rows: DataFrame) -> DataFrame:
    """rows(time, ...) with pos, gapless from 0 in the order of time: a sort by ranges, then offsets a range."""
    sorted_ = cut(rows.repartitionByRange("time").sortWithinPartitions("time").withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    each = sorted_.groupBy("_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")).select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a partition
    return sorted_.join(F.broadcast(each), "_part").withColumn("pos", F.col("_row") - F.col("_first") + F.col("_before")).drop("_part", "_row", "_first", "_before")


def connected_before(edges: DataFrame, asked: DataFrame, fan: int = FAN) -> DataFrame:
    """edges(a, b, time), asked(q, a, b, time) -> the q of which any a and b are connected by edges of earlier dates alone. Dates may be of any ordered type.

    Spans of dates are split into fan parts, level by level, as many levels as the number of dates has digits. Whoever asks in a part takes what the
    parts before it (inside their common span) connect as one node, and goes on inside its part with what is left: one run of components a level for
    all parts at once, and no task holds a group of nodes."""
    rows = asked.select("q", "a", "b", "time").union(edges.select(F.lit(None).cast(asked.schema["q"].dataType), "a", "b", "time"))
    rows = cut(_numbered(rows.where("a <> b")))
    span = fan
    while span < (rows.agg(F.max("pos")).first()[0] or 0) + 1:
        span *= fan
    out = asked.where("a = b").select("q")
    while span > 1:
        part = span // fan
        own = rows.withColumn("child", F.expr(f"pos div {part}"))
        wanted = own.where("q is not null").select("child").distinct()
        upto = F.expr(f"(pos div {span} + 1) * {fan} - 1")
        ahead = own.where("q is null").withColumn("child", F.explode(F.when(F.col("child") < upto, F.sequence(F.col("child") + 1, upto)))).join(wanted.hint(GROWS), "child", "left_semi")
        node = lambda c: F.struct("child", F.col(c).alias("node"))
        groups = components(ahead.select(node("a").alias("a"), node("b").alias("b"))).select("node.child", "node.node", F.col("component.node").alias("root"))
        to = lambda c: groups.select("child", F.col("node").alias(c), F.col("root").alias(f"_{c}")).hint(GROWS)
        moved = own.join(wanted.hint(GROWS), "child", "left_semi").join(to("a"), ["child", "a"], "left").join(to("b"), ["child", "b"], "left")
        moved = cut(moved.select("q", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "pos").distinct())
        out = out.union(moved.where("q is not null and a = b").select("q"))
        rows, span = moved.where("a <> b"), part
    return out.distinct()


def _near(x: Column, y: Column, px: Column, py: Column, limit: int) -> Column:
    return (x - px) * (x - px) + (y - py) * (y - py) < limit * limit


def _laid_near(segments: DataFrame, limit: int, size: int) -> DataFrame:
    """segments(ax, ay, bx, by, ...) a row a cell (cx, cy) of `size` that may hold points nearer than limit: column by column, where the segment runs in what is within limit of the column."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size)))
    columns = segments.select("*", cells(F.least(ax, bx) - limit, F.greatest(ax, bx) + limit).alias("cx"))
    left, right = F.greatest(F.least(ax, bx), F.col("cx") * size - limit), F.least(F.greatest(ax, bx), (F.col("cx") + 1) * size + limit)
    at = lambda x, upright: F.when(ax == bx, upright).otherwise(ay + (x - ax) / (bx - ax) * (by - ay))
    y0, y1 = at(left, ay), at(right, by)
    return columns.select("*", cells(F.least(y0, y1) - limit - 1, F.greatest(y0, y1) + limit + 1).alias("cy"))


def stitched(fragments: DataFrame, positions: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """fragments(fid, k, nid), positions(nid, x, y in whole units) -> fragments joined at loose ends (fid, k, nid), and what was put in: (fid, k, t, nid).

    Ends of fragments are looked at in the order of fid, first end before last, a node once; segments near an end in the order of (fid, k):
    - a vertex nearer than limit becomes one node with the end (the segment's first, else its second);
    - where only the inside of a segment is nearer than limit, the end's node is put into it at its place t, once a fragment, unless the
      fragment by then has a node that is one with the end.
    Nodes that have become one have the least id of them; repeats in a row are dropped; places of several ends in a segment are in order of t.
    Decisions equal those of the walk from end to end, but are made at once: what is one is a graph of dated edges, and whether a fragment has a
    node of its end at a date is asked of it (see `connected_before`). Segments are laid in the cells of 4 x limit that they come within limit of, and meet ends by an equi join on the end's own cell: each pair once."""
    place = lambda p: positions.select(F.col("nid").alias(p), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")).hint(GROWS)
    nodes = cut(fragments.select("fid", "k", "nid"))
    on = Window.partitionBy("fid").orderBy("k")
    segments = nodes.select("fid", "k", F.col("nid").alias("a"), F.lead("nid").over(on).alias("b")).where("b is not null and a <> b").join(place("a"), "a").join(place("b"), "b")
    ends = nodes.groupBy("fid").agg(F.min(F.struct("k", "nid")).alias("p"), F.max(F.struct("k", "nid")).alias("q"))
    ends = ends.select(F.explode(F.array(F.struct(F.col("p.nid").alias("nid"), (F.col("fid") * 2).alias("turn")), F.struct(F.col("q.nid").alias("nid"), (F.col("fid") * 2 + 1).alias("turn")))).alias("e"))
    ends = ends.groupBy("e.nid").agg(F.min("e.turn").alias("turn")).join(positions.hint(GROWS), "nid")
    size = 4 * limit
    laid = _laid_near(segments, limit, size)
    asked = ends.select("nid", "turn", "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    x, y, ax, ay, bx, by, dx, dy = (F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by", "dx", "dy"))
    around = lambda p, u, v: (p >= F.least(u, v) - limit) & (p <= F.greatest(u, v) + limit)
    met = asked.join(laid.hint(GROWS), ["cx", "cy"]).where(around(x, ax, bx) & around(y, ay, by) & F.expr("nid <> a and nid <> b"))
    # generators, so that no step is worked out again for each of its uses
    met = met.select("nid", "turn", "fid", "k", "a", "b", "x", "y", "ax", "ay", "bx", "by", F.inline(F.array(F.struct((bx - ax).alias("dx"), (by - ay).alias("dy")))))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy).cast("double") / (dx * dx + dy * dy)))
    met = met.select("*", F.inline(F.array(F.struct(F.when((dx != 0) | (dy != 0), t).otherwise(F.lit(0.0)).alias("t")))))
    near_a, near_b, inside = _near(x, y, ax, ay, limit), _near(x, y, bx, by, limit), _near(x.cast("double"), y.cast("double"), ax + F.col("t") * dx, ay + F.col("t") * dy, limit)
    found = F.when(near_a, F.col("a")).when(near_b, F.col("b"))
    met = cut(met.where(near_a | near_b | inside).select("nid", "fid", "k", "t", F.struct("turn", "fid", "k").alias("time"), found.alias("to")))
    dated = cut(met.where("to is not null").select(F.least("nid", "to").alias("a"), F.greatest("nid", "to").alias("b"), "time").groupBy("a", "b").agg(F.min("time").alias("time")))
    one = cut(components(dated).select(F.col("node").alias("nid"), F.col("component").alias("root")))
    # of each end and fragment, the first place counts alone: what a fragment shares once, it shares for good
    tried = met.where("to is null").groupBy("nid", "fid").agg(F.min(F.struct("time", "k", "t")).alias("m")).select("nid", "fid", "m.time", "m.k", "m.t")
    tried = cut(tried.join(nodes.select("fid", "nid").distinct().hint(GROWS), ["fid", "nid"], "left_anti"))
    asks = tried.select(F.struct("nid", "fid").alias("q"), F.col("nid").alias("a"), "fid", "time").join(one.withColumnRenamed("nid", "a").hint(GROWS), "a")
    theirs = nodes.select("fid", F.col("nid").alias("b")).distinct().join(one.withColumnRenamed("nid", "b").hint(GROWS), "b")
    shared = connected_before(dated, asks.join(theirs.hint(GROWS), ["fid", "root"]).select("q", "a", "b", "time")).select("q.nid", "q.fid")
    put = cut(tried.join(shared.hint(GROWS), ["nid", "fid"], "left_anti").select("fid", "k", "t", "nid"))
    all_nodes = nodes.select("fid", "k", F.lit(-1.0).alias("t"), "nid").union(put).join(one.hint(GROWS), "nid", "left").select("fid", "k", "t", F.coalesce("root", "nid").alias("nid"))
    order = Window.partitionBy("fid").orderBy("k", "t", "nid")
    kept = all_nodes.withColumn("_before", F.lag("nid").over(order)).where("_before is null or _before <> nid")
    return kept.select("fid", (F.row_number().over(order) - 1).cast("long").alias("k"), "nid"), put
