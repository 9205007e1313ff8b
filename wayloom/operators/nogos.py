"""Areas that routes avoid: what they cost each edge, by the length that lies inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions.limits import inside_circle
from wayloom.operators.areas import in_polygon, segments_meet
from wayloom.operators.shared import cut


def inside_polygon(ax: Column, ay: Column, bx: Column, by: Column, ring: Column) -> Column:
    """How much of the segment a-b lies inside a closed ring, an array of structs(x, y); parts along its border count.

    The segment is cut where sides cross it; of each piece the middle says whether it is inside."""
    n, dx, dy = F.size(ring), bx - ax, by - ay

    def crossed(p: Column, q: Column) -> Column:
        ex, ey = q["x"] - p["x"], q["y"] - p["y"]
        turn = dx * ey - dy * ex
        t, u = ((p["x"] - ax) * ey - (p["y"] - ay) * ex) / turn, ((p["x"] - ax) * dy - (p["y"] - ay) * dx) / turn
        # a side along the segment ends where its ends lie on it
        along = lambda e: ((e["x"] - ax) * dx + (e["y"] - ay) * dy) / (dx * dx + dy * dy)
        on = (dx * dx + dy * dy > 0) & ((p["x"] - ax) * dy == (p["y"] - ay) * dx)
        return F.when(turn == 0, F.when(on, F.array(along(p), along(q)))).when((u >= 0) & (u <= 1), F.array(t))

    sides = F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1)).alias("q"))
    cuts = F.flatten(F.filter(F.transform(sides, lambda s: crossed(s["p"], s["q"])), lambda c: c.isNotNull()))
    ends = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(cuts, lambda t: (t > 0) & (t < 1)))))

    def piece(t: Column, u: Column) -> Column:
        return F.struct((u - t).alias("share"), (ax + dx * (t + u) / 2).alias("x"), (ay + dy * (t + u) / 2).alias("y"))

    # each step is bound by a lambda, so that nothing is worked out again for each of its uses
    pieces = F.transform(F.array(ends), lambda e: F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda i: piece(F.element_at(e, i), F.element_at(e, i + 1))))
    inside = F.aggregate(F.flatten(pieces), F.lit(0.0), lambda sum_, z: sum_ + F.when(in_polygon(z["x"], z["y"], ring), z["share"]).otherwise(0.0))
    return inside * F.sqrt(dx * dx + dy * dy)


def _meets_line(ax: Column, ay: Column, bx: Column, by: Column, line: Column) -> Column:
    sides = F.arrays_zip(F.slice(line, 1, F.size(line) - 1).alias("p"), F.slice(line, 2, F.size(line) - 1).alias("q"))
    return F.when(F.size(line) > 1, F.exists(sides, lambda s: segments_meet((ax, ay), (bx, by), (s["p"]["x"], s["p"]["y"]), (s["q"]["x"], s["q"]["y"])) > 0)).otherwise(F.lit(False))


#: Areas: a circle (points holds its centre) or a line of points, closed or not. A null weight forbids what the area meets.
AREAS = "aid long, points array<struct<x: double, y: double>>, radius double, closed boolean, weight double"


def _box(areas: DataFrame) -> DataFrame:
    side = lambda c, pick: pick(F.transform("points", lambda p: p[c]))
    r = F.coalesce("radius", F.lit(0.0))
    return areas.where("size(points) > 0").withColumns({"x0": side("x", F.array_min) - r, "x1": side("x", F.array_max) + r, "y0": side("y", F.array_min) - r, "y1": side("y", F.array_max) + r})


def _laid(df: DataFrame, size: float) -> DataFrame:
    """df(x0, x1, y0, y1, ...) a row a grid cell (cx, cy) that the box touches."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return df.select("*", cells("x0", "x1").alias("_cx")).select("*", cells("y0", "y1").alias("_cy"))


def usable_areas(areas: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """areas (see AREAS) without those that hold a waypoint of points(x, y): nobody could start or arrive there."""
    at = points.select(F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).distinct().where("px is not null and py is not null").withColumns({"_cx": F.floor(F.col("px") / size), "_cy": F.floor(F.col("py") / size)})
    px, py, p = F.col("px"), F.col("py"), F.element_at("points", 1)
    in_circle = (px - p["x"]) * (px - p["x"]) + (py - p["y"]) * (py - p["y"]) < F.col("radius") * F.col("radius")
    holds = F.when(F.col("radius").isNotNull(), in_circle).when(F.col("closed"), in_polygon(px, py, F.col("points"))).otherwise(_meets_line(px, py, px, py, F.col("points")))
    held = _laid(_box(areas), size).join(at, ["_cx", "_cy"]).where(holds).select("aid").distinct()
    return areas.join(held, "aid", "left_anti")


def with_area_costs(edges: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """edges(shape array<struct<x, y, ...>>, ...) with areacost: the sum over areas (see AREAS) of weight x length inside, or -1 if an area forbids the edge.

    A line that isn't closed costs its weight once for each section of the edge that it meets. Edges and areas meet by an equi join on cells of `size` that their boxes touch.
    Null weights forbid; areas without points do nothing; repeated edges are edges of their own."""
    kept = [c for c in edges.columns if c != "areacost"]
    own = cut(edges.select(F.monotonically_increasing_id().alias("_edge"), F.struct(*kept).alias("_all")))
    p = lambda i, c: F.element_at("_all.shape", i)[c].cast("double")
    sections = own.where("size(_all.shape) > 1").select("_edge", "_all", F.posexplode(F.sequence(F.lit(1), F.size("_all.shape") - 1)).alias("_n", "_i"))
    i = F.col("_i")
    sections = sections.select("_edge", "_n", p(i, "x").alias("ax"), p(i, "y").alias("ay"), p(i + 1, "x").alias("bx"), p(i + 1, "y").alias("by"))
    boxed = sections.where("ax <> bx or ay <> by").withColumns({"x0": F.least("ax", "bx"), "x1": F.greatest("ax", "bx"), "y0": F.least("ay", "by"), "y1": F.greatest("ay", "by")})
    box = {c: F.col(c).alias(f"_{c}") for c in ("x0", "x1", "y0", "y1")}
    laid = _laid(_box(areas), size).select("aid", "points", "radius", "closed", "weight", "_cx", "_cy", *box.values())
    # only where boxes meet, and there in the first cell that both touch: each pair once
    first = lambda c: F.floor(F.greatest(f"{c}0", f"_{c}0") / size)
    meet = (F.col("x0") <= F.col("_x1")) & (F.col("_x0") <= F.col("x1")) & (F.col("y0") <= F.col("_y1")) & (F.col("_y0") <= F.col("y1"))
    pairs = _laid(boxed, size).join(laid, ["_cx", "_cy"]).where(meet & (F.col("_cx") == first("x")) & (F.col("_cy") == first("y")))
    a = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    ring, one = F.col("points"), F.element_at("points", 1)
    inside = F.when(F.col("radius").isNotNull(), inside_circle(*a, one["x"], one["y"], F.col("radius"))).when(F.col("closed"), inside_polygon(*a, ring)).otherwise(_meets_line(*a, ring).cast("double"))
    costs = pairs.withColumn("_inside", inside).where("_inside > 0").groupBy("_edge").agg(F.sum(F.col("weight") * F.col("_inside")).alias("_cost"), F.max(F.col("weight").isNull()).alias("_no"))
    return own.join(costs, "_edge", "left").select("_all.*", F.when(F.col("_no"), -1.0).otherwise(F.coalesce("_cost", F.lit(0.0))).alias("areacost"))
