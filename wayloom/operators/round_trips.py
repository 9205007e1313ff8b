"""Round trips: where to head for from a start, by the ways around it, and the points of the trip; circles round polygons."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.functions import geo

# How far ways are looked for as a multiple of the radius, the spread of directions in degrees, and what is added to a circle.
REACH, SPREAD, MARGIN, EXTRA_M = 1.5, 60, 1.001, 1.0
DIRECTIONS = (90, 180, 270, 360)
#: Ways of a square that one group holds, about.
LOT = 100_000
#: Shifts of a circle's centre; where they don't settle, the circle grows round the centre that was reached.
MOST_SHIFTS = 1000


def directions(starts: DataFrame, ways: DataFrame, by: str, cell: int, seed: int | None = None) -> DataFrame:
    """starts(id, ilon, ilat, radius in metres, height), ways(ilon, ilat, height, forest, river) -> (id, direction): the quarter with the largest share of ways that are
    `by`: flat (within 50 m of the start's height), forest or river. Of equal ones the first from the east on clockwise, also where no ways are.

    Each quarter is a triangle from the start to two corners, 1.5 radii away; the four share their corners. Starts meet the ways of a square of `cell` units, which
    should be about as large as a triangle, in one group: what each square adds to a start's counts is worked out there, and no row is a pair of a start and a way. Squares with over LOT ways
    are split by hashes of places. With a seed the direction is spread by up to 30 degrees, by a hash of the id."""
    corner = lambda a: F.struct(*(c.alias(n) for n, c in zip("xy", geo.destination(F.col("ilon"), F.col("ilat"), F.col("radius") * REACH, F.lit(float(a))))))
    own = F.struct(F.col("ilon").cast("long").alias("x"), F.col("ilat").cast("long").alias("y"))
    laid = starts.select("id", F.col("height").cast("double").alias("_h"), F.array(own, *(corner(a) for a in (45, 135, 225, 315))).alias("ring"))
    laid = laid.select("id", "_h", F.transform("ring", lambda p: p["x"]).alias("xs"), F.transform("ring", lambda p: p["y"]).alias("ys"))
    span = lambda c: F.sequence(*(F.floor(f(c) / cell) for f in (F.array_min, F.array_max)))
    asked = laid.where(~F.exists("xs", lambda v: v.isNull()) & ~F.exists("ys", lambda v: v.isNull())).select("*", F.explode(span("xs")).alias("_cx")).select("*", F.explode(span("ys")).alias("_cy"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    placed = ways.where("ilon is not null and ilat is not null").select(F.col("ilon").cast("long").alias("ilon"), F.col("ilat").cast("long").alias("ilat"), F.col("height").cast("double").alias("height"), yes("forest"), yes("river"), F.floor(F.col("ilon") / cell).alias("_cx"), F.floor(F.col("ilat") / cell).alias("_cy"))
    lots = placed.groupBy("_cx", "_cy").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("_lots"))
    dealt = placed.join(lots, ["_cx", "_cy"]).withColumn("_lot", F.pmod(F.xxhash64("ilon", "ilat"), F.col("_lots")).cast("int")).drop("_lots")
    asked = asked.join(lots, ["_cx", "_cy"]).select("id", "_h", "xs", "ys", "_cx", "_cy", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)).alias("_lot"))
    by_square = ["_cx", "_cy", "_lot"]
    key = starts.schema["id"].dataType.simpleString()
    counted = asked.groupBy(*by_square).cogroup(dealt.groupBy(*by_square)).applyInPandas(_counted, f"id {key}, direction int, ways long, flat long, forest long, river long")
    counted = counted.groupBy("id", "direction").agg(*(F.sum(c).alias(c) for c in ("ways", "flat", "forest", "river")))
    share = (F.col(by) * 100.0 / F.col("ways")).cast("int").alias(by)
    quarters = starts.select("id", F.explode(F.array(*(F.lit(a) for a in DIRECTIONS))).alias("direction"))
    ranked = quarters.join(counted.select("id", "direction", share), ["id", "direction"], "left")
    best = ranked.groupBy("id").agg(F.max_by("direction", F.struct(F.coalesce(by, F.lit(0)), -F.col("direction"))).alias("direction"))
    return best if seed is None else best.withColumn("direction", F.col("direction") - SPREAD // 2 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(SPREAD)).cast("int"))


def _counted(starts: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
    """Of every start and quarter: the ways of one square in it, and how many are flat, in forest, by a river. Borders of a triangle count as inside."""
    ways = ways.sort_values("ilat", kind="stable")
    x, y, height = (ways[c].to_numpy() for c in ("ilon", "ilat", "height"))
    marks = ways["forest"].to_numpy(dtype=bool), ways["river"].to_numpy(dtype=bool)
    rows = []
    for key, h, xs, ys in zip(starts["id"], starts["_h"], starts["xs"], starts["ys"]):
        part = slice(np.searchsorted(y, ys.min(), "left"), np.searchsorted(y, ys.max(), "right"))
        held = np.flatnonzero((x[part] >= xs.min()) & (x[part] <= xs.max())) + part.start
        if not len(held):
            continue
        px, py, flat = x[held], y[held], np.abs(height[held] - h) < 50
        forest, river = marks[0][held], marks[1][held]
        side = lambda i, j: (xs[j] - xs[i]) * (py - ys[i]) - (ys[j] - ys[i]) * (px - xs[i])
        rays = [side(0, k) for k in (1, 2, 3, 4)]
        for k, direction in enumerate(DIRECTIONS):
            i, j = k + 1, (k + 1) % 4 + 1
            a, b, c = rays[k], side(i, j), -rays[j - 1]
            ring = [0, i, j]
            # a triangle without area holds what lies on its line, between its ends
            inside = (((a >= 0) & (b >= 0) & (c >= 0)) | ((a <= 0) & (b <= 0) & (c <= 0))) & (px >= xs[ring].min()) & (px <= xs[ring].max()) & (py >= ys[ring].min()) & (py <= ys[ring].max())
            n = int(np.count_nonzero(inside))
            if n:
                rows.append((key, direction, n, *(int(np.count_nonzero(inside & m)) for m in (flat, forest, river))))
    return pd.DataFrame(rows, columns=["id", "direction", "ways", "flat", "forest", "river"])


def trip_points(starts: DataFrame, points: int = 5, same_way_back: bool = False) -> DataFrame:
    """starts(id, ilon, ilat, radius, direction) -> (id, seq, ilon, ilat): the start, points - 1 others spread over the half circle ahead, and the start again; or one straight ahead if the way back is to be the same."""
    at = lambda d: F.struct(*(c.alias(n) for n, c in zip(("ilon", "ilat"), geo.destination(F.col("ilon"), F.col("ilat"), F.col("radius").cast("double"), F.col("direction") + F.lit(d)))))
    own = F.struct(F.col("ilon").cast("long").alias("ilon"), F.col("ilat").cast("long").alias("ilat"))
    between = [at(0.0)] if same_way_back else [at(180.0 * i / points - 90) for i in range(1, points)]
    return starts.select("id", F.posexplode(F.array(own, *between, *([] if same_way_back else [own]))).alias("seq", "p")).select("id", "seq", "p.*")


def _metres_of_unit(ilat: int) -> tuple[float, float]:
    """`geo.ruler` for one latitude."""
    phi = math.radians(min(max(ilat // 100000, 0), 1799) / 10 + 0.05 - 90)
    return (111.41513 * math.cos(phi) - 0.09455 * math.cos(3 * phi) + 0.00012 * math.cos(5 * phi)) * 1e-3, (111.13209 - 0.56605 * math.cos(2 * phi) + 0.0012 * math.cos(4 * phi)) * 1e-3


def circle_round(xs: np.ndarray, ys: np.ndarray) -> tuple[int, int, float]:
    """(x, y, radius in metres) of a circle that holds all points, hardly larger than the smallest one.

    From the centre of the box on, the centre is shifted towards the point that lies farthest outside, by as much as takes it in without letting go of the other side."""

    def away(x: int, y: int) -> np.ndarray:
        kx, ky = _metres_of_unit(y)
        return np.sqrt(((x - xs) * kx) ** 2 + ((y - ys) * ky) ** 2)

    x, y, radius = int(xs.min() + xs.max()) // 2, int(ys.min() + ys.max()) // 2, 0.0
    for _ in range(MOST_SHIFTS):
        far = away(x, y)
        k = int(far.argmax())
        if far[k] <= radius:
            break
        part = 0.5 * (1 - radius / far[k])
        x, y = x + int(part * (xs[k] - x) + 0.5), y + int(part * (ys[k] - y) + 0.5)
        radius = float(away(x, y)[k])
    else:
        radius = max(radius, float(away(x, y).max()))
    return x, y, radius * MARGIN + EXTRA_M


_RULER = np.array([_metres_of_unit(k * 100000) for k in range(1800)])


def circles_round(xs: np.ndarray, ys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`circle_round` of many rings side by side, none empty: ring k begins at starts[k] of xs and ys. Rings whose circle has settled drop out."""
    sizes = np.diff(starts, append=len(xs))
    most, least = np.maximum.reduceat, np.minimum.reduceat
    cx, cy, radius = (least(xs, starts) + most(xs, starts)) // 2, (least(ys, starts) + most(ys, starts)) // 2, np.zeros(len(starts))
    left, px, py, n, at, settled = np.arange(len(starts)), xs, ys, sizes, starts, np.zeros(len(starts), dtype=bool)

    def away(x, y, px, py):
        k = _RULER[np.clip(y // 100000, 0, 1799)]
        return np.sqrt(((x - px) * k[:, 0]) ** 2 + ((y - py) * k[:, 1]) ** 2)

    for _ in range(MOST_SHIFTS):
        far = away(np.repeat(cx[left], n), np.repeat(cy[left], n), px, py)
        top = most(far, at)
        out = top > radius[left]
        settled[left[~out]] = True
        row = np.where(far == np.repeat(top, n), np.arange(len(far)), len(far))
        first = least(row, at)[out]
        inner = np.repeat(out, n)
        fx, fy, top, left, n = px[first], py[first], top[out], left[out], n[out]
        if not len(left):
            break
        px, py, at = px[inner], py[inner], np.cumsum(n) - n
        part = 0.5 * (1 - radius[left] / top)
        cx[left] += np.trunc(part * (fx - cx[left]) + 0.5).astype(np.int64)
        cy[left] += np.trunc(part * (fy - cy[left]) + 0.5).astype(np.int64)
        radius[left] = away(cx[left], cy[left], fx, fy)
    else:
        radius[left] = np.maximum(radius[left], most(away(np.repeat(cx[left], n), np.repeat(cy[left], n), px, py), at))
    return cx, cy, radius * MARGIN + EXTRA_M


def bounding_circles(polygons: DataFrame, ring: str = "ring") -> DataFrame:
    """polygons(id, ring array<struct<x, y>> in E6 units) -> (id, x, y, radius). Rings that are null or empty give nulls. All rings of an Arrow batch are worked out side by side."""
    key_type = polygons.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n").to_numpy(zero_copy_only=False)
            some = np.flatnonzero(sizes > 0)
            values = [np.full(batch.num_rows, 0, dtype=np.int64) for _ in "xy"] + [np.zeros(batch.num_rows)]
            if len(some):
                xs, ys = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("xs", "ys"))
                for value, found in zip(values, circles_round(xs, ys, (np.cumsum(sizes) - sizes)[some])):
                    value[some] = found
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, mask=sizes <= 0) for v in values)], names=["id", "x", "y", "radius"])

    part = lambda c: F.coalesce(F.transform(F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), lambda p: p[c].cast("long")), F.array().cast("array<bigint>")).alias(f"{c}s")
    return polygons.select("id", part("x"), part("y")).select("id", "xs", "ys", F.size("xs").cast("long").alias("n")).mapInArrow(run, f"id {key_type}, x long, y long, radius double")


def inside(x: Column, y: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """Whether a point lies in a circle, by the lengths at the circle's centre."""
    kx, ky = geo.ruler(cy)
    return F.sqrt(F.pow((x - cx) * kx, 2) + F.pow((y - cy) * ky, 2)) <= radius
