"""Regions, five-degree buckets and tile chunks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators.shared import cut

CHUNK_TILES = 64
CELL = 5_000_000
WORLD = 360_000_000


def chunks(tiles: DataFrame, cx: int, cy: int) -> DataFrame:
    """tiles(x, y) in chunks of 64 x 64: their number and squared distance from an anchor chunk."""
    c = tiles.groupBy(F.floor(F.col("x") / CHUNK_TILES).alias("cx"), F.floor(F.col("y") / CHUNK_TILES).alias("cy")).agg(F.count(F.lit(1)).alias("tiles"))
    return c.withColumn("far", (F.col("cx") - cx) * (F.col("cx") - cx) + (F.col("cy") - cy) * (F.col("cy") - cy))


def _cells(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / CELL), F.floor(high / CELL))


def first_region(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """points(id, ilon, ilat), boxes(rid, west, east, south, north) -> (id, rid): the first box in order of rid that holds a point.

    Boxes are laid in grid cells, so this is an equi join on the cell with a check; a box over the date line is laid on both sides.
    In a cell no box counts that comes after one which holds the whole cell."""
    turns = F.explode(F.array(*(F.lit(t).cast("long") for t in (-WORLD, 0, WORLD))))
    sides = boxes.withColumn("turn", turns).selectExpr("rid", "west + turn as west", "east + turn as east", "south", "north").where(f"east >= 0 and west < {WORLD}")
    laid = sides.select("*", F.explode(_cells(F.greatest("west", F.lit(0)), F.least("east", F.lit(WORLD)))).alias("cx")).select("*", F.explode(_cells(F.col("south"), F.col("north"))).alias("cy"))
    whole = (F.col("west") <= F.col("cx") * CELL) & (F.col("east") >= (F.col("cx") + 1) * CELL) & (F.col("south") <= F.col("cy") * CELL) & (F.col("north") >= (F.col("cy") + 1) * CELL)
    last = laid.groupBy("cx", "cy").agg(F.min(F.when(whole, F.col("rid"))).alias("_last"))
    laid = cut(laid.join(last, ["cx", "cy"]).where("_last is null or rid <= _last").drop("_last"))
    at = points.select("id", "ilon", "ilat", F.floor(F.col("ilon") / CELL).alias("cx"), F.floor(F.col("ilat") / CELL).alias("cy"))
    held = at.join(laid, ["cx", "cy"]).where("ilon between west and east and ilat between south and north")
    return held.groupBy("id").agg(F.min("rid").alias("rid"))


def nearest_region(points: DataFrame, centres: DataFrame) -> DataFrame:
    """points(id, ilon, ilat), centres(id, ilon, ilat) -> (id, rid): the centre at the least folded squared distance, the smaller id first.

    Centres are laid in a grid of about as many cells as there are centres. A point looks into the cells around its own,
    twice as far each time (an equi join), until the best centre is no farther than what these cells cover for sure;
    points go on only until then, and the last reach covers the whole grid. Longitudes fold: cells count round the globe."""
    n = centres.count()
    if not n:
        return points.select("id", F.lit(None).cast(centres.schema["id"].dataType).alias("rid"))
    across = max(3, min(1 << 15, math.isqrt(2 * n)))
    size = -(-WORLD // across)
    across = -(-WORLD // size)  # the last column may be narrower
    low, high = centres.agg(F.floor(F.min("ilat") / size), F.floor(F.max("ilat") / size)).first()
    column = lambda c: F.floor(F.pmod(c.cast("long"), F.lit(WORLD)) / size)
    laid = centres.select(F.col("id").alias("rid"), F.col("ilon").alias("clon"), F.col("ilat").alias("clat"), column(F.col("ilon")).alias("cx"), F.floor(F.col("ilat") / size).alias("cy"))
    places = points.select("ilon", "ilat").distinct()
    out, left, reach = None, places, 2
    while True:
        last = 2 * reach + 1 >= across
        if last:  # every column, every row that holds centres
            xs, y0, y1 = F.sequence(F.lit(0), F.lit(across - 1)), F.lit(low), F.lit(high)
        else:
            x, y = column(F.col("ilon")), F.floor(F.col("ilat") / size)
            xs = F.array_distinct(F.transform(F.sequence(x - reach, x + reach), lambda c: F.pmod(c, F.lit(across))))
            y0, y1 = F.greatest(y - reach, F.lit(low)), F.least(y + reach, F.lit(high))
        ys = F.when(y0 <= y1, F.sequence(y0, F.greatest(y0, y1)))
        asked = left.select("ilon", "ilat", F.explode(xs).alias("cx"), ys.alias("ys")).select("ilon", "ilat", "cx", F.explode("ys").alias("cy"))
        dx = F.pmod(F.col("ilon") - F.col("clon") + WORLD // 2, F.lit(WORLD)) - WORLD // 2
        dy = F.col("ilat") - F.col("clat")
        best = asked.join(laid, ["cx", "cy"]).groupBy("ilon", "ilat").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "rid")).alias("best"))
        sure = (reach - 1) * size  # one of the columns may be the narrow one
        found = cut(best if last else best.where(F.col("best.d") < F.lit(sure * sure)))
        out = found if out is None else out.union(found)
        if last:
            break
        left = cut(left.join(found.select("ilon", "ilat"), ["ilon", "ilat"], "left_anti"))
        if left.isEmpty():
            break
        reach *= 2
    return points.join(out, ["ilon", "ilat"], "left").select("id", F.col("best.rid").alias("rid"))


def corridor(lines: DataFrame, dlon: Column, dlat: Column, steps: int) -> DataFrame:
    """lines(id, lon, lat) sampled at `steps` strides -> distinct (id, bucket) along them, longitudes wrapped."""
    i = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    at = lines.withColumn("i", i).select("id", geo.wrap_lon(F.col("lon") + dlon * F.col("i")).alias("lon"), (F.col("lat") + dlat * F.col("i")).alias("lat"))
    return at.select("id", geo.bucket_name(geo.bucket_corner(F.col("lon"), 180), geo.bucket_corner(F.col("lat"), 90)).alias("bucket")).distinct()


def halo(corners: DataFrame) -> DataFrame:
    """corners(a, b) of known buckets -> the names of their neighbours that aren't known."""
    shift = F.array(*(F.lit(d) for d in (-5, 0, 5)))
    around = corners.select("a", "b", F.explode(shift).alias("i")).select("a", "b", "i", F.explode(shift).alias("j"))
    around = around.select((((F.col("a") + F.col("i") + 180) % 360 + 360) % 360 - 180).cast("int").alias("a"), (F.col("b") + F.col("j")).alias("b")).distinct()
    return around.join(corners, ["a", "b"], "left_anti").select(geo.bucket_name(F.col("a"), F.col("b")).alias("bucket"))


def box_buckets(boxes: DataFrame) -> DataFrame:
    """boxes(id, w, s, e, n in E6 from the corner of the world) -> (id, bucket): the 5-degree buckets that a box touches. Nulls touch none."""
    steps = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / 5_000_000).cast("int"), F.floor(F.col(high) / 5_000_000).cast("int")))
    columns = boxes.where("w <= e and s <= n").select("id", "s", "n", steps("w", "e").alias("a"))
    cells = columns.select("id", "a", steps("s", "n").alias("b"))
    return cells.select("id", geo.bucket_name(F.col("a") * 5 - 180, F.col("b") * 5 - 90).alias("bucket"))


def grid(spark: SparkSession, west: float, south: float, east: float, north: float) -> DataFrame:
    """The names of all buckets that a bounding box touches."""
    a = spark.range(1).select(F.explode(F.sequence(geo.bucket_corner(F.lit(west), 180), geo.bucket_corner(F.lit(east), 180), F.lit(5))).alias("a"))
    return a.select("a", F.explode(F.sequence(geo.bucket_corner(F.lit(south), 90), geo.bucket_corner(F.lit(north), 90), F.lit(5))).alias("b")).select(geo.bucket_name(F.col("a"), F.col("b")).alias("bucket"))


def tile_claims(tiles: DataFrame, boxes: DataFrame, zoom: int) -> DataFrame:
    """tiles(x, y), boxes(rid, west, east, south, north) in E6 -> (x, y, rid): the boxes that hold any of nine points of a tile, its corners, sides' middles and centre.

    Boxes are laid in the tiles' own grid, widened by one tile, so this is an equi join with a check."""
    n = 1 << zoom
    lon, lat = (lambda x: geo.tile_lon(x, F.lit(0), 1, zoom)), (lambda y: geo.tile_lat(y, F.lit(0), 1, zoom))
    tile = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))
    w, e, s, t = (f(F.col(c)) for c, f in (("west", geo.lon_of), ("east", geo.lon_of), ("south", geo.lat_of), ("north", geo.lat_of)))
    xs = F.sequence(tile(geo.tile_x(w, zoom) - 1), tile(geo.tile_x(e, zoom) + 1))
    ys = F.sequence(tile(geo.tile_y(t, zoom) - 1), tile(geo.tile_y(s, zoom) + 1))
    laid = boxes.select("rid", w.alias("w"), e.alias("e"), s.alias("s"), t.alias("t"), F.explode(xs).alias("x"), ys.alias("ys")).select("rid", "w", "e", "s", "t", "x", F.explode("ys").alias("y"))
    half = (F.lit(0.0), F.lit(0.5), F.lit(1.0))
    inside = lambda v, low, high: (v >= low) & (v <= high)
    across = F.exists(F.array(*(lon(F.col("x") + h) for h in half)), lambda v: inside(v, F.col("w"), F.col("e")))
    up = F.exists(F.array(*(lat(F.col("y") + h) for h in half)), lambda v: inside(v, F.col("s"), F.col("t")))
    return tiles.select("x", "y").distinct().join(laid, ["x", "y"]).where(across & up).select("x", "y", "rid")


def nearest_first(tiles: DataFrame, zoom: int, anchor: tuple[float, float] | None = None, side: int = CHUNK_TILES) -> DataFrame:
    """tiles(x, y, ...) of one zoom, each once, with the chunk (cx, cy) of side x side tiles that it lies in and that chunk's distance `far`, ordered: nearest chunks to the anchor (lon, lat) first.

    Chunks are counted from the least x and y of the tiles, and cut off at the greatest. Near is the squared distance in degrees from a chunk's centre, with
    longitudes shortened at the anchor's latitude and taken the short way round; equally near ones go by rows, tiles in a chunk by x, then y. Without an anchor
    far is null and chunks go by columns. The order is a sort by ranges over all tasks."""
    box = tiles.agg(*(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max)))).first()
    if box["lowx"] is None:
        return tiles.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("cx", "long"), ("cy", "long"), ("far", "double"))))
    low, high = ({c: F.lit(box[f"{n}{c}"]) for c in "xy"} for n in ("low", "high"))
    dealt = tiles.withColumns({f"c{c}": F.floor((F.col(c) - low[c]) / side) for c in "xy"})
    first = lambda c: low[c] + F.col(f"c{c}") * side
    middle = lambda c: (first(c) + F.least(first(c) + side - 1, high[c]) + 1) / 2.0
    if not anchor:
        return dealt.withColumn("far", F.lit(None).cast("double")).orderBy("cx", "cy", "x", "y")
    none = F.lit(0.0)
    dx = geo.fold_lon(geo.tile_lon(middle("x"), none, 1, zoom) - anchor[0]) * math.cos(math.radians(anchor[1]))
    dy = geo.tile_lat(middle("y"), none, 1, zoom) - anchor[1]
    return dealt.withColumn("far", dx * dx + dy * dy).orderBy("far", "cy", "cx", "x", "y")
