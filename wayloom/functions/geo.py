"""Map geometry as column expressions. Positions are degrees, or E6 integers: (degrees + 180 or 90) x 1,000,000."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
METRES_PER_LATITUDE = 110_540.0
MOST_LATITUDE = 85.05112878
BUCKET_DEGREES = 5


def half_up(x: Column) -> Column:
    """To the nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5).cast("long")


def to_e6(lon: Column, lat: Column) -> tuple[Column, Column]:
    return half_up((lon + 180) * 1e6), half_up((lat + 90) * 1e6)


def lon_of(ilon: Column) -> Column:
    return ilon / 1e6 - 180


def lat_of(ilat: Column) -> Column:
    return ilat / 1e6 - 90


def position_id(ilon: Column, ilat: Column) -> Column:
    return F.shiftleft(ilon.cast("long"), 32).bitwiseOR(ilat.cast("long"))


def position_of(pid: Column) -> tuple[Column, Column]:
    return F.shiftright(pid, 32), pid.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def snap_cell(degrees: Column, offset: int) -> Column:
    """The E6 coordinate cut down to its grid of ten units."""
    return ((degrees + offset) * 1e5).cast("long") * 10


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.least(F.greatest(F.floor((lon + 180) / 360 * n), F.lit(0)), F.lit(n - 1)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    r = F.radians(F.least(F.greatest(lat, F.lit(-MOST_LATITUDE)), F.lit(MOST_LATITUDE)))
    return F.least(F.greatest(F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.pi()) / 2 * n), F.lit(0)), F.lit(n - 1)).cast("long")


def tile_lon(x: Column, px: Column, extent: int, zoom: int) -> Column:
    return 360 * (x + px / extent) / (1 << zoom) - 180


def tile_lat(y: Column, py: Column, extent: int, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * (y + py / extent) / (1 << zoom)))))


def hilbert_id(x: Column, y: Column, zoom: int) -> Column:
    """The tile's place on the Hilbert curve of its zoom, after all tiles of smaller zooms: one fold over its bits."""
    n = 1 << zoom
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(a: Column, s: Column) -> Column:
        rx = F.when(a["x"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        ry = F.when(a["y"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        d = a["d"] + s * s * (3 * rx).bitwiseXOR(ry)
        mx, my = F.when(rx == 1, n - 1 - a["x"]).otherwise(a["x"]), F.when(rx == 1, n - 1 - a["y"]).otherwise(a["y"])
        return F.struct(F.when(ry == 0, my).otherwise(a["x"]).alias("x"), F.when(ry == 0, mx).otherwise(a["y"]).alias("y"), d.alias("d"))

    sides = F.array(*(F.lit(1 << k).cast("long") for k in range(zoom - 1, -1, -1))) if zoom else F.array().cast("array<bigint>")
    return F.aggregate(sides, start, step, lambda a: a["d"]) + sum(4**k for k in range(zoom))


def hilbert_tile(tile_id: Column, zoom: int) -> Column:
    """struct(x, y) of a tile id of this zoom."""
    t0 = tile_id.cast("long") - sum(4**k for k in range(zoom))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("x"), zero.alias("y"), t0.alias("t"))

    def step(a: Column, s: Column) -> Column:
        rx = F.shiftright(a["t"], 1).bitwiseAND(F.lit(1).cast("long"))
        ry = a["t"].bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("long"))
        x = F.when((ry == 0) & (rx == 1), s - 1 - a["x"]).otherwise(a["x"])
        y = F.when((ry == 0) & (rx == 1), s - 1 - a["y"]).otherwise(a["y"])
        x, y = F.when(ry == 0, y).otherwise(x), F.when(ry == 0, x).otherwise(y)
        return F.struct((x + s * rx).alias("x"), (y + s * ry).alias("y"), F.shiftright(a["t"], 2).alias("t"))

    sides = F.array(*(F.lit(1 << k).cast("long") for k in range(zoom))) if zoom else F.array().cast("array<bigint>")
    return F.aggregate(sides, start, step, lambda a: F.struct(a["x"].alias("x"), a["y"].alias("y")))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlon, dlat = F.radians(lon2 - lon1), F.radians(lat2 - lat1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def flat_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Along a route: scaled by the cosine at the first point."""
    x = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians(lat1))
    y = (lat2 - lat1) * METRES_PER_DEGREE
    return F.sqrt(x * x + y * y)


def local_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Around a street: scaled by the cosine at the mean latitude."""
    x = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    y = (lat2 - lat1) * METRES_PER_LATITUDE
    return F.sqrt(x * x + y * y)


def along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where on the segment a-b the point nearest to p lies, 0 to 1, judged in degrees."""
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length
    return F.when(length > 0, F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def segment_metres(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = along(px, py, ax, ay, bx, by)
    return local_metres(px, py, ax + (bx - ax) * t, ay + (by - ay) * t)


def ruler_degrees(ilat: Column) -> tuple[Column, Column]:
    """Kilometres of one degree, along and across, in the latitude slot of ilat: enough where only proportions count, with one rounding less."""
    slot = F.least(F.greatest(F.floor(ilat / 100000), F.lit(0)), F.lit(1799))
    phi = F.radians(slot / 10.0 + 0.05 - 90)
    kx = 111.41513 * F.cos(phi) - 0.09455 * F.cos(3 * phi) + 0.00012 * F.cos(5 * phi)
    ky = 111.13209 - 0.56605 * F.cos(2 * phi) + 0.0012 * F.cos(4 * phi)
    return kx, ky


def ruler(ilat: Column) -> tuple[Column, Column]:
    """Metres of one E6 unit, along and across, in the latitude slot of ilat."""
    kx, ky = ruler_degrees(ilat)
    return kx * 1e-3, ky * 1e-3


def ruler_metres(ilon1: Column, ilat1: Column, ilon2: Column, ilat2: Column) -> Column:
    kx, ky = ruler(F.shiftright((ilat1 + ilat2).cast("long"), 1))
    x, y = (ilon1 - ilon2) * kx, (ilat1 - ilat2) * ky
    return F.sqrt(x * x + y * y)


def destination(ilon: Column, ilat: Column, metres: Column, bearing: Column) -> tuple[Column, Column]:
    """The E6 point that lies so far in this compass direction."""
    kx, ky = ruler(ilat)
    r = F.radians(90 - bearing)
    return ilon + (metres * F.cos(r) / kx).cast("long"), ilat + (metres * F.sin(r) / ky).cast("long")


def bearing(ilon1: Column, ilat1: Column, ilon2: Column, ilat2: Column) -> Column:
    """Compass degrees from 0 to 360."""
    kx, ky = ruler(F.shiftright((ilat1 + ilat2).cast("long"), 1))
    return normal(F.degrees(F.atan2((ilon2 - ilon1) * kx, (ilat2 - ilat1) * ky)))


def normal(angle: Column) -> Column:
    a = angle % 360
    return F.when(a < 0, a + 360).otherwise(a)


def angle_between(a: Column, b: Column) -> Column:
    """The smaller angle between two directions."""
    d = F.abs(normal(a) - normal(b))
    return F.when(d > 180, 360 - d).otherwise(d)


def turn(x10: Column, y10: Column, x21: Column, y21: Column) -> tuple[Column, Column]:
    """(angle in degrees, positive to the right; cosine) between two steps in scaled units; (0, 1) if one has no length."""
    d = F.sqrt((x10 * x10 + y10 * y10) * (x21 * x21 + y21 * y21))
    s, c = (y10 * x21 - x10 * y21) / d, (y10 * y21 + x10 * x21) / d
    steep = s * s > 0.5
    offset = F.when(steep & (s < 0), -90.0).when(steep, 90.0).when((c < 0) & (s < 0), -180.0).when(c < 0, 180.0).otherwise(0.0)
    v = F.when(steep & (s < 0), c).when(steep, -c).when(c < 0, -s).otherwise(s)
    v2 = v * v
    angle = offset + v * (57.4539 + v2 * (9.57565 + v2 * (4.30904 + v2 * 2.56491)))
    return F.when(d == 0, 0.0).otherwise(angle), F.when(d == 0, 1.0).otherwise(c)


def bound(use: Callable[..., Column], *made: Column) -> Column:
    """use(*made) with each of made worked out once. Inside higher-order functions Spark works an expression out anew for each of its uses; there this is an element of an array of one."""
    return F.element_at(F.transform(F.array(F.struct(*(c.alias(f"_{k}") for k, c in enumerate(made)))), lambda m: use(*(m[f"_{k}"] for k in range(len(made))))), 1)


def turn_angle(x10: Column, y10: Column, x21: Column, y21: Column) -> Column:
    """The angle of `turn`, for use inside higher-order functions."""

    def of_ratios(s: Column, c: Column, d: Column) -> Column:
        steep, low, back = s * s > 0.5, s < 0, c < 0
        offset = F.when(steep & low, -90.0).when(steep, 90.0).when(back & low, -180.0).when(back, 180.0).otherwise(0.0)
        v = F.when(steep & low, c).when(steep, -c).when(back, -s).otherwise(s)
        return bound(lambda v, v2: F.when(d == 0, 0.0).otherwise(offset + v * (57.4539 + v2 * (9.57565 + v2 * (4.30904 + v2 * 2.56491)))), v, v * v)

    def of_steps(x10: Column, y10: Column, x21: Column, y21: Column) -> Column:
        length = F.sqrt((x10 * x10 + y10 * y10) * (x21 * x21 + y21 * y21))
        return bound(lambda d, by: bound(of_ratios, (y10 * x21 - x10 * y21) / by, (y10 * y21 + x10 * x21) / by, d), length, F.nullif(length, F.lit(0.0)))  # null and not 0, by which nothing is divided

    return bound(of_steps, x10, y10, x21, y21)


def bucket_corner(degrees: Column, offset: int) -> Column:
    """The south-west corner of the five-degree bucket, in whole degrees: towards minus infinity."""
    return (F.floor((F.floor(degrees) + offset) / BUCKET_DEGREES) * BUCKET_DEGREES - offset).cast("int")


def bucket_name(lon_min: Column, lat_min: Column) -> Column:
    east = F.when(lon_min < 0, F.concat(F.lit("W"), (-lon_min).cast("string"))).otherwise(F.concat(F.lit("E"), lon_min.cast("string")))
    north = F.when(lat_min < 0, F.concat(F.lit("S"), (-lat_min).cast("string"))).otherwise(F.concat(F.lit("N"), lat_min.cast("string")))
    return F.concat(east, F.lit("_"), north)


def wrap_lon(lon: Column) -> Column:
    """Into -180 up to 180."""
    a = (lon + 180) % 360
    return F.when(a < 0, a + 360).otherwise(a) - 180


def fold_lon(delta: Column) -> Column:
    """The short way round of a difference of longitudes."""
    a = ((delta + 180) % 360 + 360) % 360
    return a - 180
