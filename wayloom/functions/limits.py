"""Heights, speeds on foot, distances inside circles, turn restrictions by angle and other small rules of a road graph, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayloom.functions import geo

# Encoded heights are quarter metres in 16 bits, the least one says that there is none.
PER_METRE, LEAST, MOST, UNSET = 4.0, -32767, 32767, -32768
# Degrees between which a turn of that name lies.
TURNS = {"left_turn": (-175.0, -5.0), "right_turn": (5.0, 175.0), "straight_on": (-85.0, 85.0)}
U_TURN = 95.0


def clamped_height(encoded: Column) -> Column:
    return F.when(encoded.isNull() | F.isnan(encoded), UNSET).otherwise(F.least(F.greatest(encoded.cast("long"), F.lit(LEAST)), F.lit(MOST))).cast("int")


def encoded_height(metres: Column) -> Column:
    """Quarter metres, cut towards zero; UNSET for null and NaN."""
    return clamped_height(metres * PER_METRE)


def height_of(encoded: Column) -> Column:
    """Metres; null where the height is unset."""
    return F.when(encoded != UNSET, encoded / PER_METRE)


def walking_speed(fastest: Column, incline: Column) -> Column:
    """Fastest on a slight descent, by Tobler's exponential."""
    return fastest * F.exp(-3.5 * F.abs(incline + 0.05))


def inside_circle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, radius: Column) -> Column:
    """How much of the segment a-b lies inside a circle that it meets, in the units of a plane; all of it if both ends do."""
    length = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    far = lambda x, y: (x - cx) * (x - cx) + (y - cy) * (y - cy)
    a_in, b_in = far(ax, ay) < radius * radius, far(bx, by) < radius * radius
    sx, sy, ex, ey = F.when(a_in, bx).otherwise(ax), F.when(a_in, by).otherwise(ay), F.when(a_in, ax).otherwise(bx), F.when(a_in, ay).otherwise(by)
    to = ((ex - sx) * (cx - sx) + (ey - sy) * (cy - sy)) / length
    across = far(sx, sy) - to * to
    half = F.sqrt(F.greatest(radius * radius - across, F.lit(0.0)))
    return F.when(a_in & b_in, length).when(a_in | b_in, half + length - to).when((to > 0) & (to < length) & (across < radius * radius), 2 * half).otherwise(0.0)


def restriction_fits(kind: Column, angle: Column) -> Column:
    """Whether a restriction (no_... or only_...) names a turn that its angle can be; conditions after @ don't count."""
    turn = F.trim(F.regexp_replace(F.regexp_replace(kind, "^(only_|no_)", ""), "@.*$", ""))
    fits = turn.isin("entry", "exit") | ((turn == "u_turn") & (F.abs(angle) > U_TURN))
    for name, (low, high) in TURNS.items():
        fits = fits | ((turn == name) & (angle > low) & (angle < high))
    return kind.rlike("^(only_|no_)") & ~kind.contains("on_red") & fits


def with_concrete(tags: Column) -> Column:
    """A map of tags with `concrete` added from a surface of concrete:..., unless it has one."""
    start = "concrete:"
    found = tags["surface"].startswith(start) & ~F.map_contains_key(tags, "concrete")
    more = F.create_map(F.lit("concrete"), F.substring(tags["surface"], len(start) + 1, 1_000_000))
    return F.when(F.coalesce(found, F.lit(False)), F.map_concat(tags, more)).otherwise(tags)


def in_search_boundary(ilon: Column, ilat: Column, start_lon: Column, start_lat: Column, cost: Column, radius: Column) -> Column:
    """Within radius metres of the start; for radius 0 in the box around the start's five-degree bucket: five degrees more on each side at cost 0, else one."""
    edge = F.when(cost == 0, 5_000_000).otherwise(1_000_000)
    side = geo.BUCKET_DEGREES * 1_000_000
    inside = lambda v, s: (v > F.floor(s / side) * side - edge) & (v < F.floor(s / side) * side + side + edge)
    return F.when(radius > 0, geo.ruler_metres(ilon, ilat, start_lon, start_lat) < radius).otherwise(inside(ilon, start_lon) & inside(ilat, start_lat))


def box_of(path: Column) -> Column:
    """(west, south, east, north) of an array of structs(x, y)."""
    xs, ys = F.transform(path, lambda p: p["x"]), F.transform(path, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))


def dictionary_line(line: Column) -> Column:
    """(key, value, aliases) of a line `key;histogram value alias...` of a tag dictionary; nulls where key or value is missing."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    ok = F.size(words) >= 2
    return F.struct(F.when(ok, F.substring_index(words[0], ";", 1)).alias("key"), F.when(ok, words[1]).alias("value"), F.when(ok, F.slice(words, 3, 1_000_000)).alias("aliases"))
