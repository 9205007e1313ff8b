"""Road tags: from tile attributes to the tags that rules read, and values in units to metric numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tile classes with their road kind, those that have ramps, kinds of paths, service details, and classes that are no roads.
CLASS_TO_ROAD = {"motorway": "motorway", "trunk": "trunk", "primary": "primary", "secondary": "secondary", "tertiary": "tertiary", "minor": "residential", "service": "service", "track": "track", "pier": "footway"}
WITH_RAMPS = ("motorway", "trunk", "primary", "secondary", "tertiary")
PATHS = ("footway", "cycleway", "pedestrian", "track", "path", "bridleway", "steps", "corridor", "platform")
SERVICE_DETAILS = ("alley", "driveway", "parking_aisle", "drive-through", "emergency_access")
NO_ROADS = ("major_rail", "minor_rail", "rail", "transit", "aerialway", "ferry", "busway", "bus_guideway", "construction", "raceway")
CARRIED = ("surface", "access", "bicycle", "foot")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def known_class(kind: Column) -> Column:
    base = F.regexp_replace(kind, "_construction$", "")
    return F.coalesce(base.isin(*CLASS_TO_ROAD, "path") | base.isin(*NO_ROADS), F.lit(False))


def road_tags(kind: Column, subclass: Column, ramp: Column, service: Column, oneway: Column, brunnel: Column, carried: dict[str, Column]) -> Column:
    """map<string, string> of road tags, or null for what is no road: unknown classes, rails, ferries and what is being built."""
    building = (subclass == "construction") | (kind.endswith("_construction") & known_class(kind))
    road = F.when(kind.isin(*WITH_RAMPS) & ramp, F.concat(kind, F.lit("_link")))
    road = road.when(kind == "path", F.when(subclass.isin(*PATHS), subclass).otherwise("path")).otherwise(_lookup(CLASS_TO_ROAD, kind))
    found = [("highway", road), ("service", F.when((kind == "service") & service.isin(*SERVICE_DETAILS), service)), ("oneway", F.when(oneway == 1, "yes").when(oneway == -1, "-1"))]
    found += [(k, F.when(brunnel == k, "yes")) for k in ("bridge", "tunnel")]
    found += [(k, F.when(F.trim(c) != "", c)) for k, c in carried.items()]
    tags = F.map_filter(F.create_map(*(x for k, c in found for x in (F.lit(k), c))), lambda k, v: v.isNotNull())
    return F.when(~F.coalesce(building, F.lit(False)) & road.isNotNull(), tags)


def metric(value: Column) -> Column:
    """The number of a tag value in metres or km/h, to one decimal: feet and inches, fathoms, centimetres, mph and knots are converted, of a range
    the first number counts; null if there is none. Lower case, blanks and commas don't matter."""
    v = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), ",", "."), r"\s+", "")
    v = F.regexp_replace(v, r"^(~|ca\.?|default)", "")
    number = r"^([0-9]+(?:\.[0-9]+)?)"
    n = F.regexp_extract(v, number, 1).try_cast("double")
    inches = F.regexp_extract(v, r"^[0-9]+(?:\.[0-9]+)?(?:ft|'|feet)([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    unit = F.regexp_extract(v, number + r"(?:-[0-9.]+)?(ft|feet|'|in|\"|fathom|cm|mph|knots?|kmh|km/h|m)?", 2)
    scaled = F.when(unit.isin("ft", "feet", "'"), n * 0.3048 + F.coalesce(inches, F.lit(0.0)) * 0.0254).when(unit.isin("in", '"'), n * 0.0254).when(unit == "fathom", n * 1.8288).when(unit == "cm", n / 100)
    scaled = scaled.when(unit == "mph", n * 1.609344).when(unit.isin("knot", "knots"), n * 1.852).otherwise(n)
    return F.floor(scaled * 10 + 0.5) / 10


def stored_number(value: Column) -> Column:
    """How a numeric tag is kept: 1000 plus hundredths, the sign lost; 0 if it is no number."""
    return F.coalesce((F.floor(F.abs(value) * 100 + 1e-9) + 1000).cast("int"), F.lit(0))


def restriction_exceptions(value: Column) -> Column:
    """Who a turn restriction doesn't bind: bit 1 bicycles, bit 2 cars."""
    has = lambda w, bit: F.when(F.instr(value, w) > 0, bit).otherwise(0)
    return F.coalesce(has("bicycle", 1) + has("motorcar", 2), F.lit(0))
