"""Areas to keep out of, area profiles, and texts that name places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.operators.routing import matches


def cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Positive if p lies left of a-b, 0 on its line."""
    return (bx - ax) * (py - ay) - (px - ax) * (by - ay)


def segments_meet(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """0 apart, 1 crossing, 2 touching; integer coordinates."""
    d1, d2, d3, d4 = cross(*c, *d, *a), cross(*c, *d, *b), cross(*a, *b, *c), cross(*a, *b, *d)
    within = lambda p, q, r: (r[0] >= F.least(p[0], q[0])) & (r[0] <= F.greatest(p[0], q[0])) & (r[1] >= F.least(p[1], q[1])) & (r[1] <= F.greatest(p[1], q[1]))
    touch = ((d1 == 0) & within(c, d, a)) | ((d2 == 0) & within(c, d, b)) | ((d3 == 0) & within(a, b, c)) | ((d4 == 0) & within(a, b, d))
    return F.when(touch, 2).when((F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0), 1).otherwise(0)


def in_polygon(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring, an array of structs(x, y): by winding number, its border counts as inside."""
    n = F.size(ring)
    start = F.struct(F.lit(0).alias("w"), F.lit(False).alias("on"))

    def step(s: Column, i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
        side = cross(a["x"], a["y"], b["x"], b["y"], px, py)
        on = (side == 0) & (px >= F.least(a["x"], b["x"])) & (px <= F.greatest(a["x"], b["x"])) & (py >= F.least(a["y"], b["y"])) & (py <= F.greatest(a["y"], b["y"]))
        w = F.when((a["y"] <= py) & (b["y"] > py) & (side > 0), 1).when((a["y"] > py) & (b["y"] <= py) & (side < 0), -1).otherwise(0)
        return F.struct((s["w"] + w).alias("w"), (s["on"] | on).alias("on"))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["on"] | (s["w"] != 0))


def area_profile(ways: DataFrame, by: str) -> DataFrame:
    """ways(by, climb, forest, river) -> number of ways, and whole percents of them that stay within 50 m of the start's height, are in forest, are by a river."""
    share = lambda c: F.when(F.count(F.lit(1)) > 0, (F.count_if(c) * 100.0 / F.count(F.lit(1))).cast("int")).otherwise(0)
    return ways.groupBy(by).agg(F.count(F.lit(1)).alias("ways"), share(F.abs("climb") < 50).alias("flat"), share(F.col("forest")).alias("forest"), share(F.col("river")).alias("river"))


def street_names(turns: DataFrame, roads: DataFrame, reach: int = 30) -> DataFrame:
    """turns(id, x, y, heading), roads(sid, name, ax, ay, bx, by) -> (id, name): the nearest road's, none beyond `reach`."""
    return matches(turns, roads.drop("name"), reach, 1).join(roads.select("sid", "name"), "sid").select("id", "name")


def kept_tags(tags: Column, keys: list[str]) -> Column:
    """The tags that rules can read; all of them if no rule is known."""
    return F.map_filter(tags, lambda k, v: k.isin(*keys)) if keys else tags


def unquoted(text: Column) -> Column:
    """+ and percent signs of a query decoded."""
    return F.try_url_decode(text)


def geo_uri(uri: Column) -> Column:
    """struct(lat, lon, label, zoom, query) of a geo: uri, or null. geo:0,0?q=lat,lon(label) is the point of q; q without one is a query."""
    number = r"[-+]?[0-9]+(?:\.[0-9]+)?"
    pair = lambda c: (F.regexp_extract(c, rf"^\s*({number})\s*,\s*({number})", 1).try_cast("double"), F.regexp_extract(c, rf"^\s*({number})\s*,\s*({number})", 2).try_cast("double"))
    head, q = F.regexp_extract(uri, r"(?i)^geo:([^?;]*)", 1), unquoted(F.regexp_extract(uri, r"[?&]q=([^&]*)", 1))
    zoom = F.regexp_extract(uri, r"[?&]z=([0-9]+)", 1).try_cast("int")
    (lat, lon), (qlat, qlon) = pair(head), pair(q)
    label = F.nullif(F.regexp_extract(q, r"\(([^)]*)\)\s*$", 1), F.lit(""))
    here = F.when(qlat.isNotNull(), F.struct(qlat.alias("lat"), qlon.alias("lon"))).when(~((lat == 0) & (lon == 0) & (q != "")), F.struct(lat.alias("lat"), lon.alias("lon")))
    ok = here["lat"].between(-90, 90) & here["lon"].between(-180, 180)
    query = F.when(qlat.isNull(), F.nullif(q, F.lit("")))
    return F.when(uri.rlike("(?i)^geo:") & (F.coalesce(ok, F.lit(False)) | query.isNotNull()), F.struct(F.when(ok, here["lat"]).alias("lat"), F.when(ok, here["lon"]).alias("lon"), label.alias("label"), zoom.alias("zoom"), query.alias("query")))


def appended(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tracks (track, seq, node, cost): the second after the first, its first node dropped as it is the first one's last, its costs carried on."""
    ends = first.groupBy("track").agg(F.max("seq").alias("_seq"), F.max("cost").alias("_cost"))
    more = second.where("seq > 0").join(ends, "track").select("track", (F.col("seq") + F.col("_seq")).alias("seq"), "node", (F.col("cost") + F.col("_cost")).alias("cost"))
    return first.select("track", "seq", "node", "cost").union(more)


def manifest(version: int, fingerprint: Column, buckets: Column) -> Column:
    """One line of JSON, its fields in fixed order."""
    return F.to_json(F.struct(F.lit(version).alias("version"), fingerprint.alias("fingerprint"), F.array_sort(buckets).alias("buckets")))


def read_manifest(text: Column) -> Column:
    return F.from_json(text, "version int, fingerprint string, buckets array<string>", {"mode": "PERMISSIVE"})
