"""Registered queries over positions, tiles, buckets and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators import regions
from wayloom.plans.derived import cte, derived
from wayloom.plans.registry import query

Z = 10
_LON, _LAT = "(ilon / 1e6 - 180)", "(ilat / 1e6 - 90)"
_TX = "CAST(floor(({lon} + 180) / 360 * {n}) AS BIGINT)"
_TY = "CAST(floor((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * {n}) AS BIGINT)"


def tx(n: int = 1 << Z) -> str:
    return _TX.format(lon=_LON, n=n)


def ty(n: int = 1 << Z) -> str:
    return _TY.format(lat=_LAT, n=n)


def _places(spark, sf_dir):
    return derived(spark, sf_dir, "places").withColumns({"lon": geo.lon_of(F.col("ilon")), "lat": geo.lat_of(F.col("ilat"))})


def _r(c, digits=6):
    return F.floor(c * 10**digits + 0.5).cast("long")


@query("tile_xy", f"WITH {cte('places')} SELECT id, {tx()} AS x, {ty()} AS y FROM places")
def tile_xy(spark, sf_dir):
    return _places(spark, sf_dir).select("id", geo.tile_x(F.col("lon"), Z).alias("x"), geo.tile_y(F.col("lat"), Z).alias("y"))


@query(
    "tile_hilbert",
    f"""WITH RECURSIVE {cte('places')}, t AS (SELECT id, {tx()} AS x0, {ty()} AS y0 FROM places),
  h(id, x0, y0, x, y, s, d) AS (SELECT id, x0, y0, x0, y0, CAST(512 AS BIGINT), CAST(0 AS BIGINT) FROM t UNION ALL
  SELECT id, x0, y0, CASE WHEN y & s = 0 THEN CASE WHEN x & s > 0 THEN 1023 - y ELSE y END ELSE x END, CASE WHEN y & s = 0 THEN CASE WHEN x & s > 0 THEN 1023 - x ELSE x END ELSE y END, s // 2,
    d + s * s * xor(CASE WHEN x & s > 0 THEN 3 ELSE 0 END, CASE WHEN y & s > 0 THEN 1 ELSE 0 END) FROM h WHERE s > 0)
  SELECT id, d + 349525 AS tile_id, x0 AS x, y0 AS y FROM h WHERE s = 0""",
)
def tile_hilbert(spark, sf_dir):
    t = _places(spark, sf_dir).select("id", geo.tile_x(F.col("lon"), Z).alias("x"), geo.tile_y(F.col("lat"), Z).alias("y"))
    t = t.withColumn("tile_id", geo.hilbert_id(F.col("x"), F.col("y"), Z)).withColumn("back", geo.hilbert_tile(F.col("tile_id"), Z))
    return t.select("id", "tile_id", "back.x", "back.y")


@query("tile_corner", f"WITH {cte('places')} SELECT id, CAST(floor((360.0 * ({tx()} + 0.5) / 1024 - 180) * 1000000 + 0.5) AS BIGINT) AS lon6, CAST(floor(degrees(atan(sinh(pi() * (1 - 2 * ({ty()} + 0.5) / 1024)))) * 1000000 + 0.5) AS BIGINT) AS lat6 FROM places")
def tile_corner(spark, sf_dir):
    half = F.lit(2048)
    return _places(spark, sf_dir).select("id", _r(geo.tile_lon(geo.tile_x(F.col("lon"), Z), half, 4096, Z)).alias("lon6"), _r(geo.tile_lat(geo.tile_y(F.col("lat"), Z), half, 4096, Z)).alias("lat6"))


@query("tile_bounds_scan", f"WITH {cte('places')}, t AS (SELECT {tx()} AS x, {ty()} AS y, id FROM places) SELECT x, y, count(*) AS n FROM t WHERE x BETWEEN 500 AND 620 AND y BETWEEN 300 AND 420 GROUP BY ALL")
def tile_bounds_scan(spark, sf_dir):
    t = _places(spark, sf_dir).select(geo.tile_x(F.col("lon"), Z).alias("x"), geo.tile_y(F.col("lat"), Z).alias("y"))
    return t.where("x between 500 and 620 and y between 300 and 420").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query("tile_chunks", f"WITH {cte('places')}, t AS (SELECT DISTINCT {tx()} AS x, {ty()} AS y FROM places), c AS (SELECT x // 64 AS cx, y // 64 AS cy, count(*) AS tiles FROM t GROUP BY ALL) SELECT cx, cy, tiles, (cx - 8) * (cx - 8) + (cy - 8) * (cy - 8) AS far FROM c")
def tile_chunks(spark, sf_dir):
    t = _places(spark, sf_dir).select(geo.tile_x(F.col("lon"), Z).alias("x"), geo.tile_y(F.col("lat"), Z).alias("y")).distinct()
    return regions.chunks(t, 8, 8).select("cx", "cy", "tiles", "far")


@query("geo_position_id", f"WITH {cte('places')} SELECT id, (ilon << 32) | ilat AS pid, ilon, ilat FROM places")
def position_id(spark, sf_dir):
    p = derived(spark, sf_dir, "places").select("id", geo.position_id(F.col("ilon"), F.col("ilat")).alias("pid"))
    ilon, ilat = geo.position_of(F.col("pid"))
    return p.select("id", "pid", ilon.alias("ilon"), ilat.alias("ilat"))


@query("geo_snap", f"WITH {cte('places')} SELECT id, CAST(trunc(({_LON} + 180) * 1e5) AS BIGINT) * 10 AS x, CAST(trunc(({_LAT} + 90) * 1e5) AS BIGINT) * 10 AS y FROM places")
def snap(spark, sf_dir):
    return _places(spark, sf_dir).select("id", geo.snap_cell(F.col("lon"), 180).alias("x"), geo.snap_cell(F.col("lat"), 90).alias("y"))


_BUCKET = "CASE WHEN a < 0 THEN 'W' || -a ELSE 'E' || a END || '_' || CASE WHEN b < 0 THEN 'S' || -b ELSE 'N' || b END"
_CORNERS = f"CAST(floor((floor({_LON}) + 180) / 5) * 5 - 180 AS INT) AS a, CAST(floor((floor({_LAT}) + 90) / 5) * 5 - 90 AS INT) AS b"


@query("geo_bucket", f"WITH {cte('places')}, c AS (SELECT id, {_CORNERS} FROM places) SELECT id, {_BUCKET} AS bucket FROM c")
def bucket(spark, sf_dir):
    return _places(spark, sf_dir).select("id", geo.bucket_name(geo.bucket_corner(F.col("lon"), 180), geo.bucket_corner(F.col("lat"), 90)).alias("bucket"))


_PAIR = "p AS (SELECT a.id, a.ilon AS x1, a.ilat AS y1, b.ilon AS x2, b.ilat AS y2 FROM places a JOIN points b USING (id))"


def _pair(spark, sf_dir):
    a = derived(spark, sf_dir, "places").select("id", F.col("ilon").alias("x1"), F.col("ilat").alias("y1"))
    return a.join(derived(spark, sf_dir, "points").select("id", F.col("ilon").alias("x2"), F.col("ilat").alias("y2")), "id")


_K = "least(greatest(floor(({y}) / 100000), 0), 1799) / 10.0 + 0.05 - 90"


def _kx(y: str) -> str:
    k = f"radians({_K.format(y=y)})"
    return f"((111.41513 * cos({k}) - 0.09455 * cos(3 * {k}) + 0.00012 * cos(5 * {k})) * 1e-3)"


def _ky(y: str) -> str:
    k = f"radians({_K.format(y=y)})"
    return f"((111.13209 - 0.56605 * cos(2 * {k}) + 0.0012 * cos(4 * {k})) * 1e-3)"


@query("geo_ruler", f"WITH {cte('places', 'points')}, {_PAIR} SELECT id, CAST(floor(sqrt(pow((x1 - x2) * {_kx('(y1 + y2) >> 1')}, 2) + pow((y1 - y2) * {_ky('(y1 + y2) >> 1')}, 2)) + 0.5) AS BIGINT) AS metres FROM p")
def ruler(spark, sf_dir):
    return _pair(spark, sf_dir).select("id", _r(geo.ruler_metres(*map(F.col, ("x1", "y1", "x2", "y2"))), 0).alias("metres"))


@query("geo_bearing", f"WITH {cte('places', 'points')}, {_PAIR}, b AS (SELECT id, degrees(atan2((x2 - x1) * {_kx('(y1 + y2) >> 1')}, (y2 - y1) * {_ky('(y1 + y2) >> 1')})) AS d FROM p) SELECT id, CAST(floor(CASE WHEN d < 0 THEN d + 360 ELSE d END * 1000 + 0.5) AS BIGINT) AS millidegrees FROM b")
def bearing(spark, sf_dir):
    return _pair(spark, sf_dir).select("id", _r(geo.bearing(*map(F.col, ("x1", "y1", "x2", "y2"))), 3).alias("millidegrees"))


@query("geo_haversine", f"WITH {cte('places', 'points')}, {_PAIR} SELECT id, CAST(floor(2 * 6371000.0 * asin(sqrt(pow(sin(radians((y2 - y1) / 1e6) / 2), 2) + cos(radians(y1 / 1e6 - 90)) * cos(radians(y2 / 1e6 - 90)) * pow(sin(radians((x2 - x1) / 1e6) / 2), 2))) + 0.5) AS BIGINT) AS metres FROM p")
def haversine(spark, sf_dir):
    x1, y1, x2, y2 = map(F.col, ("x1", "y1", "x2", "y2"))
    return _pair(spark, sf_dir).select("id", _r(geo.haversine(geo.lon_of(x1), geo.lat_of(y1), geo.lon_of(x2), geo.lat_of(y2)), 0).alias("metres"))


@query("geo_segment_distance", f"""WITH {cte('places', 'points')}, {_PAIR}, s AS (SELECT id, x1 / 1e6 - 180 AS ax, y1 / 1e6 - 90 AS ay, x2 / 1e6 - 180 AS bx, y2 / 1e6 - 90 AS b_y FROM p),
  t AS (SELECT *, least(greatest(((13.4 - ax) * (bx - ax) + (52.5 - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)), 0), 1) AS t FROM s)
  SELECT id, CAST(floor(sqrt(pow((ax + (bx - ax) * t - 13.4) * 111320.0 * cos(radians((52.5 + ay + (b_y - ay) * t) / 2)), 2) + pow((ay + (b_y - ay) * t - 52.5) * 110540.0, 2)) + 0.5) AS BIGINT) AS metres FROM t""")
def segment_distance(spark, sf_dir):
    x1, y1, x2, y2 = geo.lon_of(F.col("x1")), geo.lat_of(F.col("y1")), geo.lon_of(F.col("x2")), geo.lat_of(F.col("y2"))
    return _pair(spark, sf_dir).select("id", _r(geo.segment_metres(F.lit(13.4), F.lit(52.5), x1, y1, x2, y2), 0).alias("metres"))


@query("geo_destination", f"WITH {cte('places')} SELECT id, ilon + CAST(trunc(1500.0 * cos(radians(90 - id % 360)) / {_kx('ilat')}) AS BIGINT) AS x, ilat + CAST(trunc(1500.0 * sin(radians(90 - id % 360)) / {_ky('ilat')}) AS BIGINT) AS y FROM places")
def destination(spark, sf_dir):
    x, y = geo.destination(F.col("ilon"), F.col("ilat"), F.lit(1500.0), F.col("id") % 360)
    return derived(spark, sf_dir, "places").select("id", x.alias("x"), y.alias("y"))


@query("geo_turn_angle", """WITH v AS (SELECT p_partkey AS id, CAST(p_partkey % 37 - 18 AS DOUBLE) AS ax, CAST(p_partkey % 29 - 14 AS DOUBLE) AS ay, CAST(p_partkey % 31 - 15 AS DOUBLE) AS bx, CAST(p_partkey % 23 - 11 AS DOUBLE) AS b_y FROM part),
  n AS (SELECT *, sqrt((ax * ax + ay * ay) * (bx * bx + b_y * b_y)) AS d FROM v), m AS (SELECT *, (ay * bx - ax * b_y) / d AS s, (ay * b_y + ax * bx) / d AS c FROM n WHERE d > 0),
  k AS (SELECT id, CASE WHEN s * s > 0.5 AND s < 0 THEN -90.0 WHEN s * s > 0.5 THEN 90.0 WHEN c < 0 AND s < 0 THEN -180.0 WHEN c < 0 THEN 180.0 ELSE 0.0 END AS o, CASE WHEN s * s > 0.5 AND s < 0 THEN c WHEN s * s > 0.5 THEN -c WHEN c < 0 THEN -s ELSE s END AS v FROM m)
  SELECT id, CAST(floor((o + v * (57.4539 + v * v * (9.57565 + v * v * (4.30904 + v * v * 2.56491)))) * 1000 + 0.5) AS BIGINT) AS millidegrees FROM k""")
def turn_angle(spark, sf_dir):
    p = F.col("p_partkey")
    at = [(p % m - o).cast("double") for m, o in ((37, 18), (29, 14), (31, 15), (23, 11))]
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(p.alias("id"), *(c.alias(n) for c, n in zip(at, ("ax", "ay", "bx", "by"))))
    angle, _ = geo.turn(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return part.where("(ax <> 0 or ay <> 0) and (bx <> 0 or by <> 0)").select("id", _r(angle, 3).alias("millidegrees"))


_BOXES = "r AS (SELECT id AS rid, ilon - 10000000 AS west, ilon + 10000000 AS east, ilat - 8000000 AS south, ilat + 8000000 AS north FROM anchors)"


@query("region_first", f"WITH {cte('points', 'anchors')}, {_BOXES} SELECT id, min(rid) AS rid FROM points JOIN r ON ilat BETWEEN south AND north AND (ilon BETWEEN west AND east OR ilon + 360000000 BETWEEN west AND east OR ilon - 360000000 BETWEEN west AND east) GROUP BY id")
def region_first(spark, sf_dir):
    boxes = derived(spark, sf_dir, "anchors").selectExpr("id as rid", "ilon - 10000000 as west", "ilon + 10000000 as east", "ilat - 8000000 as south", "ilat + 8000000 as north")
    return regions.first_region(derived(spark, sf_dir, "points"), boxes).select("id", "rid")


@query("region_nearest", f"WITH {cte('points', 'anchors')}, d AS (SELECT p.id, a.id AS rid, ((p.ilon - a.ilon + 180000000) % 360000000 + 360000000) % 360000000 - 180000000 AS dx, p.ilat - a.ilat AS dy FROM points p, anchors a) SELECT id, arg_min(rid, {{'d': dx * dx + dy * dy, 'r': rid}}) AS rid FROM d GROUP BY id")
def region_nearest(spark, sf_dir):
    return regions.nearest_region(derived(spark, sf_dir, "points"), derived(spark, sf_dir, "anchors")).select("id", "rid")


_STEPS = "s AS (SELECT id, ilon / 1e6 - 180 AS lon, ilat / 1e6 - 90 AS lat, unnest(range(0, 161)) AS i FROM anchors)"


@query("corridor_buckets", f"WITH {cte('anchors')}, {_STEPS}, q AS (SELECT id, ((lon + 0.05 * i + 180) % 360 + 360) % 360 - 180 AS lon, lat + 0.03 * i AS lat FROM s), c AS (SELECT DISTINCT id, CAST(floor((floor(lon) + 180) / 5) * 5 - 180 AS INT) AS a, CAST(floor((floor(lat) + 90) / 5) * 5 - 90 AS INT) AS b FROM q) SELECT id, {_BUCKET} AS bucket FROM c")
def corridor(spark, sf_dir):
    a = derived(spark, sf_dir, "anchors").select("id", geo.lon_of(F.col("ilon")).alias("lon"), geo.lat_of(F.col("ilat")).alias("lat"))
    return regions.corridor(a, F.lit(0.05), F.lit(0.03), 160)


@query("halo_buckets", f"""WITH {cte('anchors')}, k AS (SELECT DISTINCT {_CORNERS} FROM anchors), n AS (SELECT DISTINCT ((k.a + i + 180) % 360 + 360) % 360 - 180 AS a, k.b + j AS b FROM k, (VALUES (-5), (0), (5)) x(i), (VALUES (-5), (0), (5)) y(j)),
  h AS (SELECT * FROM n EXCEPT SELECT * FROM k) SELECT {_BUCKET} AS bucket FROM h""")
def halo(spark, sf_dir):
    a = derived(spark, sf_dir, "anchors").select(geo.bucket_corner(geo.lon_of(F.col("ilon")), 180).alias("a"), geo.bucket_corner(geo.lat_of(F.col("ilat")), 90).alias("b")).distinct()
    return regions.halo(a)


@query("needed_buckets", f"WITH {cte('places', 'points')}, n AS (SELECT DISTINCT {_CORNERS} FROM points), d AS (SELECT DISTINCT {_CORNERS} FROM places WHERE id % 2 = 0), x AS (SELECT * FROM n EXCEPT SELECT * FROM d) SELECT {_BUCKET} AS bucket FROM x")
def needed(spark, sf_dir):
    corner = lambda df: df.select(geo.bucket_name(geo.bucket_corner(geo.lon_of(F.col("ilon")), 180), geo.bucket_corner(geo.lat_of(F.col("ilat")), 90)).alias("bucket")).distinct()
    return corner(derived(spark, sf_dir, "points")).join(corner(derived(spark, sf_dir, "places").where("id % 2 = 0")), "bucket", "left_anti")


_BOXES = "b AS (SELECT id, greatest(ilon - (id % 7 + 1) * 1500000, 0) AS w, least(ilon + (id % 5 + 1) * 2500000, 359999999) AS e, greatest(ilat - (id % 4) * 3000000, 0) AS s, least(ilat + (id % 9) * 1000000, 179999999) AS n FROM anchors)"


@query("archive_buckets", f"WITH {cte('anchors')}, {_BOXES}, x AS (SELECT id, unnest(range(w // 5000000, e // 5000000 + 1)) * 5 - 180 AS a, s, n FROM b), y AS (SELECT id, a, unnest(range(s // 5000000, n // 5000000 + 1)) * 5 - 90 AS b FROM x) SELECT id, CASE WHEN a < 0 THEN 'W' || -a ELSE 'E' || a END || '_' || CASE WHEN b < 0 THEN 'S' || -b ELSE 'N' || b END AS bucket FROM y")
def archive_buckets(spark, sf_dir):
    """The buckets that the box of an archive around each anchor covers."""
    boxes = spark.sql("WITH " + _BOXES.replace("FROM anchors", "FROM {anchors}") + " SELECT * FROM b", anchors=derived(spark, sf_dir, "anchors"))
    return regions.box_buckets(boxes.select("id", *(F.col(c).cast("long").alias(c) for c in "wsen")))


@query(
    "tile_nearest_first",
    f"""WITH {cte('places')}, t AS (SELECT DISTINCT {tx()} AS x, {ty()} AS y FROM places), b AS (SELECT min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM t),
    c AS (SELECT x, y, (x - x1) // 64 AS cx, (y - y1) // 64 AS cy, x1, x2, y1, y2 FROM t, b), m AS (SELECT x, y, cx, cy, (x1 + cx * 64 + least(x1 + cx * 64 + 63, x2) + 1) / 2.0 AS mx, (y1 + cy * 64 + least(y1 + cy * 64 + 63, y2) + 1) / 2.0 AS my FROM c),
    d AS (SELECT x, y, cx, cy, ((mx / {1 << Z} * 360 - 180 - 151.2 + 180) % 360 + 360) % 360 - 180 AS dlon, degrees(atan(sinh(pi() * (1 - 2 * my / {1 << Z})))) + 33.9 AS dlat FROM m)
    SELECT x, y, cx, cy, CAST(floor(pow(dlon * cos(radians(-33.9)), 2) * 1000 + pow(dlat, 2) * 1000 + 0.5) AS BIGINT) AS far FROM d""".replace("sinh(pi() * (1 - 2 * my / 1024))", "(exp(pi() * (1 - 2 * my / 1024)) - exp(-pi() * (1 - 2 * my / 1024))) / 2"),
)
def tile_nearest_first(spark, sf_dir):
    t = _places(spark, sf_dir).select(geo.tile_x(F.col("lon"), Z).alias("x"), geo.tile_y(F.col("lat"), Z).alias("y")).distinct()
    return regions.nearest_first(t, Z, (151.2, -33.9)).select("x", "y", "cx", "cy", _r(F.col("far"), 3).alias("far"))
