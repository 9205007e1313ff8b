"""Queries of round trips and circles round polygons, over whole tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import round_trips
from wayloom.plans.derived import cte, derived
from wayloom.plans.geometry import _kx, _ky
from wayloom.plans.registry import query

_RADIUS = 700_000
#: Starts with the four corners around them, as struct columns.
_AT = lambda d, m: f"{{'x': ilon + CAST(trunc({m} * cos(radians(90 - ({d}))) / {_kx('ilat')}) AS BIGINT), 'y': ilat + CAST(trunc({m} * sin(radians(90 - ({d}))) / {_ky('ilat')}) AS BIGINT)}}"
_DIRECTIONS = f"""{cte('anchors', 'points')}, s AS (SELECT id, ilon, ilat, id * 7 % 400 AS h FROM anchors),
  q AS (SELECT id, h, direction, {{'x': ilon, 'y': ilat}} AS o, {_AT('direction - 45', f'{_RADIUS * 1.5}')} AS a, {_AT('(direction + 45) % 360', f'{_RADIUS * 1.5}')} AS b FROM s, (VALUES (90), (180), (270), (360)) v(direction)),
  m AS (SELECT q.id, direction, count(*) AS n, count(*) FILTER (abs(w.id % 400 - h) < 50) AS flat FROM q JOIN points w
    ON w.ilon BETWEEN least(o.x, a.x, b.x) AND greatest(o.x, a.x, b.x) AND w.ilat BETWEEN least(o.y, a.y, b.y) AND greatest(o.y, a.y, b.y)
    AND abs(sign((a.x - o.x) * (w.ilat - o.y) - (a.y - o.y) * (w.ilon - o.x)) + sign((b.x - a.x) * (w.ilat - a.y) - (b.y - a.y) * (w.ilon - a.x)) + sign((o.x - b.x) * (w.ilat - b.y) - (o.y - b.y) * (w.ilon - b.x))) >= 2
    GROUP BY ALL),
  best AS (SELECT q.id, direction FROM q LEFT JOIN m USING (id, direction) QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY coalesce(trunc(flat * 100.0 / n), 0) DESC, direction) = 1)"""


def _starts(spark, sf_dir):
    return derived(spark, sf_dir, "anchors").select("id", "ilon", "ilat", F.lit(float(_RADIUS)).alias("radius"), (F.col("id") * 7 % 400).alias("height"))


@query(
    "round_trip_points",
    f"""WITH {_DIRECTIONS}, t AS (SELECT id, ilon, ilat, direction FROM s JOIN best USING (id))
    SELECT id, 0 AS seq, ilon, ilat FROM t UNION ALL SELECT id, 5, ilon, ilat FROM t
    UNION ALL SELECT id, i, p.x, p.y FROM (SELECT id, CAST(i AS INT) AS i, {_AT('direction + 180.0 * i / 5 - 90', f'{_RADIUS}.0')} AS p FROM t, range(1, 5) r(i))""",
)
def round_trip_points(spark, sf_dir):
    """From each anchor towards the quarter with the most level ground, as the points around tell."""
    starts = _starts(spark, sf_dir)
    ways = derived(spark, sf_dir, "points").select("ilon", "ilat", (F.col("id") % 400).alias("height"), F.lit(False).alias("forest"), F.lit(False).alias("river"))
    best = round_trips.directions(starts, ways, "flat", 10_000_000)
    return round_trips.trip_points(starts.join(best, "id")).select("id", "seq", "ilon", "ilat")


_RINGS = "SELECT l_orderkey AS id, l_linenumber AS k, l_orderkey * 6151 % 300000000 + l_partkey * 1013 % 50021 AS x, l_orderkey * 5737 % 140000000 + 20000000 + l_suppkey * 719 % 30011 + l_linenumber * 37 AS y FROM lineitem"


@query(
    "nogo_circles",
    f"""WITH RECURSIVE p AS ({_RINGS}),
  c AS (SELECT id, (min(x) + max(x)) // 2 AS cx, (min(y) + max(y)) // 2 AS cy, 0.0::DOUBLE AS radius, 0 AS n FROM p GROUP BY id
    UNION ALL SELECT id, nx, ny, sqrt(pow((nx - f.x) * {_kx('ny')}, 2) + pow((ny - f.y) * {_ky('ny')}, 2)), n + 1 FROM (
      SELECT id, n, f, cx + CAST(trunc(0.5 * (1 - radius / -f.d) * (f.x - cx) + 0.5) AS BIGINT) AS nx, cy + CAST(trunc(0.5 * (1 - radius / -f.d) * (f.y - cy) + 0.5) AS BIGINT) AS ny FROM (
        SELECT id, cx, cy, radius, n, min({{'d': -d, 'k': k, 'x': x, 'y': y}}) AS f FROM (SELECT c.*, k, x, y, sqrt(pow((cx - x) * {_kx('cy')}, 2) + pow((cy - y) * {_ky('cy')}, 2)) AS d FROM c JOIN p USING (id)) GROUP BY ALL)
      WHERE -f.d > radius))
  SELECT id, cx AS x, cy AS y, round(radius * 1.001 + 1, 3) AS radius FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1""",
)
def nogo_circles(spark, sf_dir):
    """The circle round the parts of each order."""
    points = spark.sql(_RINGS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    rings = points.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return round_trips.bounding_circles(rings).select("id", "x", "y", F.round("radius", 3).alias("radius"))
