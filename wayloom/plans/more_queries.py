"""Registered queries over heights, limits, sequences of points, dictionaries and tile claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import limits
from wayloom.operators import elevation, regions, search, tracks
from wayloom.plans.derived import cte, derived
from wayloom.plans.geometry import tx, ty
from wayloom.plans.registry import query
from wayloom.plans.search_queries import _ADDR, _addresses


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("height_encoding", "SELECT p_partkey AS id, CAST(least(greatest(trunc(h * 4), -32767), 32767) AS INT) AS encoded, least(greatest(trunc(h * 4), -32767), 32767) / 4.0 AS metres FROM (SELECT p_partkey, (p_retailprice - 1500) * 10 AS h FROM part)")
def height_encoding(spark, sf_dir):
    encoded = limits.encoded_height((F.col("p_retailprice") - 1500) * 10)
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), encoded.alias("encoded"), limits.height_of(encoded).alias("metres"))


_CELLS = "c AS (SELECT l_suppkey % 20 AS tx, l_partkey % 20 AS ty, r, c, CAST((l_suppkey % 20 * 31 + l_partkey % 20 * 17 + r * 7 + c * 5) % 300 AS DOUBLE) AS height FROM (SELECT DISTINCT l_suppkey % 20 AS l_suppkey, l_partkey % 20 AS l_partkey FROM lineitem) t, (VALUES (0), (1), (2), (3), (4)) a(r), (VALUES (0), (1), (2), (3), (4)) b(c) WHERE (l_suppkey % 20 + l_partkey % 20 + r * c) % 11 <> 10)"


@query(
    "node_heights",
    f"""WITH {_CELLS}, n AS (SELECT c_custkey AS id, c_custkey * 7919 % 2100 AS x, c_custkey * c_custkey * 31 % 2000 AS y FROM customer),
  a AS (SELECT *, x // 100 AS tx, y // 100 AS ty, (x % 100) / 20.0 - 0.5 AS dc, (y % 100) / 20.0 - 0.5 AS dr FROM n),
  e AS (SELECT *, CAST(least(greatest(floor(dr), 0), 3) AS BIGINT) AS r0, CAST(least(greatest(floor(dc), 0), 3) AS BIGINT) AS c0 FROM a),
  h AS (SELECT id, (SELECT height FROM c WHERE c.tx = e.tx AND c.ty = e.ty AND r = r0 AND c.c = c0) AS h00, (SELECT height FROM c WHERE c.tx = e.tx AND c.ty = e.ty AND r = r0 + 1 AND c.c = c0) AS h10,
    (SELECT height FROM c WHERE c.tx = e.tx AND c.ty = e.ty AND r = r0 AND c.c = c0 + 1) AS h01, (SELECT height FROM c WHERE c.tx = e.tx AND c.ty = e.ty AND r = r0 + 1 AND c.c = c0 + 1) AS h11, dr - r0 AS wr, dc - c0 AS wc FROM e)
  SELECT id, CAST(coalesce(trunc(round(((1 - wr) * (1 - wc) * h00 + wr * (1 - wc) * h10 + (1 - wr) * wc * h01 + wr * wc * h11) * 4, 6)), -32768) AS INT) AS height FROM h""",
)
def node_heights(spark, sf_dir):
    tiles = _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("tx"), (F.col("l_partkey") % 20).alias("ty")).distinct()
    five = F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))
    cells = tiles.select("tx", "ty", F.explode(five).alias("row")).select("tx", "ty", "row", F.explode(five).alias("col")).where("(tx + ty + row * col) % 11 <> 10")
    cells = cells.withColumn("height", ((F.col("tx") * 31 + F.col("ty") * 17 + F.col("row") * 7 + F.col("col") * 5) % 300).cast("double"))
    k = F.col("c_custkey")
    nodes = _table(spark, sf_dir, "customer").select(k.alias("id"), (k * 7919 % 2100).alias("x"), (k * k * 31 % 2000).alias("y"))
    return elevation.node_heights(nodes, cells, 20, 5)


@query("walking_speed", "SELECT s_suppkey AS id, CAST(floor(6 * exp(-3.5 * abs((s_suppkey % 41 - 20) * 0.01 + 0.05)) * 1000 + 0.5) AS BIGINT) AS speed FROM supplier")
def walking_speed(spark, sf_dir):
    v = limits.walking_speed(F.lit(6.0), (F.col("s_suppkey") % 41 - 20) * 0.01)
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.floor(v * 1000 + 0.5).cast("long").alias("speed"))


# The expected lengths come from the two roots of the line's quadratic equation, clipped to the segment.
@query(
    "nogo_circle_length",
    """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_partkey % 200 AS DOUBLE) AS ax, CAST(l_suppkey % 100 AS DOUBLE) AS ay, CAST(l_orderkey % 211 AS DOUBLE) + 0.5 AS bx, CAST(l_quantity * 3 AS DOUBLE) + 0.5 AS b_y, 20.0 + l_orderkey % 60 AS r FROM lineitem),
  q AS (SELECT *, (bx - ax) ** 2 + (b_y - ay) ** 2 AS a, 2 * ((ax - 100) * (bx - ax) + (ay - 70) * (b_y - ay)) AS b, (ax - 100) ** 2 + (ay - 70) ** 2 - r * r AS c FROM s),
  d AS (SELECT id, a, b, b * b - 4 * a * c AS d FROM q)
  SELECT id, CAST(floor(CASE WHEN d <= 0 THEN 0 ELSE sqrt(a) * greatest(0, least(1, (-b + sqrt(d)) / (2 * a)) - greatest(0, (-b - sqrt(d)) / (2 * a))) END * 1000 + 0.5) AS BIGINT) AS inside FROM d""",
)
def nogo_circle_length(spark, sf_dir):
    k = lambda c: F.col(c).cast("double")
    length = limits.inside_circle(k("l_partkey") % 200, k("l_suppkey") % 100, k("l_orderkey") % 211 + 0.5, k("l_quantity") * 3 + 0.5, F.lit(100.0), F.lit(70.0), 20.0 + F.col("l_orderkey") % 60)
    return _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.floor(length * 1000 + 0.5).cast("long").alias("inside"))


_KINDS = "CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 'no_left_turn' WHEN 1 THEN 'only_right_turn' WHEN 2 THEN 'no_straight_on' WHEN 3 THEN 'no_u_turn' WHEN 4 THEN 'no_entry' WHEN 5 THEN 'only_left_turn @ (Mo-Fr)' WHEN 6 THEN 'no_right_turn_on_red' ELSE 'give_way' END"


@query(
    "restriction_by_angle",
    f"SELECT id, CASE WHEN k IN ('give_way', 'no_right_turn_on_red') THEN false WHEN k IN ('no_left_turn', 'only_left_turn @ (Mo-Fr)') THEN a > -175 AND a < -5 WHEN k = 'only_right_turn' THEN a > 5 AND a < 175 WHEN k = 'no_straight_on' THEN a > -85 AND a < 85 WHEN k = 'no_u_turn' THEN a < -95 OR a > 95 ELSE true END AS valid FROM (SELECT o_orderkey AS id, {_KINDS} AS k, o_orderkey * 13 % 360 - 179.5 AS a FROM orders)",
)
def restriction_by_angle(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), limits.restriction_fits(F.expr(_KINDS), F.col("o_orderkey") * 13 % 360 - 179.5).alias("valid"))


@query("tags_concrete", "SELECT p_partkey AS wid, CASE WHEN p_partkey % 5 = 0 THEN 'own' WHEN p_partkey % 3 = 0 THEN 'plates' WHEN p_partkey % 3 = 1 THEN 'lanes' END AS concrete FROM part")
def tags_concrete(spark, sf_dir):
    k = F.col("p_partkey")
    surface = F.when(k % 3 == 0, "concrete:plates").when(k % 3 == 1, "concrete:lanes").when(k % 2 == 0, "concrete")
    tags = F.map_filter(F.create_map(F.lit("surface"), surface, F.lit("concrete"), F.when(k % 5 == 0, "own")), lambda a, b: b.isNotNull())
    return _table(spark, sf_dir, "part").select(k.alias("wid"), limits.with_concrete(tags)["concrete"].alias("concrete"))


@query(
    "search_boundary",
    f"WITH {cte('points')}, b AS (SELECT id, ilon, ilat, CASE WHEN id % 2 = 0 THEN 5000000 ELSE 1000000 END AS e FROM points) SELECT id, ilon > 175000000 - e AND ilon < 180000000 + e AND ilat > 85000000 - e AND ilat < 90000000 + e AS inside FROM b",
)
def search_boundary(spark, sf_dir):
    p = derived(spark, sf_dir, "points")
    return p.select("id", limits.in_search_boundary(F.col("ilon"), F.col("ilat"), F.lit(177_000_000), F.lit(86_500_000), F.col("id") % 2, F.lit(0)).alias("inside"))


@query("path_boxes", "SELECT l_orderkey AS id, min(l_partkey) AS west, min(l_suppkey) AS south, max(l_partkey) AS east, max(l_suppkey) AS north FROM lineitem GROUP BY 1")
def path_boxes(spark, sf_dir):
    path = F.collect_list(F.struct(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")))
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(path.alias("path")).select("id", limits.box_of(F.col("path")).alias("b")).select("id", "b.*")


@query(
    "dictionary_lines",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 <> 0 THEN 'highway' END AS key, CASE WHEN p_partkey % 6 <> 0 THEN p_type END AS value, CASE WHEN p_partkey % 6 <> 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE len(string_split(p_name, ' ')) END END AS aliases FROM part",
)
def dictionary_lines(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.when(k % 6 == 0, "  highway;0000000001 ").otherwise(F.concat_ws(" ", F.concat(F.lit("highway;"), F.lpad(k.cast("string"), 10, "0")), F.col("p_type"), F.when(k % 4 != 0, F.concat(F.lit("  "), F.col("p_name")))))
    return _table(spark, sf_dir, "part").select(k.alias("id"), limits.dictionary_line(line).alias("d")).select("id", "d.key", "d.value", F.when(F.col("d.aliases").isNotNull(), F.size("d.aliases")).cast("long").alias("aliases"))


@query(
    "track_segments",
    f"""WITH {cte('fixes')}, p AS (SELECT session, row_number() OVER w AS seq, 190000000 + CAST(sum(dx * 20) OVER w AS BIGINT) AS x, 140000000 + CAST(sum(dy * 20) OVER w AS BIGINT) AS y FROM fixes WINDOW w AS (PARTITION BY session ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)),
  l AS (SELECT *, lag(x) OVER o AS x1, lag(y) OVER o AS y1, lag(x, 2) OVER o AS x2, lag(y, 2) OVER o AS y2 FROM p WINDOW o AS (PARTITION BY session ORDER BY seq)),
  k AS (SELECT *, radians(floor(y1 / 100000.0) / 10.0 + 0.05 - 90) AS f, radians(floor(((y + y1) // 2) / 100000.0) / 10.0 + 0.05 - 90) AS g FROM l),
  m AS (SELECT *, (111.41513 * cos(f) - 0.09455 * cos(3 * f) + 0.00012 * cos(5 * f)) AS kx, (111.13209 - 0.56605 * cos(2 * f) + 0.0012 * cos(4 * f)) AS ky, (111.41513 * cos(g) - 0.09455 * cos(3 * g) + 0.00012 * cos(5 * g)) * 1e-3 AS mx, (111.13209 - 0.56605 * cos(2 * g) + 0.0012 * cos(4 * g)) * 1e-3 AS my FROM k),
  a AS (SELECT *, (x1 - x2) * kx AS ux, (y1 - y2) * ky AS uy, (x - x1) * kx AS vx, (y - y1) * ky AS vy FROM m),
  d AS (SELECT *, sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy)) AS d FROM a), t AS (SELECT *, CASE WHEN d > 0 THEN (uy * vx - ux * vy) / d END AS s, CASE WHEN d > 0 THEN (uy * vy + ux * vx) / d END AS c FROM d),
  v AS (SELECT *, CASE WHEN s * s > 0.5 THEN CASE WHEN s < 0 THEN -90 ELSE 90 END WHEN c < 0 THEN CASE WHEN s < 0 THEN -180 ELSE 180 END ELSE 0 END AS o, CASE WHEN s * s > 0.5 THEN CASE WHEN s < 0 THEN c ELSE -c END WHEN c < 0 THEN -s ELSE s END AS v FROM t)
  SELECT session, seq, CAST(floor(coalesce(sqrt(((x - x1) * mx) ** 2 + ((y - y1) * my) ** 2), 0) * 100 + 0.5) AS BIGINT) AS cm,
    CAST(floor(coalesce(o + v * (57.4539 + v * v * (9.57565 + v * v * (4.30904 + v * v * 2.56491))), 0) * 100 + 0.5) AS BIGINT) AS turn FROM v""",
)
def track_segments(spark, sf_dir):
    from pyspark.sql import Window

    order = tracks.by("session", "ms", "event_id")
    whole = order.rowsBetween(Window.unboundedPreceding, 0)
    p = derived(spark, sf_dir, "fixes").select(F.col("session").alias("track"), F.row_number().over(order).cast("long").alias("seq"), (190_000_000 + F.sum(F.col("dx") * 20).over(whole)).alias("ilon"), (140_000_000 + F.sum(F.col("dy") * 20).over(whole)).alias("ilat"))
    return tracks.segments(p).select(F.col("track").alias("session"), "seq", F.floor(F.col("metres") * 100 + 0.5).cast("long").alias("cm"), F.floor(F.col("angle") * 100 + 0.5).cast("long").alias("turn"))


@query("turn_distances", "SELECT track, seq, lag(d, 1, 0) OVER w AS before, lead(seq) OVER w AS next_seq FROM (SELECT l_orderkey AS track, CAST(l_linenumber AS BIGINT) AS seq, min(l_quantity) AS d FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY track ORDER BY seq)")
def turn_distances(spark, sf_dir):
    hints = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track"), F.col("l_linenumber").cast("long").alias("seq")).agg(F.min("l_quantity").alias("to_next"))
    return tracks.turn_distances(hints).drop("to_next")


@query(
    "nav_signal_lost",
    f"WITH {cte('fixes')}, g AS (SELECT session, ms, lead(ms) OVER (PARTITION BY session ORDER BY ms, event_id) AS a, min(ms) OVER (PARTITION BY session) AS b FROM fixes), s AS (SELECT session, a, b + ((ms + 10000 - b) // 2000 + 1) * 2000 AS ms FROM g) SELECT session, ms FROM s WHERE a IS NULL OR a > ms",
)
def nav_signal_lost(spark, sf_dir):
    return tracks.signal_lost(derived(spark, sf_dir, "fixes"))


_OFF = "p AS (SELECT session, ms, event_id, CAST(sum(dx) OVER w AS BIGINT) AS x, CAST(sum(dy) OVER w AS BIGINT) AS y FROM fixes WINDOW w AS (PARTITION BY session ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING))"


@query(
    "nav_reroutes",
    f"""WITH RECURSIVE {cte('fixes')}, {_OFF}, n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ms, event_id) AS k FROM p),
  r AS (SELECT session, ms, event_id, x, y, k FROM n WHERE k = 1 UNION ALL
    SELECT s.session, s.ms, s.event_id, s.x, s.y, s.k FROM (SELECT n.*, row_number() OVER (PARTITION BY n.session ORDER BY n.k) AS first FROM r JOIN n ON n.session = r.session AND n.k > r.k AND n.ms - r.ms >= 10000 AND (n.x - r.x) ** 2 + (n.y - r.y) ** 2 >= 625) s WHERE first = 1)
  SELECT session, ms, event_id FROM r""",
)
def nav_reroutes(spark, sf_dir):
    return tracks.reroutes(tracks.positions(derived(spark, sf_dir, "fixes")))


@query(
    "tile_claims",
    f"""WITH {cte('points', 'anchors')}, t AS (SELECT DISTINCT {tx(256)} AS x, {ty(256)} AS y FROM points),
  b AS (SELECT id AS rid, (ilon - 3000000) / 1e6 - 180 AS w, (ilon + 3000000) / 1e6 - 180 AS e, (ilat - 1500000) / 1e6 - 90 AS s, (ilat + 1500000) / 1e6 - 90 AS n FROM anchors),
  q AS (SELECT x, y, 360.0 * (x + i) / 256 - 180 AS lon, degrees(atan(sinh_)) AS lat FROM (SELECT x, y, i, (exp(pi() * (1 - 2 * (y + j) / 256)) - exp(-pi() * (1 - 2 * (y + j) / 256))) / 2 AS sinh_ FROM t, (VALUES (0.0), (0.5), (1.0)) a(i), (VALUES (0.0), (0.5), (1.0)) c(j)))
  SELECT DISTINCT x, y, rid FROM q JOIN b ON lon BETWEEN w AND e AND lat BETWEEN s AND n""",
)
def tile_claims(spark, sf_dir):
    from wayloom.functions import geo

    p = derived(spark, sf_dir, "points")
    tiles = p.select(geo.tile_x(geo.lon_of(F.col("ilon")), 8).alias("x"), geo.tile_y(geo.lat_of(F.col("ilat")), 8).alias("y"))
    boxes = derived(spark, sf_dir, "anchors").selectExpr("id as rid", "ilon - 3000000 as west", "ilon + 3000000 as east", "ilat - 1500000 as south", "ilat + 1500000 as north")
    return regions.tile_claims(tiles, boxes, 8)


@query("best_area", "SELECT c_nationkey AS start, arg_max(c_custkey, (c_custkey * 7 % 100, -c_custkey)) AS area FROM customer GROUP BY 1")
def best_area(spark, sf_dir):
    """Of the areas around each start the one of the largest weight, the first of equals."""
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("start")).agg(F.max(F.struct(k * 7 % 100, -k, k.alias("area"))).alias("b")).select("start", "b.area")


@query("search_address_match", f"WITH {_ADDR}, h AS (SELECT * FROM a WHERE street IS NOT NULL AND regexp_matches(' ' || lower(CASE WHEN trim(unit) = '' THEN number ELSE unit || '/' || number END || ' ' || street), '[^a-z0-9]13[^a-z0-9]') AND regexp_matches(' ' || lower(street), '[^a-z0-9]ro')), k AS (SELECT CAST(floor((ilon / 1e6 - 180) * 1000 + 0.5) AS BIGINT) AS p, CAST(floor((ilat / 1e6 - 90) * 1000 + 0.5) AS BIGINT) AS q, trim(unit) AS u, number, upper(street) AS s, min(id) AS id FROM h GROUP BY 1, 2, 3, 4, 5) SELECT id FROM k")
def search_address_match(spark, sf_dir):
    rows = _addresses(spark, sf_dir)
    whole = search.inverted_index(rows)
    number = whole.where("token = '13'").select("id").distinct()
    return search.matching(whole, "ro").join(number, "id")


@query(
    "search_projected_places",
    "SELECT p_partkey AS id, trim(coalesce(CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 10 = 1 THEN '  ' ELSE ' ' || p_name END END, CASE WHEN p_partkey % 2 = 0 THEN p_brand END)) AS name, p_type AS kind, CAST(CASE WHEN p_partkey % 5 = 0 THEN 20 ELSE p_size END AS INT) AS rank FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 7 <> 6 AND trim(coalesce(CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_partkey % 10 = 1 THEN '  ' ELSE p_name END END, CASE WHEN p_partkey % 2 = 0 THEN p_brand END)) <> ''",
)
def projected_places(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 3 != 0, F.when(k % 10 == 1, "  ").otherwise(F.concat(F.lit(" "), F.col("p_name"))))
    props = F.create_map(F.lit("name"), name, F.lit("name:en"), F.when(k % 2 == 0, F.col("p_brand")), F.lit("class"), F.when(k % 7 != 6, F.col("p_type")), F.lit("rank"), F.when(k % 5 != 0, F.col("p_size").cast("string")))
    layer = F.when(k % 4 == 0, "place").when(k % 4 == 3, "water").otherwise("poi")
    features = _table(spark, sf_dir, "part").select(k.alias("id"), layer.alias("layer"), F.lit("point").alias("geom_type"), F.map_filter(props, lambda a, b: b.isNotNull()).alias("props"))
    return search.projected_places(features).select("id", "name", "kind", "rank")
