"""Registered queries over the search index."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import names

from wayloom.operators import search
from wayloom.plans.derived import cte, derived
from wayloom.plans.registry import query

QUERY, LON, LAT = "small wid", 13.4, 52.5
_HAVERSINE = "2 * 6371000.0 * asin(sqrt(sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) ** 2))"
_METRES = "CAST(floor(" + _HAVERSINE.format(lat1=LAT, lon1=LON, lat2="(ilat / 1e6 - 90)", lon2="(ilon / 1e6 - 180)") + " + 0.5) AS BIGINT)"
_DEDUPED = "d AS (SELECT name || '|' || kind AS dedupe_key, arg_min({'id': id, 'name': name, 'kind': kind, 'rank': rank, 'ilon': ilon, 'ilat': ilat, 'zoom': zoom}, (zoom, id)) AS r FROM places GROUP BY 1)"
_TOKENS = "t AS (SELECT r.id AS id, unnest(regexp_split_to_array(lower(r.name), '[^a-z0-9]+')) AS token FROM d)"
_HITS = "h AS (SELECT id FROM t WHERE token LIKE 'small%' INTERSECT SELECT id FROM t WHERE token LIKE 'wid%')"


def _deduped(spark, sf_dir):
    return search.dedupe_places(derived(spark, sf_dir, "places"))


@query("search_min_zoom_dedupe", f"WITH {cte('places')}, {_DEDUPED} SELECT dedupe_key, r.id AS id, r.zoom AS zoom, r.rank AS rank FROM d")
def min_zoom_dedupe(spark, sf_dir):
    return _deduped(spark, sf_dir).select("dedupe_key", "id", "zoom", "rank")


@query("search_topk", f"WITH {cte('places')}, {_DEDUPED}, {_TOKENS}, {_HITS} SELECT r.id AS id, r.name AS name, r.rank AS rank, {_METRES.replace('ilat', 'r.ilat').replace('ilon', 'r.ilon')} AS metres FROM d JOIN h ON r.id = h.id ORDER BY 3, 4, 1 LIMIT 20")
def topk(spark, sf_dir):
    places = _deduped(spark, sf_dir)
    hits = places.join(search.matching(search.inverted_index(places), QUERY), "id")
    return search.ranked(hits, LON, LAT).select("id", "name", "rank", "metres")


@query("search_prefix_match", f"WITH {cte('places')}, {_DEDUPED}, {_TOKENS}, {_HITS} SELECT id FROM h")
def prefix_match(spark, sf_dir):
    return search.matching(search.inverted_index(_deduped(spark, sf_dir)), QUERY)


@query("search_phrase_match", f"WITH {cte('places')} SELECT id FROM places WHERE regexp_matches(lower(name), '(^| )red wid[a-z]*( |$)')")
def phrase_match(spark, sf_dir):
    return search.matching(search.inverted_index(derived(spark, sf_dir, "places")), '"red-wid"*')


_ADDR = """a AS (SELECT o_orderkey AS id, CAST(o_orderkey % 300 AS VARCHAR) AS number, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE CAST(o_orderkey % 7 AS VARCHAR) END AS unit,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE upper(p_name) || ' ' || CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'ST' WHEN 1 THEN 'road' WHEN 2 THEN 'NSW' ELSE '3RD' END END AS street,
  (o_custkey * 6700417 + 31) % 360000000 AS ilon, (o_custkey * 92821 + 17) % 160000000 + 10000000 AS ilat
  FROM orders JOIN part ON p_partkey = o_orderkey % 100)"""


def _addresses(spark, sf_dir):
    sql = "WITH " + _ADDR.replace("VARCHAR", "STRING").replace("FROM orders JOIN part", "FROM {orders} JOIN {part}") + " SELECT * FROM a"
    return search.addresses(spark.sql(sql, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"), part=spark.read.parquet(f"{sf_dir}/part.parquet")))


_WORD = "CASE WHEN upper(w) IN ('NSW') THEN upper(w) WHEN upper(w) = 'ST' THEN 'St' WHEN upper(w) = 'ROAD' THEN 'Road' WHEN regexp_matches(w, '[0-9]') THEN w ELSE upper(w[1]) || lower(w[2:]) END"


@query(
    "search_address_index",
    f"""WITH {_ADDR}, n AS (SELECT *, CASE WHEN trim(unit) = '' THEN number ELSE unit || '/' || number END || ' ' || list_aggregate(list_transform(string_split(street, ' '), lambda w: {_WORD}), 'string_agg', ' ') AS name,
  'address|' || CAST(floor((ilon / 1e6 - 180) * 1000 + 0.5) AS BIGINT) || '|' || CAST(floor((ilat / 1e6 - 90) * 1000 + 0.5) AS BIGINT) || '|' || trim(unit) || '|' || number || '|' || upper(street) AS dedupe_key FROM a WHERE street IS NOT NULL)
SELECT dedupe_key, min(id) AS id, arg_min(name, id) AS name FROM n GROUP BY 1""",
)
def address_index(spark, sf_dir):
    return _addresses(spark, sf_dir).select("dedupe_key", "id", "name")


@query(
    "search_insert_or_ignore",
    f"""WITH {cte('places')}, {_DEDUPED}, s AS (SELECT dedupe_key FROM d WHERE r.zoom <= 4), o AS (SELECT DISTINCT name || '|' || kind AS dedupe_key FROM places WHERE zoom > 2)
SELECT (SELECT count(*) FROM s) AS stored, (SELECT count(*) FROM places WHERE zoom > 2) AS offered, (SELECT count(*) FROM o WHERE dedupe_key NOT IN (SELECT dedupe_key FROM s)) AS inserted""",
)
def insert_or_ignore(spark, sf_dir):
    places = derived(spark, sf_dir, "places")
    stored = search.dedupe_places(places).where("zoom <= 4")
    offered = places.where("zoom > 2").withColumn("dedupe_key", names.place_key(F.col("name"), F.col("kind")))
    new = search.insert_or_ignore(stored, offered, "dedupe_key")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(stored, "stored").crossJoin(count(offered, "offered")).crossJoin(count(new, "inserted"))  # single rows


_REGION = "c{n} AS (SELECT id, name, rank, ilon, ilat FROM places WHERE id % 3 = {n} AND regexp_matches(lower(name), '(^| )red') ORDER BY rank, abs(ilon - 193400000) + abs(ilat - 142500000), id LIMIT 500)"


@query("search_multi_region", f"WITH {cte('places')}, {_REGION.format(n=0)}, {_REGION.format(n=1)}, {_REGION.format(n=2)} SELECT id, name, rank, {_METRES} AS metres FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2) ORDER BY rank, metres, id LIMIT 20")
def multi_region(spark, sf_dir):
    places = derived(spark, sf_dir, "places").select("id", "name", "rank", "ilon", "ilat")
    return search.search_regions([places.where(F.col("id") % 3 == n) for n in range(3)], "red", LON, LAT).select("id", "name", "rank", "metres")


@query(
    "search_address_shaped",
    "SELECT p_partkey AS id, len(q) >= 2 AND len(list_filter(q, lambda x: regexp_matches(x, '^[0-9]'))) > 0 AND len(list_filter(q, lambda x: NOT regexp_matches(x, '^[0-9]'))) > 0 AS shaped FROM (SELECT p_partkey, string_split(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_size ELSE '' END, ' ') AS q FROM part)",
)
def address_shaped(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(' "'), F.col("p_size").cast("string"), F.lit("*"))).otherwise(""))
    return part.select(F.col("p_partkey").alias("id"), names.is_address_shaped(text).alias("shaped"))


@query("search_fingerprint", "SELECT p_partkey AS id, sha256('index/3/' || p_name || p_size) AS fingerprint FROM part")
def fingerprint(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), names.fingerprint("index", 3, F.col("p_name"), F.col("p_size")).alias("fingerprint"))


@query("search_table_counts", f"WITH {cte('places')}, {_DEDUPED} SELECT r.kind AS kind, count(*) AS n FROM d GROUP BY 1")
def table_counts(spark, sf_dir):
    return _deduped(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_distance_duration",
    "SELECT o_orderkey AS id, CASE WHEN m < 1000 THEN m || ' m' ELSE printf('%.1f km', m / 1000.0) END AS distance, CASE WHEN t < 60 THEN t || ' min' ELSE (t // 60) || ' h ' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') || ' min' END AS duration FROM (SELECT o_orderkey, o_orderkey * 20 + 7 AS m, (o_orderkey + 59) // 60 AS t FROM orders)",
)
def distance_duration(spark, sf_dir):
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("id"), names.shown_distance(key * 20 + 7).alias("distance"), names.shown_duration(key).alias("duration"))


@query("text_region_id", "SELECT c_custkey AS id, trim(regexp_replace(regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9-]+', '-', 'g'), '-{2,}', '-', 'g'), '-') AS region FROM customer")
def region_slug(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), names.region_id(F.concat(F.lit("map-"), F.col("c_name"), F.lit(" "), F.col("c_mktsegment"), F.lit(".pm"))).alias("region"))


