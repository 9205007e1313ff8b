"""Registered queries over areas, names and small formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import areas
from wayloom.plans.derived import cte, derived
from wayloom.plans.registry import query
from wayloom.plans.routes import _MATCH, _PNT, _SEG, _plane


@query("nogo_polygon", "SELECT c_custkey AS id, (x BETWEEN 0 AND 60 AND y BETWEEN 0 AND 20) OR (x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 60) AS inside FROM (SELECT c_custkey, c_custkey * 7 % 81 - 5 AS x, c_custkey * 11 % 79 - 5 AS y FROM customer)")
def nogo_polygon(spark, sf_dir):
    k = F.col("c_custkey")
    ring = F.array(*(F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ((0, 0), (60, 0), (60, 20), (20, 20), (20, 60), (0, 60))))
    at = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), (k * 7 % 81 - 5).alias("x"), (k * 11 % 79 - 5).alias("y"))
    return at.select("id", areas.in_polygon(F.col("x"), F.col("y"), ring).alias("inside"))


@query("nogo_segment_crossing", "SELECT c_custkey AS id, CAST(CASE WHEN x IN (10, 20) THEN CASE WHEN y <= 5 AND y + 30 >= 5 THEN 2 ELSE 0 END WHEN x > 10 AND x < 20 AND y < 5 AND y + 30 > 5 THEN 1 WHEN x BETWEEN 10 AND 20 AND (y = 5 OR y + 30 = 5) THEN 2 ELSE 0 END AS INT) AS meets FROM (SELECT c_custkey, c_custkey % 31 AS x, c_custkey * 3 % 71 - 35 AS y FROM customer)")
def nogo_crossing(spark, sf_dir):
    k = F.col("c_custkey")
    at = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), (k % 31).alias("x"), (k * 3 % 71 - 35).alias("y"))
    c = lambda n: F.lit(n).cast("long")
    return at.select("id", areas.segments_meet((c(10), c(5)), (c(20), c(5)), (F.col("x"), F.col("y")), (F.col("x"), F.col("y") + 30)).alias("meets"))


@query("nogo_checksum", f"WITH {cte('anchors')} SELECT CAST(sum(ilon) AS BIGINT) AS lon, CAST(sum(ilat) AS BIGINT) AS lat, CAST(sum(id * 10) AS BIGINT) AS radius FROM anchors")
def nogo_checksum(spark, sf_dir):
    return derived(spark, sf_dir, "anchors").agg(F.sum("ilon").alias("lon"), F.sum("ilat").alias("lat"), F.sum(F.col("id") * 10).alias("radius"))


@query("area_profile", "SELECT l_suppkey AS area, count(*) AS ways, CAST(trunc(count(*) FILTER (l_quantity < 50) * 100.0 / count(*)) AS INT) AS flat, CAST(trunc(count(*) FILTER (l_returnflag = 'R') * 100.0 / count(*)) AS INT) AS forest, CAST(trunc(count(*) FILTER (l_linestatus = 'O') * 100.0 / count(*)) AS INT) AS river FROM lineitem GROUP BY 1")
def area_profile(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("area"), F.col("l_quantity").alias("climb"), (F.col("l_returnflag") == "R").alias("forest"), (F.col("l_linestatus") == "O").alias("river"))
    return areas.area_profile(li, "area")


@query("turn_street_names", f"WITH {_SEG}, {_PNT}, {_MATCH}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY metres, off, sid) AS nth FROM f WHERE metres <= 60) SELECT id, p_name || ' st' AS name FROM n JOIN part ON p_partkey = sid WHERE nth = 1")
def street_names(spark, sf_dir):
    turns, roads = _plane(spark, sf_dir)
    named = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("sid"), F.concat("p_name", F.lit(" st")).alias("name"))
    return areas.street_names(turns, roads.join(named, "sid"), 60)


@query("tags_retention", "SELECT p_partkey AS id, 1 + CAST(p_partkey % 2 = 0 AS INT) AS kept FROM part")
def retention(spark, sf_dir):
    k = F.col("p_partkey")
    tags = F.map_filter(F.create_map(F.lit("barrier"), F.lit("gate"), F.lit("note"), F.lit("x"), F.lit("foot"), F.when(k % 2 == 0, "no")), lambda _, v: v.isNotNull())
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("id"), F.size(areas.kept_tags(tags, ["barrier", "foot"])).alias("kept"))


@query("text_geo_uri", "SELECT c_custkey AS id, CASE CAST(c_custkey % 4 AS INT) WHEN 3 THEN NULL ELSE CAST(c_custkey % 80 + 0.5 AS DOUBLE) END AS lat, CASE CAST(c_custkey % 4 AS INT) WHEN 3 THEN NULL ELSE CAST(-(c_custkey % 170) - 0.25 AS DOUBLE) END AS lon, CASE CAST(c_custkey % 4 AS INT) WHEN 1 THEN c_name END AS label, CASE CAST(c_custkey % 4 AS INT) WHEN 2 THEN 14 END AS zoom, CASE CAST(c_custkey % 4 AS INT) WHEN 3 THEN 'main street ' || c_custkey END AS query FROM customer")
def geo_uri(spark, sf_dir):
    k = F.col("c_custkey")
    pair = F.concat((k % 80).cast("string"), F.lit(".5,-"), (k % 170).cast("string"), F.lit(".25"))
    uri = F.when(k % 4 == 0, F.concat(F.lit("geo:"), pair)).when(k % 4 == 1, F.concat(F.lit("geo:0,0?q="), pair, F.lit("("), F.replace("c_name", F.lit("#"), F.lit("%23")), F.lit(")"))).when(k % 4 == 2, F.concat(F.lit("GEO:"), pair, F.lit("?z=14")))
    uri = uri.otherwise(F.concat(F.lit("geo:0,0?q=main+street%20"), k.cast("string")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), areas.geo_uri(uri).alias("g")).select("id", "g.*")


@query("track_append", "SELECT count(*) AS nodes, CAST(max(seq) AS BIGINT) AS last, CAST(sum(cost) AS BIGINT) AS cost FROM (SELECT l_orderkey AS track, l_linenumber AS seq, l_linenumber * 10 AS cost FROM lineitem UNION ALL SELECT a.track, b.seq + a.seq, b.cost + a.cost FROM (SELECT l_orderkey AS track, max(l_linenumber) AS seq, max(l_linenumber * 10) AS cost FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey AS track, l_linenumber AS seq, l_linenumber * 3 AS cost FROM lineitem WHERE l_linenumber > 0) b USING (track))")
def track_append(spark, sf_dir):
    n = F.col("l_linenumber")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("track"), n.alias("seq"), F.col("l_partkey").alias("node"), (n * 10).alias("c10"), (n * 3).alias("c3"))
    out = areas.appended(li.withColumn("cost", F.col("c10")), li.withColumn("cost", F.col("c3")))
    return out.agg(F.count(F.lit(1)).alias("nodes"), F.max("seq").cast("long").alias("last"), F.sum("cost").alias("cost"))


@query("text_manifest", "SELECT n_nationkey AS id, '{\"version\":3,\"fingerprint\":\"' || n_name || '\",\"buckets\":[\"E10_N50\",\"W5_N45\"]}' AS manifest, CAST(3 AS INT) AS version FROM nation")
def manifest(spark, sf_dir):
    m = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("id"), areas.manifest(3, F.col("n_name"), F.array(F.lit("W5_N45"), F.lit("E10_N50"))).alias("manifest"))
    return m.select("id", "manifest", areas.read_manifest(F.col("manifest"))["version"].alias("version"))
