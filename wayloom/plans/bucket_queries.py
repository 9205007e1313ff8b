"""Queries of the bucket store: whole tables are published and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators.shared import scratch
from wayloom.plans.derived import cte, derived
from wayloom.plans.registry import query
from wayloom.sources import buckets

_NAME = "(CASE WHEN lo < 0 THEN 'W' || -lo ELSE 'E' || lo END) || '_' || (CASE WHEN la < 0 THEN 'S' || -la ELSE 'N' || la END)"


@query(
    "sink_buckets",
    f"""WITH {cte('places', 'points')}, n AS (SELECT id, ilon, ilat, ilon // 5000000 * 5 - 180 AS lo, ilat // 5000000 * 5 - 90 AS la FROM places), b AS (SELECT *, {_NAME} AS bucket FROM n),
    w AS (SELECT *, {_NAME} AS bucket FROM (SELECT id, ilon // 5000000 * 5 - 180 AS lo, ilat // 5000000 * 5 - 90 AS la FROM points)), k AS (SELECT bucket, count(*) AS ways FROM w GROUP BY 1)
    SELECT bucket, CAST(min(ilon // 45000000 * 6 + ilat // 30000000) AS INT) AS tile45, count(*) AS nodes, CAST(sum(id) AS BIGINT) AS ids, coalesce(max(ways), 0) AS ways FROM b LEFT JOIN k USING (bucket) WHERE lo >= 0 GROUP BY bucket""",
)
def sink_buckets(spark, sf_dir):
    """Places as nodes and points as ways of the eastern buckets are published in two builds, the second of which replaces what lies south; what is read back."""
    named = lambda t: derived(spark, sf_dir, t).select("id", "ilon", "ilat", buckets.bucket_of(F.col("ilon"), F.col("ilat")).alias("bucket"))
    frames = {"nodes": named("places"), "ways": named("points")}
    east = frames["nodes"].where(F.col("bucket").startswith("E")).select("bucket").distinct()
    asked = [r[0] for r in east.collect()]  # at most as many as the world has
    root = scratch(spark)
    buckets.publish(spark, root, frames, asked, "first")
    buckets.publish(spark, root, frames, [b for b in asked if "_S" in b], "second")
    nodes, ways = (buckets.published(spark, root, k) for k in ("nodes", "ways"))
    tile = F.min(buckets.tile45_of(F.col("ilon"), F.col("ilat"))).alias("tile45")
    told = nodes.groupBy("bucket").agg(tile, F.count(F.lit(1)).alias("nodes"), F.sum("id").alias("ids"))
    return told.join(ways.groupBy("bucket").agg(F.count(F.lit(1)).alias("ways")), "bucket", "left").select("bucket", "tile45", "nodes", "ids", F.coalesce("ways", F.lit(0)).alias("ways"))
