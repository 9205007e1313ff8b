"""A query of stitching over fragments made of all customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.operators import stitching
from wayloom.plans.registry import query


@query("graph_stitched")
def graph_stitched(spark, sf_dir):
    """Four nodes a fragment, in rows of 40 fragments whose ends come close to the next ones: its nodes after stitching."""
    c, k = F.col("c_custkey"), F.col("k")
    nodes = spark.read.parquet(f"{sf_dir}/customer.parquet").select(c, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    nodes = nodes.select(
        c.alias("fid"), k, (c * 4 + k).alias("nid"), (c % 40 * 60 + k * 25 + c * (k + 1) * 13 % 11).alias("x"), (F.floor(c / 40) * 40 + c * (k * 3 + 1) * 7 % 23).alias("y")
    )
    joined, _ = stitching.stitched(nodes.select("fid", "k", "nid"), nodes.select("nid", "x", "y"), 12)
    return joined.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "nid"))), lambda n: n["nid"]).alias("nodes")).select("fid", F.concat_ws(",", F.col("nodes").cast("array<string>")).alias("nodes"))
