"""A store of five-degree buckets on a shared file system: builds are staged beside what is published, checked, and taken over bucket by bucket.

    root/<kind>/build=<id>/bucket=<name>/*.parquet     rows, with a checksum each
    root/state/version=<n>/*.parquet                   one row a bucket: which build is published

A build becomes visible only with the next version of the state, which is one file, so readers see all of a publication or none of it, also where renames
of folders aren't atomic. What fails its checks, or a job that is lost half way, leaves the published build as it was. One writer at a time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geo

CHECK = "_check"
STATE = "bucket string, state string, build string, nodes long, fingerprint string"
ROWS_PER_FILE = 1_000_000
#: States of a bucket. A bucket that was asked for and has no rows is empty, and has no build.
BUILT, EMPTY = "built", "empty"


def bucket_of(ilon: Column, ilat: Column) -> Column:
    """The name of the five-degree bucket of an E6 position (counted from 180 west and 90 south)."""
    corner = lambda c, off: (F.floor(c / 5_000_000) * 5 - off).cast("int")
    return geo.bucket_name(corner(ilon, 180), corner(ilat, 90))


def tile45_of(ilon: Column, ilat: Column) -> Column:
    """The number of the 45 x 30 degree tile: six from south to north, then on to the east."""
    return (F.floor(ilon / 45_000_000) * 6 + F.floor(ilat / 30_000_000)).cast("int")


def state_of(spark: SparkSession, root: str) -> DataFrame:
    """The last version of the state; no rows before the first publication. At most 2,592 rows, one a bucket of the world."""
    try:
        versions = spark.read.parquet(f"{root}/state")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{STATE}, version int")
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == last)


def _put_state(spark: SparkSession, root: str, rows: list[tuple], version: int) -> None:
    spark.createDataFrame(rows, STATE).coalesce(1).write.parquet(f"{root}/state/version={version}")


def _sound(staged: DataFrame, columns: list[str]) -> DataFrame:
    """(bucket, rows, broken) of what was written, read back."""
    fits = F.col(CHECK) == F.xxhash64(*columns)
    return staged.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.coalesce(fits, F.lit(False))).alias("broken"))


def publish(spark: SparkSession, root: str, frames: dict[str, DataFrame], asked: list[str], fingerprint: str, check: Callable[[dict[str, DataFrame]], DataFrame] | None = None, counted: str | None = None) -> DataFrame:
    """Stages frames (kind -> rows with a column bucket), checks them, and publishes the asked buckets that are sound -> (bucket, published, reason).

    Rows of buckets that aren't asked for stay behind: a build of one bucket holds only the rims of its neighbours. A bucket is refused where a kind's rows
    read back are fewer or more than were given, where a row doesn't fit its checksum, or where check(kind -> rows read back) -> (bucket, reason) names it. Refused
    buckets keep the build they had. counted: the kind whose rows the state counts, else the first."""
    build, first = uuid.uuid4().hex, counted or next(iter(frames))
    told, staged = None, {}
    names = spark.createDataFrame([(b,) for b in sorted(set(asked))], "bucket string")
    for kind, frame in frames.items():
        columns = [c for c in frame.columns if c != "bucket"]
        own = frame.join(F.broadcast(names), "bucket", "left_semi")  # bounded by the buckets of the world
        path = f"{root}/{kind}/build={build}"
        given = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("given"))
        # a small bucket is one file, a large one is dealt out by its rows' checksums
        dealt = own.join(F.broadcast(given), "bucket").withColumn(CHECK, F.xxhash64(*columns))
        dealt.repartition("bucket", F.pmod(F.col(CHECK), F.ceil(F.col("given") / ROWS_PER_FILE))).drop("given").write.partitionBy("bucket").parquet(path)
        schema = own.select(*columns, F.lit(0).cast("long").alias(CHECK), F.lit("").alias("bucket")).schema
        staged[kind] = spark.read.schema(schema).parquet(path)
        met = given.join(_sound(staged[kind], columns), "bucket", "full")
        lost = F.when(F.coalesce("given", F.lit(0)) != F.coalesce("rows", F.lit(0)), f"{kind}: rows lost").when(F.col("broken") > 0, f"{kind}: rows broken")
        part = met.select("bucket", lost.alias("reason"), F.lit(kind).alias("kind"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
        told = part if told is None else told.union(part)
    if check:
        told = told.union(check({k: f.drop(CHECK) for k, f in staged.items()}).select("bucket", "reason", F.lit("check"), F.lit(0).cast("long")))
    verdicts = names.join(told, "bucket", "left").groupBy("bucket").agg(F.min("reason").alias("reason"), F.sum(F.when(F.col("kind") == first, F.col("rows"))).alias("nodes"), F.coalesce(F.sum("rows"), F.lit(0)).alias("all"))
    rows = verdicts.orderBy("bucket").collect()  # one row a bucket
    before = state_of(spark, root).collect()
    now = {r["bucket"]: tuple(r)[:5] for r in before}
    for r in rows:
        if r["reason"] is None:
            now[r["bucket"]] = (r["bucket"], BUILT, build, r["nodes"] or 0, fingerprint) if r["all"] else (r["bucket"], EMPTY, None, 0, fingerprint)
    _put_state(spark, root, [now[b] for b in sorted(now)], max((r["version"] for r in before), default=0) + 1)
    return spark.createDataFrame([(r["bucket"], r["reason"] is None, r["reason"]) for r in rows], "bucket string, published boolean, reason string")


def stale(spark: SparkSession, root: str, asked: DataFrame, fingerprint: str) -> DataFrame:
    """asked(bucket): those that aren't published, or were built from something else than this fingerprint."""
    fresh = state_of(spark, root).where(F.col("fingerprint") == fingerprint)
    return asked.select("bucket").distinct().join(fresh, "bucket", "left_anti")


def published(spark: SparkSession, root: str, kind: str, buckets: list[str] | None = None) -> DataFrame | None:
    """The rows of a kind in the published builds, with their bucket, whole or of some buckets; None where there are none. Only folders of published builds are listed."""
    state = [r for r in state_of(spark, root).where(F.col("state") == BUILT).collect() if buckets is None or r["bucket"] in buckets]
    out = None
    for build in sorted({r["build"] for r in state}):
        top = f"{root}/{kind}/build={build}"
        try:
            rows = spark.read.parquet(top).where(F.col("bucket").isin([r["bucket"] for r in state if r["build"] == build])).drop(CHECK)
        except AnalysisException as e:  # a build without any row of this kind, or without the kind
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def dangling(nodes: str = "nodes", ways: str = "ways") -> Callable[[dict[str, DataFrame]], DataFrame]:
    """A check: ways(bucket, nid) whose node is in no staged bucket of nodes(bucket, id)."""

    def check(staged: dict[str, DataFrame]) -> DataFrame:
        known = staged[nodes].select(F.col("id").alias("nid"))
        return staged[ways].join(known, "nid", "left_anti").groupBy("bucket").agg(F.lit("ways: nodes missing").alias("reason"))

    return check
