"""The bucket store: what is published, refused, replaced and read back."""

import glob

from pyspark.sql import functions as F

from wayloom.sources import buckets

NODES, WAYS = "bucket string, id long, ilon long", "bucket string, nid long"


def rows(frame):
    return sorted(map(tuple, frame.collect())) if frame is not None else []


def test_names_and_tiles(spark):
    at = spark.createDataFrame([(0, 0), (179_999_999, 90_000_000), (185_000_000, 139_999_999), (359_999_999, 179_999_999)], "x long, y long")
    got = at.select(buckets.bucket_of(F.col("x"), F.col("y")), buckets.tile45_of(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [("W180_S90", 0), ("W5_N0", 21), ("E5_N45", 28), ("E175_N85", 47)]


def test_publication(spark, tmp_path):
    root = str(tmp_path / "store")
    first = {"nodes": spark.createDataFrame([("A", 1, 5), ("A", 2, None), ("B", 3, 7), ("C", 9, 9)], NODES), "ways": spark.createDataFrame([("A", 1), ("A", 3)], WAYS)}
    assert rows(buckets.state_of(spark, root)) == [] and buckets.published(spark, root, "nodes") is None
    got = buckets.publish(spark, root, first, ["A", "B", "D"], "f1", buckets.dangling())
    assert rows(got) == [("A", True, None), ("B", True, None), ("D", True, None)]
    state = {r.bucket: r for r in buckets.state_of(spark, root).collect()}
    assert {b: (r.state, r.nodes, r.fingerprint, r.build is None) for b, r in state.items()} == {"A": ("built", 2, "f1", False), "B": ("built", 1, "f1", False), "D": ("empty", 0, "f1", True)}
    nodes = buckets.published(spark, root, "nodes").select("bucket", "id")
    assert rows(nodes) == [("A", 1), ("A", 2), ("B", 3)]  # C wasn't asked for
    # one bucket is replaced, the rim of another one in the same frames doesn't touch it
    second = {"nodes": spark.createDataFrame([("A", 11, 5), ("B", 12, 1)], NODES), "ways": spark.createDataFrame([("A", 11)], WAYS)}
    buckets.publish(spark, root, second, ["A"], "f2", buckets.dangling())
    assert rows(buckets.published(spark, root, "nodes").select("bucket", "id")) == [("A", 11), ("B", 3)]
    assert rows(buckets.published(spark, root, "ways")) == [(11, "A")] or rows(buckets.published(spark, root, "ways").select("bucket", "nid")) == [("A", 11)]
    # a build that fails its check leaves what was published
    bad = {"nodes": spark.createDataFrame([("A", 21, 5), ("B", 22, 1)], NODES), "ways": spark.createDataFrame([("A", 999), ("B", 22)], WAYS)}
    got = buckets.publish(spark, root, bad, ["A", "B"], "f3", buckets.dangling())
    assert rows(got) == [("A", False, "ways: nodes missing"), ("B", True, None)]
    assert rows(buckets.published(spark, root, "nodes").select("bucket", "id")) == [("A", 11), ("B", 22)]
    assert rows(buckets.published(spark, root, "nodes", ["B"]).select("id")) == [(22,)]
    asked = spark.createDataFrame([("A",), ("B",), ("D",), ("E",)], "bucket string")
    assert rows(buckets.stale(spark, root, asked, "f3")) == [("A",), ("D",), ("E",)]
    assert sorted(p.split("=")[-1] for p in glob.glob(root + "/state/version=*")) == ["1", "2", "3"]


def test_broken_rows_and_lost_jobs(spark, tmp_path):
    root = str(tmp_path / "store")
    good = {"nodes": spark.createDataFrame([("A", 1, 5), ("B", 3, 7)], NODES)}
    buckets.publish(spark, root, good, ["A", "B"], "f1")
    # a stage that was lost half way: files without a state
    good["nodes"].withColumn(buckets.CHECK, F.lit(0)).write.partitionBy("bucket").parquet(f"{root}/nodes/build=lost")
    assert rows(buckets.published(spark, root, "nodes").select("bucket", "id")) == [("A", 1), ("B", 3)]
    # rows that don't fit their checksums, or are fewer than given
    staged = spark.createDataFrame([("A", 1, 5, 0)], NODES + ", _check long")
    assert [tuple(r) for r in buckets._sound(staged, ["id", "ilon"]).collect()] == [("A", 1, 1)]
    fitting = staged.withColumn("_check", F.xxhash64("id", "ilon"))
    assert [tuple(r) for r in buckets._sound(fitting, ["id", "ilon"]).collect()] == [("A", 1, 0)]
    empty = buckets.publish(spark, root, {"nodes": spark.createDataFrame([], NODES)}, ["A"], "f2")
    assert rows(empty) == [("A", True, None)]
    assert rows(buckets.published(spark, root, "nodes").select("bucket", "id")) == [("B", 3)]
