"""Lineage cuts in the shared folder, and connected components by alternating large and small stars, as Spark joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset: below the warehouse, or a temporary one where the driver is the only executor."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        alone = spark.conf.get("spark.master", "local").split("[")[0] == "local"
        top = tempfile.mkdtemp(prefix="wayloom-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/wayloom-scratch"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain(column: pa.Array) -> list:
    """What column.to_pylist() gives; nested values are taken apart by whole columns, as value by value they take many times longer."""
    if pa.types.is_list(column.type):
        values, out, at = plain(column.flatten()), [], 0
        for n in column.value_lengths().to_pylist():
            out.append(None if n is None else values[at : at + n])
            at += n or 0
        return out
    if pa.types.is_struct(column.type):
        names = [f.name for f in column.type]
        rows = [dict(zip(names, values)) for values in zip(*map(plain, column.flatten()))]
        return [row if here else None for row, here in zip(rows, column.is_valid().to_pylist())] if column.null_count else rows
    fixed = pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if fixed and not column.null_count else column.to_pylist()


def by_groups(df: DataFrame, key: str, order: list[str], each: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """each(rows of one group, sorted) -> rows as in schema ("name type, ..."), for all groups of df. Groups come one after the other in a sorted stream, so a small one costs no more than its rows; one group is held at a time."""
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*map(plain, batch.columns)):
                row = dict(zip(batch.schema.names, values))
                if held and held[0][key] != row[key]:
                    out += each(held)
                    held = []
                held.append(row)
            if out:
                yield batch_of(out)
        out = each(held) if held else []
        if out:
            yield batch_of(out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour of a node to the least node around it: the larger neighbours, or else the smaller ones.

    The least neighbour is an aggregate with partial sums, and the join that follows has one row a node on its
    right side, so a hub's rows can be split over tasks by the adaptive skew join."""
    if large:
        around = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        kept = around.where("b > a")
    else:
        around = kept = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    linked = kept.join(least, kept.a == least.k)
    out = linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of any ordered type -> (node, component): the least node reachable, for every node with an edge.

    Nulls and loops link nothing; repeated edges count once. Each round is cut off in the shared folder."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.sum(F.shiftright(F.xxhash64("b", "a"), 20)).alias("g")).first()
        if not seen["n"] or mark == tuple(seen):
            break
        mark = tuple(seen)
        now = cut(_star(_star(now, large=True), large=False))
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
