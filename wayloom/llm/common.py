"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayloom.operators.shared import cut

__all__ = ["WORD", "ascii_lower", "batched", "cut", "extended", "ranked", "table", "unused", "words"]

#: Words after lower-casing: runs of digits, a-z and every character beyond ASCII; and the same as Java reads it faster.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_JAVA_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that go to a Python worker at once: a batch and what is made of it take several times as much there and in the JVM.
BATCH_BYTES = 8 << 20


def batched(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python in Arrow batches of about BATCH_BYTES (a setting of its session)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept; the slower per-character way only where a text isn't ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(_JAVA_WORD), F.lit(0))


#: Buckets of a value whose sizes are broadcast.
MOST_BROADCAST = 4096


def ranked(df: DataFrame, by: list[str], order: list[str], spread: Column, per_bucket: int, rows: int, name: str) -> DataFrame:
    """Adds name: a gapless rank from 0 inside each value of `by`, without one task holding a value's rows.

    Rows are dealt to buckets by `spread` (a long); bucket sizes are summed up in a table of at most
    (values of by) x buckets rows, broadcast up to MOST_BROADCAST buckets, and rows are numbered inside their bucket only. The order is that of
    (bucket, order)."""
    from pyspark.sql import Window

    n = max(1, rows // per_bucket + 1)
    df = df.withColumn("_bucket", F.pmod(spread, F.lit(n)).cast("int"))
    sizes = df.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    out = df.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(offsets) if n <= MOST_BROADCAST else offsets, [*by, "_bucket"])
    return out.withColumn(name, F.col("_offset") + F.col("_row") - 1).drop("_bucket", "_row", "_offset")


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores put before it as it takes to differ from all columns (in any case of letters)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def extended(df: DataFrame, fields: str) -> StructType:
    """The schema of df with more fields, given as in a CREATE TABLE."""
    return StructType(df.schema.fields + StructType.fromDDL(fields).fields)
