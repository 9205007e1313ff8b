"""Mixing sources to target weights: pivotal dependent rounding of copies in a reduction tree. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.llm.common import cut, table

#: Weights of the sources in code point order, repeating, nulls last; the words of the mix as a share of all words; copies of a source at most.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Fractional documents that are settled against each other in one array, and rows of a source that are numbered in one window.
FAN, BUCKET_ROWS = 128, 2048
#: Sources whose targets are broadcast, at most.
MOST_BROADCAST = 10_000
SEED = 11

_SPACE = r"[^\x20\x09-\x0D]++"


def n_words(text: Column) -> Column:
    """The number of runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_SPACE)), F.lit(0)).cast("long")


def placed(names: DataFrame, column: str) -> DataFrame:
    """Adds place, a gapless rank from 0 in code point order, nulls last, to distinct names: sorted by ranges, so that no task holds all."""
    rows = names.repartitionByRange(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(column).isNull(), F.col(column)).sortWithinPartitions(F.col(column).isNull(), F.col(column))
    rows = cut(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a partition
    return rows.join(F.broadcast(offsets), "_part").withColumn("place", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def targets(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs(source, size) -> source, rows, source_size, place, target: words that each source is to give.

    share times all words are dealt out by the weights; a source stops at most times its own words, and what it leaves goes to
    the others by their weights until none is above. Each round is one aggregate over the sources. The shares can't all be
    reached where share > most: then every source stops."""
    sums = docs.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    named = cut(placed(sums, "source").withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))))
    level = None
    while True:
        stops = F.lit(False) if level is None else F.col("_cap") <= F.col("_weight") * F.lit(level)
        seen = named.agg(F.sum("source_size").alias("words"), F.sum(F.when(stops, F.col("_cap"))).alias("full"), F.sum(F.when(~stops, F.col("_weight"))).alias("open")).first()
        new = (share * (seen["words"] or 0) - (seen["full"] or 0.0)) / seen["open"] if seen["open"] else level
        if new is None or level is not None and new <= level * (1 + 1e-15):
            break
        level = new
    target = F.least(F.col("_cap"), F.col("_weight") * F.lit(float(level or 0.0)))
    return named.withColumn("target", target).drop("_weight", "_cap")


def _settled(members: Column, seed: int) -> Column:
    """An array of at least one struct (key, size, mass, row), mass in 0..size -> (held, done): one stays fractional, the others have mass 0 or size.

    The first is held. The held one and the next pass mass on until one of them is 0 or whole: by chance in either way, so that neither's expected
    mass changes; the sum never does. The one that isn't integral is held on."""

    def meet(acc: Column, x: Column) -> Column:
        h, done = acc["held"], acc["done"]
        room_h, room_x = h["size"] - h["mass"], x["size"] - x["mass"]
        up, down = F.least(room_h, x["mass"]), F.least(h["mass"], room_x)
        chance = F.shiftrightunsigned(F.xxhash64(h["key"], x["key"], F.lit(seed)), 11) * F.lit(2.0**-53)
        to = lambda s, mass: s.withField("mass", mass)
        whole = lambda s: to(s, s["size"])
        none = lambda s: to(s, F.lit(0.0))
        rose = F.when(room_h <= x["mass"], F.struct(to(x, x["mass"] - up).alias("held"), whole(h).alias("d"))).otherwise(F.struct(to(h, h["mass"] + up).alias("held"), none(x).alias("d")))
        fell = F.when(h["mass"] <= room_x, F.struct(to(x, x["mass"] + down).alias("held"), none(h).alias("d"))).otherwise(F.struct(to(h, h["mass"] - down).alias("held"), whole(x).alias("d")))
        turned = F.when(chance * (up + down) < down, rose).otherwise(fell)
        # a one-element array binds the pair, so that it isn't computed for each of its uses
        return F.get(F.transform(F.array(turned), lambda t: F.struct(t["held"].alias("held"), F.concat(done, F.array(t["d"])).alias("done"))), F.lit(0))

    begin = F.struct(F.get(members, F.lit(0)).alias("held"), F.slice(members, 1, 0).alias("done"))
    return F.aggregate(F.slice(members, F.lit(2), F.greatest(F.size(members) - 1, F.lit(0))), begin, meet)


def rounded(rows: DataFrame, fan: int = FAN, bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """rows(place, key, size double, mass double, rows, row) -> place, size, mass, row, last: each with mass 0 or size, but for one a place (last).

    place tells groups apart that keep their sums, rows is their number of rows. A tree: rows of a bucket are settled in
    arrays of fan at most, what each leaves meets others of its bucket, then of fan buckets, and so on until one is left."""
    parts = F.ceil(F.col("rows") / F.lit(bucket_rows))
    own = rows.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed)), parts).cast("long"))
    number = F.row_number().over(Window.partitionBy("place", "bucket").orderBy("key", "size")) - 1
    level = own.select("place", "bucket", number.cast("long").alias("at"), F.struct("key", "size", "mass", "row").alias("member"))
    in_order = lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)
    done, left, turn = None, {"at": 1, "bucket": 1}, 0
    while left["at"] or left["bucket"]:
        order = "at" if left["at"] else "bucket"  # inside buckets first, whose rows may be more than planned, then across them
        group = ["bucket", F.expr(f"at div {fan}").alias("at")] if order == "at" else [F.expr(f"bucket div {fan}").alias("bucket"), F.lit(0).cast("long").alias("at")]
        members = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("member").alias("m"))), in_order), lambda z: z["m"])
        met = level.groupBy("place", *group).agg(members.alias("members"))
        met = cut(met.select("place", "bucket", "at", _settled(F.col("members"), seed + turn).alias("got")).select("place", "bucket", "at", "got.held", "got.done"))
        found = met.select("place", F.explode("done").alias("m")).select("place", "m.size", "m.mass", "m.row", F.lit(False).alias("last"))
        done = found if done is None else done.union(found)
        level = met.select("place", "bucket", "at", F.col("held").alias("member"))
        left, turn = {k: v or 0 for k, v in level.agg(F.max("at").alias("at"), F.max("bucket").alias("bucket")).first().asDict().items()}, turn + 1
    return done.union(level.select("place", "member.size", "member.mass", "member.row", F.lit(True).alias("last")))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, whole: bool = False, seed: int = SEED) -> DataFrame:
    """docs(id, source, size, ...) -> its rows with source_size, target and taken (long: words that the mix takes of a row, repeats counted) added.

    Every row is taken target / source_size times on average: the integral part for certain, the rest by pivotal rounding, which keeps each
    source's sum. So a row is taken as a whole, 0 to ceil(most) times. The one row a source that is left at the root of the tree can't be
    whole without missing the target: the words that the target still lacks are taken of it (with whole, all or none of them, by chance).
    Results depend on ids, sources, sizes and the seed, not on partitions. Rows that share id, source and size may change places with each other.
    Null sources are one source, the last; null or negative sizes are 0, and such rows are never taken; null ids are a value like others; repeated rows each
    get their own number; columns of the three names are replaced, all others stay; an empty table stays empty. Whole rows travel along the tree: leave long texts out."""
    kept = [F.col(c) for c in docs.columns if c not in ("source_size", "target", "taken")]
    size = F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).cast("long")
    held = cut(docs.select("source", size.alias("size"), F.xxhash64("id", size).alias("key"), F.struct(*kept).alias("row")))
    plan = cut(targets(held, weights, share, most))
    few = plan.count() <= MOST_BROADCAST
    to = plan.select(F.col("source").alias("_source"), "place", "rows", "source_size", "target")
    on = F.col("source").eqNullSafe(F.col("_source"))
    own = held.join(F.broadcast(to) if few else to, on)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    full = F.floor(copies)
    rows = own.select("place", "key", "rows", F.col("size").cast("double").alias("size"), ((copies - full) * F.col("size")).alias("mass"), F.struct("row", (full * F.col("size")).alias("sure")).alias("row"))
    loose = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    sure = rows.where(~loose).select("place", "size", "mass", "row", F.lit(False).alias("last"))
    parts = rounded(rows.where(loose), seed=seed).union(sure)
    chance = F.shiftrightunsigned(F.xxhash64("place", F.lit(seed)), 11) * F.lit(2.0**-53)
    rest = F.when(chance * F.col("size") < F.col("mass"), F.col("size")).otherwise(0.0) if whole else F.round("mass")
    taken = F.col("row.sure") + F.when(F.col("last"), rest).otherwise(F.col("mass")).cast("long")
    back = plan.select("place", "source_size", "target")
    return parts.select("place", "row.row", taken.alias("taken")).join(F.broadcast(back) if few else back, "place").select("row.*", "source_size", "target", "taken")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", n_words(F.col("text")).alias("size"))
    return mixed(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
