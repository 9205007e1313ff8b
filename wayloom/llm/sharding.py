"""Shards of equal size that keep linked documents together: balanced label propagation. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.common import cut, ranked, table

SHARDS = 24
ROUNDS = 6
#: A unit of linked rows is at most about this share of a shard; larger groups are split by a hash of the row.
UNIT_SHARE = 32
ROWS_PER_BUCKET = 50_000
#: Parts by which movers are admitted to a shard.
BUCKETS = 256


def _choose(code, table_rows: list[tuple[int, int]]):
    """A column that maps a gapless rank to the shard whose interval holds it."""
    out, upto = F.lit(None).cast("int"), sum(n for _, n in table_rows)
    for shard, n in reversed(table_rows):
        out = F.when(F.col(code) < upto, F.lit(shard)).otherwise(out)
        upto -= n
    return out


def _by_shard(rows: list, shards: int) -> list[int]:
    """The sums n of a row a shard, 0 where a shard has none."""
    found = {r["shard"]: r["n"] for r in rows}
    return [int(found.get(j, 0)) for j in range(shards)]


def _admitted(sizes: DataFrame, shard: str, room: list[int]) -> DataFrame:
    """sizes(shard, _bucket, n) -> (shard, _bucket): the buckets that fit into the room of their shard, in order."""
    upto = F.sum("n").over(Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    left = F.element_at(F.array(*(F.lit(n).cast("long") for n in room)), F.col(shard) + 1)
    return sizes.withColumn("_upto", upto).where(F.col("_upto") <= left).select(shard, "_bucket")  # shards x BUCKETS rows at most


def propagated(state: DataFrame, shards: int, room: int, rounds: int, report: list | None = None) -> DataFrame:
    """state(id, link, w, unit, shard) after label propagation: each round, rows move to the shard that most of their neighbours (rows of their link) are in now.

    Shards that leading cells fill already take nobody; among the others the fullest cell of a link draws all its lesser ones. A shard admits movers by
    buckets of their unit as long as its room (less those that stay) lasts, so rows that stay out look again at where their neighbours are a round
    later. report: takes the number of linked pairs that are cut, at the start of each round and at the end."""
    for turn in range(rounds + 1):
        cells = cut(state.groupBy("link", "shard").agg(F.sum("w").alias("n")))
        if report is not None:
            each = cells.groupBy("link").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("s"))
            report.append(int(each.agg(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2)).first()[0] or 0))
        if turn == rounds:
            break
        place = F.struct("n", F.xxhash64("link", "shard").alias("h"), "shard")
        lead = cells.groupBy("link").agg(F.max(place).alias("top")).select("top.shard", "top.n").groupBy("shard").agg(F.sum("n").alias("n"))
        taken = [j for j, n in enumerate(_by_shard(lead.collect(), shards)) if n >= room]  # a row a shard
        best = cells.groupBy("link").agg(F.max(F.when(~F.col("shard").isin(taken), place)).alias("top"))
        moves = cut(cells.join(best, "link").where(place < F.col("top")).select("link", "shard", "n", F.col("top.shard").alias("target")))
        inside = _by_shard(cells.groupBy("shard").agg(F.sum("n").alias("n")).collect(), shards)
        leaving = _by_shard(moves.groupBy("shard").agg(F.sum("n").alias("n")).collect(), shards)
        free = [max(0, room - i + o) for i, o in zip(inside, leaving)]
        asked = cut(state.join(moves.drop("n"), ["link", "shard"], "left").withColumn("_bucket", F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(BUCKETS)).cast("int")))
        let_in = cut(_admitted(asked.where("target is not null").groupBy("target", "_bucket").agg(F.sum("w").alias("n")), "target", free))
        if not let_in.head(1):
            rounds = turn
            break
        let_in = F.broadcast(let_in.withColumn("_in", F.lit(True)))
        state = cut(asked.join(let_in, ["target", "_bucket"], "left").select("id", "link", "w", "unit", F.when(F.col("_in"), F.col("target")).otherwise(F.col("shard")).alias("shard")))
    return state


def balanced_shards(nodes: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, report: list | None = None) -> DataFrame:
    """nodes(id, link, ...) -> the same rows with shard (int) and slot (long, gapless from 0 in each shard).

    Rows with the same non-null link are linked. Shard counts differ by one at most. Linked rows start anywhere and move towards their
    neighbours' shards (see `propagated`); those of a very large group start side by side. Units (the rows of a link, or parts of a very large one) that are then
    split, or more than their shard's quota, leave as a whole, and these and rows without links fill the exact quotas in the order of their
    links. Everything that shards or buckets share is an aggregate of shards x buckets rows.
    Null ids are a value like others; columns named shard or slot are replaced, all others stay; repeated rows each get a slot; an empty table stays empty."""
    kept = [F.col(c) for c in nodes.columns if c not in ("shard", "slot")]
    held = cut(nodes.select("id", "link", F.struct(*kept).alias("_all")))
    total = held.count()
    if not total:
        return nodes.select(*kept, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    floor = total // shards
    quota = {j: floor + (j < total % shards) for j in range(shards)}
    most = max(2, floor // UNIT_SHARE)
    groups = held.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    linked = held.groupBy("id", "link").agg(F.count(F.lit(1)).alias("w")).join(groups, "link")
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / most))
    # the parts of a very large group start side by side, as many as nearly fill a shard
    side = F.pmod(F.xxhash64("link"), F.lit(shards)) + F.floor(part / (UNIT_SHARE * 7 // 8))
    begin = F.when(F.col("_n") > most, F.pmod(side, F.lit(shards))).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)))
    state = cut(linked.select("id", "link", "w", F.xxhash64("link", part).alias("unit"), begin.cast("int").alias("shard")))
    state = propagated(state, shards, floor, rounds, report)
    # units that are still split leave as a whole
    spans = state.groupBy("unit").agg(F.min("shard").alias("_lo"), F.max("shard").alias("_hi"))
    state = state.join(spans, "unit").withColumn("shard", F.when(F.col("_lo") == F.col("_hi"), F.col("shard"))).withColumn("_bucket", F.pmod(F.xxhash64("unit", F.lit(-1)), F.lit(BUCKETS)).cast("int"))
    fits = cut(_admitted(state.where("shard is not null").groupBy("shard", "_bucket").agg(F.sum("w").alias("n")), "shard", [floor] * shards)).withColumn("_fits", F.lit(True))
    homes = state.join(F.broadcast(fits), ["shard", "_bucket"], "left").select(F.col("id").alias("_i"), F.col("link").alias("_l"), F.col("unit").alias("_unit"), F.when(F.col("_fits"), F.col("shard")).alias("_home"))
    placed = cut(held.join(homes, F.col("id").eqNullSafe(F.col("_i")) & (F.col("link") == F.col("_l")), "left").drop("_i", "_l"))
    count = {r["_home"]: r["n"] for r in placed.groupBy("_home").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    gaps = [(j, quota[j] - count.get(j, 0)) for j in range(shards)]
    rest = ranked(placed.where("_home is null"), [], ["link", "id"], F.coalesce("_unit", F.xxhash64("id")), ROWS_PER_BUCKET, total, "_rank")
    filled = rest.withColumn("shard", _choose("_rank", gaps)).drop("_rank", "_home", "_unit")
    done = placed.where("_home is not null").withColumnRenamed("_home", "shard").drop("_unit").select(*filled.columns).union(filled)
    return ranked(done, ["shard"], ["id", "link"], F.xxhash64("id", F.lit(2)), ROWS_PER_BUCKET, total // shards + 1, "slot").select("_all.*", "shard", "slot")


def op6_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.md5("text").alias("link"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = balanced_shards(docs, SHARDS)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
