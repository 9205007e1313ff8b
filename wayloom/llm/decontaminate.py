"""Benchmark decontamination: windows of benchmark items found in documents by a prefix-filtered join. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.common import cut, table, words

WINDOW = 10
#: Tables of windows up to this size are broadcast, as measured; larger ones are joined by shuffling.
BROADCAST_BYTES = 32 << 20


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """items(item_id, text) -> (item_id, w): each distinct run of `window` words of an item; the whole of a shorter one; none of an empty one."""
    w, n = F.col("w"), F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))
    cutout = F.transform(starts, lambda i: F.slice(w, i + 1, window))
    return items.select("item_id", words(F.col("text")).alias("w")).where(n > 0).select("item_id", F.explode(cutout).alias("w")).distinct()


def _fits(df: DataFrame, column: str) -> bool:
    got = df.agg(F.sum(F.octet_length(F.concat_ws(" ", column)) + 64).alias("b")).first()["b"] or 0
    return 3 * got <= BROADCAST_BYTES


def _matches(docs: DataFrame, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame, bool]:
    """docs(doc_id, text), items(item_id, text) -> (rows, windows, whether windows are small).

    rows(doc_id, key, start, length, window): each occurrence of a window in a document, and for each row of docs one with a null window and its
    number of words as start; key is a hash of the text. windows(window, w, items): the distinct windows and the items that have them.

    A window occurs only where its rarest word does, so that word is all of its prefix: tokens are ordered by how
    many times the documents have them, and each window is joined by its rarest one. The place of that word inside the window
    gives the only start that can match; it must leave room on both sides, and then all words are compared. Documents are cut into
    words twice: once to count tokens, once to find windows. (Outer generators: no filter on their input is derived, which would cut texts once more.)"""
    found = cut(item_windows(items, window).groupBy("w").agg(F.collect_set("item_id").alias("items")).select(F.monotonically_increasing_id().alias("window"), "w", "items"))
    small = _fits(found, "w")
    vocabulary = found.select(F.explode("w").alias("token")).distinct()
    tokens = docs.select(F.explode_outer(words(F.col("text"))).alias("token"))
    counts = tokens.join(F.broadcast(vocabulary) if small else vocabulary, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = found.select("window", "w", F.posexplode("w").alias("at", "token")).join(counts, "token")  # a word that no document has rules its windows out
    least = ranked.groupBy("window").agg(F.first("w").alias("w"), F.count(F.lit(1)).alias("known"), F.min(F.struct("n", "token", "at")).alias("rare"))
    wanted = cut(least.where(F.col("known") == F.size("w")).select("window", "w", F.col("rare.token").alias("token"), F.col("rare.at").alias("at"), F.size("w").alias("length")))
    end = ""  # stands after the last word of each document, at the number of its words
    base = docs.select("doc_id", F.xxhash64("text").alias("key"), F.concat(words(F.col("text")), F.array(F.lit(end))).alias("d"))
    at = base.select("doc_id", "key", "d", F.posexplode_outer("d").alias("p", "token"))
    null = F.lit(None)
    if small:
        last = wanted.sparkSession.range(1).select(null.cast("long").alias("window"), null.cast("array<string>").alias("w"), F.lit(end).alias("token"), F.lit(0).alias("at"), F.lit(0).alias("length"))
        start = F.col("p") - F.col("at")
        same = F.col("window").isNull() | ((start >= 0) & (F.slice("d", F.greatest(start, F.lit(0)) + 1, F.col("length")) == F.col("w")))
        rows = at.join(F.broadcast(wanted.union(last)), "token").where(same)
    else:  # each word travels with the words around it, so that what is shuffled stays in proportion to the text
        begin = F.greatest(F.col("p") - (window - 1), F.lit(0))
        near = at.where(F.col("token") != end).select("doc_id", "key", "p", "token", begin.alias("begin"), F.slice("d", begin + 1, 2 * window - 1).alias("d"))
        start = F.col("p") - F.col("at")
        same = (start >= 0) & (F.slice("d", F.greatest(start - F.col("begin"), F.lit(0)) + 1, F.col("length")) == F.col("w"))
        rows = near.join(wanted, "token").where(same).select("doc_id", "key", "p", "at", "length", "window")
        rows = rows.union(at.where(F.col("token") == end).select("doc_id", "key", "p", F.lit(0), F.lit(0), null.cast("long")))
    return cut(rows.select("doc_id", "key", start.cast("long").alias("start"), "length", "window")), found, small


def _hits(matches: DataFrame) -> DataFrame:
    """(doc_id, key, n_hit): the words of a document inside any occurrence of a window."""
    order = Window.partitionBy("doc_id", "key").orderBy("start", "length")
    reached = F.coalesce(F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", reached))
    return matches.select("doc_id", "key", "start", "length").distinct().withColumn("fresh", fresh).groupBy("doc_id", "key").agg(F.sum("fresh").alias("n_hit"))


def contaminated_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> (doc_id, key) of the documents in which any window occurs; key is xxhash64 of the text."""
    rows, _, _ = _matches(docs, items, window)
    return rows.where("window is not null").select("doc_id", "key").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row a row of docs.

    Null and empty texts have no words; null and empty items have no windows. Copies of a row get equal rows; rows with
    one doc_id and different texts are told apart by their texts. Null doc_ids and item_ids are values like others;
    the null item counts in n_items and drops out of the list that items_sha256 is made from. Empty tables give no rows, or no hits."""
    rows, windows, small = _matches(docs, items, window)
    matches = rows.where("window is not null")
    names = windows.select("window", F.explode("items").alias("item_id"))
    matched = matches.select("doc_id", "key", "window").distinct().join(F.broadcast(names) if small else names, "window").select("doc_id", "key", "item_id").distinct()
    listed = F.concat_ws(",", F.array_sort(F.collect_set(F.col("item_id").cast("string"))))
    per_doc = matched.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_items"), listed.alias("items"))
    known = _hits(matches).join(per_doc.withColumnsRenamed({"doc_id": "d2", "key": "k2"}), F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("key").eqNullSafe(F.col("k2"))).select(
        F.col("doc_id").alias("d"), F.col("key").alias("k"), "n_hit", "n_items", "items"
    )
    each = rows.where("window is null").select("doc_id", "key", F.col("start").alias("n_words"))
    out = each.join(known, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", number("n_hit").alias("n_hit"), number("n_items").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"), (number("n_hit") > 0).alias("contaminated"))


def op1_decontaminate(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


#: The same in DuckDB: windows of both sides, joined by their words.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS s
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, l WHERE len(w) >= l)),
m AS (SELECT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.l = bw.l),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
