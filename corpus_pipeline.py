"""A corpus made ready for training, stage by stage: toxic documents go, one of each group of near copies stays, repeated
passages are cut out, documents with benchmark passages go, and the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import bpe, decontaminate, minhash_dedup, suffix_dedup, toxicity
from wayloom.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go. The model learns from the labelled ones of docs.

    Null and empty texts have no toxic words and stay; without labels nothing goes; an empty table gives none."""
    scorer = toxicity.trained_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, scorer).where("predicted = 0").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least doc_id stays; of repeated rows, one. Null texts stay, one a doc_id.

    Where texts of one class share that doc_id, one of them stays. An empty table gives none."""
    classes = minhash_dedup.classes_of(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first")
    stays = classes.where("component is not null").groupBy("component").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.node").alias("_node"))
    stays = stays.union(classes.where("component is null").select("doc_id", "node").distinct())
    text = F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    left = docs.withColumn("_text", text).join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_node")), "left_semi")
    return left.dropDuplicates(["doc_id", "_text"]).select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every passage of 100 bytes and more that also starts earlier is cut out; halves of characters at the cuts go with it.

    Null and empty texts, and rows with a null doc_id, stay as they are; an empty table gives none."""
    raw = F.col("raw").cast("string")
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.regexp_replace(F.make_valid_utf8(raw), "�", ""))
    done = suffix_dedup.keep_first(docs)
    text = F.when(F.col("n_removed") > 0, text).otherwise(F.col("text"))
    out = done.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any window of a benchmark item occurs go. Null and empty texts hold none; an empty table gives none."""
    hits = decontaminate.contaminated_rows(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = hits.select(F.col("doc_id").alias("_id"), "key")
    return docs.join(hits, docs.doc_id.eqNullSafe(hits._id) & (F.xxhash64(docs.text) == hits.key), "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), their hash, and the hash of the decoded bytes: a row a document. Null texts are empty: no ids."""
    out = bpe.encode_texts(docs.select("doc_id", "text"), *bpe.public_vocabulary(), decoded="decoded")
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("repeats", cut_repeats), ("decontamination", drop_contaminated), ("bpe", encode)]
#: SQL can't express the first three stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
