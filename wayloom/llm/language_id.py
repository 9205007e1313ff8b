"""Language identification by compression: the language whose zstandard dictionary makes a text smallest."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import batched, extended, table

#: Labelled documents that make a language's dictionary (expected number: a hash picks them), and the dictionary's size.
DOCS_PER_LANGUAGE = 150
DICTIONARY_BYTES = 1 << 17
#: Texts are compressed in pieces of so many bytes, each with the dictionary alone, so that a long text doesn't become its own dictionary.
PIECE_BYTES = 4096
LEVEL = 3
#: Margins under this share of the smaller size count as narrow.
NARROW = 0.01

_LETTER = regex.compile(r"\p{L}")


def learn_languages(labelled: DataFrame) -> dict[str, bytes]:
    """labelled(doc_id, text, lang) -> each language's dictionary, from a bounded sample of its documents.

    A hash of doc_id picks about DOCS_PER_LANGUAGE documents of each language, whatever its share of the rows and their
    lengths; the text that doesn't fit is cut to the dictionary's rest. Rows without text or language teach nothing."""
    usable = labelled.where("lang is not null and text is not null and text <> ''").select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(DOCS_PER_LANGUAGE)) / F.col("count"))
    picked = usable.join(F.broadcast(counts), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < share * (1 << 20))

    def lay(key, frame):
        own, used = [], 0
        for text in sorted(set(frame["text"]), key=lambda t: (zlib.crc32(t.encode()), t)):
            if used >= DICTIONARY_BYTES:
                break
            own.append(text.encode()[: DICTIONARY_BYTES - used])
            used += len(own[-1]) + 1
        return pd.DataFrame({"lang": [key[0]], "raw": [b"\n".join(own)]})

    first = F.substring("text", 1, DICTIONARY_BYTES).alias("text")  # more never fits
    laid = picked.select("lang", first).groupBy("lang").applyInPandas(lay, "lang string, raw binary")
    return {r["lang"]: bytes(r["raw"]) for r in sorted(laid.collect(), key=lambda r: r["lang"])}  # a dictionary a language


def sizes(texts: list[str], dictionaries: dict[str, bytes]) -> np.ndarray:
    """Compressed bytes of each text under each dictionary."""
    tools = []
    for raw in dictionaries.values():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        tools.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False).compress)
    out = np.zeros((len(texts), len(tools)), dtype=np.int64)
    for i, text in enumerate(texts):
        raw = text.encode()
        pieces = [raw[k : k + PIECE_BYTES] for k in range(0, len(raw), PIECE_BYTES)]
        out[i] = [sum(len(compress(p)) for p in pieces) for compress in tools]
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """Adds lang_pred, score and lang_rejected to docs; every row returns once, other columns stay.

    The whole text is compressed under each dictionary; the smallest size wins, the language first in order among equals.
    score is its share if each language's odds fall by half for each 1 % by which its size is larger. Margins under
    NARROW set lang_rejected (the guess is still told). Null texts and texts without any letter are `und`, score 0, rejected;
    so are all texts if no language is known."""
    made = ("lang_pred", "score", "lang_rejected")
    kept = [c for c in docs.columns if c not in made]
    schema = extended(docs.select(*kept), "lang_pred string, score double, lang_rejected boolean")
    names = list(dictionaries)

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            told = [k for k, t in enumerate(texts) if names and t and _LETTER.search(t)]
            lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            if told:
                size = sizes([texts[k] for k in told], dictionaries)
                best = size.argmin(axis=1)
                ratio = size / size.min(axis=1, keepdims=True) - 1
                odds = np.exp2(-100 * ratio)
                ratio[np.arange(len(told)), best] = np.inf
                for k, b in zip(told, best):
                    lang[k] = names[b]
                score[told] = 1 / odds.sum(axis=1)
                rejected[told] = ratio.min(axis=1) < NARROW
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(lang), pa.array(score), pa.array(rejected)], names=[*kept, *made])

    return batched(docs.select(*kept)).mapInArrow(run, schema)


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = learn_languages(docs.where(_remainder(5) != 0))
    return identify(docs.select("doc_id", "text"), known).select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "lang_rejected")
