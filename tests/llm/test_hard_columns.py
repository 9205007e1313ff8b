"""Very short texts, and columns named like those that operators make on the way."""


import pytest

import corpus_pipeline
from wayloom.llm import common, minhash_dedup, suffix_dedup, url_filter, word_hashes

np = pytest.importorskip("numpy")


def test_unused_names_differ_from_all_columns():
    assert common.unused(["_A", "__a", "b"], "_a", "b", "c") == ["___a", "_b", "c"]


@pytest.mark.parametrize("n", range(7))
def test_runs_of_few_words(n):
    hashes = np.arange(1, n + 1, dtype=np.uint64)
    runs, counts = word_hashes.shingles(hashes, np.array([n], dtype=np.int64), 5)
    assert len(runs) == counts[0] == (0 if n == 0 else max(1, n - 4)) and len(set(runs.tolist())) == len(runs)
    # the same row between others gives the same runs
    more = np.concatenate([np.array([9, 9], dtype=np.uint64), hashes, np.array([8], dtype=np.uint64)])
    again, counts = word_hashes.shingles(more, np.array([2, n, 1], dtype=np.int64), 5)
    assert again[1 : 1 + len(runs)].tolist() == runs.tolist() and counts.tolist() == [1, len(runs), 1]


@pytest.mark.parametrize("n", range(7))
def test_near_duplicates_of_one_short_text(spark, n):
    text = " ".join("abcdefg"[:n])
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(one).count() == 1
    two = spark.createDataFrame([(1, text), (2, text), (3, "hello there")], "doc_id long, text string").coalesce(1)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, two, "").collect())
    assert kept == [1, 3]


def test_repeats_keep_clashing_columns(spark):
    text = "x".join(str(i) for i in range(90))
    docs = spark.createDataFrame([(1, text, 10, "a", True, 0.5), (2, text, 11, "b", False, 1.5)], "doc_id long, text string, _doc long, _key string, _hash boolean, _spans double")
    got = sorted((r.doc_id, r._doc, r._key, r._hash, r._spans, r.n_removed) for r in suffix_dedup.keep_first(docs).collect())
    assert got == [(1, 10, "a", True, 0.5, 0), (2, 11, "b", False, 1.5, len(text))]


def test_urls_keep_clashing_columns(spark):
    pages = spark.createDataFrame([("http://a.example.org/es/1", None, 1, 2, 3, 4, 5)], "url string, html string, r int, _key int, _group int, _verdict int, h int")
    got = url_filter.filter_urls(pages, url_filter.RULES).first()
    assert (got.r, got._key, got._group, got["_verdict"], got.h, got.verdict, got.rule) == (1, 2, 3, 4, 5, "block", "example.org/es/")


def test_stages_of_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_vectors_of_several_lengths_and_of_one_id(spark):
    from wayloom.llm import vector_dedup

    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [2.0]), (7, [3.0]), (8, [-1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in vector_dedup.near_vectors(df).collect())
    assert got == [(0, 0, 0, True), (1, 0, 1, True), (1, 1, 1, True), (3, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (8, 0, 8, True)]
