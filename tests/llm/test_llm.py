"""The training-data operators against brute force, other libraries and hard inputs."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.llm import bpe, common, decontaminate, html_text, language_id, minhash_dedup, sharding, suffix_dedup, toxicity, url_filter, vector_dedup
from wayloom.operators import shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def rand_words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


# 1 decontamination


def plain_words(text):
    return re.findall(common.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_contamination(docs, items, window=10):
    spans = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(len(w) - window, 0) + 1) if w else []:
            spans.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for d, t in docs:
        w = plain_words(t)
        hit, found = set(), set()
        for length in {len(s) for s in spans}:
            for k in range(len(w) - length + 1):
                got = spans.get(tuple(w[k : k + length]))
                if got:
                    hit |= set(range(k, k + length))
                    found |= got
        listed = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rng = random.Random(1)
    items = [(1, rand_words(rng, 30)), (2, "Only three WORDS"), (3, ""), (4, None), (5, rand_words(rng, 10)), (6, "é É e" * 5), (7, rand_words(rng, 30))]
    texts = [rand_words(rng, 50) + " " + items[0][1][20:120] + " tail", items[0][1], "x only three words y only three words", None, "", rand_words(rng, 5000) + items[4][1], "ONLY-three_words", items[0][1] + " " + items[4][1].upper(), items[0][1]]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, items[4][1])]
    got = decontaminate.decontaminate(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_contamination(docs, items)))


def test_decontamination_of_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(no_docs, no_items).count() == 0
    assert [r.contaminated for r in decontaminate.decontaminate(docs_of(spark, ["a b c"]), no_items).collect()] == [False]


# 2 toxicity


def test_chain_marginals_sum_over_all_labellings():
    rng = np.random.default_rng(3)
    chain = toxicity.Chain(toxicity.Index(["a", "b"]), rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    for ids in ([0], [1, 0, 2], [2, 2, 0, 1, 0]):
        total, want = 0.0, np.zeros(len(ids))
        for ys in itertools.product((0, 1), repeat=len(ids)):
            s = sum(chain.w[f, y] for f, y in zip(ids, ys)) + sum(chain.t[a, b] for a, b in zip(ys, ys[1:]))
            total += np.exp(s)
            want += np.exp(s) * np.array(ys)
        assert np.allclose(chain.marginals([ids, [0]])[0], want / total)


def test_toxicity_finds_held_out_documents(spark):
    rng = random.Random(5)
    bad = ["idiot", "moron", "scum"]
    rows = []
    for i in range(400):
        toxic = i % 3 == 0
        words = rand_words(rng, 40).split()
        if toxic:
            words[rng.randrange(40)] = rng.choice(bad).title()
        rows.append((i, " ".join(words), int(toxic)))
    docs = docs_of(spark, [r[1] for r in rows]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    scorer = toxicity.trained_on(docs, labels)
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, "IDIOT"), (1003, "x " * 50_000 + "moron.")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs.unionByName(extra, True), scorer).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].predicted == rows[i][2] for i in held)
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003)] == [0, 0, 1, 1]
    assert [(s.start, s.end) for s in got[1003].toxic_spans] == [(100_000, 100_005)]
    assert toxicity.score(docs.limit(0), scorer).count() == 0


def test_toxicity_learns_words_that_come_with_others(spark):
    rng = random.Random(6)
    texts = [rand_words(rng, 12) + (" idiot" if i % 3 == 0 else "") + (" vermin" if i % 63 == 0 else "") for i in range(1200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1200)], "doc_id long, toxic int")
    scorer = toxicity.train(docs_of(spark, texts), labels)  # vermin: 20 of 400 toxic texts, none without idiot
    assert {"idiot", "vermin"} <= set(scorer.chain.index.marks)
    assert scorer.tag("You vermin!")[0] >= toxicity.THRESHOLD and scorer.tag("w1x w2x")[0] < toxicity.THRESHOLD


def test_chain_counts_sentences_as_often_as_they_occur():
    for counts in ((1, 9), (9, 1)):
        chain = toxicity.Chain(toxicity.Index(["a"]), np.zeros((2, 2)), np.zeros((2, 2)))
        chain.learn([([1, 0], [1, 0]), ([1, 0], [0, 0])], list(counts), 20)
        assert (chain.marginals([[1, 0]])[0][0] > 0.5) == (counts[0] > counts[1])


def test_toxicity_without_labels(spark):
    scorer = toxicity.train(docs_of(spark, ["a", "b"]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(docs_of(spark, ["a", None]), scorer).collect()} == {0}


# 3 byte-level BPE


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    model = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["", "Hello world, it's  we'LL\n\n  x", "a" * 3000, "ab" * 1500, "日本語" * 300, "🙂🙃" * 200, "\x00\x01", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(3000)), "".join(rng.choice("abcd") for _ in range(5000))]
    got = bpe.encode_texts(docs_of(spark, [*texts, None]).withColumn("ids", F.lit(1)), path, pattern, decoded="decoded").orderBy("doc_id").collect()
    for t, r in zip([*texts, ""], got):
        assert np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == model.encode_ordinary(t)
        assert bytes(r.decoded) == t.encode()


# 4 near duplicates


def plain_classes(docs):
    words = [plain_words(t) for _, t in docs]
    sets = [Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter() for w in words]
    label = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        alike = sets[i] and (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total() or (docs[i][1] is not None and docs[i][1] == docs[j][1])
        if alike and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    least = {}
    for (d, _), x in zip(docs, label):
        least[x] = min(least.get(x, d), d)
    return sorted((d, least[x]) for (d, _), x in zip(docs, label))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    docs, base = [], [rand_words(rng, n, 5000) for n in (3, 8, 60, 60, 200)]
    for b in base:
        docs.append(b)
        for k in range(6):
            w = b.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            docs.append(" ".join(w))
    chain = rand_words(rng, 100, 10**6).split()
    for k in range(0, 40, 4):  # each like its neighbours, the ends unlike
        docs.append(" ".join(chain[k:] + [f"t{i}" for i in range(k)]))
    docs += [None, None, "", "", "!!!", docs[0], docs[0], docs[9].upper()]
    rows = list(enumerate(docs))
    got = minhash_dedup.near_duplicates(docs_of(spark, docs)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == plain_classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert minhash_dedup.near_duplicates(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("chunk", [minhash_dedup.CHUNK, 7])
def test_groups_around_the_threshold_equal_brute_force(spark, monkeypatch, chunk):
    """Copies of one text that are linked with some of each other, and repeated lines, which weigh as often as they come."""
    monkeypatch.setattr(minhash_dedup, "CHUNK", chunk)
    monkeypatch.setattr(minhash_dedup, "PARTNERS", 5)
    rng = random.Random(17)
    base = rand_words(rng, 120, 10**6).split()
    docs = []
    for _ in range(90):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(1, 5)):
            w[k] = f"new{rng.randrange(10**6)}"
        docs.append(" ".join(w))
    line = rand_words(rng, 12, 10**6)
    docs += [" ".join([line] * 30), " ".join([line] * 29), " ".join([line] * 12), "one two three", "three two one", "x " * 70_000, "x " * 70_001]
    got = minhash_dedup.near_duplicates(docs_of(spark, docs).withColumn("key", F.lit("k")).withColumn("n", F.lit(1))).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == plain_classes(list(enumerate(docs)))
    assert len({r.class_id for r in got}) > 8


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(8)
    ids = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = rng.uniform(0.2, 4, 60), rng.uniform(0.2, 4, 60)
    s = minhash_dedup.dart_signatures(np.concatenate([ids, ids]), np.array([60, 60]), 4000, np.concatenate([a, b]))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (5, 6)]
    got = dict(map(tuple, shared.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# 5 vectors


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CHUNK", 40)
    monkeypatch.setattr(vector_dedup, "_ROWS", 16)
    monkeypatch.setattr(vector_dedup, "_COLUMNS", 24)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 16))
    v = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.1, 0.2, 0.3, 0.3)]).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [1.0] * 15 + [None]), (903, [float("nan")] * 16), (904, [1.0] * 3), (905, []), (5, v[5].tolist())]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    u = vector_dedup.unit(v)
    link = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    label = np.arange(len(u))
    for _ in range(len(u)):
        label = np.minimum(label, np.where(link, label[None, :], len(u)).min(axis=1))
    want = [(i, int(link[i].sum()), int(label[i])) for i in [*range(len(u)), 5]] + [(i, 0, i) for i in range(900, 906)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 6 sharding


@pytest.mark.parametrize("most", [0, 4096])
def test_ranks_are_gapless_with_and_without_a_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    df = spark.range(300).selectExpr("id", "id % 3 as k")
    got = common.ranked(df, ["k"], ["id"], F.xxhash64("id"), 10, 300, "r").collect()
    assert all(sorted(r.r for r in got if r.k == k) == list(range(100)) for k in range(3))
    assert sorted(r.r for r in common.ranked(df, [], ["id"], F.xxhash64("id"), 10, 300, "r").collect()) == list(range(300))


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(10)
    links = ["hot"] * 900 + [f"g{i // 3}" for i in range(600)] + [None] * 1003
    rng.shuffle(links)
    rows = [(i, x) for i, x in enumerate(links)] + [(3, links[3])]
    out = sharding.balanced_shards(spark.createDataFrame(rows, "id long, link string"), 24).collect()
    sizes = [sum(r.shard == j for r in out) for j in range(24)]
    assert len(out) == len(rows) and max(sizes) - min(sizes) <= 1
    for j in range(24):
        assert sorted(r.slot for r in out if r.shard == j) == list(range(sizes[j]))
    small = {}
    for r in out:
        if r.link and r.link != "hot":
            small.setdefault(r.link, set()).add(r.shard)
    assert sum(len(x) == 1 for x in small.values()) > 0.95 * len(small)
    assert len({r.shard for r in out if r.link == "hot"}) < 24
    assert sharding.balanced_shards(spark.createDataFrame([], "id long, link string"), 24).count() == 0


def test_shards_cut_fewer_links_each_round(spark):
    """Pairs alone leave no free room; what is reported is what a plain count of cut pairs gives."""
    rows = [(i, f"p{i // 2}", i, -1) for i in range(2400)]
    report: list[int] = []
    out = sharding.balanced_shards(spark.createDataFrame(rows, "id long, link string, _unit long, shard int"), 24, report=report).collect()
    assert sorted(r._unit for r in out) == list(range(2400)) and report == sorted(report, reverse=True) and report[0] > 1000
    sizes = [sum(r.shard == j for r in out) for j in range(24)]
    assert set(sizes) == {100}
    by_link: dict = {}
    for r in out:
        by_link.setdefault(r.link, []).append(r.shard)
    assert sum(a != b for a, b in by_link.values()) <= 48
    state = spark.createDataFrame([(i, f"g{i // 5}", 1, i // 5, (i * 7) % 24) for i in range(500)], "id long, link string, w long, unit long, shard int")
    report = []
    after = sharding.propagated(state, 24, 100, 2, report).collect()
    groups: dict = {}
    for r in after:
        groups.setdefault(r.link, []).append(r.shard)
    assert report[-1] == sum(a != b for g in groups.values() for i, a in enumerate(g) for b in g[:i])


def test_shards_of_null_ids_and_repeats(spark):
    rows = [(None, "a", "x")] * 30 + [(1, None, "y")] * 20 + [(2, "b", None)] * 2
    out = sharding.balanced_shards(spark.createDataFrame(rows, "id long, link string, slot string"), 24).collect()
    sizes = [sum(r.shard == j for r in out) for j in range(24)]
    assert len(out) == 52 and max(sizes) - min(sizes) <= 1
    assert sorted((r.shard, r.slot) for r in out) == [(j, k) for j in range(24) for k in range(sizes[j])]


# 7 html


def test_labelled_pages_are_learnt():
    tree = html_text.train_tree()
    for page, labels in html_text.labelled_pages():
        assert html_text.judge(tree, html_text.features(html_text.blocks(page))).tolist() == labels


def test_html_scripts_end_at_their_closing_tag():
    text = lambda page: [b.text for b in html_text.blocks(page)]
    assert text("<head><script>for(i=0;i<n;i++){f(i)}</script></head><p>one<p>two") == ["one", "two"]
    assert text("<script>if(a<b)c()</script><p>one</p><script>x</script><p>two") == ["one", "two"]
    assert text("<p>one<script><!-- f() </script><p>two") == ["one", "two"]
    assert text("<style>a:after{content:'<!--'}</style >one<SCRIPT>'</scripts>'</Script\n>two") == ["onetwo"]
    assert text("<p>one<script>i<n<p>two") == ["one"]


def test_html_of_broken_tags_is_read_once(spark):
    text = lambda page: [b.text for b in html_text.blocks(page)]
    assert text("<p title='a>one</p><p>two") == ["one", "two"] and text("<p>a<br>b<br/>c") == ["a b c"]
    for start in ("<a ", "<a href='", "<!-", "</"):
        assert html_text.blocks(start * 100_000) is not None


def test_html_math_is_text_and_hidden_is_an_attribute_name():
    text = lambda page: [b.text for b in html_text.blocks(page)]
    assert text("<p>let <math><semantics><msup><mi>x</mi><mn>2</mn></msup><annotation>x^2</annotation></semantics></math> be") == ["let x2 be"]
    assert text("<p class='a hidden b'>one</p><p title=\"display:none, aria-hidden='true'\">two</p><p data-x=' hidden '>three</p>") == ["one", "two", "three"]
    assert text("<p hidden>one</p><p HIDDEN=''>two</p><p style='color:red; display : none'>three</p><p aria-hidden=true>four</p>five") == ["five"]


def test_html_of_hard_pages(spark):
    page = "<html><head><title>x</title><script>var a='</p>';</script></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>one\n two<p><b>three<br>four</article><div class=comments>Nice!</div><footer>&copy;</footer>"
    pages = spark.createDataFrame([(1, page, "u"), (2, None, "u"), (3, "", None), (4, "<p>" + "long " * 100_000, "u"), (5, "<<<>>> a < b </", "u"), (5, page, "u")], "page_id long, html string, text string")
    got = {(r.page_id, r.n_chars): r.text for r in html_text.extract(pages).collect()}
    assert got[1, 26] == "A & B\n\none two\n\nthree four" and got[5, 26] == got[1, 26]
    assert got[2, 0] == "" and got[3, 0] == "" and (4, 499_999) in got


# 8 repeated passages


def removed(docs):
    return sorted(map(tuple, suffix_dedup.keep_first(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("raw", 256)).collect()))


@pytest.mark.parametrize("hot, piece", [(suffix_dedup.HOT, suffix_dedup.PIECE_BYTES), (suffix_dedup.HOT, 300), (3, 300), (0, 300)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
    if piece == 300:
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 250)
        monkeypatch.setattr(suffix_dedup, "SORTED_AT_ONCE", 150)
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(400))
    texts = [rand_words(rng, 60) + passage[k : k + 100 + 40 * k] + rand_words(rng, 30) for k in range(6)]
    texts += [texts[0], "a" * 350, "ab" * 200, "x" + "a" * 120, "", None, passage[:99], passage[:100], "z" * 100 + "y" * 100, "q" + "z" * 100 + "y" * 100]
    line = passage[50:140]
    texts += [rand_words(rng, 3) + line + rand_words(rng, 4) for _ in range(12)] + [line + passage[140:160]] * 5
    docs = docs_of(spark, texts).withColumn("n_bytes", F.lit("clash")).withColumn("key", F.lit("clash")).repartition(3)
    assert removed(docs) == sorted(suffix_dedup.brute_force([(i, t) for i, t in enumerate(texts)]))


def test_repeats_of_repeated_ids_and_long_texts(spark):
    rng = random.Random(12)
    passage, other = ("".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (150, 137))
    long = "".join(rng.choice("abcdefghijklmnop") for _ in range(1_500_000))
    rows = [(1, passage + "tail"), (2, "A" * 40 + passage), (2, other + "-" + other + "+" + other), (2, "A" * 40 + passage), (3, long), (4, long[600_000:900_000] + "!" + long[:50] + long[-1000:]), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert removed(docs) == sorted(suffix_dedup.brute_force(rows))
    assert suffix_dedup.keep_first(docs_of(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, passage), (None, passage)], "doc_id long, text string")
    assert [r[2] for r in removed(nulls)] == [0, 0]


# 9 languages


def test_languages_are_told_apart(spark):
    rng = random.Random(12)
    sounds = {"aa": "ka to mi su re".split(), "bb": "sch ung ein ver keit".split()}
    make = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(l, 60), l, "s", 0) for i, l in enumerate(["aa", "bb", "bb"] * 60)]
    docs = spark.createDataFrame(rows, DOCS)
    known = language_id.learn_languages(docs.where("doc_id % 5 <> 0"))
    hard = spark.createDataFrame([(1000, None), (1001, "12 34 !"), (1002, ""), (1003, make("bb", 20_000))], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.identify(docs.unionByName(hard, True), known).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _, _ in rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.learn_languages(docs.limit(0)) == {} and language_id.identify(hard, {}).where("lang_pred <> 'und'").count() == 0


def test_languages_of_long_texts_and_many_languages(spark):
    rows = [(i, f"word{i} " * 5, f"l{i:03}", "s", 0) for i in range(210)] + [(500, "palabra larga " * 1000, "long", "s", 0), (501, "huge " * 100_000, "huge", "s", 0)]
    known = language_id.learn_languages(spark.createDataFrame(rows, DOCS))
    assert list(known) == sorted(r[2] for r in rows)
    assert known["long"] == rows[210][1].encode() and known["huge"] == rows[211][1].encode()[: language_id.DICTIONARY_BYTES]


# 10 urls


def test_blocks_travel_along_aliases(spark):
    canon = lambda u: f'<head><link rel="canonical" href="{u}"></head>'
    pages = [
        (1, "http://A.com/de/1#x", ""), (2, "http://b.net/x/y", canon("//A.COM/de/1")), (3, "http://c.net/r?q", "<meta http-equiv=refresh content='0; url=/z'>"), (4, "http://c.net/z", canon("http://b.net/x/y")),
        (5, "http://d.net/", canon("http://b.net/p")), (6, "http://b.net/p", canon("http://e.com/fr/")), (7, "http://b.net/q", canon("http://e.com/fr/")), (8, "http://b.net/q", canon("http://x.com/de/")),
        (9, None, None), (10, "no url", "x"), (11, "http://sub.example.org/es/1", None), (12, "http://host", None), (13, "http://org", None), (13, "http://org", None),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit(1)), url_filter.RULES).collect()}
    assert got[1] == ("a.com", "/de/1", "com/de/", "block")
    assert [got[i][3] for i in (2, 3, 4)] == ["block"] * 3
    assert [got[i][3] for i in (5, 6, 7, 8)] == ["allow"] * 4
    assert got[9] == ("", "", None, "allow") and got[10] == ("", "", None, "allow")
    assert got[11][2:] == ("example.org/es/", "block") and got[12] == ("host", "", None, "allow") and got[13] == ("org", "", None, "allow")


# the pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(13)
    clean = [rand_words(rng, 80, 10**6) for _ in range(60)]
    bench = rand_words(rng, 20, 10**6)
    toxic = [rand_words(rng, 40, 10**6) + " idiot scum" for _ in range(40)]
    texts = clean + toxic + [clean[0], clean[1] + " one", clean[2] + " " + bench, None, "", rand_words(rng, 50, 10**6) + " " + " ".join(clean[3].split()[:40])]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(60 <= i < 100)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = common.table(spark, str(tmp_path), "documents")
    seen = []
    for name, stage in cp.STAGES:
        docs = common.cut(stage(spark, docs, str(tmp_path)))
        seen.append({r.doc_id for r in docs.collect()})
        if name != cp.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen[0] == set(range(60)) | set(range(100, 106))
    assert seen[1] == seen[0] - {100, 101} and seen[2] == seen[1]
    assert seen[3] == seen[2] - {102} and seen[4] == seen[3]
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == seen[4]
