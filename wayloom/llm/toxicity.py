"""Toxic spans and document scores by a linear-chain conditional random field."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import batched, cut, extended, table

#: Labelled documents of each class (expected number: a hash picks them) that the model learns from.
DOCS_PER_CLASS = 6000
#: Words, and starts of words of these lengths, are features if they mark toxic texts: in so many of them, so much likelier there, and beyond
#: chance (log-likelihood ratio). Each such mark is one; the chain's weights decide what it tells.
STEMS = (6, 5, 4, 3)
LEAST_RATIO, LEAST_G2, LEAST_DOCS = 20.0, 32.0, 3
ROUNDS, EPOCHS, FIT_PARTS = 2, 3, 8
THRESHOLD = 0.3
#: Words whose feature a Python worker remembers; at the bound it forgets all and goes on.
CACHE_WORDS = 200_000
#: Words of sequences, padded to equal lengths, that always run side by side.
LEAST_CELLS = 4096

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")


class Index(dict):
    """A lower-cased word's feature: that of the word itself, else of its longest known start (kept as `start*`), else 0."""

    def __init__(self, marks: list[str]):
        super().__init__()
        self.marks = {m: i for i, m in enumerate(marks, 1)}

    def __missing__(self, word: str) -> int:
        get = self.marks.get
        found = get(word) or next((i for n in STEMS if len(word) >= n and (i := get(word[:n] + "*"))), 0)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found
        return found

    def __reduce__(self):
        return Index, (list(self.marks),)


def sequences(text: str) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """The sentences of a whole text: lower-cased words with their offsets, cut at sentence ends and line ends."""
    out, words, spans = [], [], []
    for m in _TOKEN.finditer(text):
        if m[0] in _ENDS:
            if words:
                out.append((words, spans))
                words, spans = [], []
        else:
            words.append(m[0].lower())
            spans.append(m.span())
    if words:
        out.append((words, spans))
    return out


class Chain:
    """A chain of two labels (1: toxic). Feature 0 is any unknown word; w[f, y] scores a word's feature, t[y, y'] a step."""

    def __init__(self, index: Index, w: np.ndarray, t: np.ndarray):
        self.index, self.w, self.t = index, w, t

    def marginals(self, ids: list[list[int]]) -> list[np.ndarray]:
        """Forward-backward: each word's probability of label 1. Sequences of like lengths run side by side, so that a long one doesn't pad many short ones."""
        out: list = [None] * len(ids)
        some: list[int] = []
        cells = 0
        for i in sorted(range(len(ids)), key=lambda i: len(ids[i])):
            if some and len(ids[i]) * (len(some) + 1) > max(LEAST_CELLS, 2 * (cells + len(ids[i]))):
                for k, p in zip(some, self._side_by_side([ids[k] for k in some])):
                    out[k] = p
                some, cells = [], 0
            some.append(i)
            cells += len(ids[i])
        for k, p in zip(some, self._side_by_side([ids[k] for k in some])):
            out[k] = p
        return out

    def _side_by_side(self, ids: list[list[int]]) -> list[np.ndarray]:
        lengths = np.array([len(x) for x in ids])
        longest = int(lengths.max())
        f = np.zeros((len(ids), longest), dtype=np.int64)
        f[np.arange(longest) < lengths[:, None]] = list(itertools.chain.from_iterable(ids))
        e, step = np.exp(self.w[f]), np.exp(self.t)
        a, b = np.empty_like(e), np.ones_like(e)
        a[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for k in range(1, longest):
            x = (a[:, k - 1] @ step) * e[:, k]
            a[:, k] = x / x.sum(axis=1, keepdims=True)
        for k in range(longest - 2, -1, -1):
            x = (b[:, k + 1] * e[:, k + 1]) @ step.T
            b[:, k] = np.where((k + 1 < lengths)[:, None], x / x.sum(axis=1, keepdims=True), 1.0)
        p = a * b
        p = p[..., 1] / p.sum(axis=2)
        return [p[i, :n] for i, n in enumerate(lengths)]

    def learn(self, data: list[tuple[list[int], list[int]]], counts: list[int], epochs: int, rate: float = 0.5, decay: float = 1e-4) -> None:
        """Gradient ascent on the likelihood of labelled sequences, one after another, each as often as it counts.

        Steps are scaled by the root of each weight's squared gradients so far, so that a sequence that counts for many
        neither overshoots nor makes the weights of rare features stand still."""
        sw, st = np.full_like(self.w, 1e-8), np.full_like(self.t, 1e-8)
        for _ in range(epochs):
            for (ids, labels), count in zip(data, counts):
                n = len(ids)
                e, step = np.exp(self.w[ids]), np.exp(self.t)
                a, b = np.empty((n, 2)), np.ones((n, 2))
                x = e[0]
                a[0] = x / x.sum()
                for k in range(1, n):
                    x = (a[k - 1] @ step) * e[k]
                    a[k] = x / x.sum()
                for k in range(n - 2, -1, -1):
                    x = step @ (b[k + 1] * e[k + 1])
                    b[k] = x / x.sum()
                p = a * b
                p /= p.sum(axis=1, keepdims=True)
                gold = np.eye(2)[labels]
                gt = np.zeros((2, 2))
                for k in range(1, n):
                    x = a[k - 1][:, None] * step * (e[k] * b[k])[None, :]
                    gt -= x / x.sum()
                    gt[labels[k - 1], labels[k]] += 1
                some, at = np.unique(ids, return_inverse=True)
                gw = np.zeros((len(some), 2))
                np.add.at(gw, at, gold - p)
                gw, gt = count * gw, count * gt
                sw[some] += gw * gw
                st += gt * gt
                self.w[some] += rate * gw / np.sqrt(sw[some])
                self.t += rate * (gt / np.sqrt(st) - decay * self.t)
            self.w *= 1 - decay


class Scorer:
    """A trained chain, and the share of toxic documents among those without any known word."""

    def __init__(self, chain: Chain, base: float):
        self.chain, self.base = chain, base

    def tag(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """(score, offsets of the words that are likelier toxic than not) of a whole text.

        The score is the base for a text without known words, and rises to 1 with the sum of -log(1 - p) over the
        words of all sentences that hold known ones; other sentences bear no evidence."""
        known = self.chain.index
        if not any(map(known.__getitem__, _WORD.findall(text.lower()))):
            return self.base, []
        found = [(spans, ids) for words, spans in sequences(text) if any(ids := [known[x] for x in words])]
        if not found:
            return self.base, []
        mass, hits = 0.0, []
        for (spans, _), p in zip(found, self.chain.marginals([ids for _, ids in found])):
            mass -= float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
            hits += [s for s, x in zip(spans, p) if x > 0.5]
        return self.base + (1 - self.base) * float(-np.expm1(-mass)), hits


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(sampled documents with text and toxic, labels of each class in all).

    A hash of doc_id picks about DOCS_PER_CLASS labels a class, before any text is touched; that bound lets them be broadcast to the documents."""
    usable = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}  # two rows
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("toxic") == y, F.lit(min(1.0, DOCS_PER_CLASS / n))).otherwise(share)
    # at most 4 * DOCS_PER_CLASS: with a wide margin over what the hash picks, so that nothing is cut off but a flood of labels
    picked = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20)) < share * (1 << 20)).limit(4 * DOCS_PER_CLASS)
    texts = docs.select("doc_id", "text").where("text is not null")
    return cut(texts.join(F.broadcast(picked), "doc_id")), counts


def toxic_marks(sample: DataFrame) -> list[str]:
    """The words and starts of words (`start*`) that mark the toxic texts of sample(text, toxic); token labels come from these.

    Copies of a text count once. Every mark that passes the tests is kept, however rare and whatever else comes along with it."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    texts = sample.groupBy(F.md5("text")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select("toxic", words.alias("words"))
    starts = lambda n: F.transform(F.filter("words", lambda w: F.length(w) >= n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))
    stems = F.flatten(F.array(*map(starts, STEMS)))
    texts = cut(texts.select("toxic", F.array_distinct(F.concat("words", stems)).alias("marks")))
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}  # two rows
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return []
    found = texts.select("toxic", F.explode("marks").alias("mark")).groupBy("mark").agg(F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g")).where(F.col("b") >= LEAST_DOCS)
    b, g = F.col("b"), F.col("g")
    term = lambda x, share: F.when(x > 0, x * F.log(x / ((b + g) * share))).otherwise(0.0)
    strong = ((b / bad) / ((g + 0.5) / good) >= LEAST_RATIO) & (2 * (term(b, bad / (bad + good)) + term(g, good / (bad + good))) >= LEAST_G2)
    return sorted(r["mark"] for r in found.where(strong).select("mark").collect())  # of a bounded sample's words


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """docs(doc_id, text), labels(doc_id, toxic 0/1) -> a scorer. Rows without text or label teach nothing.

    Marks of toxic documents label the tokens of a sample of DOCS_PER_CLASS documents a class. Each partition
    fits a chain to its sentences, and the weights are averaged, ROUNDS times over, a feature's by how often each partition has it. The base score is the share of toxic
    documents among those without marks, or a third of THRESHOLD if that is less; without any label it is 0."""
    sample, counts = _sample(docs, labels)
    marks = toxic_marks(sample)
    w, t = np.zeros((len(marks) + 1, 2)), np.zeros((2, 2))
    w[0, 0], w[1:, 1] = 1.0, 1.0
    for _ in range(ROUNDS if marks else 0):

        def fit(batches, now=Chain(Index(marks), w, t)):  # noqa: B008
            held: dict[tuple, int] = {}  # sentences with the same features and labels count together
            for batch in batches:
                for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                    for words, _ in sequences(text):
                        ids = tuple(now.index[x] for x in words)
                        key = (ids, tuple(int(bool(toxic and i)) for i in ids))
                        held[key] = held.get(key, 0) + 1
            if held:
                chain = Chain(now.index, now.w.copy(), now.t.copy())
                chain.learn([(list(a), list(b)) for a, b in held], list(held.values()), EPOCHS)
                seen, steps = np.zeros(len(chain.w)), 0
                for (ids, _), c in held.items():
                    np.add.at(seen, list(ids), c)
                    steps += c * (len(ids) - 1)
                some = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (some.tolist(), seen[some].tolist(), chain.w[some].ravel().tolist(), float(steps), chain.t.ravel().tolist())], names=["f", "n", "w", "steps", "t"])

        fitted = batched(sample.repartition(FIT_PARTS, F.xxhash64("doc_id")).select("toxic", "text")).mapInArrow(fit, "f array<long>, n array<double>, w array<double>, steps double, t array<double>").collect()  # a row a partition
        seen, total, steps = np.zeros((len(w), 1)), np.zeros_like(w), sum(r["steps"] for r in fitted)
        for r in fitted:
            n = np.array(r["n"])[:, None]
            seen[r["f"]] += n
            total[r["f"]] += np.array(r["w"]).reshape(-1, 2) * n
        w = np.where(seen > 0, total / np.maximum(seen, 1), w)
        t = sum(np.array(r["t"]) * r["steps"] for r in fitted).reshape(t.shape) / steps if steps else t
    scorer = Scorer(Chain(Index(marks), w, t), 0.0)
    unmarked = F.avg((F.col("n_toxic_words") == 0).cast("double")).alias("m")
    rest = {r["toxic"]: r["m"] * counts[r["toxic"]] for r in score(sample, scorer).groupBy("toxic").agg(unmarked).collect()}  # two rows
    base = rest.get(1, 0.0) / sum(rest.values()) if sum(rest.values()) else 0.0
    return Scorer(scorer.chain, min(base, THRESHOLD / 3))


def score(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """Adds score (0 to 1), predicted (1 if score >= THRESHOLD), n_toxic_words and toxic_spans (offsets in characters) to docs.

    Every row returns once and other columns stay. Null and empty texts have no toxic words, so they get the base score."""
    made = ("score", "predicted", "n_toxic_words", "toxic_spans")
    kept = [c for c in docs.columns if c not in made]
    schema = extended(docs.select(*kept), "score double, predicted int, n_toxic_words int, toxic_spans array<struct<start:int,end:int>>")
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            found = [scorer.tag(t or "") for t in batch.column(text).to_pylist()]
            s = np.array([x[0] for x in found], dtype=float)
            offsets = [[{"start": a, "end": b} for a, b in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array([len(x) for x in offsets], pa.int32()), pa.array(offsets, spans)], names=[*kept, *made])

    return batched(docs.select(*kept)).mapInArrow(run, schema)


def trained_on(docs: DataFrame, labels: DataFrame) -> Scorer:
    """The scorer of the labelled documents whose crc32 of doc_id leaves no remainder 2 by 4."""
    return train(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, trained_on(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "score", "predicted", "n_toxic_words", "toxic_spans")
