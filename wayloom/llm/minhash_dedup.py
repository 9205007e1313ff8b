"""Near-duplicate documents: DartMinHash signatures, banded joins, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import batched, cut, table
from wayloom.llm.word_hashes import counted, hashed_words, mix, shingles, text_pieces
from wayloom.operators.shared import components

SHINGLE = 5
SIMILAR = 0.8
#: Of pairs at similarity s, 1 - (1 - s**ROWS)**BANDS meet in a band: all but 3 in a million at 0.8.
BANDS, ROWS = 24, 4
#: The least share of equal coordinates at which a pair is verified: a pair at 0.8 has less about once in 8,000.
MAYBE = 0.65
#: Members of a bucket, and runs of words in their texts, whose pairs one task compares with those of another such chunk.
CHUNK, CHUNK_RUNS = 1024, 300_000
#: How much a Python worker signs at once, and about how many partners of a text are verified together.
BYTES_AT_ONCE, DOCS_AT_ONCE, PARTNERS = 1_000_000, 500, 512

_SEED = np.uint64(0x9E3779B97F4A7C15)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(elements: np.ndarray, counts: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash: (documents, k) hashes; two documents agree in a coordinate with their weighted Jaccard similarity.

    elements: hashes of each document's elements, one document after another, counts of them a document; weights: of
    elements, 1 if left out. Each element owns a strip of width 1 for each started unit of its weight, on which hashed
    darts fall at unit density along a time axis, the same ones in every document. Darts beyond the weight miss; each of the others hits
    one coordinate, which keeps its earliest. Only darts before a time that makes k (ln k + 3) of them likely are thrown; a
    document with an empty coordinate throws for twice as long again. Repeated elements of weight 1 count once. Documents without
    elements have an all-zero signature."""
    n = len(counts)
    out = np.zeros((n, k), dtype=np.uint64)
    doc = np.repeat(np.arange(n), counts)
    weight = np.ones(len(elements)) if weights is None else weights.astype(float)
    strips = np.ceil(weight).astype(np.int64)
    row = np.repeat(np.arange(len(elements)), strips)
    strip = np.arange(len(row)) - np.repeat(np.cumsum(strips) - strips, strips)
    ids = mix(elements[row] + strip.astype(np.uint64) * _SEED)
    doc, room = doc[row], weight[row] - strip
    until = k * (np.log(k) + 3) / np.maximum(np.bincount(doc, weights=np.minimum(room, 1), minlength=n), 1e-9)
    todo = np.flatnonzero(np.bincount(doc, minlength=n))
    while len(todo):
        asked = np.zeros(n, dtype=bool)
        asked[todo] = True
        on = asked[doc]
        i, d, r = ids[on], doc[on], room[on]
        time = np.zeros(len(i))
        slots, times, darts = [], [], []
        turn = 0
        while len(i):
            turn += 1
            h = mix(i + np.uint64(turn * 0xD1342543DE82EF95 % 2**64))
            time = time - np.log(_unit(h))
            live = time <= until[d]
            i, d, r, time, h = i[live], d[live], r[live], time[live], h[live]
            h = mix(h)
            if weights is None:
                hit_d, hit_t, hit_h = d, time, h
            else:
                inside = _unit(mix(h + _SEED)) < r
                hit_d, hit_t, hit_h = d[inside], time[inside], h[inside]
            slots.append(hit_d * k + (hit_h % np.uint64(k)).astype(np.int64))
            times.append(hit_t)
            darts.append(hit_h)
        slot, at, dart = np.concatenate(slots), np.concatenate(times), np.concatenate(darts)
        first = np.full(n * k, np.inf)
        np.minimum.at(first, slot, at)
        won = at == first[slot]
        flat = out.ravel()
        flat[slot[won]] = dart[won]
        empty = np.isinf(first.reshape(n, k)[todo]).any(axis=1)
        todo = todo[empty]
        until[todo] *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _SEED, (len(signatures), bands)).copy()
    for r in range(rows):
        key = mix(key + signatures[:, r * bands : (r + 1) * bands])
    return key


def sign(texts: DataFrame) -> DataFrame:
    """texts(node, text) -> (node, size, keys array<long>, coordinates binary) of all texts with a word; size: distinct runs of words.

    A run that comes c times in a text weighs c."""

    def run(batches):
        for batch in batches:
            for at, to, data, offsets in text_pieces(batch.column("text"), BYTES_AT_ONCE):
                for i in range(0, to - at, DOCS_AT_ONCE):  # some documents at once, so that their darts stay few
                    some = offsets[i : i + DOCS_AT_ONCE + 1]
                    elements, counts, weights = counted(*shingles(*hashed_words(data[some[0] : some[-1]], some - some[0]), SHINGLE))
                    have = np.flatnonzero(counts)
                    signatures = dart_signatures(elements, counts, BANDS * ROWS, weights)[have]
                    keys = band_keys(signatures).view(np.int64)
                    short = (signatures >> np.uint64(13)).astype("<u2")
                    ends = pa.array(np.arange(len(have) + 1, dtype=np.int32) * BANDS)
                    columns = [batch.column("node").take(pa.array(at + i + have)), pa.array(counts[have]), pa.ListArray.from_arrays(ends, pa.array(keys.ravel())), pa.array([x.tobytes() for x in short], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "keys", "coordinates"])

    return batched(texts.select("node", "text")).mapInArrow(run, "node long, size long, keys array<long>, coordinates binary")


def _only(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows(node, ...) whose node is in nodes(n). Always by a shuffle, as the nodes grow with the documents."""
    return rows.join(nodes.hint("shuffle_hash"), F.col("node") == F.col("n"), "left_semi")


def _coordinates(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), BANDS * ROWS)


def _alike(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """pairs(a, b) of nodes, marks(node, coordinates, ...) -> those that agree in so many coordinates that they are worth verifying."""
    for c in "ab":
        pairs = pairs.join(marks.select(F.col("node").alias(c), F.col("coordinates").alias(f"of_{c}")), c)

    def run(batches):
        for batch in batches:
            good = (_coordinates(batch.column("of_a")) == _coordinates(batch.column("of_b"))).mean(axis=1) >= MAYBE
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in "ab"], names=["a", "b"])

    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


class Shingled:
    """The counted runs of words of some texts: elements, row after row and ascending in each, how many each row has, and how often each comes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.elements, self.counts, self.weights = counted(*shingles(*hashed_words(data, offsets), SHINGLE))
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.elements[self.begins[i] : self.ends[i]], self.weights[self.begins[i] : self.ends[i]]

    def like(self, elements: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Those of the rows that are SIMILAR at least to a text with these elements, by all of both."""
        if not len(elements) or not len(rows):
            return rows[:0]
        counts = self.counts[rows]
        at = np.repeat(self.begins[rows] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        e, w = self.elements[at], self.weights[at]
        found = np.minimum(np.searchsorted(elements, e), len(elements) - 1)
        both = np.where(elements[found] == e, np.minimum(weights[found], w), 0)
        row = np.repeat(np.arange(len(rows)), counts)
        same, own = np.bincount(row, both, len(rows)), np.bincount(row, w, len(rows))
        return rows[(counts > 0) & (same + 1e-9 >= SIMILAR * (own + weights.sum() - same))]


def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """pairs(a, b) of nodes, own(node, text) -> those whose texts are SIMILAR at least, exactly.

    The partners of an a come to one task, after its own text; they are split after about PARTNERS of them."""
    size = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / PARTNERS)).cast("int")
    some = cut(pairs.join(size, "a").select("a", "b", part.alias("part")))
    heads = some.select("a", "part").distinct().select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    rows = heads.union(some.select("a", "part", "b", F.col("b").alias("node"))).join(own, "node").select("a", "part", "b", "text")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches):
        leader = None
        for batch in batches:
            head = batch.column("b").is_null().to_numpy(zero_copy_only=False)
            for at, to, data, offsets in text_pieces(batch.column("text"), BYTES_AT_ONCE):
                found = Shingled(data, offsets)
                begins = np.flatnonzero(head[at:to])
                good = [found.like(*leader, np.arange(begins[0] if len(begins) else to - at))] if leader else []
                for i, j in zip(begins, np.append(begins[1:], to - at)):
                    leader = tuple(x.copy() for x in found.row(i))
                    good.append(found.like(*leader, np.arange(i + 1, j)))
                good = pa.array(at + np.concatenate(good) if good else np.zeros(0, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(good) for c in "ab"], names=["a", "b"])

    return batched(dealt).mapInArrow(run, "a long, b long")


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of sorted batches, a table for each run of equal values of columns."""
    held, last = [], None
    for batch in batches:
        values = [batch.column(c).to_numpy() for c in columns]
        change = np.zeros(batch.num_rows, dtype=bool)
        for x in values:
            change[1:] |= x[1:] != x[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows] if batch.num_rows else []
        for i, j in zip(starts, starts[1:]):
            key = tuple(x[i] for x in values)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class Chunks:
    """A pair of chunks of a bucket (or a chunk and itself): the pairs across them that are to be compared."""

    def __init__(self, rows: pa.Table):
        self.key, c1, c2 = (rows.column(c)[0].as_py() for c in ("key", "c1", "c2"))
        self.group, self.mine = (rows.column(c).to_numpy() for c in ("class", "mine"))
        self.across = c1 != c2
        self.marks = _coordinates(rows.column("coordinates"))
        self.keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, BANDS)
        self.band = int(np.flatnonzero(self.keys[0] == self.key)[0])

    def partners(self, i: int) -> np.ndarray:
        """The rows after i, of other classes and chunks, that are alike enough in their coordinates and share no bucket of an earlier band with i."""
        rest = slice(i + 1, None)
        like = self.group[rest] != self.group[i]
        if self.across:
            like &= self.mine[rest] != self.mine[i]
        j = i + 1 + np.flatnonzero(like)
        j = j[(self.marks[j] == self.marks[i]).mean(axis=1) >= MAYBE]
        return j[~(self.keys[j, : self.band] == self.keys[i, : self.band]).any(axis=1)]


def _open_members(shared: DataFrame, leaders: DataFrame, marks: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, c1, c2, mine, class, node, keys, coordinates): the members of buckets in which several classes remain that have a partner left to be compared with.

    A bucket's leader has been compared with all. Buckets are dealt to tasks by pairs of chunks, bounded by members and by the runs
    of words of their texts, so that no task holds a whole large bucket."""
    known = shared.join(classes, shared.node == classes.n, "left").select("key", "node", F.coalesce("component", "node").alias("class"))
    mixed = known.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most"), F.count(F.lit(1)).alias("n")).where("least <> most and n > 2").select("key")
    open_ = known.join(mixed, "key").join(leaders, "key").where("node <> leader").select("key", "node", "class")
    open_ = cut(open_.join(marks, "node").select("key", "node", "class", "size", "keys", "coordinates"))
    sizes = open_.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("size") / CHUNK_RUNS)).cast("int").alias("chunks"))
    open_ = open_.join(sizes, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = open_.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("mine", "other").alias("c1"), F.greatest("mine", "other").alias("c2"), "mine", "class", "node", "keys", "coordinates")

    def run(batches):
        for rows in _grouped(batches, ("key", "c1", "c2")):
            chunks, wanted = Chunks(rows), np.zeros(rows.num_rows, dtype=bool)
            for i in range(rows.num_rows - 1):
                j = chunks.partners(i)
                wanted[j] = True
                wanted[i] |= len(j) > 0
            if wanted.any():
                yield from rows.filter(pa.array(wanted)).combine_chunks().to_batches()

    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return batched(dealt).repartition(parts, "key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "node").mapInArrow(run, dealt.schema)


def _links_of_classes(members: DataFrame, own: DataFrame) -> DataFrame:
    """members as _open_members gives them, own(node, text) -> (a, b): classes that a link of SIMILAR texts connects, not all of them but a forest a task."""
    rows = members.join(own, "node").select(*members.columns, "text")

    def run(batches):
        for rows in _grouped(batches, ("key", "c1", "c2")):
            chunks = Chunks(rows)
            texts = rows.column("text").combine_chunks()
            pieces = [(data, offsets) for _, _, data, offsets in text_pieces(texts, 1 << 40)]
            found = Shingled(*pieces[0])
            a, b = [], []
            for i in range(rows.num_rows - 1):
                for j in found.like(*found.row(i), chunks.partners(i)).tolist():
                    x, y = chunks.group[i], chunks.group[j]
                    if x != y:
                        a.append(x)
                        b.append(y)
                        chunks.group = np.where(chunks.group == y, x, chunks.group)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b)], names=["a", "b"])

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return batched(rows).repartition(parts, "key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "node").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, class_id, kept, class_size: classes_of its rows, whatever else docs holds. kept: doc_id = class_id."""
    out = classes_of(docs)
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "class_size")


def classes_of(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, node (a hash of the text, null for null), class_id, class_size and component (a name of the class, null for null texts): one row a row of docs.

    Documents are linked if their runs of five words (lower-cased A-Z; all words if there are fewer), counted as often as they come, have a
    Jaccard similarity of SIMILAR at least (sum of the lesser counts by sum of the greater); classes are what links connect, and equal texts are one node from the start
    (by a 64-bit hash). class_id is the least doc_id of the class. Null texts, and texts without
    a word that no equal text has, are classes of their own. Null doc_ids never name a class that has another; a class without any other has a null class_id.
    Very long texts are signed and compared whole; an empty table gives no rows.

    In each bucket of a band all members are verified against the bucket's least node. Where several classes remain, members are
    compared further inside tasks, which give links between classes only: groups of copies cost a pair a copy and band."""
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("node"), "text")
    signed = cut(sign(texts))
    members = signed.select(F.explode("keys").alias("key"), "node")
    leaders = cut(members.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("key", "leader"))
    shared = cut(members.join(leaders.select("key"), "key", "left_semi").distinct())
    alive = cut(shared.select(F.col("node").alias("n")).distinct())
    marks = _only(signed, alive).groupBy("node").agg(F.first(F.struct("size", "keys", "coordinates")).alias("s"))
    marks = cut(marks.select("node", "s.size", "s.keys", "s.coordinates"))
    own = cut(_only(texts, alive).groupBy("node").agg(F.min("text").alias("text")))  # of every node that shares a bucket
    stars = shared.join(leaders, "key").where("node > leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = cut(_alike(stars, marks))
    classes = cut(components(verified(stars, own)).select(F.col("node").alias("n"), "component"))
    open_ = cut(_open_members(shared, leaders, marks, classes))
    joined = components(_links_of_classes(open_, own)).select(F.col("node").alias("class"), F.col("component").alias("joined"))
    rows = docs.select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("node"), F.col("text").isNull().alias("none"))
    nodes = rows.where("not none").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.join(classes, nodes.node == classes.n, "left").select("node", "least", "copies", F.coalesce("component", "node").alias("class"))
    nodes = nodes.join(joined, "class", "left").select("node", "least", "copies", F.coalesce("joined", "class").alias("component"))
    named = nodes.groupBy("component").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    named = nodes.join(named, "component").select("node", "class_id", "class_size", "component")
    out = rows.where("not none").join(named, "node").select("doc_id", "node", "class_id", "class_size", "component")
    null = F.lit(None).cast("long")
    return out.union(rows.where("none").select("doc_id", null, "doc_id", F.lit(1).cast("long"), null))


def op4_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same in DuckDB: all pairs of texts that share a run of words, with their counts.
OP4_SQL = r"""
WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY text) AS n, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
w AS (SELECT n, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM n),
s AS (SELECT n, s, count(*) AS k FROM (SELECT n, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT n, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)) GROUP BY ALL),
c AS (SELECT n, sum(k) AS c FROM s GROUP BY n),
p AS (SELECT a.n AS a, b.n AS b, sum(least(a.k, b.k)) AS k FROM s a JOIN s b ON a.s = b.s AND a.n <> b.n GROUP BY a.n, b.n),
l AS (SELECT a, b FROM p JOIN c x ON x.n = a JOIN c y ON y.n = b WHERE 5 * k >= 4 * (x.c + y.c - k)),
r(n, m) AS (SELECT n, n FROM n UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
g AS (SELECT n, min(m) AS g FROM r GROUP BY n),
d AS (SELECT doc_id, g FROM documents JOIN n USING (text) JOIN g USING (n)),
k AS (SELECT g, min(doc_id) AS class_id, count(*) AS class_size FROM d GROUP BY g)
SELECT doc_id, class_id, doc_id = class_id AS kept, class_size FROM d JOIN k USING (g)
UNION ALL SELECT doc_id, doc_id, true, 1 FROM documents WHERE text IS NULL
"""
