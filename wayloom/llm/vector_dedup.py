"""Near-duplicate vectors: a pigeonhole join over blocks of rotated coordinates, verified by exact cosines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import batched, cut, table
from wayloom.operators.shared import components

COSINE = 0.9
BLOCKS = 4
#: Vectors that meet in one task, twice; vectors that cells are laid around, at most.
CHUNK, MOST_PIVOTS = 16_384, 256
#: Rows and columns of a product of two blocks, so that it stays in a processor's cache; pairs that are compared at once.
_ROWS, _COLUMNS, _PAIRS = 512, 2048, 50_000
#: Pairs of chunks in a partition.
_MEETINGS = 4


def rotation(size: int) -> np.ndarray:
    """A fixed orthogonal matrix, so that no block of coordinates is empty by the way vectors were made."""
    q, r = np.linalg.qr(np.random.default_rng(20_24).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def block_slices(size: int, blocks: int) -> list[slice]:
    edges = np.linspace(0, size, min(blocks, size) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def linked(left: np.ndarray, right: np.ndarray, own: bool, block: int, slices: list[slice], turn: np.ndarray, cosine: float):
    """Pairs (i, j) of rows whose cosine is large enough and whose first block within budget is this one.

    Squared distances of unit vectors are 2 - 2 cos; at least one of the blocks has its share, in proportion to its
    width, of the largest allowed one. own: both sides are the same rows; each pair is given once."""
    a, b = unit(left), unit(right)
    ra, rb = a @ turn, b @ turn
    size = turn.shape[0]
    most = 2 - 2 * cosine
    budget = [most * (s.stop - s.start) / size * (1 + 1e-9) + 1e-12 for s in slices]
    s = slices[block]
    fa, fb = ra[:, s].astype(np.float32), rb[:, s].astype(np.float32)
    one = np.ones((1,), dtype=np.float32)
    # squared distances less the budget, as one product
    fa = np.concatenate([-2 * fa, (fa * fa).sum(axis=1, keepdims=True) - np.float32(budget[block] + 1e-4), np.broadcast_to(one, (len(fa), 1))], axis=1)
    fb = np.concatenate([fb, np.broadcast_to(one, (len(fb), 1)), (fb * fb).sum(axis=1, keepdims=True)], axis=1).T.copy()
    for k in range(0, len(a), _ROWS):
        for m in range(k // _COLUMNS * _COLUMNS if own else 0, len(b), _COLUMNS):
            i, j = (fa[k : k + _ROWS] @ fb[:, m : m + _COLUMNS] <= 0).nonzero()
            i, j = i + k, j + m
            if own:
                i, j = i[i < j], j[i < j]
            for p in range(0, len(i), _PAIRS):
                x, y = i[p : p + _PAIRS], j[p : p + _PAIRS]
                good = (a[x] * b[y]).sum(axis=1) >= cosine
                x, y = x[good], y[good]
                gap = (ra[x] - rb[y]) ** 2
                first = np.ones(len(x), dtype=bool)
                for other in range(block + 1):
                    within = gap[:, slices[other]].sum(axis=1) <= budget[other]
                    first &= within if other == block else ~within
                if first.any():
                    yield x[first], y[first]


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its group) of what pairs of ids connect."""
    ids, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = flat[: len(x)], flat[len(x) :]
    label = np.arange(len(ids))
    while True:
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def near_vectors(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """vectors(vec_id, embedding array<float>) -> vec_id, n_links, component_id, kept: one row a row of vectors.

    Two vectors are linked if they are of one length and their cosine in double precision is `cosine` at least. Null embeddings, and
    those that are zero or hold nulls, NaN or infinities, link with nothing. Rows with equal vec_id and embedding are one vector, rows of one vec_id with
    different embeddings are different ones (which may link with each other); component_id is the least vec_id that links reach. Rows with a null vec_id link
    with nothing and have a null component. Vectors of each length are compared by themselves; lengths are taken to be few.

    Blocks of rotated coordinates are joined one by one. Vectors are laid in cells around pivots (vectors, one for CHUNK of them, MOST_PIVOTS at most); only
    cells that can hold a pair within the block's budget meet, in chunks of at most about CHUNK vectors, so that neither a hot cell
    nor a group of copies comes into one task. Each chunk is dealt out to its meetings, each meeting is one row of a join. A task gives counts and a forest, never its pairs."""
    spark = vectors.sparkSession
    rows = cut(vectors.select("vec_id", "embedding", F.monotonically_increasing_id().alias("row")))
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = rows.where("vec_id is not null and embedding is not null").where(usable)
    often = cut(good.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"))
    same = None
    if often.head(1):  # equal rows are compared once
        several = good.join(often, "vec_id", "left_semi")
        first = several.groupBy(F.col("vec_id").alias("v"), F.col("embedding").alias("e")).agg(F.min("row").alias("first"))
        same = cut(several.join(first, (F.col("vec_id") == F.col("v")) & (F.col("embedding") == F.col("e"))).where("row <> first").select("row", "first"))
        good = good.join(same, "row", "left_anti")
    good = cut(good.select(F.col("row").alias("vec_id"), F.col("vec_id").alias("id"), "embedding", F.size("embedding").alias("d")))
    found = spark.createDataFrame([], "vec_id long, n long, other long")
    for size, total in sorted((r["d"], r["n"]) for r in good.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a length
        if total > 1:
            part = good.where(F.col("d") == size).select("vec_id", "embedding")
            turn, slices = rotation(size), block_slices(size, blocks)
            chosen = part.orderBy(F.xxhash64("vec_id")).limit(max(1, min(MOST_PIVOTS, total // CHUNK))).collect()  # MOST_PIVOTS at most
            found = found.union(_links(part, unit(np.array([r["embedding"] for r in chosen])) @ turn, turn, slices, cosine))
    found = cut(found)
    groups = components(found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    named = groups.join(good.select(F.col("vec_id").alias("node"), "id"), "node")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    known = found.groupBy("vec_id").agg(F.sum("n").alias("n")).join(groups.join(least, "component").select(F.col("node").alias("vec_id"), "least"), "vec_id", "left").withColumnRenamed("vec_id", "_row")
    asked = rows.select("vec_id", "row")
    if same is not None:
        asked = asked.join(same, "row", "left").select("vec_id", F.coalesce("first", "row").alias("row"))
    out = asked.join(known, F.col("row") == F.col("_row"), "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").eqNullSafe(component)).alias("kept"))


def _links(good: DataFrame, pivots: np.ndarray, turn: np.ndarray, slices: list[slice], cosine: float) -> DataFrame:
    """(vec_id, n, other): parts of the number of links of vec_id, or a link in a forest of each task's links."""
    spark, size = good.sparkSession, turn.shape[0]
    dtype = "<f4" if good.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"

    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            raw = np.ascontiguousarray(flat.reshape(batch.num_rows, size))
            r = unit(raw) @ turn
            blobs = pa.array([x.tobytes() for x in raw.astype(dtype)], pa.binary())
            for k, s in enumerate(slices):
                d = np.maximum(0, (r[:, s] ** 2).sum(axis=1)[:, None] + (pivots[:, s] ** 2).sum(axis=1)[None] - 2 * r[:, s] @ pivots[:, s].T)
                cell = d.argmin(axis=1)
                far = np.sqrt(d[np.arange(len(d)), cell]) + 1e-6
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(np.full(len(d), k, dtype=np.int32)), pa.array(cell.astype(np.int32)), pa.array(far), blobs], names=["vec_id", "block", "cell", "far", "raw"])

    laid = cut(batched(good).mapInArrow(placed, "vec_id long, block int, cell int, far double, raw binary"))
    cells = laid.groupBy("block", "cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()  # blocks x MOST_PIVOTS at most
    parts = {(c["block"], c["cell"]): -(-c["n"] // CHUNK) for c in cells}
    meets = []
    for x in cells:
        for y in cells:
            if x["block"] == y["block"] and x["cell"] <= y["cell"]:
                s = slices[x["block"]]
                gap = np.sqrt(((pivots[x["cell"], s] - pivots[y["cell"], s]) ** 2).sum())
                if gap <= x["far"] + y["far"] + np.sqrt((2 - 2 * cosine) * (s.stop - s.start) / size) + 1e-6:
                    meets.append((x["block"], x["cell"], y["cell"], parts[x["block"], x["cell"]], parts[y["block"], y["cell"]]))
    known = spark.createDataFrame([(*k, n) for k, n in parts.items()], "block int, cell int, parts int")
    chunked = laid.join(F.broadcast(known), ["block", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame.iloc[0]
        return pd.DataFrame({"block": [head["block"]], "cell": [head["cell"]], "chunk": [head["chunk"]], "ids": [frame["vec_id"].to_numpy().astype("<i8").tobytes()], "rows": [b"".join(frame["raw"])]})

    chunks = cut(chunked.groupBy("block", "cell", "chunk").applyInPandas(pack, "block int, cell int, chunk int, ids binary, rows binary"))
    meeting = F.broadcast(spark.createDataFrame(meets, "block int, x int, y int, px int, py int"))  # blocks x MOST_PIVOTS x MOST_PIVOTS at most
    key = ["block", "x", "y", "cx", "cy"]
    # a cell's chunks meet each other and themselves once
    once = (F.col("x") < F.col("y")) | (F.col("cx") <= F.col("cy"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = chunks.select("block", F.col("cell").alias("x"), F.col("chunk").alias("cx"), F.col("ids").alias("ids1"), F.col("rows").alias("rows1"))
    left = left.join(meeting, ["block", "x"]).select("*", upto("py").alias("cy")).where(once).select(*key, "ids1", "rows1")
    right = chunks.select("block", F.col("cell").alias("y"), F.col("chunk").alias("cy"), F.col("ids").alias("ids2"), F.col("rows").alias("rows2"))
    right = right.join(meeting, ["block", "y"]).select("*", upto("px").alias("cx")).where(once).select(*key, "ids2", "rows2")
    total = sum(px * py for _, _, _, px, py in meets)
    tasks = max(1, min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // _MEETINGS)))
    own = (F.col("x") == F.col("y")) & (F.col("cx") == F.col("cy"))
    dealt = batched(left.repartition(tasks, *key).join(right.repartition(tasks, *key), key).select("block", "ids1", "rows1", "ids2", "rows2", own.alias("own")))

    def compare(batches):
        for batch in batches:
            for block, ids1, rows1, ids2, rows2, own in zip(*(batch.column(c).to_pylist() for c in ("block", "ids1", "rows1", "ids2", "rows2", "own"))):
                u, v = np.frombuffer(ids1, dtype="<i8"), np.frombuffer(ids2, dtype="<i8")
                x, y = (np.frombuffer(rows, dtype=dtype).reshape(-1, size) for rows in (rows1, rows2))
                n1, n2 = np.zeros(len(u), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
                edges: list[tuple[np.ndarray, np.ndarray]] = []
                for i, j in linked(x, y, own, block, slices, turn, cosine):
                    n1 += np.bincount(i, minlength=len(u))
                    n2 += np.bincount(j, minlength=len(v))
                    edges.append(_forest(u[i], v[j]))
                for ids, n in ((u, n1), (v, n2)):
                    some = n > 0
                    if some.any():
                        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(n[some]), pa.nulls(int(some.sum()), pa.int64())], names=["vec_id", "n", "other"])
                if edges:
                    a, b = _forest(*(np.concatenate(z) for z in zip(*edges)))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.zeros(len(a), dtype=np.int64)), pa.array(b)], names=["vec_id", "n", "other"])

    return dealt.mapInArrow(compare, "vec_id long, n long, other long")


def op5_vector_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP5_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
c AS (SELECT vec_id AS s, vec_id AS r FROM v UNION SELECT c.s, l.b FROM c JOIN l ON c.r = l.a)
SELECT e.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = e.vec_id) AS BIGINT) AS n_links,
  coalesce((SELECT min(r) FROM c WHERE c.s = e.vec_id), e.vec_id) AS component_id,
  coalesce((SELECT min(r) FROM c WHERE c.s = e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e
"""
