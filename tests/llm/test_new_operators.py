"""Mixing, conversation repair and whitening against brute force."""

import hashlib
import itertools
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.llm import conversations, mixing, whitening

DATA = "/root/testdata/sf0.001"

# 11 mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, total, full = {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * sum(sizes.values()), set()
    while len(full) < len(names):
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        new = {s for s in names if s not in full and weight[s] * level >= most * sizes[s]}
        if not new:
            break
        full |= new
    return {s: most * sizes[s] if s in full else weight[s] * level for s in names}


def mix_rows(rng, n):
    return [(i, rng.choice(["hot"] * 6 + ["a", "é", "Z", "\U0001f600", "￿", "none", None]), rng.choice([0, 1, 2, 7, 40, rng.randrange(3000)])) for i in range(n)]


def test_mixing_meets_targets_with_whole_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 3)
    rows = mix_rows(random.Random(2), 3000) + [(7, "b", 5)] * 90 + [(8, "b", None), (None, "b", -4), (9, "empty", 0)]
    df = spark.createDataFrame(rows, "id long, source string, size long").withColumn("taken", F.lit("clash")).withColumn("row", F.lit(1))
    got = mixing.mixed(df.repartition(7)).collect()
    assert sorted(map(repr, [(r.id, r.source, r.size) for r in got])) == sorted(map(repr, rows)) and {r.row for r in got} == {1}
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + max(0, n or 0)
    want = plain_targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {sizes[s]} and mine[0].target == pytest.approx(want[s], rel=1e-12)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 0.5 + 1e-6
        assert all(0 <= r.taken <= 2 * max(0, r.size or 0) for r in mine)
        assert sum(r.size > 0 and r.taken % r.size > 0 for r in mine if r.size) <= 1
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixing.mixed(df.repartition(3)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


@pytest.mark.parametrize("fan, bucket", [(2, 5), (128, 2048)])
def test_rounding_tree_keeps_sums_and_means(spark, fan, bucket):
    rng = random.Random(3)
    rows = [(g, i * 7919, float(s), rng.uniform(0.01, 0.99) * s, 60 if g else 1, i) for g, k in ((0, 1), (1, 60)) for i in range(k) for s in [rng.randrange(1, 50)]]
    df = spark.createDataFrame(rows, "place long, key long, size double, mass double, rows long, row int")
    seen = dict.fromkeys(range(60), 0.0)
    seeds = 12
    for seed in range(seeds):
        got = mixing.rounded(df, fan, bucket, seed * 1000).collect()
        assert sorted((r.place, r.row, r["size"]) for r in got) == sorted((g, i, s) for g, _, s, _, _, i in rows)
        for g in (0, 1):
            mine = [r for r in got if r.place == g]
            assert sum(r.mass for r in mine) == pytest.approx(sum(r[3] for r in rows if r[0] == g))
            assert sum(r.last for r in mine) == 1 and all(r.last or r.mass in (0.0, r["size"]) for r in mine)
        for r in got:
            if r.place == 1:
                seen[r.row] += r.mass / r["size"] / seeds
    want = {i: m / s for g, _, s, m, _, i in rows if g}
    assert sum(abs(seen[i] - want[i]) for i in want) / 60 < 0.25  # the mean of 12 draws is off by 0.11 or so


def test_mixing_of_empty_tables_and_words(spark):
    empty = spark.createDataFrame([], "id long, source string, size long")
    assert mixing.mixed(empty).count() == 0
    texts = [None, "", " \t\n", "a b", "\x0b a\x0cb\rc ", "a b 　c", "x " * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mixing.n_words(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [0, 0, 0, 2, 3, 2, 5000]


# 12 conversations


def plain_conversation(rows):
    """The contract row by row: the least (cost, audit) of each place of the grammar."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {(0, ""): (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(4):  # insertions
            for (j, g), (c, a, kept) in list(best.items()):
                if j == i:
                    for r in nexts[g].replace("s", ""):
                        new = (c + 3, a + "I", (*kept, f"{'user' if r == 'u' else 'assistant'}:"))
                        if (i, r) not in best or new[:2] < best[i, r][:2]:
                            best[i, r] = new
        if i == len(rows):
            break
        _, role, text = rows[i]
        for (j, g), (c, a, kept) in list(best.items()):
            if j != i:
                continue
            ways = [(g, c + 4, a + "D", kept)]
            if faults[i] not in ("b", "d"):
                late = 3 * (faults[i] == "t")
                ways += [(r, c + late, a + "K", (*kept, f"{role}:{text}")) for r in nexts[g] if role[:1] == r]
                ways += [(r, c + late + 3, a + "R", (*kept, f"{'user' if r == 'u' else 'assistant'}:{text}")) for r in nexts[g] if r in "ua"]
            for r, *new in ways:
                if (i + 1, r) not in best or tuple(new[:2]) < best[i + 1, r][:2]:
                    best[i + 1, r] = tuple(new)
    cost, audit, kept = min(best[k] for k in ((len(rows), ""), (len(rows), "a")) if k in best)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def random_conversations(seed, n):
    rng = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "Sys", "uu"]
    texts = ["Yes.", "No!", "why?", "cut off", "", " \n", None, "Yes. ", "ab.c", "　"]
    return [(rng.choice([c, None] if c == 0 else [c]), rng.choice([*range(9), None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"t{rng.random()}.") for c in range(n) for _ in range(rng.choice([1, 1, 3, 8, 14]))]


SCHEMA = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = {}
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        out.setdefault(c, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return {c: plain_conversation(r) for c, r in out.items()}


@pytest.mark.parametrize("most_rows, block", [(4096, 512), (4096, 2), (5, 3), (0, 4)])
def test_conversations_equal_brute_force(spark, monkeypatch, most_rows, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rows = random_conversations(4, 60)
    rows += [(3, None, None, None), (99, 5, "user", "Hi."), *[(98, 2, "user", "Same.")] * 7]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cost", F.lit("clash")).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(conversations.damaged(df), most_rows).collect()}
    assert got == plain_damage(rows)


def test_search_equals_all_edit_sequences():
    rng = random.Random(8)
    for _ in range(60):
        items = [(rng.choice("suax"), rng.choice(["", "", "t", "b", "d"])) for _ in range(rng.randrange(5))]
        want = None
        for audit in (a for n in range(len(items) + 4) for a in itertools.product("DIKR", repeat=n) if sum(x != "I" for x in a) == len(items)):
            cost, at, place = 0, iter(items), 0
            for x in audit:
                role, f = next(at) if x != "I" else ("", "")
                if x == "D":
                    cost += 4
                    continue
                wanted = conversations._NEXT[place]
                initial = role if x == "K" else next(c for c in wanted if c != "s")
                if f in ("b", "d") or initial not in wanted:
                    break
                cost, place = cost + (0 if x == "K" else 3) + 3 * (f == "t"), wanted[initial]
            else:
                if place in (0, 3) and (want is None or (cost, "".join(audit)) < want):
                    want = (cost, "".join(audit))
        assert conversations.best(conversations.search(items, {0: (0, "")})) == want


def test_repaired_turns_are_the_hashed_ones(spark):
    rows = random_conversations(5, 25)
    df = conversations.damaged(spark.createDataFrame(rows, SCHEMA))
    want = {r.conv_id: r.repaired_sha256 for r in conversations.repair(df).collect()}
    for most in (4096, 4):
        turns = {}
        for r in sorted(conversations.repaired_turns(df, most).collect(), key=lambda r: r.place):
            assert r.place == len(turns.setdefault(r.conv_id, []))
            turns[r.conv_id].append(f"{r.role}:{r.text}")
        assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in want} == want
    assert conversations.repair(df.limit(0)).count() == 0


def test_conversations_sql(spark, tmp_path):
    rows = random_conversations(6, 80)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    for folder in [str(tmp_path)] + [DATA] * os.path.isdir(DATA):
        duck = duckdb.connect()
        path = f"{folder}/conversations.parquet"
        duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
        want = duck.execute(conversations.OP12_SQL).fetchall()
        assert sorted(map(repr, want)) == sorted(map(repr, map(tuple, conversations.op12_conversations(spark, folder).collect())))


# 13 whitening


def test_eigen_of_hard_matrices():
    rng = np.random.default_rng(1)
    half = rng.normal(size=(9, 4))
    for a in (np.zeros((3, 3)), np.ones((5, 5)), np.diag([2.0, 2.0, 0.0, 5.0]), half @ half.T, np.array([[4.0]]), np.diag([1e-12, 1e12]) + 1, np.eye(40) + np.eye(40, k=1) + np.eye(40, k=-1)):
        values, vectors = whitening.eigen(a)
        top = max(1.0, np.abs(a).max())
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, a, atol=1e-12 * top)
        assert np.allclose(vectors.T @ vectors, np.eye(len(a)), atol=1e-12) and (np.diff(values) <= 1e-12 * top).all()
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * top)


def test_moments_merge_as_if_seen_at_once():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, size=(200, 5)) + 10**9
    x[:, 3] = x[:, 0]
    parts = []
    for p in np.array_split(x, [3, 4, 90]):
        parts.append(whitening.Moments(p[0]))
        parts[-1].add(p)
    whole = parts[0]
    for p in parts[1:]:
        whole.merge(p)
    exact = x - x[0]
    centred = exact - exact.mean(axis=0)
    assert whole.n == 200 and whole.sums == x.sum(axis=0).tolist() and np.allclose(whole.covariance(), centred.T @ centred / 200, rtol=1e-12, atol=1e-9)


def test_whitening_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(40, 40)) * np.linspace(0.1, 3, 40)
    vectors = (rng.normal(size=(300, 40)) @ mixed).astype(np.float32)
    vectors[5:60] = vectors[4]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5, vectors[5].tolist()), (None, vectors[9].tolist())]
    bad = [(400, None), (401, []), (402, [None] * 40), (403, [float("nan")] * 40), (404, [float("inf")] + [0.0] * 39), (405, [3e38] + [0.0] * 39)]
    short = [(500 + i, [float(i), float(-i)]) for i in range(4)]
    df = spark.createDataFrame(rows + bad + short, "vec_id long, embedding array<float>").withColumn("n", F.lit("clash")).repartition(7)
    got = whitening.whitened(df).collect()
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = centred @ axes[:, :32] / np.sqrt(values[:32])
    mine = sorted((r for r in got if r.vec_id is None or r.vec_id < 400), key=lambda r: (r.component, r.vec_id is None, r.vec_id or 0, r.whitened))
    order = sorted(range(n), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    assert len(mine) == n * 32
    for k in range(32):
        part = mine[k * n : (k + 1) * n]
        w = np.array([r.whitened for r in part])
        sign = np.sign(w @ want[order, k])
        assert np.allclose(w * sign, want[order, k], atol=1e-9) and {r.component for r in part} == {k + 1}
        assert part[0].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
    assert [r.deviation for r in mine[:n]] == [int(((n * x[i] - s).astype(object) ** 2).sum()) for i in order] and {r.n for r in mine} == {n}
    assert {r.identity_error for r in mine} == {mine[0].identity_error} and mine[0].identity_error < 1e-9
    small = sorted((r.vec_id, r.component, r.n, r.deviation, r.explained) for r in got if r.vec_id and r.vec_id >= 500)
    assert [(v, c, m) for v, c, m, _, _ in small] == [(500 + i, c, 4) for i in range(4) for c in (1, 2)]
    assert [r.whitened for r in got if r.vec_id and r.vec_id >= 500 and r.component == 2] == [None] * 4
    assert whitening.whitened(df.limit(0)).count() == 0


def test_deviations_beyond_a_long():
    moments = whitening.Moments(np.array([2**40, 0]))
    moments.add(np.array([[2**40, 0], [-(2**40), 3]]))
    model = whitening.Whitener(moments, 2)
    assert model.deviations(np.array([[2**40, 0], [0, 1]])) == [None, 1]
