"""Repair of conversation structure: A* on the edit lattice of each conversation, cut into blocks that are joined again."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import batched, cut, table

#: Rows of a block, which one search goes through; rows and bytes of text of a conversation that one task holds.
BLOCK, MOST_ROWS, MOST_BYTES = 512, 4096, 16 << 20
#: Long conversations whose ids are broadcast, at most.
MOST_BROADCAST = 10_000
#: Costs of the edits (Keep costs nothing), and what a row costs more that stays though it is truncated.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Places in `(s?(ua)+)?`: nothing yet, after s, after u, after a. What may stand next, by place, and where that leads; places that may be last.
_START, _SYSTEM, _USER, _WHOLE = range(4)
_NEXT = [{"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _WHOLE}, {"u": _USER}]
_NAMES = {"u": "user", "a": "assistant"}
_LAST = (_START, _WHOLE)
_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = ("su", "ua", "au")

_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
SUMMARY = f"conv_id {{}}, {_TOTALS}, repaired_sha256 string"
TURNS = "conv_id {}, place long, role string, text string, edit string"


def fault(text: str, seen: bool) -> str:
    """b (blank), d (duplicate), t (truncated) or nothing: the first that holds."""
    body = text.rstrip(_SPACE)
    return "b" if not body else "d" if seen else "" if body[-1] in ".!?" else "t"


def search(items: list[tuple[str, str]], begin: dict[int, tuple[int, str]]) -> dict[int, tuple[int, str]]:
    """items (role initial, fault), begin {place: (cost, audit)} -> the same of each place that can stand behind the items.

    A*: what is left costs at least the deletion of each blank or duplicate row and the charge of each truncated one, a sum
    of suffixes. The queue is keyed by (cost plus heuristic, audit); no edit makes that key less, so what first comes
    out at a place is its cheapest audit, and of those the least."""
    least = [0]
    for _, f in reversed(items):
        least.append(least[-1] + (DELETE if f in ("b", "d") else TRUNCATED if f == "t" else 0))
    least.reverse()
    queue = [(cost + least[0], audit, 0, place) for place, (cost, audit) in begin.items()]
    heapq.heapify(queue)
    settled, out, n = set(), {}, len(items)
    while queue and len(out) < 4:
        key, audit, i, place = heapq.heappop(queue)
        if (i, place) in settled:
            continue
        settled.add((i, place))
        cost = key - least[i]
        if i == n:
            out[place] = (cost, audit)
        for initial, to in _NEXT[place].items():
            if initial != "s" and (i, to) not in settled:
                heapq.heappush(queue, (key + INSERT, audit + "I", i, to))
        if i == n:
            continue
        role, f = items[i]
        cost += least[i + 1]
        heapq.heappush(queue, (cost + DELETE, audit + "D", i + 1, place))
        if f in ("b", "d"):
            continue
        cost += TRUNCATED if f == "t" else 0
        for initial, to in _NEXT[place].items():
            if initial == role:
                heapq.heappush(queue, (cost, audit + "K", i + 1, to))
            elif initial != "s":
                heapq.heappush(queue, (cost + REROLE, audit + "R", i + 1, to))
    return out


def best(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    return min(ends[p] for p in _LAST if p in ends)


class Tally:
    """What is counted over rows in order; parts of a conversation can be added up in order."""

    FIELDS = "first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, rows long"
    NAMES = [f.split()[0] for f in FIELDS.split(", ")]

    def __init__(self, **known):
        self.first = self.last = self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.rows = 0
        self.__dict__.update(known)

    def add(self, other: Tally) -> None:
        """The rows of other follow."""
        if not other.rows:
            return
        if self.rows:
            self.illegal += self.last + other.first not in _LEGAL
        else:
            self.first = other.first
        self.last = other.last
        if other.turns:
            self.turns += other.turns - (other.low == self.high)
            self.low, self.high = other.low if self.low is None else self.low, other.high
        for name in ("blank", "duplicate", "truncated", "illegal", "rows"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def row(self, turn: int | None, initial: str, f: str) -> None:
        self.add(Tally(first=initial, last=initial, low=turn, high=turn, turns=int(turn is not None), blank=int(f == "b"), duplicate=int(f == "d"), truncated=int(f == "t"), rows=1))

    def totals(self, cost: int, audit: str) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def replayed(audit: Iterable[str], rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of each row that stays or is inserted, from the edits and the (role, text) in order."""
    rows, place = iter(rows), _START
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K":
            place = _NEXT[place][role[:1]]
        else:
            initial = next(c for c in _NEXT[place] if c in _NAMES)
            role, place = _NAMES[initial], _NEXT[place][initial]
        yield role, text, edit


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)


class _Out:
    """Takes rows of the result, gives batches of them: a summary of each conversation, or its turns."""

    def __init__(self, kind: str, id_type: pa.DataType):
        text, whole = pa.string(), pa.int64()
        if kind == "summary":
            fields = [("conv_id", id_type), *((f.split()[0], text if f.endswith("string") else whole) for f in _TOTALS.split(", ")), ("repaired_sha256", text)]
        else:
            fields = [("conv_id", id_type), ("place", whole), ("role", text), ("text", text), ("edit", text)]
        self.kind, self.schema, self.rows, self.bytes = kind, pa.schema(fields), [], 0

    def conversation(self, conv, totals: tuple, rows: Iterable[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        digest, some = hashlib.sha256(), False
        for place, (role, text, edit) in enumerate(replayed(totals[-1], rows)):
            if self.kind == "summary":
                digest.update((f"\n{role}:{text}" if some else f"{role}:{text}").encode())
                some = True
            else:
                yield from self._put((conv, place, role, text, edit), len(text) + 40)
        if self.kind == "summary":
            yield from self._put((conv, *totals, digest.hexdigest()), len(totals[-1]) + 150)

    def _put(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if self.bytes > 4 << 20:
            yield self.rest()

    def rest(self) -> pa.RecordBatch:
        out, self.rows, self.bytes = _table(self.rows, self.schema), [], 0
        return out


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _whole(kind: str):
    """Sorted rows (conv_id, turn, role, text, times) of whole conversations -> results."""

    def run(batches):
        out, conv, held = None, None, None

        def finish():
            tally, seen, items, places = Tally(), set(), [], {_START: (0, "")}
            for turn, role, text in held:
                f = fault(text, (role, text) in seen)
                seen.add((role, text))
                tally.row(turn, role[:1], f)
                items.append((role[:1], f))
            for k in range(0, len(items), BLOCK):
                places = search(items[k : k + BLOCK], places)
            if not items:
                places = {_START: (0, "")}
            return out.conversation(conv, tally.totals(*best(places)), ((r, t) for _, r, t in held))

        for batch in batches:
            out = out or _Out(kind, batch.schema.field(0).type)
            for c, turn, role, text, times in _rows([batch]):
                if held is None or c != conv:
                    if held is not None:
                        yield from finish()
                    conv, held = c, []
                held += [(turn, role, text)] * times
        if held is not None:
            yield from finish()
            yield out.rest()

    return run


_ENDS = "ends array<struct<begin: int, place: int, cost: long, audit: string>>"


def _blocks(batches):
    """Sorted rows (conv_id, turn, role, text, times, seen) of parts of conversations -> a row for each block: what is counted, and the cheapest audits from each place to each."""
    schema = None

    def block(conv, part, number, items, tally):
        ends = [{"begin": b, "place": p, "cost": c, "audit": a} for b in range(4) for p, (c, a) in search(items, {b: (0, "")}).items()]
        return (conv, part, number, *(getattr(tally, n) for n in Tally.NAMES), ends)

    from pyspark import TaskContext

    part, number, conv, items, tally, last = TaskContext.get().partitionId(), 0, None, [], Tally(), None
    for batch in batches:
        if schema is None:
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in Tally.FIELDS.split(", ")]
            end = pa.list_(pa.struct([("begin", pa.int32()), ("place", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("part", pa.int64()), ("number", pa.int64()), *zip(Tally.NAMES, kinds), ("ends", end)])
        for c, turn, role, text, times, seen in _rows([batch]):
            for k in range(times):
                if items and (c != conv or len(items) >= BLOCK):
                    yield _table([block(conv, part, number, items, tally)], schema)
                    number, items, tally = number + 1, [], Tally()
                conv = c
                f = fault(text, seen or k > 0)
                tally.row(turn, role[:1], f)
                items.append((role[:1], f))
    if items:
        yield _table([block(conv, part, number, items, tally)], schema)


def _joined(batches):
    """Sorted blocks -> conv_id and totals of each conversation: blocks are added up one by one, so what is held is an audit a place."""
    conv, tally, places, started, schema = None, None, None, False, None

    def done():
        return _table([(conv, *tally.totals(*best(places)))], schema)

    for batch in batches:
        if schema is None:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), *((f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in _TOTALS.split(", "))])
        for row in batch.to_pylist():
            if not started or row["conv_id"] != conv:
                if started:
                    yield done()
                conv, tally, places, started = row["conv_id"], Tally(), {_START: (0, "")}, True
            tally.add(Tally(**{n: row[n] for n in Tally.NAMES}))
            ways = [(e["place"], places[e["begin"]][0] + e["cost"], places[e["begin"]][1] + e["audit"]) for e in row["ends"] if e["begin"] in places]
            places = {p: min((c, a) for q, c, a in ways if q == p) for p in {w[0] for w in ways}}
    if started:
        yield done()


def _streamed(kind: str):
    """Sorted rows, a conversation's totals before its rows (conv_id, turn, role, text, times, totals...) -> results, row by row."""

    def run(batches):
        from itertools import groupby

        out = None

        def opened():
            nonlocal out
            for batch in batches:
                out = out or _Out(kind, batch.schema.field(0).type)
                yield from _rows([batch])

        for conv, rows in groupby(opened(), key=lambda r: r[0]):
            totals = next(rows)[5:]
            yield from out.conversation(conv, totals, ((r[2], r[3]) for r in rows for _ in range(r[4])))
        if out is not None:
            yield out.rest()

    return run


def _order(*more):
    return ["conv_id", *more, F.col("turn").asc_nulls_first(), "role", "text"]


def _repair(rows: DataFrame, kind: str, most_rows: int, most_bytes: int) -> DataFrame:
    times = F.coalesce("times", F.lit(0)).cast("long") if "times" in rows.columns else F.lit(1).cast("long")
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), times.alias("times"))
    schema = (SUMMARY if kind == "summary" else TURNS).format(rows.schema["conv_id"].dataType.simpleString())
    sizes = rows.groupBy("conv_id").agg(F.sum("times").alias("n"), F.sum(F.octet_length("text") * F.col("times")).alias("bytes"))
    long = cut(sizes.where((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select(F.col("conv_id").alias("_id")))
    n = long.count()
    on = F.col("conv_id").eqNullSafe(F.col("_id"))
    named = F.broadcast(long) if n <= MOST_BROADCAST else long
    short = rows.join(named, on, "left_anti") if n else rows
    out = batched(short.repartition("conv_id").sortWithinPartitions(*_order())).mapInArrow(_whole(kind), schema)
    if not n:
        return out
    # equal rows become one with a count, and know whether an earlier turn has them
    same = cut(rows.join(named, on, "left_semi").where("times > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times")))
    turn, text = F.struct(F.col("turn").isNotNull(), F.col("turn")), F.sha2("text", 256)
    first = same.groupBy(F.col("conv_id").alias("_id"), F.col("role").alias("_role"), text.alias("_text")).agg(F.min(turn).alias("_first"))
    known = same.join(first, on & (F.col("role") == F.col("_role")) & (text == F.col("_text"))).select(*same.columns, (turn > F.col("_first")).alias("seen"))
    head = F.substring("text", 1, 32)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.repartitionByRange(parts, "conv_id", F.col("turn").asc_nulls_first(), "role", head).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", head, "text")
    kind_of_id = rows.schema["conv_id"].dataType.simpleString()
    blocks = cut(dealt.mapInArrow(_blocks, f"conv_id {kind_of_id}, part long, number long, {Tally.FIELDS}, {_ENDS}"))
    totals = cut(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(_joined, f"conv_id {kind_of_id}, {_TOTALS}"))
    names = [f.split()[0] for f in _TOTALS.split(", ")]
    none = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in _TOTALS.split(", ")]
    heads = totals.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("times"), *names, F.lit(0).alias("_row"))
    both = heads.union(same.select("conv_id", "turn", "role", "text", "times", *none, F.lit(1).alias("_row")))
    return out.union(batched(both.repartition("conv_id").sortWithinPartitions(*_order("_row")).drop("_row")).mapInArrow(_streamed(kind), schema))


def repair(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """rows(conv_id, turn, role, text) -> a row a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken in the order of turn (nulls first), those of one turn by role and text. A column times, if there is one, says how often a row
    stands there; a conversation of rows that stand there 0 times has no rows. The audit is that of the cheapest edits that make the initials of the
    roles `(s?(ua)+)?`; of equally cheap ones the least. Null ids are one conversation; null roles and texts are one space; repeated rows are
    duplicates; other columns are ignored; an empty table gives no rows.

    Conversations of up to most_rows rows and most_bytes of text are repaired in one task each. Longer ones are sorted over many tasks and
    searched block by block from each place of the grammar to each; the blocks' results are joined in order; one task hashes the repaired rows as a stream."""
    return _repair(rows, "summary", most_rows, most_bytes)


def repaired_turns(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """As `repair`, but the repaired rows themselves: conv_id, place (from 0), role, text and edit (K, R or I)."""
    return _repair(rows, "turns", most_rows, most_bytes)


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> the same with times, damaged by crc32 of `conv_id:turn` modulo 20 (nulls: one space)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The cheapest audits row by row, as text of nine digits of cost and then the audit, so that the least text is the best."""

    def add(key: str, cost, edit: str) -> str:
        return f"(lpad(CAST(CAST(left({key}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({key}, 10) || '{edit}')"

    def step(places: list[str], edit: str, cost: str, when: str) -> list[str]:
        return [f"CASE WHEN {when} THEN {add(p, cost, edit)} END" for p in places]

    free, late = "f NOT IN ('b', 'd')", "(CASE f WHEN 't' THEN 3 ELSE 0 END)"
    to_u, to_a = ["t", "s", "c1"], ["n1"]
    inserted = f"least(n, {add('t', 3, 'I')}, {add('s', 3, 'I')}, {add('c', 3, 'I')}) AS n1, least(c, {add('n', 3, 'I')}) AS c1"
    new_s = [add("s", 4, "D"), *step(["t"], "K", late, f"{free} AND r = 's'")]
    new_n = [add("n1", 4, "D"), *step(to_u, "K", late, f"{free} AND r = 'u'"), *step(to_u, "R", f"3 + {late}", free)]
    new_c = [add("c1", 4, "D"), *step(to_a, "K", late, f"{free} AND r = 'a'"), *step(to_a, "R", f"3 + {late}", free)]
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
d AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), CAST(4294967295 AS BIGINT)) % 20 AS kind FROM k),
w AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth
  FROM (SELECT *, left(role, 1) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM w)),
x AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS f,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
v AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS t, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS n, CAST(NULL AS VARCHAR) AS c FROM conversations
  UNION ALL
  SELECT conv_id, i, {add("t", 4, "D")}, least({", ".join(new_s)}), least({", ".join(new_n)}), least({", ".join(new_c)})
  FROM (SELECT x.conv_id, x.i, x.r, x.f, t, s, n, c, {inserted} FROM v JOIN x ON x.conv_id IS NOT DISTINCT FROM v.conv_id AND x.i = v.i + 1)),
e AS (SELECT conv_id, i, least(t, c, {add("n", 3, "I")}) AS key FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
a AS (SELECT conv_id, CAST(left(key, 9) AS BIGINT) AS cost, substr(key, 10) AS audit FROM e),
p AS (
  SELECT conv_id, j, substr(audit, j, 1) AS op, length(replace(substr(audit, 1, j), 'I', '')) AS i FROM a, unnest(range(1, length(audit) + 1)) AS u(j)),
q AS (
  SELECT p.conv_id, p.j, p.op, x.role, x.text, row_number() OVER (PARTITION BY p.conv_id ORDER BY p.j) - 1 AS pos,
    first_value(CASE WHEN p.op = 'K' THEN x.r END) OVER (PARTITION BY p.conv_id ORDER BY p.j) IS NOT DISTINCT FROM 's' AS led
  FROM p LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.i = p.i WHERE p.op <> 'D'),
h AS (
  SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (pos - led::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE op WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole FROM q GROUP BY conv_id),
g AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
    count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM a LEFT JOIN g ON a.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN h ON a.conv_id IS NOT DISTINCT FROM h.conv_id
"""


OP12_SQL = _sql()
