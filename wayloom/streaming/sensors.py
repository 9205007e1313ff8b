"""Fixes, compass readings and steps of a session as one ordered stream: who owns the heading, and walking on by steps where fixes are rare.

A fix at 1.5 m/s or more takes its bearing as the heading; a slower one only turns the heading by 0.3 of the difference, and not at all where that is over
90 degrees. Between fixes the compass owns it. Steps move walkers on by a learned length, never drivers; who stands still is moved by the second step only once
fixes have been silent for ten seconds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.streaming import fusion

# Fixed values.
TRUSTED, REJECTED, NUDGE = 1.5, 90.0, 0.3
STEP_M, SHORTEST_M, LONGEST_M, LEARNING, SILENT_MS = 0.72, 0.4, 1.2, 0.2, 10_000

EVENT = "session long, ms long, kind string, x double, y double, speed double, accuracy double, bearing double"
OUT = "session long, ms long, kind string, x double, y double, speed double, mode string, accepted boolean, heading double, source string, step_m double"
_OUT = [c.split()[0] for c in OUT.split(", ")]
#: In this order events of one time are taken.
KINDS = ("fix", "heading", "step")
_OWN = {"heading": "double", "source": "string", "step_m": "double", "steps": "int", "broken": "int", "seen": "long", "fixed": "long"}
#: Behind the state of fusion: heading (not a number: none) and its source, length of a step, steps since the last fix taken, steps that may end standing still, times of the last fix and of the last one taken.
START = (*fusion.START, math.nan, "", STEP_M, 0, 0, -1, -1)
_N = len(fusion.START)
_WAITING = {"ms": "long", "rank": "int", "x": "double", "y": "double", "speed": "double", "accuracy": "double", "bearing": "double"}
STATE = ", ".join([*(f"{k} {t}" for k, t in (fusion._STATE | _OWN).items()), *(f"w_{k} array<{t}>" for k, t in _WAITING.items())])


def turned(heading: float, bearing: float, speed: float) -> tuple[float, bool]:
    """(heading, whether the bearing changed it) after a fix with a bearing."""
    if speed >= TRUSTED:
        return bearing % 360, True
    if math.isnan(heading) or speed <= 0:
        return heading, False
    off = 180 - (180 - (bearing - heading)) % 360
    return (heading, False) if abs(off) > REJECTED else ((heading + NUDGE * off) % 360, True)


def _on_fix(state: tuple, ms: int, x: float, y: float, speed: float, accuracy: float, bearing: float) -> tuple[tuple, bool]:
    inner, (heading, source, step_m, steps, broken, _, fixed) = state[:_N], state[_N:]
    fx, fy = inner[6:8]
    if math.isnan(speed) and fixed >= 0:
        speed = math.hypot(x - fx, y - fy) * 1000 / (ms - fixed) if ms > fixed else 0.0
    inner, told = fusion.step(inner, ms, x, y, speed, accuracy)
    if not told[5]:
        return (*inner, heading, source, step_m, steps, broken, ms, fixed), False
    speed, mode = inner[4], inner[9]
    if not math.isnan(bearing):
        heading, changed = turned(heading, bearing, speed)
        source = "fix" if changed else source
    if mode == "WALKING" and fixed >= 0 and steps and fusion.STILL <= speed < fusion.WALKING:
        learned = math.hypot(x - fx, y - fy) / steps
        step_m += LEARNING * (learned - step_m) if SHORTEST_M <= learned <= LONGEST_M else 0.0
    return (*inner, heading, source, step_m, 0, broken, ms, ms), True


def _on_step(state: tuple, ms: int) -> tuple:
    inner, (heading, source, step_m, steps, broken, seen, fixed) = state[:_N], state[_N:]
    mode = inner[9]
    if mode == "STILL" and ms - seen >= SILENT_MS:
        broken += 1
        if broken >= 2:
            inner, mode, broken = (*inner[:9], "WALKING", "", -1), "WALKING", 0
    if mode == "WALKING":
        way = 0.0 if math.isnan(heading) else step_m
        inner = (inner[0] + inner[2] * way, inner[1] + inner[3] * way, *inner[2:5], ms, *inner[6:])
        steps += 1
    return (*inner, heading, source, step_m, steps, broken, seen, fixed)


def take(state: tuple, ms: int, rank: int, x: float, y: float, speed: float, accuracy: float, bearing: float) -> tuple[tuple, tuple | None]:
    """(next state, row) for one event; events come in order of their own time. Before the first fix all others are dropped (no row)."""
    if KINDS[rank] == "fix":
        state, accepted = _on_fix(state, ms, x, y, speed, accuracy, bearing)
    elif state[_N + 5] < 0:
        return state, None
    elif KINDS[rank] == "heading":
        state, accepted = (*state[:_N], bearing % 360, "compass", *state[_N + 2 :]), True
    else:
        state, accepted = _on_step(state, ms), True
    heading = state[_N]
    if not math.isnan(heading):
        r = math.radians(heading)
        state = (*state[:2], math.sin(r), math.cos(r), *state[4:])
    return state, (ms, KINDS[rank], state[0], state[1], state[4], state[9], accepted, heading, state[_N + 1], state[_N + 2])


def _usable(events: DataFrame) -> DataFrame:
    """Events with their rank; those of unknown kind, or without what their kind needs, drop out."""
    kind = F.col("kind")
    rank = F.when(kind == "fix", 0).when(kind == "heading", 1).when(kind == "step", 2)
    given = F.when(kind == "fix", F.col("x").isNotNull() & F.col("y").isNotNull()).when(kind == "heading", F.col("bearing").isNotNull() & ~F.isnan("bearing")).otherwise(True)
    return events.withColumn("rank", rank).where(rank.isNotNull() & given & F.col("session").isNotNull() & F.col("ms").isNotNull())


def _taken(state: tuple, session: int, events) -> tuple[tuple, list[tuple]]:
    rows = []
    for ms, rank, *rest in events:
        state, row = take(state, int(ms), int(rank), *(math.nan if v is None else float(v) for v in rest))
        if row:
            rows.append((int(session), *row))
    return state, rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_OUT)


def sensed(events: DataFrame) -> DataFrame:
    """events as in EVENT, whole sessions, in batch -> rows as in OUT, one an event. Events come sorted, and one state is held at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, START
        for frame in frames:
            rows = []
            for key, part in frame.groupby("session", sort=False):
                state, more = _taken(state if key == session else START, key, part[list(_WAITING)].itertuples(index=False))
                session = key
                rows += more
            yield _frame(rows)

    rows = _usable(events).select("session", *_WAITING)
    return rows.repartition("session").sortWithinPartitions("session", *_WAITING).mapInPandas(run, OUT)


def merged(at: str, **streams: DataFrame) -> DataFrame:
    """Streams (or tables) of fixes, headings and steps as one of events, with the event time column `at`; columns that a kind lacks are null."""
    names = [c.split() for c in EVENT.split(", ")]
    out = None
    for kind, rows in streams.items():
        part = rows.select(at, *((F.lit(kind) if n == "kind" else F.col(n).cast(t) if n in rows.columns else F.lit(None).cast(t)).alias(n) for n, t in names))
        out = part if out is None else out.unionByName(part)
    return out


def sense_stream(events: DataFrame, late: str = "10 seconds", at: str = "at") -> DataFrame:
    """The same over a stream with an event time that ms tells as well. Events wait in the state until the watermark has passed them, so those of different
    sensors and micro-batches are taken in the order of their own time; those behind it drop out. An idle session goes ten minutes after its last event."""

    def some(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        whole = tuple(held.get) if held.exists else (*START, *([] for _ in _WAITING))
        state, waiting = whole[: len(START)], list(zip(*whole[len(START) :]))
        mark = held.getCurrentWatermarkMs()
        if held.hasTimedOut and not waiting:
            held.remove()
            return
        if not held.hasTimedOut:
            for frame in frames:
                waiting += list(frame.loc[frame["ms"] >= mark, list(_WAITING)].itertuples(index=False, name=None))
        waiting.sort(key=lambda e: tuple(-math.inf if v is None or math.isnan(v) else v for v in e))
        due = [e for e in waiting if e[0] < mark]
        waiting = waiting[len(due) :]
        state, rows = _taken(state, key[0], due)
        columns = [list(c) for c in zip(*waiting)] or [[] for _ in _WAITING]
        whole = [[int(v) for v in c] for c in columns[:2]] + [[math.nan if v is None else float(v) for v in c] for c in columns[2:]]
        held.update((*state, *whole))
        held.setTimeoutTimestamp(max(1, int(waiting[0][0])) if waiting else mark + 600_000)
        if rows:
            yield _frame(rows)

    return _usable(events).withWatermark(at, late).groupBy("session").applyInPandasWithState(some, OUT, STATE, "append", "EventTimeTimeout")
