"""Fixes of a session fused into smooth positions: a state machine, in batch and as a stream, and its positions between fixes.

Fixes blend into the extrapolated position by their quality; far ones are doubted once and believed the second time. Standing still begins after three
seconds of slow fixes and ends with the first faster one; walking and driving change over at the second fix in the other band."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
HOLD_S, FREEZE_S, HALF_LIFE_S = 3.0, 20.0, 2.0
STILL, WALKING, STILL_FREEZE_MS = 0.3, 2.2, 3000
LEAST_ACCEPT_M, LEAST_BLEND, POOR_M, DAMPING, ACCURACY_M = 10.0, 0.15, 50.0, 0.3, 30.0

OUT = "session long, ms long, x double, y double, speed double, mode string, accepted boolean, ux double, uy double"
_STATE = {"x": "double", "y": "double", "ux": "double", "uy": "double", "v": "double", "at": "long", "fx": "double", "fy": "double", "doubted": "boolean", "mode": "string", "band": "string", "slow": "long"}
#: One row of state a session: where it was (x, y) at what time, its direction and speed, the last fix taken, whether the last one was doubted, the
#: mode, the band that would be the next mode, and since when fixes are slow.
START = (0.0, 0.0, 0.0, 0.0, 0.0, -1, 0.0, 0.0, False, "STILL", "", -1)
#: Fixes that wait for the watermark, a list a column.
_WAITING = ["ms", "x", "y", "speed", "accuracy"]
STATE = ", ".join([f"{k} {t}" for k, t in _STATE.items()] + [f"w_{c} array<{'long' if c == 'ms' else 'double'}>" for c in _WAITING])


def coast(seconds: float) -> float:
    t = min(max(seconds, 0.0), FREEZE_S)
    return t if t <= HOLD_S else HOLD_S + HALF_LIFE_S / math.log(2) * (1 - 2 ** (-(t - HOLD_S) / HALF_LIFE_S))


def fading(seconds: float) -> float:
    """The share of the speed that is left: all of it at first, then half of it every two seconds."""
    return 2 ** (-max(0.0, min(seconds, FREEZE_S) - HOLD_S) / HALF_LIFE_S)


def band_of(speed: float) -> str:
    return "STILL" if speed < STILL else "WALKING" if speed < WALKING else "DRIVING"


def _mode(mode: str, band: str, slow: int, ms: int, speed: float) -> tuple[str, str, int]:
    """(mode, band, slow) after a fix."""
    here = band_of(speed)
    if here == "STILL":
        slow = ms if slow < 0 else slow
        return ("STILL", "", slow) if ms - slow >= STILL_FREEZE_MS else (mode, band, slow)
    if mode in ("STILL", here) or band == here:
        return here, "", -1
    return mode, here, -1


def step(state: tuple, ms: int, x: float, y: float, speed: float, accuracy: float) -> tuple[tuple, tuple]:
    """(next state, (ms, x, y, speed, mode, accepted, ux, uy)) for one fix; fixes come in order of their own time.

    A speed or accuracy that is not known is NaN: the speed is then that from the last fix taken, the accuracy 30 m."""
    px, py, ux, uy, v, before, fx, fy, doubted, mode, band, slow = state
    first, seconds = before < 0, max(0.0, (ms - before) / 1000)
    accuracy = ACCURACY_M if math.isnan(accuracy) else accuracy
    reach = v * coast(seconds) if mode == "DRIVING" and not first else 0.0
    ex, ey = (x, y) if first else (px + ux * reach, py + uy * reach)
    residual = math.hypot(x - ex, y - ey)
    if residual > 4 * accuracy + 30 and not doubted:
        return (px, py, ux, uy, v, before, fx, fy, True, mode, band, slow), (ms, ex, ey, v * fading(seconds), mode, False, ux, uy)
    way = 0.0 if first else math.hypot(x - fx, y - fy)
    if math.isnan(speed):
        speed = way / seconds if way and seconds else 0.0
    if way:
        ux, uy = (x - fx) / way, (y - fy) / way
    mode, band, slow = _mode(mode, band, slow, ms, speed)
    accept, poor = max(2 * accuracy, LEAST_ACCEPT_M), min(1.0, POOR_M / accuracy) if accuracy > 0 else 1.0
    if mode == "STILL":
        # a slow mean of the fixes, however far they lie
        f, ex, ey = DAMPING, *((x, y) if first else (px, py))
    elif residual <= accept:
        f = max(LEAST_BLEND, residual / accept) * poor
    else:
        f = poor  # 1, a jump, unless the fix is poor
    nx, ny = ex + (x - ex) * f, ey + (y - ey) * f
    return (nx, ny, ux, uy, speed, ms, x, y, False, mode, band, slow), (ms, nx, ny, speed, mode, True, ux, uy)


def _run(state: tuple, session: int, fixes) -> tuple[tuple, list[tuple]]:
    rows = []
    for ms, *fix in fixes:
        state, out = step(state, int(ms), *(math.nan if v is None else float(v) for v in fix))
        rows.append((int(session), *out))
    return state, rows


_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def fuse(fixes: DataFrame) -> DataFrame:
    """fixes(session, ms, x, y, speed, accuracy) of whole sessions, in batch. Fixes come sorted, and only one state is held at a time.

    Rows with a null session, time or position drop out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, START
        for frame in frames:
            rows = []
            for key, part in frame.groupby("session", sort=False):
                state, more = _run(state if key == session else START, key, part[_WAITING].itertuples(index=False))
                session = key
                rows += more
            yield pd.DataFrame(rows, columns=_COLUMNS)

    fixes = fixes.select("session", *_WAITING).dropna(subset=["session", "ms", "x", "y"])
    return fixes.repartition("session").sortWithinPartitions("session", *_WAITING).mapInPandas(run, OUT)


def fuse_stream(fixes: DataFrame, late: str = "10 seconds") -> DataFrame:
    """The same over a stream with a column at, the event time that ms tells as well.

    Fixes wait in the state until the watermark has passed them, so those that come out of order, in one micro-batch or in several, are taken in the order of
    their own time. Fixes that come behind the watermark are late and drop out. A session is kept until nothing waits and ten minutes have passed."""

    def some(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        whole = tuple(held.get) if held.exists else (*START, *([] for _ in _WAITING))
        state, waiting = whole[: len(START)], list(zip(*whole[len(START) :]))
        mark = held.getCurrentWatermarkMs()
        if held.hasTimedOut and not waiting:
            held.remove()
            return
        if not held.hasTimedOut:
            for frame in frames:
                frame = frame.dropna(subset=["ms", "x", "y"])
                waiting += list(frame.loc[frame["ms"] >= mark, _WAITING].itertuples(index=False, name=None))
        waiting.sort(key=lambda fix: tuple(-math.inf if v is None or math.isnan(v) else v for v in fix))
        due = [fix for fix in waiting if fix[0] < mark]
        waiting = waiting[len(due) :]
        state, rows = _run(state, key[0], due)
        columns = [[float(v) if v is not None else math.nan for v in c] for c in zip(*waiting)] or [[] for _ in _WAITING]
        held.update((*state, [int(v) for v in columns[0]], *columns[1:]))
        held.setTimeoutTimestamp(max(1, int(waiting[0][0])) if waiting else mark + 600_000)
        if rows:
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return fixes.withWatermark("at", late).groupBy("session").applyInPandasWithState(some, OUT, STATE, "append", "EventTimeTimeout")


def ticks(fused: DataFrame, every_ms: int = 100, lost_ms: int = 10_000) -> DataFrame:
    """fused (rows of `fuse`) -> (session, ms, x, y, speed, mode, since, fresh): where each session is at every multiple of `every_ms` from its fix on to the next.

    Driving goes on in the fix's direction, at full speed first, then slower, and stands after 20 s; others stay. After the last fix, and in longer gaps, ticks
    end when that time is over. since: ticks since the last fix, 0 at its own time; fresh: whether any fix, even a doubted one, came within `lost_ms`.
    Of fixes at one time the last one counts."""
    w = Window.partitionBy("session").orderBy("ms", "accepted")
    taken = F.when(F.col("accepted"), F.struct("ms", "x", "y", "ux", "uy", "speed", "mode"))
    rows = fused.select("session", "ms", F.last(taken, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("f"), F.lead("ms").over(w).alias("_next"))
    end = F.least(F.coalesce(F.col("_next") - 1, F.col("ms") + int(FREEZE_S * 1000)), F.col("ms") + int(FREEZE_S * 1000))
    begin = F.ceil(F.col("ms") / every_ms) * every_ms
    rows = rows.where(begin <= end).select("session", "f", F.col("ms").alias("_seen"), F.explode(F.sequence(begin, F.floor(end / every_ms) * every_ms, F.lit(every_ms).cast("long"))).alias("ms"))
    t = F.least((F.col("ms") - F.col("f.ms")) / 1000.0, F.lit(FREEZE_S))
    left = F.pow(F.lit(2.0), -F.greatest(t - HOLD_S, F.lit(0.0)) / HALF_LIFE_S)
    metres = F.when(F.col("f.mode") == "DRIVING", F.col("f.speed") * (F.least(t, F.lit(HOLD_S)) + HALF_LIFE_S / math.log(2) * (1 - left))).otherwise(0.0)
    since = F.floor(F.col("ms") / every_ms) - F.ceil(F.col("_seen") / every_ms) + (F.col("_seen") % every_ms != 0).cast("int")
    return rows.select(
        "session", "ms", (F.col("f.x") + F.col("f.ux") * metres).alias("x"), (F.col("f.y") + F.col("f.uy") * metres).alias("y"),
        (F.col("f.speed") * left).alias("speed"), "f.mode", since.cast("long").alias("since"), (F.col("ms") - F.col("_seen") < lost_ms).alias("fresh"),
    )


def presence_stream(fixes: DataFrame, gap: str = "10 seconds") -> DataFrame:
    """Sessions of a stream with (session, at): stretches of fixes without a gap, closed by the watermark."""
    w = F.session_window("at", gap).alias("w")
    held = fixes.withWatermark("at", gap).groupBy("session", w).agg(F.count(F.lit(1)).alias("fixes"))
    return held.select("session", F.col("w.start").alias("active"), F.col("w.end").alias("lost"), "fixes")
