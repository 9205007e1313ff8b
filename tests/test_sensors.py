"""Headings and steps: traces by hand, and a stream of three sensors against the batch."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.streaming import sensors

NAN = math.nan


def trace(*events):
    """Rows after events (seconds, kind, {x, y, speed, accuracy, bearing})."""
    state, rows = sensors.START, []
    for t, kind, given in events:
        state, row = sensors.take(state, int(t * 1000), sensors.KINDS.index(kind), *(given.get(k, NAN) for k in ("x", "y", "speed", "accuracy", "bearing")))
        rows.append(row and dict(zip(sensors._OUT[1:], row)))
    return rows


def fix(x, y, speed, bearing=NAN):
    return {"x": x, "y": y, "speed": speed, "accuracy": 5.0, "bearing": bearing}


def test_who_owns_the_heading():
    r = trace((0, "heading", {"bearing": 10.0}), (1, "fix", fix(0, 0, 2.0, 350.0)), (2, "heading", {"bearing": 370.0}), (3, "fix", fix(0, 1, 1.0, 350.0)), (4, "fix", fix(0, 2, 1.0, 200.0)), (5, "fix", fix(0, 3, 0.0, 20.0)), (6, "fix", fix(0, 5, 2.0, -90.0)), (7, "fix", fix(0, 7, 2.0)))
    assert r[0] is None  # nothing to turn before the first fix
    assert [(round(x["heading"], 6), x["source"]) for x in r[1:]] == [(350, "fix"), (10, "compass"), (4, "fix"), (4, "fix"), (4, "fix"), (270, "fix"), (270, "fix")]
    assert sensors.turned(350.0, 80.0, 1.0) == (17.0, True)  # 90 degrees are not over 90
    assert math.isnan(trace((0, "fix", fix(0, 0, 1.0, 90.0)))[0]["heading"])  # slow, and nothing to compare with


def test_steps_move_walkers():
    east = (0.5, "heading", {"bearing": 90.0})
    r = trace((0, "fix", fix(0, 0, 1.0)), (0.2, "step", {}), east, (1, "step", {}), (2, "step", {}))
    assert [round(x["x"], 6) for x in r] == [0, 0, 0, 0.72, 1.44]  # no way without a heading
    # three steps on two metres: 0.667 a step; 0.72 goes a fifth of the way there
    r = trace((0, "fix", fix(0, 0, 1.0)), east, (1, "step", {}), (2, "step", {}), (3, "step", {}), (4, "fix", fix(2, 0, 1.0)))
    assert r[-1]["step_m"] == pytest.approx(0.72 + 0.2 * (2 / 3 - 0.72))
    # lengths of a giant, or of a driver, teach nothing
    assert trace((0, "fix", fix(0, 0, 1.0)), east, (1, "step", {}), (2, "fix", fix(3, 0, 1.0)))[-1]["step_m"] == 0.72
    drive = trace((0, "fix", fix(0, 0, 9.0, 90.0)), (1, "step", {}), (2, "step", {}))
    assert [x["mode"] for x in drive] == ["DRIVING"] * 3 and drive[2]["x"] == 0.0


def test_steps_end_standing_only_in_silence():
    still = [(0, "fix", fix(0, 0, 0.0)), (0.5, "heading", {"bearing": 0.0})]
    assert [x["mode"] for x in trace(*still, (1, "step", {}), (2, "step", {}), (9.9, "step", {}))][2:] == ["STILL"] * 3
    r = trace(*still, (10, "step", {}), (11, "step", {}), (12, "step", {}))
    assert [(x["mode"], round(x["y"], 6)) for x in r[2:]] == [("STILL", 0), ("WALKING", 0.72), ("WALKING", 1.44)]


def test_speed_of_a_fix_without_one_is_that_from_fix_to_fix():
    r = trace((0, "fix", fix(0, 0, 1.0)), (0.5, "heading", {"bearing": 90.0}), (3, "step", {}), (4, "fix", fix(4, 0, NAN)))
    assert r[-1]["speed"] == pytest.approx(1.0)  # not four metres in the second since the step


def test_stream_of_three_sensors_equals_the_batch(spark, tmp_path):
    rng, rows = random.Random(4), []
    for s in range(4):
        for k in range(50):
            t = 1_000_000 + 1000 * k
            rows.append((s, t, "fix", k * 1.1, float(s), rng.choice([0.0, 1.0, 1.4, 3.0, None]), 5.0, rng.choice([None, 80.0, 300.0])))
            rows.append((s, t + 300, "heading", None, None, None, None, float(rng.randrange(-20, 380))))
            rows += [(s, t + 400 + 250 * i, "step", None, None, None, None, None) for i in range(k % 3)]
    rows += [(1, 1_000_100, "unknown", 1.0, 1.0, None, None, None), (1, 1_000_200, "fix", None, 1.0, None, None, None), (1, 1_000_200, "heading", None, None, None, None, None), (None, 1_000_200, "step", None, None, None, None, None)]
    events = spark.createDataFrame(rows, sensors.EVENT)
    for n in range(3):
        # each sensor has its own delay, so they meet out of order across micro-batches
        lag = {"fix": 0, "heading": 2, "step": 3}
        part = [r for r in rows if min(2, (r[1] // 1000 - 1000 + lag.get(r[2], 0)) // 17) == n]
        rng.shuffle(part)
        spark.createDataFrame(part, sensors.EVENT).withColumn("at", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{sensors.EVENT}, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kinds = {k: stream.where(F.col("kind") == k) for k in sensors.KINDS}
    assert sensors.merged("at", **kinds).columns == ["at", *(c.split()[0] for c in sensors.EVENT.split(", "))]
    q = sensors.sense_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    want = sensors.sensed(events).where(F.col("ms") < max(r[1] for r in rows) - 10_000).collect()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(want) > 400 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))
