"""Registered queries over fixes of moving sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wayloom.operators import tracks
from wayloom.plans.derived import cte, derived
from wayloom.plans.registry import query
from wayloom.streaming import fusion, sensors

_W = "WINDOW w AS (PARTITION BY session ORDER BY ms, event_id)"
_SUM = "WINDOW w AS (PARTITION BY session ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING)"
_POS = f"p AS (SELECT *, CAST(sum(dx) OVER w AS BIGINT) AS x, CAST(sum(dy) OVER w AS BIGINT) AS y FROM fixes {_SUM})"


def _fixes(spark, sf_dir):
    return derived(spark, sf_dir, "fixes")


@query("track_positions", f"WITH {cte('fixes')}, {_POS} SELECT session, event_id, x, y FROM p")
def track_positions(spark, sf_dir):
    return tracks.positions(_fixes(spark, sf_dir)).select("session", "event_id", "x", "y")


@query("track_cumulative_distance", f"WITH {cte('fixes')} SELECT session, event_id, CAST(sum(abs(dx) + abs(dy)) OVER w AS BIGINT) AS metres FROM fixes {_SUM}")
def cumulative(spark, sf_dir):
    w = tracks.by("session", "ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _fixes(spark, sf_dir).select("session", "event_id", F.sum(F.abs("dx") + F.abs("dy")).over(w).alias("metres"))


@query("track_speed", f"WITH {cte('fixes')}, s AS (SELECT session, event_id, ms - lag(ms) OVER w AS dt, abs(dx) + abs(dy) AS d FROM fixes {_W}) SELECT session, event_id, CASE WHEN dt > 0 THEN CAST(d * 1000000 // dt AS BIGINT) END AS speed FROM s")
def speed(spark, sf_dir):
    s = _fixes(spark, sf_dir).select("session", "event_id", (F.col("ms") - F.lag("ms").over(tracks.by("session", "ms", "event_id"))).alias("dt"), (F.abs("dx") + F.abs("dy")).alias("d"))
    return s.select("session", "event_id", F.when(F.col("dt") > 0, F.expr("d * 1000000 div dt")).alias("speed"))


@query("nav_offroute_streak", f"WITH {cte('fixes')}, i AS (SELECT *, abs(dx) > 40 AS f, sum(CASE WHEN abs(dx) <= 40 THEN 1 ELSE 0 END) OVER w AS island FROM fixes {_SUM}), s AS (SELECT session, event_id, CASE WHEN f THEN CAST(sum(CAST(f AS INT)) OVER (PARTITION BY session, island ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS streak FROM i) SELECT session, event_id, streak, streak >= 3 AS recalc FROM s")
def streak(spark, sf_dir):
    return tracks.off_route(_fixes(spark, sf_dir), F.abs("dx")).select("session", "event_id", F.col("streak").cast("long").alias("streak"), "recalc")


@query("nav_announcements", f"WITH {cte('fixes')}, d AS (SELECT session, ms, event_id, (event_id * 37) % 900 AS d, t FROM fixes, (VALUES (500), (200), (50)) v(t)), a AS (SELECT session, t, arg_min(event_id, (ms, event_id)) AS s, arg_min(event_id, (ms, event_id)) FILTER (d <= t) AS h FROM d GROUP BY ALL) SELECT session, t AS threshold, h AS event_id FROM a WHERE h IS NOT NULL AND h <> s")
def announcements(spark, sf_dir):
    return tracks.first_below(_fixes(spark, sf_dir).withColumn("d", F.col("event_id") * 37 % 900), "d")


_GAPS = f"g AS (SELECT session, ms, lag(ms) OVER w AS b, lead(ms) OVER w AS a FROM fixes {_W})"


@query("nav_presence", f"WITH {cte('fixes')}, {_GAPS} SELECT session, ms, 'ACTIVE' AS state FROM g WHERE b IS NULL OR ms - b > 10000 UNION ALL SELECT session, ms + 10000, 'LOST' FROM g WHERE a IS NULL OR a - ms > 10000")
def presence(spark, sf_dir):
    return tracks.presence(_fixes(spark, sf_dir))


@query("nav_sessions", f"WITH {cte('fixes')}, g AS (SELECT session, ms, CASE WHEN ms - lag(ms) OVER w < 10000 THEN 0 ELSE 1 END AS n FROM fixes {_W}), i AS (SELECT session, ms, sum(n) OVER (PARTITION BY session ORDER BY ms ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT session, min(ms) AS started, count(*) AS fixes FROM i GROUP BY session, i")
def sessions(spark, sf_dir):
    return tracks.sessions(_fixes(spark, sf_dir))


@query("nav_coasting", f"WITH {cte('fixes')}, t AS (SELECT session, event_id, v, (event_id % 300) / 10.0 AS s FROM fixes) SELECT session, event_id, CAST(floor(CASE WHEN s <= 3 THEN v * s ELSE v * 3.0 + v * 2.0 / ln(2.0) * (1 - pow(2.0, -(least(s, 20.0) - 3.0) / 2.0)) END * 1000 + 0.5) AS BIGINT) AS mm FROM t")
def coasting(spark, sf_dir):
    s = (F.col("event_id") % 300) / 10.0
    return _fixes(spark, sf_dir).select("session", "event_id", F.floor(tracks.coasted(F.col("v").cast("double"), s) * 1000 + 0.5).cast("long").alias("mm"))


@query("nav_mode", f"WITH {cte('fixes')} SELECT session, event_id, CASE WHEN v * 0.1 < 0.3 THEN 'STILL' WHEN v * 0.1 < 2.2 THEN 'WALKING' ELSE 'DRIVING' END AS mode FROM fixes")
def mode(spark, sf_dir):
    return _fixes(spark, sf_dir).select("session", "event_id", tracks.mode(F.col("v") * 0.1).alias("mode"))


@query("nav_order_preserving_distinct", f"WITH {cte('fixes')} SELECT session, v, min(event_id) AS first FROM fixes GROUP BY ALL")
def distinct(spark, sf_dir):
    return _fixes(spark, sf_dir).groupBy("session", "v").agg(F.min("event_id").alias("first"))


def _fused(spark, sf_dir):
    fixes = tracks.positions(_fixes(spark, sf_dir)).selectExpr("session", "ms", "cast(x as double) as x", "cast(y as double) as y", "cast(v as double) * 0.1 as speed", "10.0D as accuracy")
    return fusion.fuse(fixes)


@query("nav_fusion")
def fused(spark, sf_dir):
    return _fused(spark, sf_dir).drop("ux", "uy")


@query("nav_ticks")
def ticks(spark, sf_dir):
    return fusion.ticks(_fused(spark, sf_dir), 1000)


@query("nav_route_progress")
def route_progress(spark, sf_dir):
    """Each session's route runs beside every fifth of its fixes, turns at every second point of it and stops at every ninth."""
    at = tracks.positions(_fixes(spark, sf_dir)).withColumn("n", F.row_number().over(tracks.by("session", "ms", "event_id")))
    points = at.where("n % 5 = 1").selectExpr("session as route", "n as seq", "x + 10.0D as x", "y - 7.0D as y", "n % 45 = 41 as stop", "n % 10 = 1 as turn")
    return tracks.route_progress(at, points)


@query("nav_sensors")
def sensed(spark, sf_dir):
    """Every third event of a session is a compass reading and every fifth a step, the others are fixes: one ordered stream each. Traces by hand and a stream test it."""
    at = tracks.positions(_fixes(spark, sf_dir))
    kind = "CASE WHEN event_id % 3 = 1 THEN 'heading' WHEN event_id % 5 = 2 THEN 'step' ELSE 'fix' END AS kind"
    events = at.selectExpr("session", "ms", kind, "cast(x as double) as x", "cast(y as double) as y", "cast(v as double) * 0.1 as speed", "10.0D as accuracy", "cast(event_id * 37 % 360 as double) as bearing")
    return sensors.sensed(events)
