"""Registered queries over vector tiles."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.plans.derived import cte, derived
from wayloom.plans.geometry import Z, tx, ty
from wayloom.plans.registry import query
from wayloom.sources import vector_tiles

_N = 1 << Z
_FX = f"((ilon / 1e6 - 180 + 180) / 360 * {_N})"
_FY = f"((1 - ln(tan(radians(ilat / 1e6 - 90)) + 1 / cos(radians(ilat / 1e6 - 90))) / pi()) / 2 * {_N})"


@query("tile_features_round_trip", f"WITH {cte('places')} SELECT id, {tx()} AS x, {ty()} AS y, CAST(floor(({_FX} - floor({_FX})) * 4096) AS INT) AS px, CAST(floor(({_FY} - floor({_FY})) * 4096) AS INT) AS py, name, CAST(rank AS BIGINT) AS rank FROM places")
def round_trip(spark, sf_dir):
    p = derived(spark, sf_dir, "places").withColumns({"lon": geo.lon_of(F.col("ilon")), "lat": geo.lat_of(F.col("ilat"))})
    r = F.radians("lat")
    fx, fy = (F.col("lon") + 180) / 360 * _N, (1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.pi()) / 2 * _N
    cut = lambda f: F.floor((f - F.floor(f)) * 4096).cast("int")
    at = p.select("id", "name", F.col("rank").cast("long").alias("rank"), geo.tile_x(F.col("lon"), Z).alias("x"), geo.tile_y(F.col("lat"), Z).alias("y"), cut(fx).alias("px"), cut(fy).alias("py"))

    def pack(frames):
        rows = (row for frame in frames for row in zip(*(frame[c] for c in ("x", "y", "id", "name", "rank", "px", "py"))))
        done = []
        for (x, y), run in itertools.groupby(rows, key=lambda row: row[:2]):
            done.append((Z, x, y, vector_tiles.encode("place", [(int(i), 1, {"name": n, "rank": int(k)}, [[(int(a), int(b))]]) for _, _, i, n, k, a, b in run])))
            if len(done) == 1000:
                yield pd.DataFrame(done, columns=["z", "x", "y", "data"])
                done = []
        if done:
            yield pd.DataFrame(done, columns=["z", "x", "y", "data"])

    # tiles lie side by side in sorted partitions, so each is one run of rows
    tiles = at.repartition("x", "y").sortWithinPartitions("x", "y", "id").mapInPandas(pack, "z int, x long, y long, data binary")
    found = vector_tiles.features(tiles).where("layer = 'place' and kind = 'POINT'")
    point = F.col("paths")[0][0]
    return found.select(F.col("feature_id").alias("id"), "x", "y", point["x"].alias("px"), point["y"].alias("py"), F.col("props")["name"]["s"].alias("name"), F.col("props")["rank"]["l"].alias("rank"))
