"""Heights of nodes from elevation rasters: a raster is a table of cells, and each node meets the four around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.limits import UNSET, encoded_height


def node_heights(nodes: DataFrame, cells: DataFrame, size: int, per_tile: int) -> DataFrame:
    """nodes(id, x, y), cells(tx, ty, row, col, height) -> (id, height): interpolated between the centres of four cells of the node's raster, encoded.

    A raster tile (tx, ty) covers per_tile x per_tile cells of `size` units, rows from the south. At the edge of a tile the outermost
    cells are extended. Nodes without a raster, or with a missing cell around them, have the unset height. Four rows a node meet
    their cells in an equi join, so neither a tile nor its nodes have to fit into a task."""
    side = size * per_tile
    tx, ty = F.floor(F.col("x") / side), F.floor(F.col("y") / side)
    at = nodes.select("id", tx.alias("tx"), ty.alias("ty"), ((F.col("x") - tx * side) / size - 0.5).alias("dc"), ((F.col("y") - ty * side) / size - 0.5).alias("dr"))
    edge = lambda c: F.least(F.greatest(F.floor(c).cast("long"), F.lit(0)), F.lit(per_tile - 2))
    at = at.withColumns({"row0": edge("dr"), "col0": edge("dc")})
    corner = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1))))
    four = at.select("*", corner.alias("k"))
    wr, wc = F.col("dr") - F.col("row0"), F.col("dc") - F.col("col0")
    weight = F.when(F.col("k.r") == 1, wr).otherwise(1 - wr) * F.when(F.col("k.c") == 1, wc).otherwise(1 - wc)
    asked = four.select("id", "tx", "ty", (F.col("row0") + F.col("k.r")).alias("row"), (F.col("col0") + F.col("k.c")).alias("col"), weight.alias("w"))
    met = asked.join(cells, ["tx", "ty", "row", "col"], "left")
    out = met.groupBy("id").agg(F.sum(F.col("w") * F.col("height")).alias("h"), F.count("height").alias("n"))
    return out.select("id", F.when(F.col("n") == 4, encoded_height(F.col("h"))).otherwise(UNSET).cast("int").alias("height"))
