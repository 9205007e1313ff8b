"""Grids of heights, one degree a file (names like N47E011.hgt: 16-bit big-endian metres, rows from the north, n x n samples), as a Spark data source.

    spark.dataSource.register(ElevationGrid)
    spark.read.format("elevation_grid").option("path", folder).option("bbox", "11.2,47.1,11.4,47.3").load()

Bands of rows are partitions. Of a box (west, south, east, north) only its files are opened, only its rows are read, and only its columns become rows.
A file's last row and column are those of its neighbours to the south and east, and don't come twice: the grid of a whole country has each sample once."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayloom.sources.tile_archive import _open

VOID = -32768
#: Samples of a partition, about.
BAND = 1 << 20
_NAME = re.compile(r"([NS])(\d{2})([EW])(\d{3})\.hgt$", re.IGNORECASE)


def corner(name: str) -> tuple[int, int] | None:
    """(degrees east, degrees north) of the south-west corner that a file's name tells."""
    m = _NAME.search(name)
    return (int(m[4]) * (-1 if m[3] in "Ww" else 1), int(m[2]) * (-1 if m[1] in "Ss" else 1)) if m else None


def write_grid(path: str, heights: np.ndarray) -> None:
    """heights[row from the north, column], metres or VOID."""
    with open(path, "wb") as f:
        f.write(np.ascontiguousarray(heights, dtype=">i2").tobytes())


@dataclass
class _Band(InputPartition):
    path: str
    east: int
    north: int
    samples: int
    rows: tuple[int, int]
    columns: tuple[int, int]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.box = tuple(float(v) for v in options.get("bbox", "-180,-90,180,90").split(","))

    def partitions(self):
        from pyarrow import fs

        west, south, east, north = self.box
        system, where = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        parts = []
        for f in system.get_file_info(fs.FileSelector(where, recursive=True)):
            at = corner(f.base_name) if f.is_file else None
            if at is None or at[0] > east or at[0] + 1 <= west or at[1] > north or at[1] + 1 <= south:
                continue
            n = math.isqrt(f.size // 2)
            if n < 2 or n * n * 2 != f.size:
                raise ValueError(f"{f.path}: no square grid")
            steps = n - 1
            index = lambda low, high, base: (max(0, math.ceil(round((low - base) * steps, 6))), min(steps - 1, math.floor(round((high - base) * steps, 6))))
            columns, rows = index(west, east, at[0]), index(south, north, at[1])
            band = max(1, BAND // n)
            path = f.path if "://" not in self.path else self.path.rstrip("/") + f.path[len(where.rstrip("/")) :]
            parts += [_Band(path, *at, n, (k, min(k + band - 1, rows[1])), columns) for k in range(rows[0], rows[1] + 1, band) if columns[0] <= columns[1]]
        return parts or [_Band("", 0, 0, 0, (0, -1), (0, -1))]

    def read(self, part):
        n, (low, high), (left, right) = part.samples, part.rows, part.columns
        if low > high:
            return
        with _open(part.path) as f:
            # row 0 from the south is the last one of the file
            raw = f.read_at((high - low + 1) * n * 2, (n - 1 - high) * n * 2)
        grid = np.frombuffer(raw, dtype=">i2").reshape(-1, n)[::-1, left : right + 1].astype(np.float64)
        rows, columns = np.repeat(np.arange(low, high + 1), grid.shape[1]), np.tile(np.arange(left, right + 1), grid.shape[0])
        heights = grid.ravel()
        same = lambda v: pa.array(np.full(len(heights), v), pa.int64())
        yield pa.RecordBatch.from_arrays([same(part.east + 180), same(part.north + 90), pa.array(rows, pa.int64()), pa.array(columns, pa.int64()), pa.array(heights, pa.float64(), mask=heights == VOID)], names=["tx", "ty", "row", "col", "height"])


class ElevationGrid(DataSource):
    """Rows (tx, ty: degrees from 180 west and 90 south; row from the south, col; height, null where unknown), as `node_heights` takes them.

    A sample lies on its cell's south-west corner; `node_heights` has it in the middle, so nodes go in moved by half a cell to the north-east."""

    @classmethod
    def name(cls):
        return "elevation_grid"

    def schema(self):
        return "tx long, ty long, row long, col long, height double"

    def reader(self, schema):
        return _Reader(self.options)
