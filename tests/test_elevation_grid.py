"""Grids of heights written, read and met by nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.functions.limits import UNSET, height_of
from wayloom.operators.elevation import node_heights
from wayloom.sources import elevation_grid

N = 11


def grids(folder):
    """Two degrees side by side, one of them with a void: height = 10 x degrees east + degrees north, in tenths of a degree."""
    out = {}
    for name, east, north in (("N47E011", 11, 47), ("N47E012", 12, 47), ("S01W001", -1, -1)):
        rows, columns = np.mgrid[0:N, 0:N]
        h = (10 * (columns + 10 * (east - 11)) + (N - 1 - rows)).astype(np.int16)
        if east == 12:
            h[0, 3] = h[5, 5] = elevation_grid.VOID
        elevation_grid.write_grid(str(folder / f"{name}.hgt"), h)
        for r in range(N - 1):
            for c in range(N - 1):
                v = int(h[N - 1 - r, c])
                out[east + 180, north + 90, r, c] = None if v == elevation_grid.VOID else float(v)
    (folder / "notes.txt").write_text("x")
    return out


@pytest.mark.parametrize("band", [1, 1 << 20])
def test_round_trip_and_boxes(tmp_path, monkeypatch, band):
    want = grids(tmp_path)
    monkeypatch.setattr(elevation_grid, "BAND", band)

    def read(**options):
        reader = elevation_grid._Reader({"path": str(tmp_path), **options})
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert len({r[:4] for r in rows}) == len(rows)
        return {r[:4]: r[4] for r in rows}

    assert read() == want
    at = lambda k: (k[0] - 180 + k[3] / 10, k[1] - 90 + k[2] / 10)
    inside = lambda k: 11.75 <= at(k)[0] <= 12.25 and 47.15 <= at(k)[1] <= 47.55
    assert read(bbox="11.75,47.15,12.25,47.55") == {k: v for k, v in want.items() if inside(k)}
    assert read(bbox="50,50,51,51") == {}


def test_bytes_read_fall_with_the_box(tmp_path, monkeypatch):
    grids(tmp_path)
    read, open_ = [], elevation_grid._open

    class Counted:
        def __init__(self, path):
            self.f = open_(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, n, at):
            read.append(n)
            return self.f.read_at(n, at)

    monkeypatch.setattr(elevation_grid, "_open", Counted)
    reader = elevation_grid._Reader({"path": str(tmp_path), "bbox": "11.05,47.25,11.95,47.45"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2 * 9
    assert read == [2 * N * 2]


def test_no_grid(tmp_path):
    (tmp_path / "N01E001.hgt").write_bytes(b"123")
    with pytest.raises(ValueError):
        elevation_grid._Reader({"path": str(tmp_path)}).partitions()


def test_nodes_take_their_heights(spark, tmp_path):
    grids(tmp_path)
    spark.dataSource.register(elevation_grid.ElevationGrid)
    cells = spark.read.format("elevation_grid").option("path", str(tmp_path)).load()
    assert cells.count() == 300
    size = 100_000  # a tenth of a degree
    nodes = spark.createDataFrame([(1, 191_300_000, 137_200_000), (2, 191_350_000, 137_250_000), (3, 192_450_000, 137_450_000), (4, 300_000_000, 100_000_000)], "id long, x long, y long")
    moved = nodes.select("id", (F.col("x") + size // 2).alias("x"), (F.col("y") + size // 2).alias("y"))
    got = {r.id: (r.height, r.metres) for r in node_heights(moved, cells, size, N - 1).withColumn("metres", height_of(F.col("height"))).collect()}
    assert got[1][1] == pytest.approx(32.0) and got[2][1] == pytest.approx(37.5)
    assert got[3][0] == got[4][0] == UNSET  # beside a void; no grid
