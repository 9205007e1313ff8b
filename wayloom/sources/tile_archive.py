"""Single-file tile archives (PMTiles version 3) as a Spark data source.

    spark.dataSource.register(TileArchive)
    spark.read.format("tile_archive").option("path", uri).option("minzoom", 10).option("bbox", "5.5,47,15,55").load()
    lookup(wanted, uri)

Each leaf directory (or run of root entries) is a partition, which reads its byte ranges alone; only the header and root directory,
16 KB by the format, are read on the driver. A box (west, south, east, north) or bounds of columns (x = "8600:8700", so for y)
become runs of tile ids along the curve, so that leaves without any aren't opened; what lies side by side in the file is read at once. They are options, not
filters that Spark pushes: on a frame that is used twice, Spark 4.1 hands the filters of one query to the next one's scan, which would lose rows. Files are opened by pyarrow's file systems, so uris of HDFS or object stores work."""

from __future__ import annotations

import bisect
import gzip
import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayloom.sources.wire import put_varint, varint

HEADER_BYTES = 127
NONE, GZIP = 1, 2
ENTRIES_PER_PARTITION = 4096
#: Bytes between two tiles that are read on the way, and of one read.
GAP, READ = 65_536, 4_194_304
MOST_LATITUDE = 85.05112878


@dataclass(frozen=True)
class Header:
    root: tuple[int, int]
    metadata: tuple[int, int]
    leaves: tuple[int, int]
    data: tuple[int, int]
    addressed: int
    entries: int
    contents: int
    internal: int
    compression: int
    kind: int
    minzoom: int
    maxzoom: int
    bounds: tuple[float, float, float, float]


def parse_header(raw: bytes) -> Header:
    if raw[:7] != b"PMTiles":
        raise ValueError("no tile archive")
    if raw[7] != 3:
        raise ValueError(f"version {raw[7]} is not read")
    q = struct.unpack_from("<11Q", raw, 8)
    _, internal, compression, kind, minzoom, maxzoom = raw[96:102]
    return Header(q[0:2], q[2:4], q[4:6], q[6:8], q[8], q[9], q[10], internal, compression, kind, minzoom, maxzoom, tuple(v / 1e7 for v in struct.unpack_from("<4i", raw, 102)))


def unpacked(raw: bytes, how: int) -> bytes:
    if how == GZIP:
        return gzip.decompress(raw)
    if how in (0, NONE):
        return raw
    raise ValueError(f"compression {how} is not read")


def decode_directory(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(first tile id, run length, bytes, offset) in order; run length 0 points to a leaf. An offset of 0 follows on the entry before."""
    n, at = varint(raw, 0)
    if not n:
        raise ValueError("an empty directory")
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            v, at = varint(raw, at)
            column.append(v)
        columns.append(column)
    ids, runs, lengths, offsets = columns
    out, tile, end = [], 0, 0
    for k in range(n):
        tile += ids[k]
        offset = end if offsets[k] == 0 and k else offsets[k] - 1
        end = offset + lengths[k]
        out.append((tile, runs[k], lengths[k], offset))
    return out


def encode_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    out, before = [put_varint(len(entries))], 0
    for e in entries:
        out.append(put_varint(e[0] - before))
        before = e[0]
    out += [put_varint(e[1]) for e in entries] + [put_varint(e[2]) for e in entries]
    end = None
    for e in entries:
        out.append(put_varint(0 if e[3] == end else e[3] + 1))
        end = e[3] + e[2]
    return b"".join(out)


def tile_of(tile_id: int) -> tuple[int, int, int]:
    z = 0
    while tile_id >= 1 << (2 * z):
        tile_id -= 1 << (2 * z)
        z += 1
    x = y = 0
    s = 1
    while s < 1 << z:
        rx = tile_id >> 1 & 1
        ry = (tile_id ^ rx) & 1
        if not ry:
            if rx:
                x, y = s - 1 - x, s - 1 - y
            x, y = y, x
        x, y = x + s * rx, y + s * ry
        tile_id >>= 2
        s <<= 1
    return z, x, y


def write_archive(path: str, tiles: dict[int, bytes], minzoom: int, maxzoom: int, bounds=(-180.0, -85.0, 180.0, 85.0), metadata: dict | None = None, leaf: int = 0) -> None:
    """A small archive from tile id -> bytes, for tests and exports: gzip inside; equal neighbouring tiles are stored once; leaf: entries a leaf, or none."""
    blob, entries, where = bytearray(), [], {}
    for tile in sorted(tiles):
        raw = tiles[tile]
        if raw not in where:
            where[raw] = len(blob)
            blob += gzip.compress(raw, mtime=0)
            where[raw] = (where[raw], len(blob) - where[raw])
        offset, size = where[raw]
        if entries and entries[-1][3] == offset and entries[-1][0] + entries[-1][1] == tile:
            entries[-1] = (entries[-1][0], entries[-1][1] + 1, size, offset)
        else:
            entries.append((tile, 1, size, offset))
    leaves = bytearray()
    root = entries
    if leaf:
        root = []
        for k in range(0, len(entries), leaf):
            part = gzip.compress(encode_directory(entries[k : k + leaf]), mtime=0)
            root.append((entries[k][0], 0, len(part), len(leaves)))
            leaves += part
    top, meta = gzip.compress(encode_directory(root), mtime=0), gzip.compress(json.dumps(metadata or {}).encode(), mtime=0)
    at = [HEADER_BYTES, len(top), HEADER_BYTES + len(top), len(meta)]
    at += [at[2] + at[3], len(leaves), at[2] + at[3] + len(leaves), len(blob), len(tiles), len(entries), len(where)]
    w, s, e, n = (round(v * 1e7) for v in bounds)
    head = b"PMTiles\x03" + struct.pack("<11Q", *at) + bytes([1, GZIP, GZIP, 1, minzoom, maxzoom]) + struct.pack("<4iB2i", w, s, e, n, minzoom, (w + e) // 2, (s + n) // 2)
    with open(path, "wb") as f:
        f.write(head + top + meta + bytes(leaves) + bytes(blob))


def _open(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(where)


def info(path: str) -> tuple[Header, dict]:
    with _open(path) as f:
        h = parse_header(f.read_at(HEADER_BYTES, 0))
        raw = f.read_at(h.metadata[1], h.metadata[0])
        return h, json.loads(unpacked(raw, h.internal) or b"{}") if raw else {}


def first_id(z: int) -> int:
    return ((1 << (2 * z)) - 1) // 3


def box_ranges(z: int, x1: int, y1: int, x2: int, y2: int, most: int = 512) -> list[tuple[int, int]]:
    """[low, high) runs of tile ids of zoom z that hold all tiles of a box, in order.

    Squares along the curve are quartered, level by level, until none lies across the rim or over `most` would come of it; what is across then stays, so the runs hold more than the box at worst, never less."""
    done, rim, size = [], [(0, 0)] if x1 <= x2 and y1 <= y2 else [], 1 << z
    while rim:
        across = []
        for level, place in rim:
            _, x, y = tile_of(first_id(level) + place)
            side = size >> level
            low_x, low_y = x * side, y * side
            if low_x > x2 or low_x + side <= x1 or low_y > y2 or low_y + side <= y1:
                continue
            inside = x1 <= low_x and low_x + side - 1 <= x2 and y1 <= low_y and low_y + side - 1 <= y2
            (done if inside else across).append((level, place))
        if len(done) + 4 * len(across) > most:
            done += across
            across = []
        rim = [(level + 1, place * 4 + k) for level, place in across for k in range(4)]
    return merged((first_id(z) + (place << 2 * (z - level)), first_id(z) + (place + 1 << 2 * (z - level))) for level, place in done)


def merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        elif low < high:
            out.append((low, high))
    return out


def box_tiles(z: int, west: float, south: float, east: float, north: float) -> tuple[int, int, int, int]:
    """(x1, y1, x2, y2): the tiles of a box of degrees; y grows to the south."""
    n = 1 << z
    at = lambda v: min(max(math.floor(v * n), 0), n - 1)
    row = lambda lat: (1 - math.asinh(math.tan(math.radians(min(max(lat, -MOST_LATITUDE), MOST_LATITUDE)))) / math.pi) / 2
    return at((west + 180) / 360), at(row(north)), at((east + 180) / 360), at(row(south))


@dataclass
class _Part(InputPartition):
    leaf: tuple[int, int] | None
    entries: list
    ranges: list


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.low, self.high = int(options.get("minzoom", 0)), int(options.get("maxzoom", 31))
        self.box = tuple(float(v) for v in options["bbox"].split(",")) if options.get("bbox") else None
        if self.box and len(self.box) != 4:
            raise ValueError("bbox is west,south,east,north")
        self.limits = {c: tuple(int(v) for v in options.get(c, f"0:{1 << 31}").split(":")) for c in ("x", "y")}

    def _tiles(self, z: int) -> tuple[int, int, int, int]:
        x1, y1, x2, y2 = box_tiles(z, *self.box) if self.box else (0, 0, (1 << z) - 1, (1 << z) - 1)
        (a, b), (c, d) = self.limits["x"], self.limits["y"]
        return max(x1, a), max(y1, c), min(x2, b), min(y2, d)

    def _ranges(self) -> list[tuple[int, int]]:
        return merged(r for z in range(self.low, min(self.high, 31) + 1) for r in box_ranges(z, *self._tiles(z)))

    def partitions(self):
        ranges = self._ranges()
        with _open(self.path) as f:
            h = parse_header(f.read_at(HEADER_BYTES, 0))
            root = decode_directory(unpacked(f.read_at(h.root[1], h.root[0]), h.internal))
        parts, plain = [], []
        for e, end in zip(root, [e[0] for e in root[1:]] + [1 << 62]):
            if e[1]:
                plain += [e] if _within(ranges, e[0], e[0] + e[1]) else []
            elif asked := _within(ranges, e[0], end):
                parts.append(_Part((h.leaves[0] + e[3], e[2]), [], asked))
        for k in range(0, len(plain), ENTRIES_PER_PARTITION):
            some = plain[k : k + ENTRIES_PER_PARTITION]
            parts.append(_Part(None, some, _within(ranges, some[0][0], some[-1][0] + some[-1][1])))
        return parts or [_Part(None, [], [])]

    def read(self, part):
        with _open(self.path) as f:
            h = parse_header(f.read_at(HEADER_BYTES, 0))
            entries = part.entries if part.leaf is None else decode_directory(unpacked(f.read_at(part.leaf[1], part.leaf[0]), h.internal))
            wanted = [(offset, size, _within(part.ranges, tile, tile + run)) for tile, run, size, offset in entries]
            for start, length, group in _together(sorted((w for w in wanted if w[2]), key=lambda w: w[:2])):
                raw = f.read_at(length, h.data[0] + start)
                for offset, size, ranges in group:
                    data = None
                    for t in (t for low, high in ranges for t in range(low, high)):
                        z, x, y = tile_of(t)
                        x1, y1, x2, y2 = self._tiles(z)
                        if x1 <= x <= x2 and y1 <= y <= y2:
                            data = unpacked(raw[offset - start : offset - start + size], h.compression) if data is None else data
                            yield t, z, x, y, data


def _within(ranges: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """What of sorted ranges lies in [low, high)."""
    k = max(bisect.bisect_right(ranges, (low, low)) - 1, 0)
    out = []
    while k < len(ranges) and ranges[k][0] < high:
        if ranges[k][1] > low:
            out.append((max(low, ranges[k][0]), min(high, ranges[k][1])))
        k += 1
    return out


def _together(wanted: list):
    """(start, length, entries) of one read each: neighbours in the file with small gaps between them."""
    group, end = [], 0
    for w in wanted:
        if group and (w[0] > end + GAP or w[0] + w[1] > group[0][0] + READ):
            yield group[0][0], end - group[0][0], group
            group, end = [], 0
        group.append(w)
        end = max(end, w[0] + w[1])
    if group:
        yield group[0][0], end - group[0][0], group


class TileArchive(DataSource):
    @classmethod
    def name(cls):
        return "tile_archive"

    def schema(self):
        return "tile_id long, z int, x int, y int, data binary"

    def reader(self, schema):
        return _Reader(self.options)


def lookup(wanted: DataFrame, path: str) -> DataFrame:
    """wanted(tile_id, ...) -> (tile_id, data): each tile that is asked for and there, once however often it is asked for.

    Ids are dealt out by ranges and sorted, so a task opens each leaf directory of its range once, and reads what lies side by side at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _open(path) as f:
            h = parse_header(f.read_at(HEADER_BYTES, 0))
            root = decode_directory(unpacked(f.read_at(h.root[1], h.root[0]), h.internal))
            opened, leaf, starts = None, root, [e[0] for e in root]
            top = starts
            for frame in frames:
                found = []
                for t in frame["tile_id"].tolist():
                    at = bisect.bisect_right(top, t) - 1
                    if at >= 0 and not root[at][1] and opened != at:
                        leaf = decode_directory(unpacked(f.read_at(root[at][2], h.leaves[0] + root[at][3]), h.internal))
                        opened, starts = at, [e[0] for e in leaf]
                    entries, firsts = (leaf, starts) if at >= 0 and not root[at][1] else (root, top)
                    k = bisect.bisect_right(firsts, t) - 1
                    if k >= 0 and t < entries[k][0] + entries[k][1]:
                        found.append((entries[k][3], entries[k][2], t))
                for start, length, group in _together(sorted(found)):
                    raw = f.read_at(length, h.data[0] + start)
                    yield pd.DataFrame({"tile_id": [t for *_, t in group], "data": [unpacked(raw[o - start : o - start + n], h.compression) for o, n, _ in group]})

    ids = wanted.select(F.col("tile_id").cast("long").alias("tile_id")).dropna().distinct()
    return ids.repartitionByRange("tile_id").sortWithinPartitions("tile_id").mapInPandas(run, "tile_id long, data binary")
