"""OpenStreetMap extracts (.osm.pbf) as a Spark data source: nodes, ways or relations, a partition for some blobs each.

    spark.dataSource.register(OsmPbf)
    spark.read.format("osm_pbf").option("path", uri).option("table", "ways").load()

The driver reads blob headers alone, a few bytes of each; blobs are raw or zlib."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayloom.sources.tile_archive import _open
from wayloom.sources.wire import fields, put, put_varint, signed, unzigzag, varints, zigzag

TABLES = {
    "nodes": "id long, lon7 long, lat7 long, tags map<string,string>",
    "ways": "id long, nodes array<long>, tags map<string,string>",
    "relations": "id long, members array<struct<type:string,id:long,role:string>>, tags map<string,string>",
}
FEATURES = {"OsmSchema-V0.6", "DenseNodes"}
BLOBS_PER_PARTITION = 16


def inflate(blob: bytes) -> bytes:
    for f, _, v in fields(blob):
        if f == 1:
            return v
        if f == 3:
            return zlib.decompress(v)
    raise ValueError("only raw and zlib blobs are read")


def check_features(block: bytes) -> None:
    unknown = {v.decode() for f, _, v in fields(block) if f == 4} - FEATURES
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")


def _sums(ns: list[int]) -> list[int]:
    out, total = [], 0
    for n in ns:
        total += zigzag(n)
        out.append(total)
    return out


def rows(block: bytes, table: str):
    """The rows of one block; ids and coordinates are running sums of differences."""
    strings, groups, grain, lat0, lon0 = [], [], 100, 0, 0
    for f, _, v in fields(block):
        if f == 1:
            strings = [s.decode("utf-8", "replace") for g, _, s in fields(v) if g == 1]
        elif f == 2:
            groups.append(v)
        elif f == 17:
            grain = v
        elif f == 19:
            lat0 = signed(v)
        elif f == 20:
            lon0 = signed(v)
    e7 = lambda n, base: (base + grain * n) // 100
    for group in groups:
        for kind, _, raw in fields(group):
            part = {f: v for f, _, v in fields(raw)}
            pick = lambda f: varints(part.get(f, b""))
            tags = lambda k, v: {strings[a]: strings[b] for a, b in zip(k, v)}
            if kind == 1 and table == "nodes":
                yield zigzag(part[1]), e7(zigzag(part[9]), lon0), e7(zigzag(part[8]), lat0), tags(pick(2), pick(3))
            elif kind == 2 and table == "nodes":
                mixed, at = pick(10), 0
                for i, lat, lon in zip(_sums(pick(1)), _sums(pick(8)), _sums(pick(9))):
                    own = {}
                    while at < len(mixed) and mixed[at]:
                        own[strings[mixed[at]]] = strings[mixed[at + 1]]
                        at += 2
                    at += 1
                    yield i, e7(lon, lon0), e7(lat, lat0), own
            elif kind == 3 and table == "ways":
                yield signed(part[1]), _sums(pick(8)), tags(pick(2), pick(3))
            elif kind == 4 and table == "relations":
                members = zip(pick(10), _sums(pick(9)), pick(8))
                yield signed(part[1]), [(("node", "way", "relation")[t], i, strings[r]) for t, i, r in members], tags(pick(2), pick(3))


def scan(f) -> list[tuple[str, int, int]]:
    """(type, offset, size) of every blob."""
    out, at, end = [], 0, f.size()
    while at < end:
        size = struct.unpack(">I", f.read_at(4, at))[0]
        head = {k: v for k, _, v in fields(f.read_at(size, at + 4))}
        out.append((head[1].decode(), at + 4 + size, head[3]))
        at += 4 + size + head[3]
    return out


def write_pbf(path: str, nodes: list[tuple], ways: list[tuple], relations: list[tuple]) -> None:
    """A small extract for tests: nodes (id, lon7, lat7, tags), ways (id, nodes, tags), relations (id, members, tags)."""
    pack = lambda ns: b"".join(map(put_varint, ns))
    diff = lambda ns: pack(unzigzag(b - a) for a, b in zip([0, *ns], ns))

    def block(make):
        strings: dict[str, int] = {"": 0}
        group = make(lambda s: strings.setdefault(s, len(strings)))
        return put(1, b"".join(put(1, s) for s in strings)) + put(2, group)

    def dense(no):
        mixed = [x for n in nodes for x in [*(no(s) for kv in n[3].items() for s in kv), 0]]
        return put(2, put(1, diff([n[0] for n in nodes])) + put(8, diff([n[2] for n in nodes])) + put(9, diff([n[1] for n in nodes])) + put(10, pack(mixed)))

    def tags(no, t):
        return put(2, pack(no(k) for k in t)) + put(3, pack(no(v) for v in t.values()))

    def lines(no):
        return b"".join(put(3, put(1, w[0]) + tags(no, w[2]) + put(8, diff(w[1]))) for w in ways)

    def sets(no):
        kinds = ("node", "way", "relation")
        return b"".join(put(4, put(1, r[0]) + tags(no, r[2]) + put(8, pack(no(m[2]) for m in r[1])) + put(9, diff([m[1] for m in r[1]])) + put(10, pack(kinds.index(m[0]) for m in r[1]))) for r in relations)

    with open(path, "wb") as out:
        for kind, body in [("OSMHeader", put(4, "OsmSchema-V0.6") + put(4, "DenseNodes")), *(("OSMData", block(m)) for m in (dense, lines, sets))]:
            blob = put(2, len(body)) + put(3, zlib.compress(body))
            head = put(1, kind) + put(3, len(blob))
            out.write(struct.pack(">I", len(head)) + head + blob)


@dataclass
class _Part(InputPartition):
    blobs: list


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.table = options["path"], options.get("table", "nodes")

    def partitions(self):
        with _open(self.path) as f:
            blobs = scan(f)
            for kind, at, size in blobs:
                if kind == "OSMHeader":
                    check_features(inflate(f.read_at(size, at)))
        data = [(at, size) for kind, at, size in blobs if kind == "OSMData"]
        return [_Part(data[k : k + BLOBS_PER_PARTITION]) for k in range(0, len(data), BLOBS_PER_PARTITION)]

    def read(self, part):
        with _open(self.path) as f:
            for at, size in part.blobs:
                yield from rows(inflate(f.read_at(size, at)), self.table)


class OsmPbf(DataSource):
    @classmethod
    def name(cls):
        return "osm_pbf"

    def schema(self):
        return TABLES[self.options.get("table", "nodes")]

    def reader(self, schema):
        return _Reader(self.options)
