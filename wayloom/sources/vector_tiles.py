"""Vector tiles (MVT 2) to rows of features, and back for exports and tests."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame

from wayloom.sources.wire import fields, put, put_varint, signed, unzigzag, varints, zigzag

KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON"}
FEATURES = "layer string, feature_id long, kind string, extent int, props map<string,struct<type:string,s:string,d:double,l:long>>, paths array<array<struct<x:int,y:int>>>"


def value(raw: bytes) -> dict | None:
    """A property: its text, and its number where it has one. The last field of several counts."""
    out = None
    for f, _, v in fields(raw):
        if f == 1:
            out = {"type": "string", "s": v.decode("utf-8", "replace"), "d": None, "l": None}
        elif f in (2, 3):
            d = struct.unpack("<f" if f == 2 else "<d", v)[0]
            out = {"type": "double", "s": repr(d), "d": d, "l": None}
        elif f in (4, 5, 6):
            n = zigzag(v) if f == 6 else signed(v)
            if f == 6:  # kept in 32 bits, so that it isn't taken for a 64-bit number
                n = (n + 2**31) % 2**32 - 2**31
            out = {"type": "int" if f == 6 else "long", "s": str(n), "d": float(n), "l": n}
        elif f == 7:
            out = {"type": "bool", "s": "true" if v else "false", "d": None, "l": int(bool(v))}
    return out


def paths(commands: list[int]) -> list[list[dict]]:
    """Each move starts a path; closing one ends it without its first point again."""
    out, x, y, at = [], 0, 0, 0
    while at < len(commands):
        op, n = commands[at] & 7, commands[at] >> 3
        at += 1
        if op in (1, 2):
            for _ in range(n):
                if at + 1 >= len(commands):
                    return out
                x, y = x + zigzag(commands[at]), y + zigzag(commands[at + 1])
                at += 2
                if op == 1:
                    out.append([])
                if out:
                    out[-1].append({"x": x, "y": y})
    return out


def decode(data: bytes) -> list[tuple]:
    """Rows of FEATURES; of layers with one name the last counts; tags that point nowhere are left out."""
    layers: dict[str, list[tuple]] = {}
    for f, kind, raw in fields(data):
        if f != 3 or kind != 2:
            continue
        name, extent, keys, values, parts = "", 4096, [], [], []
        for g, _, v in fields(raw):
            if g == 1:
                name = v.decode()
            elif g == 2:
                parts.append(v)
            elif g == 3:
                keys.append(v.decode())
            elif g == 4:
                values.append(value(v))
            elif g == 5:
                extent = v
        rows = []
        for part in parts:
            fid, tags, form, shape = None, [], 0, []
            for g, _, v in fields(part):
                if g == 1:
                    fid = signed(v)
                elif g == 2:
                    tags = varints(v)
                elif g == 3:
                    form = v
                elif g == 4:
                    shape = varints(v)
            props = {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2]) if k < len(keys) and v < len(values) and values[v] is not None}
            rows.append((name, fid, KINDS.get(form, "UNKNOWN"), extent, props, paths(shape)))
        layers[name] = rows
    return [r for rows in layers.values() for r in rows]


def encode(layer: str, features: list[tuple[int, int, dict, list[list[tuple[int, int]]]]], extent: int = 4096) -> bytes:
    """One layer of (id, form 1..3, props of str, int and float, paths)."""
    keys: dict[str, int] = {}
    values: dict = {}
    body = put(15, 2) + put(1, layer)
    for fid, form, props, shape in features:
        tags, commands, x, y = [], [], 0, 0
        for k, v in props.items():
            tags += [keys.setdefault(k, len(keys)), values.setdefault((type(v), v), len(values))]
        for path in shape:
            for op, points in ((1, path[:1]), (2, path[1:])):
                if points:
                    commands.append(op | len(points) << 3)
                for px, py in points:
                    commands += [unzigzag(px - x), unzigzag(py - y)]
                    x, y = px, py
            if form == 3:
                commands.append(7 | 1 << 3)
        pack = lambda ns: b"".join(map(put_varint, ns))
        body += put(2, put(1, fid) + put(2, pack(tags)) + put(3, form) + put(4, pack(commands)))
    for k in keys:
        body += put(3, k)
    for kind, v in values:
        body += put(4, put(1, v) if kind is str else put(3, v) if kind is float else put(4, v))
    return put(3, body + put(5, extent))


def features(tiles: DataFrame) -> DataFrame:
    """tiles(z, x, y, data) -> (z, x, y) and a row of FEATURES each. Null data has none."""

    def run(frames):
        for frame in frames:
            rows = [(z, x, y, *f) for z, x, y, data in zip(frame["z"], frame["x"], frame["y"], frame["data"]) if data is not None for f in decode(bytes(data))]
            yield pd.DataFrame(rows, columns=["z", "x", "y", "layer", "feature_id", "kind", "extent", "props", "paths"])

    return tiles.select("z", "x", "y", "data").mapInPandas(run, "z int, x long, y long, " + FEATURES)
