"""Variable-length integers and protocol-buffer fields, as far as the readers here need them."""

from __future__ import annotations

import struct
from collections.abc import Iterator


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def varints(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append(v)
    return out


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def unzigzag(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a message; unknown ones too."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        field, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield field, kind, value


def put_varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def put(field: int, value: int | bytes | str | float) -> bytes:
    if isinstance(value, float):
        return put_varint(field << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, int):
        return put_varint(field << 3) + put_varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return put_varint(field << 3 | 2) + put_varint(len(raw)) + raw
