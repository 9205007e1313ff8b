"""Byte-level BPE by rank files: a segment tree over byte positions keeps the leftmost least pair rank."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import batched, extended, table

#: Distinct pieces whose ids a Python worker remembers, and characters of the longest of them; at the bound it forgets all and goes on.
CACHE_PIECES, CACHE_CHARS = 400_000, 100
_NONE = np.int64(1) << 60
_LONG = 512
_GROUP_CHARS = 2_000_000
#: Bytes of pieces that are merged side by side; their trees then fit a core's cache.
_BATCH_BYTES = 1 << 17


class BytePairCodec:
    """Encodes pieces of bytes and decodes ids. ranks: token -> id; a pair's rank is the id of the two joined."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.pattern = regex.compile(pattern)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.shift = max(self.tokens).bit_length()
        pairs = {}
        for token, i in self.ranks.items():
            for at in range(1, len(token)):
                left, right = self.ranks.get(token[:at]), self.ranks.get(token[at:])
                if left is not None and right is not None:
                    pairs[left << self.shift | right] = i
        self.pairs = pairs
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_keys, self.pair_ids = keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.int64)
        self.cache: dict[str, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << self.shift | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], _NONE)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of about the same length, all merged side by side: one array, and where each piece ends in it.

        Each piece has a segment tree over its byte positions. A leaf holds rank << bits | position of the pair that
        starts there, so that a node's minimum is the leftmost pair of least rank. A merge changes the pairs of the
        merged part and of its live left neighbour and removes that of its right part: three point updates
        that walk up the tree."""
        n, width = len(pieces), max(map(len, pieces))
        bits = max(1, (width - 1).bit_length())
        size, none = 1 << bits, _NONE
        lengths = np.array([len(p) for p in pieces])
        slots = (np.arange(size) < lengths[:, None]).ravel()
        ids = np.full(n * size, -1, dtype=np.int64)
        ids[slots] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        # live neighbours, as places in ids
        place = np.arange(n * size)
        after, before = place + 1, place - 1
        before[::size] = -1
        tree = np.full((n, 2 * size), none, dtype=np.int64)
        first = np.flatnonzero(slots[:-1] & slots[1:] & (place[1:] & (size - 1) != 0))
        rank = self.pair_rank(ids[first], ids[first + 1])
        tree[first >> bits, size + (first & (size - 1))] = np.where(rank == none, none, rank << bits | (first & (size - 1)))
        for level in range(bits - 1, -1, -1):
            a, b = 1 << level, 2 << level
            tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])
        tree = tree.ravel()
        root = np.arange(n) * 2 * size + 1
        root = root[tree[root] < none]
        while len(root):
            best = tree[root]
            piece = root >> bits + 1
            start = piece << bits
            at = start + (best & (size - 1))
            merged = best >> bits
            right = after[at]
            far = after[right]
            left = before[at]
            ids[at], ids[right], after[at] = merged, -1, far
            inner, old = far < start + lengths[piece], left >= 0
            nxt, left = far[inner], left[old]
            before[nxt] = at[inner]
            rank = np.full(2 * len(at), none)
            found = self.pair_rank(np.concatenate([merged[inner], ids[left]]), np.concatenate([ids[nxt], merged[old]]))
            rank[len(at) :][inner] = found[: len(nxt)]
            spot = np.concatenate([right, at, left])
            rank = np.concatenate([rank, found[len(nxt) :]])
            node = spot & (size - 1)
            leaf = np.where(rank == none, none, rank << bits | node)
            base = spot >> bits << bits + 1
            node += size
            tree[base + node] = leaf
            for _ in range(bits):
                child = base + (node & -2)
                node >>= 1
                tree[base + node] = np.minimum(tree[child], tree[child + 1])
            root = root[tree[root] < none]
        kept = ids >= 0
        return ids[kept].astype("<u4"), np.cumsum(kept.reshape(n, size).sum(axis=1))

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, with plain lists, as arrays of one row would cost more than they save."""
        n = len(piece)
        bits = max(1, (n - 1).bit_length())
        size, none, get, shift = 1 << bits, 1 << 62, self.pairs.get, self.shift
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = get(ids[i] << shift | ids[i + 1])
            if r is not None:
                tree[size + i] = r << bits | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(at: int, value: int) -> None:
            node = at + size
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                value = other if other < value else value
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < none:
            at, merged = tree[1] & (size - 1), tree[1] >> bits
            right = after[at]
            far, left = after[right], before[at]
            ids[at], ids[right], after[at] = merged, -1, far
            put(right, none)
            if far < n:
                before[far] = at
                r = get(merged << shift | ids[far])
                put(at, none if r is None else r << bits | at)
            else:
                put(at, none)
            if left >= 0:
                r = get(ids[left] << shift | merged)
                put(left, none if r is None else r << bits | left)
        return np.array([i for i in ids if i >= 0], dtype=np.int64)

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of these pieces, as little-endian unsigned 32-bit integers, into the cache."""
        by_bits: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(raw) > _LONG:
                self.cache[piece] = self.merge_long(raw).astype("<u4").tobytes()
            else:
                by_bits.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, some in by_bits.items():
            step = max(1, _BATCH_BYTES >> bits)
            for i in range(0, len(some), step):
                part = some[i : i + step]
                ids, ends = self.merge_all([raw for _, raw in part])
                packed, begin = ids.tobytes(), 0
                for (piece, _), end in zip(part, (4 * ends).tolist()):
                    self.cache[piece] = packed[begin:end]
                    begin = end

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The packed ids of each text. New pieces are learnt for some texts at once, up to about _GROUP_CHARS."""
        group, chars = [], 0
        for text in texts:
            group.append(self.pattern.findall(text))
            chars += len(text)
            if chars >= _GROUP_CHARS:
                yield from self._encoded(group)
                group, chars = [], 0
        yield from self._encoded(group)

    def _encoded(self, group: list[list[str]]) -> Iterator[bytes]:
        pieces = set().union(*group)
        missing = pieces.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_PIECES:
            self.cache.clear()
            missing = pieces
        self.learn(missing)
        for text in group:
            yield b"".join(map(self.cache.__getitem__, text))
        for piece in missing:
            if len(piece) > CACHE_CHARS:
                del self.cache[piece]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    return BytePairCodec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Replaces or adds `ids` (binary: little-endian unsigned 32-bit) and, if named, `decoded` (binary: the bytes that the ids stand for).

    Null text counts as empty and has no ids. Every row returns once, in any number of copies; other columns stay.
    `path` must be readable on the executors, where each Python worker loads it once."""
    kept = [c for c in docs.columns if c not in (ids, decoded)]
    schema = extended(docs.select(*kept), f"{ids} binary" + (f", {decoded} binary" if decoded else ""))

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            packed = list(bpe.encode(texts))
            columns = [batch.column(c) for c in kept] + [pa.array(packed, pa.binary())]
            if decoded:
                columns.append(pa.array(map(bpe.decode, packed), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids, *([decoded] if decoded else [])])

    return batched(docs.select(*kept)).mapInArrow(run, schema)


def public_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, *public_vocabulary(), decoded="decoded")
    return encoded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
