"""Removal of repeated passages: every byte under a 100-byte string that also starts earlier in the corpus.

Strings of 100 bytes are dealt out by content: of the 24-byte grams in a string, the one with the least hash is its
anchor, so equal strings have equal anchors at equal places. All neighbouring strings of a document with one anchor form a stretch.
Anchors that only one stretch has can't hold repeats. All others are dealt to tasks by anchor, with their bytes; each task
sorts the suffixes that start there in two stages, and adjacent common prefixes of 100 bytes give the repeated ones.
Nothing is judged by a hash: hashes only say which strings meet."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import batched, cut, extended, table, unused
from wayloom.llm.word_hashes import mix, powers, text_pieces

LENGTH, GRAM = 100, 24
#: Bytes hashed at once, bytes of texts whose equal stretches are put together before they travel, and strings sorted at once.
CHUNK_BYTES, PIECE_BYTES, SORTED_AT_ONCE = 1 << 19, 1 << 22, 60_000
#: Stretches that meet by their anchor alone, at most; beyond that they are taken apart and meet by longer parts of their bytes.
HOT = 8192
STRETCHES_PER_BUCKET = 100_000

_BITS = 20  # of a place in a chunk


def _valid(size: int, offsets: np.ndarray) -> np.ndarray:
    """Whether a string of LENGTH bytes that doesn't cross rows starts at each byte."""
    step = np.zeros(size + 1, dtype=np.int8)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    np.add.at(step, offsets[long], 1)
    np.add.at(step, offsets[long + 1] - LENGTH + 1, -1)
    return np.cumsum(step[:-1], dtype=np.int8) > 0


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first start, number of starts, anchor's place from the first start, anchor's hash, hash of all the stretch's bytes) of the rows of a piece, in order.

    Chunks of CHUNK_BYTES starts are looked at one after another; a stretch ends where a chunk does."""
    valid, width, out = _valid(len(data), offsets), LENGTH - GRAM + 1, []
    for a in range(0, len(data) - LENGTH + 1, CHUNK_BYTES):
        here = data[a : a + CHUNK_BYTES + LENGTH - 1]
        n = len(here) - LENGTH + 1
        up, down = powers(len(here) + 1)
        sums = np.zeros(len(here) + 1, dtype=np.uint64)
        np.cumsum((here + np.uint64(1)) * up[: len(here)], out=sums[1:])
        gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(here) - GRAM + 1])
        least, have = gram >> np.uint64(_BITS) << np.uint64(_BITS) | np.arange(len(gram), dtype=np.uint64), 1
        while 2 * have <= width:
            least = np.minimum(least[: len(least) - have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        anchor = (least & np.uint64((1 << _BITS) - 1)).astype(np.int64)[:n]  # of the string that starts at each place
        ok = valid[a : a + n]
        fresh = ok.copy()
        fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
        lo, places = np.flatnonzero(fresh), np.flatnonzero(ok)
        if not len(lo):
            continue
        count = np.diff(np.append(np.searchsorted(places, lo), len(places)))
        mark = anchor[lo]
        body = mix((sums[lo + count + LENGTH - 1] - sums[lo]) * down[lo]) + mix((mark - lo).astype(np.uint64) * np.uint64(1000003) + count.astype(np.uint64))
        out.append((lo + a, count, mark - lo, mix(gram[mark] + np.uint64(77)), body))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    lo, *rest = (np.concatenate(x) for x in zip(*out))
    row = np.searchsorted(offsets, lo, side="right") - 1
    return row, lo - offsets[row], *rest


_RECORD = np.dtype([("b", "<u4"), ("h", "<u4"), ("d", "<i8"), ("k", "<i8"), ("lo", "<u4"), ("n", "<u1"), ("at", "<u1")])
#: What a record says: a stretch that must meet others of its anchor, a repeated one, one whose anchor is known to have others.
_MEETS, _REPEATED, _OPEN = 0, 1, 2


def _packed(docs: DataFrame, bits: int) -> DataFrame:
    """docs(doc, key, text) -> (bucket, kind, blob): stretches packed by the first bits of their anchor's hash.

    Of the stretches with equal bytes in a piece only the earliest goes on; the others are repeated and need not meet any. Where different
    stretches of a piece share an anchor they are open already, and one record of no strings stands for them in the anchor's bucket. So
    neither a passage nor an anchor of very many documents comes to a bucket more than once a piece."""

    def packed(records: np.ndarray, kind: int, to: np.ndarray):
        order = np.argsort(to, kind="stable")
        records, to = records[order], to[order]
        starts = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
        for s, e in zip(starts, [*starts[1:], len(to)]):
            x = records[s:e]
            yield int(to[s]), kind, b"".join(x[f].tobytes() for f in _RECORD.names)

    def run(batches):
        shift = np.uint64(64 - bits)
        for batch in batches:
            ids, keys = batch.column("doc").to_numpy(), batch.column("key").to_numpy()
            for first, after, data, offsets in text_pieces(batch.column("text"), PIECE_BYTES):
                row, lo, n, at, h, c = stretches(data, offsets)
                if not len(row):
                    continue
                d, k = ids[first:after][row], keys[first:after][row]
                order = np.lexsort((lo, k, d, c, h))
                row, lo, n, at, h, c, d, k = (x[order] for x in (row, lo, n, at, h, c, d, k))
                same = np.zeros(len(d), dtype=bool)
                same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
                group = np.maximum.accumulate(np.where(same, 0, np.arange(len(d))))
                raw, begin, size = data.tobytes(), offsets[row] + lo, n + LENGTH - 1
                for i in np.flatnonzero(same).tolist():  # equal bytes, not equal hashes alone
                    a, b, g = begin[i], begin[group[i]], size[i]
                    same[i] = raw[a : a + g] == raw[b : b + g]
                known = same & ((d != d[group]) | (k != k[group]) | (lo != lo[group]))
                record = np.empty(len(d), dtype=_RECORD)
                bucket, by_doc = ((x >> shift).astype(np.int64) for x in (h, mix(d.view(np.uint64))))
                record["b"], record["h"], record["d"], record["k"], record["lo"], record["n"], record["at"] = bucket, (h << np.uint64(bits) >> np.uint64(32)).astype(np.uint32), d, k, lo, n, at
                kept = np.flatnonzero(~same)
                head = np.append(True, h[kept][1:] != h[kept][:-1])
                sizes = np.diff(np.append(np.flatnonzero(head), len(kept)))
                several = np.repeat(sizes > 1, sizes)
                marks = record[kept[head & several]]
                marks["n"] = 0
                meets, open_ = kept[~several], kept[several]
                out = [*packed(record[known], _REPEATED, by_doc[known]), *packed(np.concatenate([record[meets], marks]), _MEETS, np.concatenate([bucket[meets], bucket[kept[head & several]]]))]
                out += packed(record[open_], _OPEN, by_doc[open_])
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["bucket", "kind", "blob"])

    return batched(docs).mapInArrow(run, "bucket int, kind int, blob binary")


def _unpack(blobs: list[bytes]) -> np.ndarray:
    parts = []
    for blob in blobs:
        n = len(blob) // _RECORD.itemsize
        r, at = np.empty(n, dtype=_RECORD), 0
        for f in _RECORD.names:
            t = _RECORD[f]
            r[f] = np.frombuffer(blob, dtype=t, count=n, offset=at)
            at += n * t.itemsize
        parts.append(r)
    return np.concatenate(parts) if parts else np.empty(0, dtype=_RECORD)


def _met(packed: DataFrame, bits: int) -> DataFrame:
    """(doc, key, lo, n, at, h): repeated stretches (h null), and those whose bytes must be compared with others of their anchor."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        kinds = [_unpack(frame["blob"][frame["kind"] == k].tolist()) for k in (_REPEATED, _OPEN, _MEETS)]
        r = kinds[2]
        r = r[np.lexsort((r["n"], r["lo"], r["k"], r["d"], r["h"]))]
        r = r[np.append(np.ones(min(1, len(r)), dtype=bool), (r[1:] != r[:-1]))]  # a repeated row's stretches come once
        heads = np.flatnonzero(np.append(np.ones(min(1, len(r)), dtype=bool), r["h"][1:] != r["h"][:-1]))
        sizes = np.diff(np.append(heads, len(r)))
        open_ = np.concatenate([kinds[1], r[np.repeat(sizes > 1, sizes) & (r["n"] > 0)]])
        said = np.concatenate([kinds[0], open_])
        h = (said["b"].astype(np.uint64) << np.uint64(64 - bits) | said["h"].astype(np.uint64)).view(np.int64)
        out = pd.DataFrame({"doc": said["d"], "key": said["k"], "lo": said["lo"].astype(np.int32), "n": said["n"].astype(np.int32), "at": said["at"].astype(np.int32)})
        out["h"] = pd.arrays.IntegerArray(h, np.arange(len(said)) < len(kinds[0]))
        return out

    return packed.groupBy("bucket").applyInPandas(meet, "doc long, key long, lo int, n int, at int, h long")


def two_stage(text: np.ndarray, starts: np.ndarray, follows: np.ndarray, induced: np.ndarray) -> np.ndarray:
    """Indexes of `starts` in the order of the LENGTH bytes of text that begin there.

    follows[i]: starts[i] + 1 is starts[i + 1]; induced[i]: the string is larger than its successor, which follows. First
    stage: the others are sorted directly. Second stage: buckets of a first byte are scanned from the
    least; each string met puts its predecessor, if that one is larger, next into its bucket. Inside a bucket the
    induced ones come first. Equal strings end up side by side, in any order."""
    n = len(starts)
    first = text[starts].astype(np.int16)
    direct = np.flatnonzero(~induced)
    keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, LENGTH)[starts[direct]]).view(f"S{LENGTH}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    cuts = np.searchsorted(first[direct], np.arange(257))
    before = np.zeros(n, dtype=bool)  # has an induced predecessor
    before[1:] = induced[:-1] & follows[:-1]
    out = []

    def hand_on(found: np.ndarray, own: int) -> np.ndarray:
        p = found[before[found]] - 1
        c = first[p]
        same = p[c == own]
        p, c = p[c != own], c[c != own]
        if len(p):
            order = np.argsort(c, kind="stable")
            p, c = p[order], c[order]
            heads = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            for s, e in zip(heads, np.append(heads[1:], len(c))):
                buckets[c[s]].append(p[s:e])
        return same

    for byte in range(256):
        wave = np.concatenate(buckets[byte]) if buckets[byte] else np.zeros(0, dtype=np.int64)
        while len(wave):
            out.append(wave)
            wave = hand_on(wave, byte)
        own = direct[cuts[byte] : cuts[byte + 1]]
        if len(own):
            out.append(own)
            hand_on(own, byte)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def adjacent_prefixes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The common prefix, LENGTH bytes at most, of each string with the one before it; 0 for the first."""
    out = np.zeros(len(starts), dtype=np.int64)
    window = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    for i in range(1, len(starts), 50_000):
        a, b = window[starts[i - 1 : i + 49_999]], window[starts[i : i + 50_000]]
        differs = a[: len(b)] != b
        out[i : i + len(b)] = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
    return out


def repeated_starts(contexts: list[bytes], docs: np.ndarray, keys: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, place in it) of all strings of these stretches that are equal to an earlier one of them: of a lesser (document, key, start)."""
    text = np.frombuffer(b"".join(contexts) + bytes(LENGTH + 1), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - LENGTH + 1, 0)
    # where the next rise, and the next change, of the bytes are
    here = np.arange(len(text) - 1)
    rise = np.minimum.accumulate(np.where(text[:-1] < text[1:], here, len(text))[::-1])[::-1]
    change = np.minimum.accumulate(np.where(text[:-1] != text[1:], here, len(text))[::-1])[::-1]
    larger = change < rise  # than the successor
    # the last string of a stretch needs successors down to the first that isn't larger than its own
    stop = np.minimum.accumulate(np.where(~larger, here, len(text))[::-1])[::-1]
    last = begins + counts - 1
    flat = rise[np.minimum(last, len(rise) - 1)] > last + LENGTH - 2  # bytes that never rise are sorted directly
    more = np.where((counts > 0) & ~flat, stop[np.maximum(last, 0)] - last, 0)
    taken = np.where(counts > 0, counts + more, 0)
    which = np.repeat(np.arange(len(contexts)), taken)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(taken) - taken, taken)
    starts = begins[which] + inside
    follows = np.zeros(len(which), dtype=bool)
    follows[:-1] = which[1:] == which[:-1]
    real = inside < counts[which]
    induced = larger[starts] & follows & ~(real & (rise[starts] > starts + LENGTH - 2))
    order = two_stage(text, starts, follows, induced)
    order = order[real[order]]
    prefix = adjacent_prefixes(text, starts[order])
    group = np.cumsum(prefix < LENGTH) - 1 if len(prefix) else prefix
    which, inside = which[order], inside[order]
    doc, key, place = docs[which], keys[which], lows[which] + inside
    by = np.lexsort((place, key, doc, group))
    group, doc, key, place, which, inside = group[by], doc[by], key[by], place[by], which[by], inside[by]
    head = np.ones(len(group), dtype=bool)
    head[1:] = group[1:] != group[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
    again = (doc != doc[lead]) | (key != key[lead]) | (place != place[lead])
    return which[again], inside[again]


def _sorted(rows: DataFrame, combine: bool = False) -> DataFrame:
    """rows(h, doc, key, lo, bytes) -> (doc, key, lo, n): neighbouring strings that are repeated among the stretches of one h.

    A task sorts about SORTED_AT_ONCE strings at a time. If the strings of one h go on, the stretches that hold a first one are sorted again with the
    next. combine: the rows of any h are sorted before they are dealt out, as they come, and only what holds a first string travels on."""

    def sort(batches, ends: bool):
        held: list[tuple] = []
        strings = 0  # beyond those held over

        def flush(last: bool):
            nonlocal held, strings
            which, inside = repeated_starts([x[4] for x in held], *(np.array([x[c] for x in held], dtype=np.int64) for c in (1, 2, 3)))
            order = np.lexsort((inside, which))
            which, inside = which[order], inside[order]
            at = np.flatnonzero(np.append(np.ones(min(1, len(which)), dtype=bool), (which[1:] != which[:-1]) | (inside[1:] != inside[:-1] + 1)))
            n = np.diff(np.append(at, len(which)))
            out = [(None, *held[w][1:3], held[w][3] + i, c, None) for w, i, c in zip(which[at].tolist(), inside[at].tolist(), n.tolist())]
            gone = np.bincount(which, minlength=len(held))
            first = [x for x, g in zip(held, gone.tolist()) if g < len(x[4]) - LENGTH + 1]
            if last and not ends:
                out += [(h, doc, key, lo, None, raw) for h, doc, key, lo, raw in first]
            held = [] if last else [x for x in first if x[0] == held[-1][0]]
            strings = 0
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, _SAID)], names=["h", "doc", "key", "lo", "n", "bytes"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc", "key", "lo", "bytes"))):
                if strings > SORTED_AT_ONCE:
                    yield flush(not ends or held[-1][0] != row[0])
                held.append(row)
                strings += len(row[4]) - LENGTH + 1
        if held:
            yield flush(True)

    schema = "h long, doc long, key long, lo int, n int, bytes binary"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = batched(rows.select("h", "doc", "key", "lo", "bytes"))
    said = None
    if combine:
        rows = cut(rows.mapInArrow(lambda batches: sort(batches, False), schema))
        said, rows = rows.where("n is not null"), rows.where("n is null").select("h", "doc", "key", "lo", "bytes")
    out = rows.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(lambda batches: sort(batches, True), schema)
    return (out if said is None else out.union(said)).select("doc", "key", "lo", "n")


_SAID = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _reaches() -> list[tuple[int, int]]:
    """Ranges of how far a string reaches to the left of its anchor: short ones at both ends, doubling inwards."""
    most = LENGTH - GRAM
    ends, k = [0], 1
    while k < most // 2:
        ends.append(k)
        k *= 2
    ends.append(most // 2 + 1)
    left = [(a, b - 1) for a, b in zip(ends, ends[1:])]
    right = [(most - b, most - a) for a, b in left]
    right[-1] = (left[-1][1] + 1, right[-1][1])
    return left + right[::-1]


def _pieces(contexts: DataFrame) -> DataFrame:
    """Stretches (h, doc, key, lo, n, at, bytes) cut up by how far strings reach left of the anchor; h is a hash of what all strings of a piece share.

    Equal strings are in pieces of one range and with one core, so they meet under one h again, but fewer others do."""
    ranges = F.array(*(F.struct(F.lit(a).alias("p"), F.lit(b).alias("q")) for a, b in _reaches()))
    least = F.col("at") - F.col("n") + 1
    inside = F.filter(ranges, lambda r: (r["p"] <= F.col("at")) & (r["q"] >= least))
    cut_up = contexts.select("doc", "key", "lo", "n", "at", "h", "bytes", F.explode(inside).alias("r"))
    p, q = F.greatest(F.col("r.p"), least), F.least(F.col("r.q"), F.col("at"))
    core = F.substring("bytes", F.col("at") - F.col("r.p") + 1, F.col("r.p") - F.col("r.q") + LENGTH)
    whole = F.substring("bytes", F.col("at") - q + 1, q - p + LENGTH)
    return cut_up.select(F.xxhash64("h", "r", core).alias("h"), "doc", "key", (F.col("lo") + F.col("at") - q).alias("lo"), (q - p + 1).alias("n"), whole.alias("bytes"))


def _strings(pieces: DataFrame) -> DataFrame:
    """Each string of the pieces by itself; h is its own hash."""
    each = pieces.select("doc", "key", "lo", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    string = F.substring("bytes", F.col("i") + 1, F.lit(LENGTH))
    return each.select(F.xxhash64(string).alias("h"), "doc", "key", (F.col("lo") + F.col("i")).alias("lo"), string.alias("bytes"))


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose h has HOT of them at most, and the rest."""
    hot = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT).select("h"))
    return rows.join(hot, "h", "left_anti"), rows.join(hot, "h", "left_semi")


def document_key(text: Column) -> Column:
    """Tells documents of one doc_id apart."""
    return F.xxhash64(text)


def repeated(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc, key, spans): for each document with repeated strings, (lo, n): n neighbouring starts of them from byte lo."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    bits = max(4, min(20, int(size / ((LENGTH - GRAM + 2) / 2) / STRETCHES_PER_BUCKET).bit_length()))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc"), document_key(F.col("text")).alias("key"), "text")
    met = cut(_met(_packed(texts, bits), bits))
    asked = met.where("h is not null").groupBy("doc", "key").agg(F.collect_list(F.struct("lo", "n", "at", "h")).alias("asked"))
    parts = texts.join(asked.hint("shuffle_hash"), ["doc", "key"]).select("doc", "key", F.col("text").cast("binary").alias("raw"), F.explode(F.array_distinct("asked")).alias("q"))
    contexts = cut(parts.select("q.h", "doc", "key", "q.lo", "q.n", "q.at", F.substring("raw", F.col("q.lo") + 1, F.col("q.n") + (LENGTH - 1)).alias("bytes")))
    found = met.where("h is null").select("doc", "key", "lo", "n")
    some, rest = _split(contexts)
    found = found.union(_sorted(some))
    if rest.head(1):  # by pieces of stretches, and where those are too many again, by strings
        some, rest = _split(cut(_pieces(rest)))
        found = found.union(_sorted(some, combine=True)).union(_sorted(_strings(rest), combine=True))
    return found.groupBy("doc", "key").agg(F.collect_set(F.struct("lo", "n")).alias("spans"))


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs(doc_id, text, ...) -> its rows with raw (binary: the bytes that stay), n_bytes, n_removed and n_spans added.

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a document of smaller doc_id, or earlier in its own.
    Strings are judged on the input. Null texts are empty. Rows of one doc_id and text are one document, and each
    returns; different texts of one doc_id are documents of their own, in the order of a hash. Rows with a null doc_id are not compared and stay whole. A string doesn't
    cross documents. Long texts are looked at in chunks; other columns stay, but for those of the names that are added; an empty table gives no rows."""
    made = ("raw", "n_bytes", "n_removed", "n_spans")
    kept = [c for c in docs.columns if c not in made]
    doc, key, own, found = unused(kept, "_doc", "_key", "_hash", "_spans")
    spans = repeated(docs.select("doc_id", F.col(text).alias("text"))).select(F.col("doc").alias(doc), F.col("key").alias(key), F.col("spans").alias(found))
    rows = docs.select(*kept, document_key(F.col(text)).alias(own))
    rows = rows.join(spans.hint("shuffle_hash"), (F.col("doc_id") == F.col(doc)) & (F.col(own) == F.col(key)), "left").select(*kept, found)
    schema = extended(docs.select(*kept), "raw binary, n_bytes long, n_removed long, n_spans long")
    where = kept.index(text)

    def run(batches):
        for batch in batches:
            for first, after, data, offsets in text_pieces(batch.column(where), PIECE_BYTES):
                whole, raws, counts = data.tobytes(), [], []
                for i, spans in enumerate(batch.column(len(kept)).slice(first, after - first).to_pylist()):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    pieces, end, k = [], a, 0
                    for lo, hi in sorted((a + s["lo"], min(b, a + s["lo"] + s["n"] + LENGTH - 1)) for s in spans or ()):
                        if lo > end or k == 0:
                            pieces.append(whole[end:lo])
                            k += 1
                        end = max(end, hi)
                    raws.append(b"".join([*pieces, whole[end:b]]))
                    counts.append(k)
                totals = np.diff(offsets)
                gone = totals - np.array([len(r) for r in raws], dtype=np.int64)
                columns = [batch.column(c).slice(first, after - first) for c in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(raws, pa.binary()), pa.array(totals), pa.array(gone), pa.array(counts, pa.int64())], names=[*kept, *made])

    return batched(rows).mapInArrow(run, schema)


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, int, str]]:
    """The digest of small inputs, a row each with doc_ids not null, by looking up every string; for tests. Texts of one doc_id must not share strings."""
    seen: dict[bytes, tuple] = {}
    raws = sorted({(d, (t or "").encode()) for d, t in rows})
    for d, raw in raws:
        for i in range(len(raw) - LENGTH + 1):
            seen.setdefault(raw[i : i + LENGTH], (d, raw, i))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - LENGTH + 1):
            if seen[raw[i : i + LENGTH]] != (d, raw, i):
                gone[i : i + LENGTH] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(raw) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def op8_suffix_dedup(spark, sf_dir):
    done = keep_first(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("raw", 256).alias("kept_sha256"))
