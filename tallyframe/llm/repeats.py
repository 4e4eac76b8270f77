"""Bytes covered by strings of ``least`` bytes that a document of smaller id holds too, found by merging shard transforms.

Texts are UTF-8 bytes; a match lies within one document. A byte goes if a string of ``least`` bytes over it also starts
in a document with a smaller doc_id (judged on the input; overlaps count).

1. Documents are packed into *shards* of about SHARD bytes, one row each, written once.
2. Every window of ``least`` bytes is dealt to the 16-byte string of smallest hash inside it, its *anchor*. Equal windows
   have equal anchors, so windows whose anchor occurs in one document only are settled. Shards send their distinct anchors
   to tasks by ranges of the hash and get back a bit for each: whether another document has it.
3. For the rest, windows that follow each other under one anchor form a *piece* of at most 2 * least bytes. A shard
   builds the Burrows-Wheeler transform of its distinct pieces, one per hash range, with the smallest doc_id and the key (32
   bits of the anchor's hash) of each piece. Pieces are laid out a few ranges at a time.
4. A task merges the transforms of all shards for a range by interleave refinement (``bwt.merge``): after ``least`` steps the
   blocks are the repeated strings of ``least`` bytes, whose first document is a minimum over the block. Pieces that several
   shards hold, byte for byte, enter once (their rows are found by steps in the transform and left out of the interleave), and
   only where another piece has their key: equal windows have equal anchors, so others can't meet. Each shard gets
   back one bit per window: whether a smaller document than its own first one has it.
5. Shards turn windows into bytes, and give each document's spans and what is left.

Hot anchors: one with more than HOT occurrences is not a range's load. Its windows become pieces of their own, dealt by the
hash of the whole window: equal ones are one row per shard, different ones go to different tasks. No pair of documents is
ever made, nothing is collected, and results are exact: hashes only choose tasks and candidates, bytes decide.

doc_id is an integer; a null doc_id comes before all others (rows without one count as one document, as do rows of equal
doc_id: they take nothing from each other). A null text counts as empty; repeated rows give repeated rows; an empty table
gives an empty table; other columns are ignored. A text longer than SHARD is a shard of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import bwt
from tallyframe.llm.common import release, ship
from tallyframe.llm.words import mix, text_buffers
from tallyframe.session import cut_lineage

SHARD = 12 << 20
GRAM = 16
SEGMENT = 1 << 15
#: Bytes of pieces laid out at a time, of all occurrences of a part (one range at least), anchors of a range, piece bytes of a range, ranges of a task.
LAYOUT, PART = 1 << 18, 1 << 20
RANGE_ANCHORS, RANGE_BYTES, RANGES = 1 << 20, 1 << 19, 8
HOT = 20_000
NO_ID = -(1 << 63)

_PLACE = np.uint64((1 << 20) - 1)


# Shards


def shards(docs: DataFrame) -> DataFrame:
    """One row per shard: shard, ids and sizes of its texts, and their bytes (compressed), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        parts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(parts))
            columns = [[uuid.uuid4().hex], [ids], [[len(p) for p in parts]], [data]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                part = b"" if text.as_buffer() is None else text.as_buffer().to_pybytes()
                if parts and size + len(part) > SHARD:
                    yield row()
                    ids, parts, size = [], [], 0
                ids.append(doc_id)
                parts.append(part)
                size += len(part)
        if parts:
            yield row()

    schema = pa.schema([("shard", pa.string()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_lineage(rows.mapInArrow(run, "shard string, ids array<bigint>, sizes array<bigint>, data binary"), "repeat-shards")


def _open(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, ids) of a shard row."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("data")[i].as_py()), np.uint8)
    sizes = batch.column("sizes")[i].values.to_numpy()
    ids = batch.column("ids")[i].values.fill_null(NO_ID).to_numpy()
    return raw, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), ids


# Anchors


def anchors(raw: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash of the anchor, text) of each run of windows under one anchor."""
    n, width = len(raw) - least + 1, least - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts, keys, before = [], [], -1
    text_starts = offsets[:-1][np.diff(offsets) >= least]
    for a in range(0, n, SEGMENT):
        b = min(a + SEGMENT, n)
        x = raw[a : b + least - 1].astype(np.uint64)
        for j in (1, 2, 4):  # eight bytes from each place on
            x = x[:-j] | (x[j:] << np.uint64(8 * j))
        tail = x[8:] * np.uint64(0xD6E8FEB86659FD93)
        h = mix(x[:-8] * np.uint64(0x9E3779B97F4A7C15) + (tail ^ (tail >> np.uint64(32))))
        least_of = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach * 2 <= width:
            least_of = np.minimum(least_of[:-reach], least_of[reach:])
            reach *= 2
        if reach < width:
            least_of = np.minimum(least_of[: reach - width], least_of[width - reach :])
        place = (least_of & _PLACE).astype(np.int64)
        new = np.empty(b - a, bool)
        new[0] = place[0] + a != before
        new[1:] = place[1:] != place[:-1]
        lo, hi = np.searchsorted(text_starts, [a, b])
        new[text_starts[lo:hi] - a] = True
        at = np.flatnonzero(new)
        starts.append(at + a)
        keys.append(mix(~h[place[at]]))  # hashed again: the smallest hashes crowd together, ranges of them would not be even
        before = int(place[-1]) + a
    start, key = np.concatenate(starts), np.concatenate(keys)
    text = np.searchsorted(offsets, start, side="right") - 1
    count = np.minimum(np.append(start[1:], n), offsets[text + 1] - least + 1) - start
    kept = count > 0
    return start[kept], count[kept], key[kept], text[kept]


def _range(key: np.ndarray, ranges: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _distinct_anchors(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, least: int) -> tuple:
    """(anchors in order, occurrences, whether two documents of the shard have it)."""
    _, _, key, text = anchors(raw, offsets, least)
    by = np.argsort(key, kind="stable")
    key, doc = key[by], ids[text[by]]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    if not len(at):
        return key, at, np.zeros(0, bool)
    return key[at], np.diff(np.append(at, len(key))), np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)


def _send_anchors(least: int, ranges: int):
    schema = pa.schema([("shard", pa.string()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("several", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, count, several = _distinct_anchors(*_open(batch, i), least)
                cut = np.searchsorted(_range(key, ranges), np.arange(ranges + 1))
                count = np.minimum(count, 65535).astype(np.uint16)
                rows = [
                    (batch.column("shard")[i].as_py(), b, key[lo:hi].tobytes(), count[lo:hi].tobytes(), np.packbits(several[lo:hi]).tobytes())
                    for b, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
                    if hi > lo
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _share_anchors(hot: int):
    schema = pa.schema([("shard", pa.string()), ("bucket", pa.int32()), ("shared", pa.binary()), ("hot", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not rows:
            return
        keys = [np.frombuffer(r[2], np.uint64) for r in rows]
        sizes = np.array([len(k) for k in keys])
        key = np.concatenate(keys)
        count = np.concatenate([np.frombuffer(r[3], np.uint16) for r in rows]).astype(np.int64)
        several = np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8))[:n] for r, n in zip(rows, sizes.tolist(), strict=True)])
        by = np.argsort(key, kind="stable")
        start = np.append(True, key[by][1:] != key[by][:-1])
        at = np.flatnonzero(start)
        group = np.cumsum(start) - 1
        shared = (np.diff(np.append(at, len(key))) > 1) | (np.maximum.reduceat(several[by], at) > 0)
        often = shared & (np.add.reduceat(count[by], at) > hot)
        of = np.empty(len(key), np.int64)
        of[by] = group
        cut = np.append(0, np.cumsum(sizes))
        out = []
        for r, lo, hi in zip(rows, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            s, o = shared[of[lo:hi]], often[of[lo:hi]]
            out.append((r[0], r[1], np.packbits(s).tobytes(), np.packbits(o).tobytes(), int(count[lo:hi][s].sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


# Pieces


def window_hashes(raw: np.ndarray, window: np.ndarray, least: int) -> np.ndarray:
    """Hash of the ``least`` bytes from each window's start on."""
    out = np.empty(len(window), np.uint64)
    if len(window):
        words = np.ndarray(len(raw) - 7, np.uint64, np.ascontiguousarray(raw), strides=(1,))  # eight bytes from each place on
    for a in range(0, len(window), SEGMENT):
        at = window[a : a + SEGMENT].astype(np.int64)
        h = np.full(len(at), least, np.uint64)
        for j in [*range(0, least - 8, 8), least - 8]:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + words[at + j]
        out[a : a + SEGMENT] = mix(h)
    return out


def _unpack(blocks: list[bytes], sizes: list[int]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(blocks, sizes, strict=True)]
    return np.concatenate(parts).view(bool) if parts else np.zeros(0, bool)


class Part(NamedTuple):
    """Whole ranges of a shard's pieces: occurrences (start, windows, piece, id) and the distinct pieces by range
    (bytes, range, key, windows, smallest id)."""

    start: np.ndarray
    windows: np.ndarray
    piece: np.ndarray
    ids: np.ndarray
    values: pa.Array
    bucket: np.ndarray
    key: np.ndarray
    counts: np.ndarray
    first: np.ndarray


class Pieces:
    """The pieces of a shard whose anchors other documents have, in order of their keys and so of their ranges. Bytes are
    laid out for a part of the ranges at a time (``parts``), however often a shard holds a piece."""

    def __init__(self, shard: tuple, least: int, shared: list, anchor_ranges: int, ranges: int):
        self.raw, offsets, self.ids = shard
        self.least = least
        start, count, key, text = anchors(self.raw, offsets, least)
        by = np.argsort(key)
        new = np.append(True, key[by][1:] != key[by][:-1])[: len(key)]
        known, of = key[by][new], np.cumsum(new) - 1  # the distinct anchors in order, and which of them each in order is
        cut = np.diff(np.searchsorted(_range(known, anchor_ranges), np.arange(anchor_ranges + 1)))
        blocks = sorted(shared, key=lambda r: r["bucket"])
        sizes = [int(cut[r["bucket"]]) for r in blocks]
        chosen = _unpack([r["shared"] for r in blocks], sizes)[of] if len(known) else np.zeros(0, bool)
        often = _unpack([r["hot"] for r in blocks], sizes)[of] if len(known) else chosen
        single, plain = np.sort(by[often]), by[chosen & ~often]
        del by, new, known, of, chosen, often
        place = np.int32 if len(self.raw) < 1 << 31 else np.int64
        inner = np.arange(int(count[single].sum()), dtype=place) - np.repeat((np.cumsum(count[single]) - count[single]).astype(place), count[single])
        window = np.repeat(start[single].astype(place), count[single]) + inner
        self.key = np.concatenate([key[plain], window_hashes(self.raw, window, least)])
        self.start = np.concatenate([start[plain].astype(place), window])
        self.windows = np.concatenate([count[plain], np.ones(len(window), np.int32)], dtype=np.int32)
        self.text = np.concatenate([text[plain], np.repeat(text[single].astype(np.int32), count[single])], dtype=np.int32)
        if len(window):
            by = np.argsort(self.key)
            self.key, self.start, self.windows, self.text = self.key[by], self.start[by], self.windows[by], self.text[by]
        least_key = -(-(np.arange(ranges, dtype=np.int64) << 32) // ranges)
        self.cut = np.append(np.searchsorted(self.key, least_key.astype(np.uint64) << np.uint64(32)), len(self.key))

    def parts(self) -> Iterator[Part]:
        total = np.append(0, np.cumsum(self.windows, dtype=np.int64)) + np.arange(len(self.windows) + 1) * (self.least - 1)
        size, r = total[self.cut], 0
        while r + 1 < len(self.cut):
            until = max(r + 1, int(np.searchsorted(size, size[r] + PART, side="right")) - 1)
            lo, hi = int(self.cut[r]), int(self.cut[until])
            if lo < hi:
                yield self._part(lo, hi, total, np.repeat(np.arange(r, until), np.diff(self.cut[r : until + 1])))
            r = until

    def _part(self, lo: int, hi: int, total: np.ndarray, bucket: np.ndarray) -> Part:
        found, owner, known, a = [], [], 0, lo
        while a < hi:  # laid out in runs, so that a text of one repeated byte stays small
            b = min(hi, max(a + 1, int(np.searchsorted(total, total[a] + LAYOUT, side="right")) - 1))
            sizes = self.windows[a:b] + (self.least - 1)
            at = np.repeat(self.start[a:b] - (total[a:b] - total[a]), sizes) + np.arange(int(total[b] - total[a]))
            bounds = (total[a : b + 1] - total[a]).astype(np.int32)
            coded = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds), pa.py_buffer(self.raw[at])]).dictionary_encode()
            owner.append(coded.indices.to_numpy() + np.int32(known))
            found.append(coded.dictionary)
            known += len(coded.dictionary)
            a = b
        if len(found) > 1:
            coded = pa.concat_arrays(found).dictionary_encode()
            piece = coded.indices.to_numpy()[np.concatenate(owner)]
        else:
            piece = owner[0]
        # Pieces are numbered as they come, so by key: equal ones have one key.
        values, ids, windows = coded.dictionary, self.ids[self.text[lo:hi]], self.windows[lo:hi]
        n = len(values)
        first, counts, of, key = np.full(n, np.iinfo(np.int64).max), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.uint32)
        np.minimum.at(first, piece, ids)
        counts[piece], of[piece], key[piece] = windows, bucket, self.key[lo:hi].astype(np.uint32)
        return Part(self.start[lo:hi], windows, piece, ids, values, of, key, counts, first)


def _send_transforms(least: int, anchor_ranges: int, ranges: int):
    schema = pa.schema([("shard", pa.string()), ("bucket", pa.int32()), ("rows", pa.int32()), ("strings", pa.int32()), ("data", pa.binary())])
    squeeze = zstandard.ZstdCompressor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for p in Pieces(_open(batch, i), least, batch.column("anchors")[i].as_py() or [], anchor_ranges, ranges).parts():
                    size = p.counts + least - 1
                    total, lo = np.append(0, np.cumsum(size)), 0
                    while lo < len(size):  # whole ranges, in runs of about LAYOUT bytes
                        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + LAYOUT, side="right")) - 1)
                        hi = int(np.searchsorted(p.bucket, p.bucket[hi - 1], side="right"))
                        yield from rows(batch.column("shard")[i].as_py(), p, lo, hi)
                        lo = hi
        release()

    def rows(shard: str, p: Part, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        values = p.values.slice(lo, hi - lo)
        data, bounds = text_buffers(values.cast(pa.large_binary()).view(pa.large_string()))
        numbers, group = np.unique(p.bucket[lo:hi], return_inverse=True)
        before, end, cut = bwt.transform(data, bounds, group)
        strings = np.searchsorted(group, np.arange(len(numbers) + 1))
        pack = squeeze(level=3).compress
        out = []
        for g, bucket in enumerate(numbers.tolist()):
            a, b, s, e = int(cut[g]), int(cut[g + 1]), lo + int(strings[g]), lo + int(strings[g + 1])
            parts = (before[a:b], np.packbits(end[a:b]), p.first[s:e], p.key[s:e])
            out.append((shard, bucket, b - a, e - s, pack(b"".join(x.tobytes() for x in parts))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _meeting(key: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """For each string the number of its key if it is among ``pieces`` (different ones) and so is another of that key; else -1."""
    _, of, count = np.unique(key[pieces], return_inverse=True, return_counts=True)
    out = np.full(len(key), -1, np.int32)
    out[pieces] = np.where(count[of] > 1, of, -1)
    return out


def merge_range(rows: list[tuple], least: int) -> list[np.ndarray]:
    """For each shard's row (bytes before, ends, ids, keys) of one range: a bit per window of its pieces, whether a
    document of smaller id than the piece's own first one has the window."""
    before = [np.frombuffer(r[0], np.uint8) for r in rows]
    sizes = np.array([len(x) for x in before])
    end = _unpack([r[1] for r in rows], sizes.tolist())
    ids = [np.frombuffer(r[2], np.int64) for r in rows]
    strings = np.array([len(x) for x in ids])
    own = np.concatenate(ids)
    all_shards = bwt.Shards(np.concatenate(before), end, np.repeat(np.arange(len(rows), dtype=np.int32), sizes), strings)
    step = bwt.longer(all_shards)
    string, length, total = bwt.walk(all_shards, step)
    # Equal pieces of several shards: the first stands for all, with the smallest id.
    data, bounds = bwt.strings_of(all_shards, string, length, total)
    values = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    value = values.dictionary_encode().indices.to_numpy()
    by = np.argsort(value, kind="stable")
    at = np.flatnonzero(np.append(True, value[by][1:] != value[by][:-1]))
    del data, values
    stands = np.empty(len(own), np.int64)
    stands[by] = np.repeat(by[at], np.diff(np.append(at, len(by))))
    smallest = np.empty(len(own), np.int64)
    smallest[by[at]] = np.minimum.reduceat(own[by], at)
    windows = total - least + 1
    offset = np.cumsum(windows) - windows
    first = np.repeat(smallest[stands], windows)
    # Pieces meet under one key only; one that no other piece shares its key with stays out.
    block = _meeting(np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows]), by[at])
    # A window is reached from the suffix that follows it: rows with too few bytes before them can't become one.
    entering = np.flatnonzero(length <= np.where(block >= 0, total - least, -1).astype(np.int32)[string]).astype(np.int32)
    block = block[string[entering]]
    order = np.argsort(block, kind="stable")
    found, block = bwt.merge(all_shards, step, entering[order], block[order], least)
    if len(found):
        start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        least_id = np.minimum.reduceat(smallest[string[found]], start)
        place = offset[string[found]] + total[string[found]] - length[found]
        first[place] = np.repeat(least_id, np.diff(np.append(start, len(found))))
    inner = np.arange(int(windows.sum())) - np.repeat(offset, windows)
    earlier = first[np.repeat(offset[stands], windows) + inner] < np.repeat(own, windows)
    cut = np.append(offset, windows.sum())[np.append(0, np.cumsum(strings))]
    return [earlier[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _merge_transforms(least: int):
    schema = pa.schema([("shard", pa.string()), ("bucket", pa.int32()), ("earlier", pa.binary())])

    def expand(rows: int, strings: int, data: bytes) -> tuple:
        """(bytes before, ends, ids, keys)"""
        block, bits = memoryview(zstandard.ZstdDecompressor().decompress(data)), rows + -(-rows // 8)
        return block[:rows], block[rows:bits], block[bits : bits + 8 * strings], block[bits + 8 * strings :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(r[1], []).append(r)
        for bucket in sorted(held):
            rows = held.pop(bucket)
            bits = merge_range([expand(*r[2:]) for r in rows], least)
            columns = [[r[0] for r in rows], [bucket] * len(rows), [np.packbits(b).tobytes() for b in bits]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
        release()

    return run


# Documents


def _cut_documents(least: int, anchor_ranges: int, ranges: int):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _open(batch, i)
                p = Pieces(shard, least, batch.column("anchors")[i].as_py() or [], anchor_ranges, ranges)
                gone = repeated(p, batch.column("repeats")[i].as_py() or [])
                yield documents(shard, gone, batch.column("ids")[i].values)
        release()

    def repeated(p: Pieces, repeats: list) -> np.ndarray:
        """Whether the string of ``least`` bytes from each byte on goes."""
        told = {r["bucket"]: r["earlier"] for r in repeats}
        gone = np.zeros(len(p.raw), bool)
        for x in p.parts():
            at = np.cumsum(x.counts) - x.counts  # first bit of each distinct piece
            new = np.flatnonzero(np.append(True, x.bucket[1:] != x.bucket[:-1]))
            earlier = _unpack([told[b] for b in x.bucket[new].tolist()], np.add.reduceat(x.counts, new).tolist())
            for a in range(0, len(x.start), SEGMENT // 4):
                start, windows, piece, ids = (c[a : a + SEGMENT // 4] for c in x[:4])
                inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
                hit = earlier[np.repeat(at[piece], windows) + inner] | np.repeat(ids > x.first[piece], windows)
                gone[(np.repeat(start, windows) + inner)[hit]] = True
        return gone

    def documents(shard: tuple, covered: np.ndarray, doc_ids: pa.Array) -> pa.RecordBatch:
        raw, offsets, _ = shard
        reach = 1
        while reach < least:  # each string that goes covers its bytes
            by = min(reach, least - reach)
            covered[by:] |= covered[:-by]
            reach += by
        edge = np.zeros(len(raw) + 1, bool)
        if len(raw):
            edge[0], edge[1:-1] = covered[0], covered[1:] & ~covered[:-1]
            inside = offsets[(offsets > 0) & (offsets < len(raw))]
            edge[inside] = covered[inside]
        begins = np.flatnonzero(edge)
        stop = np.zeros(len(raw) + 1, bool)
        stop[1:] = covered
        stop[1:-1] &= ~covered[1:] | edge[1:-1]
        ends = np.flatnonzero(stop)
        text = np.searchsorted(offsets, begins, side="right") - 1
        spans = pa.StructArray.from_arrays([pa.array(begins - offsets[text]), pa.array(ends - offsets[text])], fields=list(span))
        at = np.searchsorted(text, np.arange(len(offsets)))  # first span of each text
        total = np.append(0, np.cumsum(ends - begins))[at]
        kept_bounds = (offsets - total).astype(np.int32)
        kept = pa.BinaryArray.from_buffers(pa.binary(), len(doc_ids), [None, pa.py_buffer(kept_bounds), pa.py_buffer(raw[~covered])])
        listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), spans)
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(np.diff(offsets)), pa.array(np.diff(total)), listed.cast(pa.list_(span)), kept], schema=schema)

    return run


def remove_repeats(docs: DataFrame, least: int = 50, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs of bytes: start, end) and kept (the bytes left) per row."""
    if least < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes")
    ship(docs.sparkSession)
    made = shards(docs)
    volume = made.selectExpr("count(*) AS n", "coalesce(sum(aggregate(sizes, 0L, (a, x) -> a + x)), 0) AS bytes").first()
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-volume.n // RANGES))
    anchor_ranges = max(RANGES, RANGES * volume.bytes // (max(1, (least - GRAM) // 2) * RANGE_ANCHORS))
    sent = made.mapInArrow(_send_anchors(least, anchor_ranges), "shard string, bucket int, keys binary, counts binary, several binary")
    shared = sent.repartition(-(-anchor_ranges // RANGES), "bucket").mapInArrow(_share_anchors(hot), "shard string, bucket int, shared binary, hot binary, n bigint")
    shared = cut_lineage(shared, "repeat-anchors")
    pieces = shared.selectExpr("coalesce(sum(n), 0) AS n").first().n
    ranges = max(RANGES, pieces * least * 3 // 2 // RANGE_BYTES)
    by_shard = made.repartition(tasks, "shard")
    anchor_bits = shared.groupBy("shard").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("anchors")).hint("shuffle_hash")
    told = by_shard.join(anchor_bits, "shard", "left")
    sent = told.mapInArrow(_send_transforms(least, anchor_ranges, ranges), "shard string, bucket int, rows int, strings int, data binary")
    merged = sent.repartition(-(-ranges // RANGES), "bucket").mapInArrow(_merge_transforms(least), "shard string, bucket int, earlier binary")
    window_bits = merged.groupBy("shard").agg(F.collect_list(F.struct("bucket", "earlier")).alias("repeats")).hint("shuffle_hash")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return told.join(window_bits, "shard", "left").mapInArrow(_cut_documents(least, anchor_ranges, ranges), schema)
