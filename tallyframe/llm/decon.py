"""Benchmark decontamination: MinHash containment search with sketches sized by item size.

An item of n shingles counts as leaked into a document that holds at least ``threshold`` percent of
them, so a leak misses at most m = n - ceil(threshold * n / 100). Items are partitioned by size
(powers of two); the sketch of an item is its m + 1 smallest shingle hashes for the largest n of its
partition (MinHash in its bottom-k form). A leak must hold one of them, so looking up the shingles of a
document among the sketch values finds every candidate, however short the item and long the document;
no leak is missed. The share of the sketch that is found estimates the containment; the exact
containment over all shingles of the item decides.

The items are the stated query side: they are taken in blocks of about ``block`` shingles, each block
is broadcast (that is the size bound) and held against all documents in one pass without a shuffle. One block is alive
at a time: of several, each one's result is written before the next is made.

Texts are lower-cased (A-Z) and split at white space. An item of fewer than k words is one shingle of its own length, and
is looked up among all runs of that many words of a document; a document of fewer words than an item can't hold it.
Null and empty items and documents match nothing. Repeated document rows give repeated rows; repeated
items (same id and same shingles) count once; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import map_batches, ship
from tallyframe.llm.words import shingle_sets, slices, text_buffers, windows, words
from tallyframe.session import cut_lineage

FILTER_BITS = 22


def item_sets(items: DataFrame, k: int) -> DataFrame:
    """(item_id, n, width, shingles) of the items that have words; ``width``: words of a shingle, k or all of fewer."""
    fields = [("item_id", items.schema["item_id"].dataType), ("n", T.LongType()), ("width", T.LongType()), ("shingles", T.ArrayType(T.LongType()))]

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        sets = [s.view(np.int64) for s in shingle_sets(batch.column("text"), k)]
        raw, offsets = text_buffers(batch.column("text"))
        width = np.minimum(k, np.diff(np.searchsorted(words(raw, offsets, fold=True)[0], offsets)))
        yield [batch.column("item_id"), [len(s) for s in sets], width, [s.tolist() for s in sets]]

    return map_batches(items.select("item_id", "text"), run, fields).filter("n > 0").distinct()


class Block:
    """One block of items, ready to be looked up: sketch values, their items, and all their shingles."""

    def __init__(self, ids: list, sets: list[np.ndarray], widths: list[int], threshold: int, k: int) -> None:
        self.ids, self.sets = ids, sets
        # items of fewer than k words: width -> shingle -> items
        self.short: dict[int, dict[int, list[int]]] = {}
        for item, (s, w) in enumerate(zip(sets, widths, strict=True)):
            if w < k:
                self.short.setdefault(w, {}).setdefault(int(s[0]), []).append(item)
        sizes = np.array([len(s) for s in sets])
        part = np.frexp(sizes.astype(float))[1]
        largest = {p: int(sizes[part == p].max()) for p in set(part.tolist())}
        self.sketch = []
        for s, p in zip(sets, part.tolist(), strict=True):
            n = largest[p]
            self.sketch.append(s[: n - (-(-threshold * n // 100)) + 1])  # sets are sorted by hash
        for item in (i for found in self.short.values() for group in found.values() for i in group):
            self.sketch[item] = self.sketch[item][:0]
        values = np.concatenate(self.sketch)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in self.sketch])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[values >> np.uint64(64 - FILTER_BITS)] = True

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of ``hashes`` that are a sketch value."""
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        at = np.searchsorted(self.values, hashes[maybe])
        at[at == len(self.values)] = 0
        return maybe[self.values[at] == hashes[maybe]]

    def owners(self, hashes: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(self.values, hashes, "left")
        hi = np.searchsorted(self.values, hashes, "right")
        return np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo, hi, strict=True)]))


def held_items(texts: pa.Array, block: Block, k: int, threshold: int) -> Iterator[tuple[int, int, int, float]]:
    """(text, item, shared shingles, share of the sketch found) for every text that holds an item of the block."""
    raw, offsets = text_buffers(texts)
    starts, _, hashes = words(raw, offsets, fold=True)
    bounds = np.searchsorted(starts, offsets)
    grams = windows(hashes, k)
    row = np.searchsorted(bounds, np.arange(len(grams)), "right") - 1
    whole = np.arange(len(grams)) + k <= bounds[row + 1] if len(grams) else np.zeros(0, bool)
    grams, row = grams[whole], row[whole]
    for width, known in block.short.items():
        runs = windows(hashes, width)
        values = np.fromiter(known, np.uint64, len(known))
        at = np.flatnonzero(np.isin(runs, values))
        own = np.searchsorted(bounds, at, "right") - 1
        met = {(i, int(h)) for i, h, inside in zip(own.tolist(), runs[at].tolist(), (at + width <= bounds[own + 1]).tolist(), strict=True) if inside}
        for i, h in sorted(met):
            for item in known[h]:
                yield i, item, 1, 1.0
    if not len(block.values):
        return
    for i in np.unique(row[block.candidates(grams)]).tolist():
        own = np.unique(grams[slice(*np.searchsorted(row, [i, i + 1]))])
        found = own[block.candidates(own)]
        for item in block.owners(found).tolist():
            want, sketch = block.sets[item], block.sketch[item]
            shared = int(np.isin(want, own, assume_unique=True).sum())
            if 100 * shared >= threshold * len(want):
                yield i, item, shared, float(np.isin(sketch, found, assume_unique=True).mean())


def blocks_of(items: DataFrame, k: int, threshold: int, block: int) -> Iterator[Block]:
    """The items in blocks of about ``block`` shingles, one at a time on the driver."""
    sets = cut_lineage(item_sets(items, k), "items")
    blocks = max(1, -(-int(sets.agg(F.sum("n")).first()[0] or 0) // block))
    for b in range(blocks):
        rows = sets.filter(F.pmod(F.xxhash64("shingles"), F.lit(blocks)) == b).collect()
        if rows:
            sets_ = [np.array(r.shingles, np.int64).view(np.uint64) for r in rows]
            yield Block([r.item_id for r in rows], sets_, [r.width for r in rows], threshold, k)


def find_leaks(docs: DataFrame, items: DataFrame, k: int = 5, threshold: int = 80, block: int = 1 << 20) -> DataFrame:
    """Rows (doc_id, item_id, n_item, n_shared, sketch_share): each document that holds an item, with the item."""
    spark = docs.sparkSession
    fields = [
        ("doc_id", docs.schema["doc_id"].dataType),
        ("item_id", items.schema["item_id"].dataType),
        ("n_item", T.LongType()),
        ("n_shared", T.LongType()),
        ("sketch_share", T.DoubleType()),
    ]

    def held(shared) -> DataFrame:
        def run(batch: pa.RecordBatch) -> Iterator[list]:
            items_ = shared.value
            for part in slices(batch, "text"):
                found = list(held_items(part.column("text"), items_, k, threshold))
                at = [f[1] for f in found]
                yield [
                    part.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())),
                    [items_.ids[i] for i in at],
                    [len(items_.sets[i]) for i in at],
                    [f[2] for f in found],
                    [f[3] for f in found],
                ]

        return map_batches(docs.select("doc_id", "text"), run, fields)

    parts, waiting = [], None
    for b in blocks_of(items, k, threshold, block):
        if waiting:  # there are several: the one before is finished first
            parts.append(cut_lineage(held(waiting), "leaks"))
            waiting.destroy()
        waiting = spark.sparkContext.broadcast(b)
    if waiting:
        parts.append(held(waiting))
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField(*f) for f in fields]))
    return functools.reduce(DataFrame.union, parts)


def drop_leaks(docs: DataFrame, items: DataFrame, k: int = 5, threshold: int = 80, block: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns; no shuffle. Of several blocks, what each leaves is written."""
    spark = ship(docs.sparkSession)
    waiting = None
    for b in blocks_of(items, k, threshold, block):
        if waiting:
            docs = cut_lineage(docs.filter(_clean(waiting, k, threshold)(F.col("text"))), "clean")
            waiting.destroy()
        waiting = spark.sparkContext.broadcast(b)
    return docs.filter(_clean(waiting, k, threshold)(F.col("text"))) if waiting else docs


def _clean(shared, k: int, threshold: int):
    @F.arrow_udf(T.BooleanType())
    def clean(texts: pa.Array) -> pa.Array:
        out = np.ones(len(texts), bool)
        batch, start = pa.RecordBatch.from_arrays([texts], ["text"]), 0
        for part in slices(batch, "text"):
            for i, *_ in held_items(part.column("text"), shared.value, k, threshold):
                out[start + i] = False
            start += part.num_rows
        return pa.array(out)

    return clean
