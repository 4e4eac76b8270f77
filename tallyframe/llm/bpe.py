"""Byte-level BPE: ranked merges folded over the bytes of distinct words; decoding joins byte pieces.

A text is cut by the tokenizer's pattern. Each distinct word that a task meets is encoded once: its
bytes are folded by merging, again and again, the adjacent pair of lowest rank (leftmost on ties)
until no pair has a rank. The rank map is read once on the driver from the vocabulary file (a few
10,000 entries, the file is the bound) and broadcast. A worker keeps the encodings of up to
twice CACHED_WORDS words, so memory does not grow with the vocabulary of the corpus (what was not asked for since it was last full goes). Words of many bytes use a heap, so a word of n bytes costs O(n log n).

Nulls count as empty texts: no tokens. Repeated rows give repeated rows, a null doc_id is passed
through, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyframe.llm.common import map_batches
from tallyframe.llm.words import slices

#: Words of up to 64 characters kept, twice: some 250 bytes each, 100 MB at most.
CACHED_WORDS = 200_000
LONG_WORD = 40
LONG_TEXT = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def _fold_short(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best = min((r for r in pairs if r is not None), default=None)
        if best is None:
            return parts
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1])
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])


def _fold_long(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    n = len(word)
    end = list(range(1, n + 1))  # the piece at i is word[i:end[i]]; 0: merged into the one before
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def propose(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        propose(i)
        if i:
            propose(before[i])
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = end[i]
    return out


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    if word in ranks:
        return [ranks[word]]
    parts = (_fold_long if len(word) > LONG_WORD else _fold_short)(word, ranks)
    return [ranks[p] for p in parts]


class Words(dict):
    """word -> its ids as little-endian 32-bit integers, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.old = ranks, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(fold(word.encode(), self.ranks), "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def encode(text: str, pattern: regex.Pattern, words: Words) -> bytes:
    if len(text) <= LONG_TEXT:
        return b"".join(map(words.__getitem__, pattern.findall(text)))
    return b"".join(words[m.group()] for m in pattern.finditer(text))


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False, with_decoded: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids: one row per document row.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``; ``with_ids`` adds ``ids`` (binary, little-endian 32-bit
    integers), ``with_decoded`` adds ``decoded`` (binary).
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    fields = [
        ("doc_id", docs.schema["doc_id"].dataType),
        ("n_tokens", T.LongType()),
        ("ids_sha256", T.StringType()),
        ("decoded_sha256", T.StringType()),
        *([("ids", T.BinaryType())] if with_ids else []),
        *([("decoded", T.BinaryType())] if with_decoded else []),
    ]

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        words, pieces = worker_words(ranks)
        cut, piece = regex.compile(pattern), pieces.__getitem__
        for part in slices(batch, "text", 1 << 20):
            ids = [encode(t or "", cut, words) for t in part.column("text").to_pylist()]
            decoded = [b"".join(map(piece, np.frombuffer(x, "<u4").tolist())) for x in ids]
            yield [
                part.column("doc_id"),
                [len(x) // 4 for x in ids],
                [hashlib.sha256(x).hexdigest() for x in ids],
                [hashlib.sha256(x).hexdigest() for x in decoded],
                *([ids] if with_ids else []),
                *([decoded] if with_decoded else []),
            ]

    return map_batches(docs.select("doc_id", "text"), run, fields)


_worker: dict[int, tuple[Words, dict[int, bytes]]] = {}


def worker_words(ranks) -> tuple[Words, dict[int, bytes]]:
    """The worker's word encodings and rank -> piece for a broadcast rank map: one task's words serve the next."""
    if id(ranks.value) not in _worker:
        _worker.clear()
        _worker[id(ranks.value)] = Words(ranks.value), {rank: piece for piece, rank in ranks.value.items()}
    return _worker[id(ranks.value)]
