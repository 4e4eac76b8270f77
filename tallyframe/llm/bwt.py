"""Burrows-Wheeler transforms of string collections, and their merge by iterative interleave refinement.

A collection's suffixes (the empty one of each string too) are rows in lexicographic order, ties by the string's place;
the transform holds the byte before each suffix. A whole string has no byte before it: its row is an *end*.

``merge`` takes the transforms of many shards and never sorts a suffix. Its state is an interleave, a list of the rows of
all shards in which rows whose suffixes begin with the same h bytes lie together as one block. One refinement step
moves every row to that of the suffix one byte longer (a stable partition by the byte before it, the shard's own order
gives the place) and cuts blocks where the byte or the block it came from changes: then blocks agree in h + 1 bytes. The
step at which two neighbours part is their common prefix, so after h steps the blocks of two rows or more are exactly the
repeated strings of length h. A row alone in its block can have no repeated extension: it is settled and leaves the
interleave, with all that would come from it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Bits of a row number where three are sorted as one.
_PLACE = 21


class Shards(NamedTuple):
    """Transforms laid one after the other: bytes, which rows are ends, and for each row its shard."""

    before: np.ndarray
    end: np.ndarray
    shard: np.ndarray
    strings: np.ndarray  # number of strings of each shard


def _tied(start: np.ndarray) -> np.ndarray:
    """Which rows are in a tie of two or more, by the rows that begin one."""
    tied = ~start
    tied[:-1] |= ~start[1:]
    return tied


def _ordered(n: int, rank: np.ndarray, ahead: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``rows`` by rank, then by the rank ahead, then by themselves, and which of them begin a new pair of ranks; all are below ``n``."""
    new = np.ones(len(rows), bool)
    if n <= 1 << _PLACE:  # all three in one number
        shift = np.uint64(_PLACE)
        packed = (((rank.astype(np.uint64) << shift) | ahead.astype(np.uint64)) << shift) | rows.astype(np.uint64)
        packed.sort()
        pair = packed >> shift
        new[1:] = pair[1:] != pair[:-1]
        return new, (packed & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    by = np.lexsort((rows, ahead, rank))
    rank, ahead = rank[by], ahead[by]
    new[1:] = (rank[1:] != rank[:-1]) | (ahead[1:] != ahead[:-1])
    return new, rows[by]


def _first_ranks(data: np.ndarray, sizes: np.ndarray, inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(suffixes by their group and first symbols, which of them begin a tie, symbols compared). ``first``: rows before each group.

    The symbols, as many as fit above a row's place in its group, and that place are one number: groups are sorted one by one.
    """
    n = len(inside)
    seen = np.bincount(data, minlength=256) > 0
    symbols = np.zeros(n, np.uint64)  # 0 at the end of a string
    symbols[inside] = np.cumsum(seen).astype(np.uint64)[data]
    bits = max(1, int(seen.sum()).bit_length())
    low = np.uint64(max(1, int(np.diff(first).max(initial=1) - 1).bit_length()))
    last = np.uint64((1 << bits) - 1)

    def followed(key: np.ndarray, by: np.ndarray, at: int, some: int) -> np.ndarray:
        """``key`` of ``at`` symbols with the ``some`` symbols behind it, unless its last symbol is an end."""
        out = key << np.uint64(bits * some)
        rest = max(n - at, 0)
        out[:rest] |= by[at:] * ((key[:rest] & last) != 0)
        return out

    fit = max(1, (64 - int(low)) // bits)
    runs, size = [(1, symbols)], 1
    while 2 * size <= fit:
        runs.append((2 * size, followed(runs[-1][1], runs[-1][1], size, size)))
        size *= 2
    key, width = runs[-1][1], size
    for some, by in reversed(runs[:-1]):
        if width + some <= fit:
            key = followed(key, by, width, some)
            width += some
    del runs
    key <<= low
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        part = key[lo:hi]
        part |= np.arange(hi - lo, dtype=np.uint64)
        part.sort()
    order = (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64) + np.repeat(first[:-1], np.diff(first))
    key >>= low
    start = np.ones(n, bool)
    start[1:] = key[1:] != key[:-1]
    start[first[:-1][np.diff(first) > 0]] = True
    return order, start, width


def _suffix_order(data: np.ndarray, bounds: np.ndarray, group: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, string of each, first suffix of each string, first one of each group); suffixes are numbered as they
    lie, the empty one of each string too.

    Ranks by the first symbols, doubled for the rows that still tie; equal suffixes stay in the order of strings.
    """
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    n = len(owner)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    last = begins + sizes  # the empty suffix of each string
    inside = np.ones(n, bool)
    inside[last] = False
    groups = np.array([0, len(sizes)]) if group is None else np.searchsorted(group, np.arange(int(group[-1]) + 2 if len(group) else 1))
    first = np.append(begins, n)[groups].astype(np.int64)
    order, start, width = _first_ranks(data, sizes, inside, first)
    longest = int(sizes.max(initial=0))
    rank = np.empty(n, np.int32)  # place of the first row of the tie
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n, dtype=np.int32), 0))
    while width <= longest:  # suffixes read to their end that tie are equal, and in order
        at = np.flatnonzero(_tied(start))
        rows = order[at]
        more = last[owner[rows]] - rows >= width
        at, rows = at[more], rows[more]
        if not len(at):
            break
        # ranks ahead are of the same group: compared within it only
        start[at], rows = _ordered(n, rank[rows], rank[rows + width], rows)
        order[at] = rows
        rank[rows] = np.maximum.accumulate(np.where(start[at], at, 0))
        width *= 2
    return order, owner, begins, first


def suffix_rows(data: np.ndarray, bounds: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(string, position) of the suffixes of the strings ``data[bounds[i]:bounds[i + 1]]``, in order, by ``group`` first."""
    order, owner, begins, _ = _suffix_order(data, bounds, group)
    string = owner[order]
    return string, order - begins[string]


def transform(data: np.ndarray, bounds: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes before, ends, row bounds) of one transform per group of strings; ``group`` is ascending from 0."""
    order, _, begins, first = _suffix_order(data, bounds, group)
    whole = np.zeros(len(order), bool)
    whole[begins] = True
    before = np.zeros(len(order), np.uint8)
    before[~whole] = data  # as the suffixes lie, each but a whole string has the byte before it
    return before[order], whole[order], first


def longer(shards: Shards) -> np.ndarray:
    """For each row, the row of the suffix one byte longer (-1: the suffix is a whole string)."""
    out = np.full(len(shards.before), -1, np.int32)
    rows = np.flatnonzero(~shards.end)
    if len(shards.strings) <= 256:  # shard and byte are one number that is sorted by its digits
        by = np.argsort(shards.shard[rows].astype(np.uint16) << np.uint16(8) | shards.before[rows], kind="stable")
    else:
        by = np.argsort(shards.before[rows], kind="stable")
        of = shards.shard[rows[by]].astype(np.min_scalar_type(len(shards.strings)))
        by = by[np.argsort(of, kind="stable")]
    # In each shard the empty suffixes come first, one per string; the others by their first byte, in the given order.
    size = np.bincount(shards.shard, minlength=len(shards.strings))
    base = np.cumsum(size) - size
    longer = size - shards.strings
    out[rows[by]] = np.repeat(base + shards.strings - (np.cumsum(longer) - longer), longer) + np.arange(len(rows))
    return out


def walk(shards: Shards, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string of each row, length of each row's suffix, length of each string), by steps from the empty suffixes.

    Strings are numbered over all shards.
    """
    size = np.bincount(shards.shard, minlength=len(shards.strings))
    base = np.cumsum(size) - size
    offset = np.cumsum(shards.strings) - shards.strings
    rows = np.repeat(base, shards.strings) + np.arange(int(shards.strings.sum())) - np.repeat(offset, shards.strings)
    found = np.empty(len(shards.before), np.int64)  # string and length
    total = np.zeros(len(rows), np.int64)
    ids, h = np.arange(len(rows), dtype=np.int64) << 32, 0
    while len(rows):
        found[rows] = ids
        rows = step[rows]
        alive = rows >= 0
        if not alive.all():
            total[ids[~alive] >> 32] = h
            rows, ids = rows[alive], ids[alive]
        ids, h = ids + 1, h + 1
    return (found >> 32).astype(np.int32), found.astype(np.int32), total


def strings_of(shards: Shards, string: np.ndarray, length: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of all strings, back from the transforms and what ``walk`` found."""
    bounds = np.append(0, np.cumsum(total))
    data = np.empty(int(bounds[-1]), np.uint8)
    rows = np.flatnonzero(~shards.end)
    data[((bounds[1:] - 1)[string] - length)[rows]] = shards.before[rows]
    return data, bounds


def merge(shards: Shards, step: np.ndarray, rows: np.ndarray, block: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, block of each) whose suffixes begin with a string of ``depth`` bytes that two rows or more begin with.

    ``rows`` with their starting ``block`` (ascending) are the interleave to refine: rows of different starting blocks
    never meet. A string whose rows are left out takes no part.
    """
    small = len(step) < 1 << 23
    code = (step.astype(np.int32 if small else np.int64) << 8) | shards.before  # the next row and the byte that leads to it
    for _ in range(depth):
        ahead = code[rows]
        alive = ahead >= 0
        if not alive.all():
            ahead, block = ahead[alive], block[alive]
        by = np.argsort(ahead.astype(np.uint8), kind="stable")
        ahead, block = ahead[by], block[by]
        byte = ahead.astype(np.uint8)
        start = np.ones(len(ahead) + 1, bool)
        start[1:-1] = (block[1:] != block[:-1]) | (byte[1:] != byte[:-1])
        shared = ~(start[:-1] & start[1:])
        block = np.cumsum(start[:-1], dtype=np.int32)[shared]
        rows = ahead[shared] >> 8
        if not len(rows):
            break
    return rows, block
