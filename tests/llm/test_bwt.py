import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import bwt

collections = st.lists(st.lists(st.binary(max_size=12) | st.text("ab", max_size=30).map(str.encode) | st.just(b"\x00\x00"), min_size=1, max_size=6), min_size=1, max_size=4)


def laid(strings):
    bounds = np.append(0, np.cumsum([len(s) for s in strings])).astype(np.int64)
    return np.frombuffer(b"".join(strings), np.uint8), bounds


def shards_of(lists):
    made = []
    for strings in lists:
        before, end, cut = bwt.transform(*laid(strings), np.zeros(len(strings), np.int64))
        assert cut.tolist() == [0, len(before)]
        made.append((before, end))
    sizes = [len(b) for b, _ in made]
    shard = np.repeat(np.arange(len(lists), dtype=np.int32), sizes)
    return bwt.Shards(np.concatenate([b for b, _ in made]), np.concatenate([e for _, e in made]), shard, np.array([len(s) for s in lists]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=12) | st.text("ab", max_size=40).map(str.encode), min_size=1, max_size=8))
def test_suffix_order(strings):
    string, place = bwt.suffix_rows(*laid(strings))
    want = sorted((s[j:], i, j) for i, s in enumerate(strings) for j in range(len(s) + 1))
    assert list(zip(string.tolist(), place.tolist(), strict=True)) == [(i, j) for _, i, j in want]


@settings(max_examples=150, deadline=None)
@given(collections, st.integers(1, 6))
def test_merge_finds_the_repeated_strings(lists, depth):
    shards = shards_of(lists)
    step = bwt.longer(shards)
    string, length, total = bwt.walk(shards, step)
    flat = [s for strings in lists for s in strings]
    assert total.tolist() == [len(s) for s in flat]
    rows, block = bwt.merge(shards, step, np.arange(len(shards.before), dtype=np.int32), np.zeros(len(shards.before), np.int64), depth)
    got = {}
    for r, b in zip(rows.tolist(), block.tolist(), strict=True):
        got.setdefault(b, set()).add((int(string[r]), int(total[string[r]] - length[r])))
    want = {}
    for i, s in enumerate(flat):
        for j in range(len(s) - depth + 1):
            want.setdefault(s[j : j + depth], set()).add((i, j))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_starting_blocks_never_meet():
    shards = shards_of([[b"banana"], [b"banana"]])
    rows = np.arange(len(shards.before), dtype=np.int32)
    step = bwt.longer(shards)
    found, _ = bwt.merge(shards, step, rows, np.repeat([0, 1], 7), 4)
    assert not len(found)
    found, block = bwt.merge(shards, step, rows, np.zeros(14, np.int64), 4)
    assert len(found) == 6 and len(set(block.tolist())) == 3


def test_suffix_order_of_many_rows(monkeypatch):
    """Where three row numbers do not fit one, the order is the same."""
    rng = np.random.default_rng(3)
    strings = [rng.integers(97, 99, int(n)).astype(np.uint8).tobytes() for n in rng.integers(0, 90, 60)] + [b"ab" * 30] * 4
    packed = bwt.suffix_rows(*laid(strings))
    want = sorted((s[j:], i, j) for i, s in enumerate(strings) for j in range(len(s) + 1))
    assert list(zip(packed[0].tolist(), packed[1].tolist(), strict=True)) == [(i, j) for _, i, j in want]
    monkeypatch.setattr(bwt, "_PLACE", 3)
    for a, b in zip(packed, bwt.suffix_rows(*laid(strings)), strict=True):
        assert a.tolist() == b.tolist()


def test_suffixes_of_groups_in_order():
    """Groups one by one, strings of few and of all bytes, first symbols of any number."""
    rng = np.random.default_rng(12)
    for values in (1, 2, 5, 60, 256):
        strings = [rng.integers(0, values, rng.integers(0, 40)).astype(np.uint8).tobytes() for _ in range(60)] + [b"", bytes([0] * 30), bytes([0] * 30), bytes([values - 1] * 99)]
        group = np.sort(np.append(rng.integers(0, 6, len(strings) - 6), np.arange(6)))
        data, bounds = laid(strings)
        string, place = bwt.suffix_rows(data, bounds, group)
        every = [(group[i], s[p:], i, p) for i, s in enumerate(strings) for p in range(len(s) + 1)]
        assert list(zip(string.tolist(), place.tolist(), strict=True)) == [(i, p) for _, _, i, p in sorted(every, key=lambda x: (x[0], x[1], x[2], x[3]))]
        before, end, cut = bwt.transform(data, bounds, group)
        assert end.tolist() == (place == 0).tolist() and cut.tolist() == np.searchsorted(group[string], np.arange(7)).tolist()
        assert before[~end].tolist() == [strings[i][p - 1] for i, p in zip(string, place, strict=True) if p]


def test_rows_of_many_shards_step_alike():
    """Up to 256 shards are sorted with their bytes as one number, more are not."""
    rng = np.random.default_rng(3)
    for shards in (3, 256, 300):
        lists = [[rng.integers(97, 100, rng.integers(1, 6)).astype(np.uint8).tobytes() for _ in range(2)] for _ in range(shards)]
        made = [bwt.transform(*laid(strings), np.zeros(len(strings), np.int64)) for strings in lists]
        rows = [len(b) for b, _, _ in made]
        all_shards = bwt.Shards(np.concatenate([b for b, _, _ in made]), np.concatenate([e for _, e, _ in made]), np.repeat(np.arange(shards, dtype=np.int32), rows), np.full(shards, 2))
        string, length, total = bwt.walk(all_shards, bwt.longer(all_shards))
        data, bounds = bwt.strings_of(all_shards, string, length, total)
        found = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert sorted(found) == sorted(s for strings in lists for s in strings) and string.dtype == length.dtype == np.int32
