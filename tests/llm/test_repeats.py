import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard

from tallyframe.llm import repeats


def brute(rows, least):
    """(doc_id, n_bytes, n_removed, spans, kept) of (doc_id, text) rows."""
    null = -(1 << 63)
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            first[w] = min(first.get(w, 1 << 63), null if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < (null if d is None else d):
                gone[p : p + least] = b"\x01" * least
        spans, p = [], 0
        while p < len(b):
            q = p
            while q < len(b) and gone[q] == gone[p]:
                q += 1
            if gone[p]:
                spans.append((p, q))
            p = q
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def run(docs, *a, **k):
    rows = repeats.remove_repeats(docs, *a, **k).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows), key=repr)


def made_rows(seed):
    rng = np.random.default_rng(seed)
    vocabulary = ["alpha", "béta", "gamma", "délta", "epsilon", "z", "\U0001f600", "==", "\x00"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    shared = [text(30) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [text(int(rng.integers(0, 40))) for _ in range(3)]
        if i % 2:
            parts.insert(int(rng.integers(0, 3)), shared[int(rng.integers(0, 6))])
        rows.append((int(rng.integers(-50, 1 << 40)), "".join(parts)))
    rows += [(i, rows[3][1]) for i in (7, 8, 1 << 50)]  # copies
    rows += [(9, "a" * 400), (10, "a" * 90 + "b" * 90), (11, "ab" * 200), (9, "a" * 300)]
    return rows


@pytest.mark.parametrize(("least", "hot", "shard"), [(50, 20_000, 4 << 20), (50, 2, 3000), (16, 3, 2000), (31, 20_000, 900)])
def test_against_brute_force(spark, make_docs, odd_rows, least, hot, shard, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", shard)
    monkeypatch.setattr(repeats, "RANGE_BYTES", 4000)
    monkeypatch.setattr(repeats, "RANGE_ANCHORS", 50)
    odd = [(r[0], (r[1] or "")[:2000] or r[1]) for r in odd_rows]
    rows = [*made_rows(least), *odd, (None, "a text of a row without an id that is long enough to be found again"), (12, "x a text of a row without an id that is long enough to be found again")]
    got, want = run(make_docs(rows), least, hot), brute(rows, least)
    assert got == want
    assert sum(r[2] for r in want) > 1000


def test_layout_in_runs_and_segments(monkeypatch):
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 99, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 700, 701, 2500, 2540, 5000])
    whole = repeats.anchors(raw, offsets, 50)
    covered = np.concatenate([np.arange(s, s + c) for s, c in zip(whole[0], whole[1], strict=True)])
    want = np.concatenate([np.arange(a, b - 49) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b - a >= 50])
    assert covered.tolist() == want.tolist()
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    for a, b in zip(whole, repeats.anchors(raw, offsets, 50), strict=True):
        assert a.tolist() == b.tolist()


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(6)
    passage = rng.integers(97, 123, 300).astype(np.uint8)
    keys = []
    for pad in (0, 37, 411):
        raw = np.concatenate([rng.integers(97, 123, pad).astype(np.uint8), passage, rng.integers(97, 123, 90).astype(np.uint8)])
        start, count, key, _ = repeats.anchors(raw, np.array([0, len(raw)]), 50)
        by_window = np.repeat(key, count)
        keys.append(by_window[pad : pad + 251].tolist())
    assert keys[0] == keys[1] == keys[2]


def test_empty_table(spark, make_docs, odd_rows):
    assert run(make_docs(odd_rows).filter("false")) == []


def test_query_columns(spark):
    from tallyframe.llm.queries import op11_repeated_bytes

    dir_ = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{dir_}/documents.parquet").collect()]
    got = sorted(map(tuple, op11_repeated_bytes(spark, dir_).collect()))
    assert got == sorted((d, n, m, len(s), hashlib.sha256(k).hexdigest()) for d, n, m, s, k in brute(rows, 50))


def rows_of(batches):
    return [r for b in batches for r in b.to_pylist()]


def by_shard(rows, fields):
    out = {}
    for r in rows:
        out.setdefault(r["shard"], []).append({f: r[f] for f in fields})
    return out


def shard_batch(name, rows, **more):
    parts = [(t or "").encode() for _, t in rows]
    columns = {
        "shard": pa.array([name]),
        "ids": pa.array([[d for d, _ in rows]], pa.list_(pa.int64())),
        "sizes": pa.array([[len(p) for p in parts]], pa.list_(pa.int64())),
        "data": pa.array([zstandard.ZstdCompressor().compress(b"".join(parts))], pa.binary()),
    }
    columns |= {k: pa.array([v], pa.list_(pa.struct([("bucket", pa.int32()), *((f, pa.binary()) for f in v[0] if f != "bucket")])) if v else None) for k, v in more.items()}
    return pa.RecordBatch.from_pydict(columns)


def in_one_process(dealt, least, hot, ranges, cut=repeats._cut_documents):
    """The operator's stages over shards of rows, one task each, without Spark."""
    names = [f"{i:03d}" for i in range(len(dealt))]
    plain = [shard_batch(n, rows) for n, rows in zip(names, dealt, strict=True)]
    sent = pa.Table.from_batches(list(repeats._send_anchors(least, ranges)(iter(plain))))
    shared = by_shard(rows_of(repeats._share_anchors(hot)(iter(b for k in range(ranges) for b in sent.filter(pc.equal(sent["bucket"], k)).to_batches()))), ("bucket", "shared", "hot"))
    told = {n: shard_batch(n, rows, anchors=shared.get(n, [])) for n, rows in zip(names, dealt, strict=True)}
    made = list(repeats._send_transforms(least, ranges, ranges)(iter(told.values())))
    bits = by_shard(rows_of(repeats._merge_transforms(least)(iter(made))), ("bucket", "earlier"))
    for n, rows in zip(names, dealt, strict=True):
        yield from cut(least, ranges, ranges)(iter([shard_batch(n, rows, anchors=shared.get(n, []), repeats=bits.get(n, []))]))


@pytest.mark.parametrize("hot", [2, 20_000])
def test_small_parts(monkeypatch, hot):
    """Ranges dealt over many parts, pieces laid out in many runs, a key's equal windows in several runs."""
    for name, value in (("PART", 700), ("LAYOUT", 150), ("SEGMENT", 64)):
        monkeypatch.setattr(repeats, name, value, raising=False)
    rows = made_rows(8)
    got = [r for b in in_one_process([rows[i::5] for i in range(5)], 50, hot, 6) for r in b.to_pylist()]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], [(s["start"], s["end"]) for s in r["spans"]], r["kept"]) for r in got), key=repr)
    assert got == brute(rows, 50)


def test_memory_of_a_shard_of_copies():
    """A shard that is all repeated is cut in a small multiple of its bytes."""
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, 1 << 20).astype(np.uint8).tobytes().decode()
    most = []

    def cut(*a):
        def run(batches):
            tracemalloc.start()
            out = list(repeats._cut_documents(*a)(batches))
            most.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            return out

        return run

    out = [r for b in in_one_process([[(1, text)], [(2, text)]], 50, 20_000, 200, cut) for r in b.to_pylist()]
    assert [(r["n_removed"], r["spans"]) for r in out] == [(0, []), (1 << 20, [{"start": 0, "end": 1 << 20}])]
    assert max(most) < 24 * len(text)


def test_window_hashes():
    rng = np.random.default_rng(9)
    raw = np.tile(rng.integers(97, 99, 300).astype(np.uint8), 2)
    for least in (16, 17, 50, 64):
        n = len(raw) - least + 1
        hashes = repeats.window_hashes(raw, np.arange(n), least)
        assert len(set(hashes.tolist())) == len({raw[p : p + least].tobytes() for p in range(n)})
        assert (hashes[: n - 300] == hashes[300:]).all()


def test_pieces_of_one_key_only_enter_the_merge():
    key = np.array([5, 5, 7, 9, 7, 5], np.uint32)
    assert repeats._meeting(key, np.array([0, 1, 2, 3])).tolist() == [0, 0, -1, -1, -1, -1]
