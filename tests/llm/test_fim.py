import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import fim


def brute(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


def run(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["doc_id", "text"])
    columns = [c.to_pylist() if isinstance(c, pa.Array) else c.tolist() for c in fim.rearrange(batch)]
    return list(zip(*columns, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 1 << 40)), st.one_of(st.none(), st.text(max_size=40))), min_size=1, max_size=12), st.integers(4, 30))
def test_against_slices(rows, segment):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(fim, "SEGMENT", segment)
        assert run(rows) == [(d, *brute(d, t)) for d, t in rows]


def test_markers_and_their_pieces_in_texts():
    rows = [(i, t) for i, t in enumerate(["a<P>b", "<S", "<", "x<S<S", "S>P>M>", "<<<<", "a<M>", "é<\U0001f600>P"] * 40)]
    assert run(rows) == [(d, *brute(d, t)) for d, t in rows]


def test_operator(spark, make_docs, odd_rows):
    rows = [*odd_rows, (7, "ä\U0001f600z" * 700_000), *((100 + i, f"text {i} ünd") for i in range(40))]
    got = sorted(map(tuple, fim.fill_in_middle(make_docs(rows)).collect()), key=repr)
    assert got == sorted(((r[0], *brute(r[0], r[1])) for r in rows), key=repr)
    assert {"plain", "psm", "spm"} == {r[2] for r in got}
    assert fim.fill_in_middle(make_docs(rows).filter("false")).collect() == []
