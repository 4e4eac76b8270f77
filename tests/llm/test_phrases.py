import re
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top, least):
    """(lang, rank, phrase, a, l, r, n, score) from (lang, text) rows, by counting every phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {}
    for (lang, p), a in f.items():
        if len(p) >= 2 and a >= least:
            cuts = [(2_000_000 * a // (f[lang, p[:j]] + f[lang, p[j:]]), j) for j in range(1, len(p))]
            score, j = min(cuts)
            found[lang, p] = (a, f[lang, p[:j]], f[lang, p[j:]], score)
    gone = set()
    for (lang, p), (a, *_) in found.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inner = p[i : i + m]
                if 100 * a >= 80 * f[lang, inner]:
                    gone.add((lang, inner))
    out = []
    for lang in {k[0] for k in found}:
        rows = [(-s, -a, " ".join(p).encode(), " ".join(p), a, x, y, s) for (g, p), (a, x, y, s) in found.items() if g == lang and (g, p) not in gone]
        out += [(lang, i, p, a, x, y, n[lang], s) for i, (_, _, _, p, a, x, y, s) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def made_texts(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "Of", "New", "york", "city", "é", "São", "paulo", "a", "in", "x-ray", "very"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    out = []
    for i in range(n):
        words = rng.choice(vocabulary, size=rng.integers(0, 40), p=weights / weights.sum()).tolist()
        if i % 3 == 0:
            words += ["New", "York", "city", "hall"]
        text = "".join(w + str(rng.choice([" ", "  ", "\t", ", ", ".\n", "?"], p=[0.6, 0.1, 0.1, 0.1, 0.05, 0.05])) for w in words)
        out.append((["en", "de", None][i % 3], text))
    return out


@pytest.mark.parametrize("least", [2, 5])
def test_against_counting(spark, make_docs, odd_rows, least):
    rows = made_texts(least, 150)
    docs = make_docs([*((i, t, g) for i, (g, t) in enumerate(rows)), *odd_rows])
    pairs = [(r.lang, r.text) for r in docs.collect()]
    got = sorted(map(tuple, phrases.collocations(docs, 60, least).collect()))
    want = brute(pairs, 60, least)
    assert got == want
    assert len(want) > 60 and any(p.count(" ") == 3 for _, _, p, *_ in want)


def test_long_texts_are_cut_between_pieces_only(spark, make_docs, monkeypatch):
    rows = made_texts(9, 60)
    docs = make_docs([(i, " ".join([t] * 4), "en") for i, (_, t) in enumerate(rows)])
    import pyarrow as pa

    monkeypatch.setattr(phrases, "FLUSH", 50)
    column = pa.array([r.text for r in docs.collect()])
    cut = [t.decode() for _, t in phrases._texts(column)]
    assert len(cut) > len(rows)
    whole = brute([("en", t) for t in column.to_pylist()], 1000, 3)
    assert brute([("en", t) for t in cut], 1000, 3) == whole


def test_bitmap_that_marks_everything_changes_nothing(spark, make_docs, monkeypatch):
    rows = made_texts(4, 90)
    docs = make_docs([(i, t, g) for i, (g, t) in enumerate(rows)])
    monkeypatch.setattr(phrases, "_bitmap", lambda level: spark.sparkContext.broadcast(b"\xff" * (1 << (phrases.BITS - 3))))
    assert sorted(map(tuple, phrases.collocations(docs, 60, 4).collect())) == brute(rows, 60, 4)


def test_counts_past_64_bits_of_product(spark):
    a = 1 << 62
    row = spark.sql(f"SELECT (cast({phrases.SCALE} as decimal(10,0)) * cast({a} as decimal(20,0))) div (cast({a} as decimal(20,0)) + cast({a} as decimal(20,0))) AS s")
    assert row.first().s == phrases.SCALE // 2


def test_empty_table(spark, make_docs, odd_rows):
    assert phrases.collocations(make_docs(odd_rows).filter("false"), 10).collect() == []
