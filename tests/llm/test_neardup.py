import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tallyframe.llm import neardup
from tallyframe.llm.words import shingle_sets


def brute(rows, k, threshold=80):
    """{row number: component} by an inverted index over full sets."""
    import re

    sets = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        own = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())
        sets.append(own if doc_id is not None else set())
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            index[g].append(i)
    shared = defaultdict(int)
    for at in index.values():
        for x in range(len(at)):
            for y in range(x):
                shared[at[x], at[y]] += 1
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (x, y), n in shared.items():
        if 100 * n >= threshold * (len(sets[x]) + len(sets[y]) - n):
            parent[top(x)] = top(y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(least.get(top(i), doc_id), doc_id)
    return [(rows[i][0], len(s), least.get(top(i))) for i, s in enumerate(sets)]


def family(rng, base, n, rate, vocabulary):
    return [" ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base) for _ in range(n)]


def test_against_brute_force(spark, make_docs, odd_rows):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 60))) for _ in range(150)]
    for rate in (0.01, 0.03, 0.06):
        base = [rng.choice(vocabulary) for _ in range(120)]
        texts += family(rng, base, 60, rate, vocabulary)
    chain = [f"c{i}" for i in range(100)]  # each is like the next one only
    texts += [" ".join(chain[i * 4 : i * 4 + 60]) for i in range(10)]
    texts += texts[:20] + ["Only two", "only TWO", "only two words"]
    rows = list(enumerate(texts, 10))
    rng.shuffle(rows)
    rows = [*odd_rows, *rows]
    out = neardup.near_duplicates(make_docs(rows), k=4).collect()
    for key in (lambda r: (str(r[0]), r[1]),):
        got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None], key=key)
        want = sorted([w for w in brute([r[:2] for r in rows], 4) if w[0] is not None], key=key)
        assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    assert [r.kept for r in out if r.doc_id is None] == [True]
    assert neardup.near_duplicates(make_docs([])).count() == 0
    assert neardup.near_duplicates(make_docs([(1, "a b"), (2, "c")])).filter("kept").count() == 2


def test_tables_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, k=4).collect())
    assert got == sorted(brute(rows, 4))


def test_odd_sketches_estimate_high_similarities(spark):
    rng = random.Random(5)
    for share in (0.8, 0.9, 0.97):
        common = [f"a{i}" for i in range(int(2000 * share))]
        one, two = (common + [f"{x}{i}" for i in range(1000 - int(1000 * share))] for x in "bc")
        jaccard = len(common) / (len(common) + 2 * (1000 - int(1000 * share)))
        sets = list(shingle_sets(pa.array([" ".join(one), " ".join(two)]), 1))
        flat, starts = np.concatenate(sets), np.array([0, len(sets[0])])
        a, b = neardup.odd_sketches(neardup.minima(flat, starts))
        ones = int(np.bitwise_count(a ^ b).sum())
        from pyspark.sql import functions as F

        estimate = spark.range(1).select(neardup.similarity(F.lit(ones))).first()[0]
        assert abs(estimate - jaccard) < 0.12
    del rng


def closest(texts, k, threshold=80):
    """Smallest row number that each of many short texts reaches, by the product of their incidence matrix."""
    sets = [{tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in texts]
    number = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    rows = np.zeros((len(texts), len(number)), np.float32)
    for i, s in enumerate(sets):
        rows[i, [number[g] for g in s]] = 1
    n = rows.sum(1)
    component = np.arange(len(texts))
    linked = []
    for at in range(0, len(texts), 500):
        same = rows[at : at + 500] @ rows.T
        linked.append(100 * same >= threshold * (n[at : at + 500, None] + n[None, :] - same))
    linked = np.vstack(linked)
    while True:
        least = np.array([component[l].min() for l in linked])
        if (least == component).all():
            return component.tolist()
        component = least


def test_a_family_of_thousands_around_the_threshold(spark, make_docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    texts = [t for rate in (0.10, 0.14) for t in family(rng, base, 1500, rate, vocabulary)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(make_docs(list(enumerate(texts))), k=1).collect()}
    assert [got[i] for i in range(len(texts))] == closest(texts, 1)


def test_the_exact_join_takes_rows_of_prefixes_only(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(80)]
    texts = [t for rate in (0.01, 0.03, 0.3) for t in family(rng, base, 40, rate, vocabulary)]
    rows = [(i, 5 + i % 3 if i < 100 else 1000 + i, t) for i, t in enumerate(texts)]
    plans, cut = [], neardup.cut_lineage
    monkeypatch.setattr(neardup, "cut_lineage", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or cut(df, name))
    sets = spark.createDataFrame(rows, "id bigint, component bigint, text string")
    made = neardup.prefixes(sets, 3, 80).collect()
    assert not [p for p in plans if "explode(shingles" in p]
    full = [set(s.view(np.int64).tolist()) for s in shingle_sets(pa.array(texts), 3)]
    for i, own in enumerate(full):
        mine = [r for r in made if r.id == i]
        assert {r.shingle for r in mine} <= own and {r.n for r in mine} <= {len(own)}
        assert len(mine) <= len(own) + -4 * len(own) // 5 + 1
        assert len({r.place for r in mine}) == len(mine)
    pairs = {(r.id, r.hub) for r in neardup.across(sets, 3, 80).collect()}
    linked = {(x, y) for y in range(len(rows)) for x in range(y) if rows[x][1] != rows[y][1] and 5 * len(full[x] & full[y]) >= 4 * len(full[x] | full[y])}
    assert linked and linked <= pairs
