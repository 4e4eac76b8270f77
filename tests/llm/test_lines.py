import random
import re

import duckdb

from tallyframe.llm import lines


def brute(rows, least):
    """The definition, on (doc_id, text) rows of distinct documents with a doc_id."""
    windows = []
    for doc_id, text in rows:
        cut = (text or "").split("\n")
        spoken = [(p, line, len(re.findall(r"[^\x20\x09-\x0d]+", line))) for p, line in enumerate(cut)]
        spoken = [s for s in spoken if s[2]]
        for a in range(len(spoken)):
            n, e = 0, a
            while e < len(spoken) and n < least:
                n += spoken[e][2]
                e += 1
            if n >= least:
                windows.append((tuple(s[1] for s in spoken[a:e]), doc_id, a, e, spoken[a][0], spoken[e - 1][0]))
    first = {}
    for w in windows:
        first[w[0]] = min(first.get(w[0], w[1:4]), w[1:4])
    gone = {}
    for key, doc_id, a, _, p, q in windows:
        f = first[key]
        if f[0] != doc_id or a >= f[2]:
            gone.setdefault(doc_id, set()).update(range(p, q + 1))
    out = []
    for doc_id, text in rows:
        cut = text.split("\n") if text is not None else []
        own = gone.get(doc_id, set())
        kept = "\n".join(x for p, x in enumerate(cut) if p not in own) if text is not None else None
        out.append((doc_id, kept, len(cut), len(own)))
    return sorted(out)


def test_against_brute_force_and_sql(spark):
    rng = random.Random(21)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 7))) for _ in range(14)] + ["", " ", "x " * 25]
    passages = [[rng.choice(pool) for _ in range(rng.randint(2, 7))] for _ in range(6)]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(pool) + f" {rng.randint(0, 40)}"]
        rows.append((i, "\n".join(parts)))
    rows += [(900, None), (901, ""), (902, "\n".join(["one two three"] * 30)), (903, "w " * 30_000), (904, "w " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least in (10, 17):
        got = sorted(map(tuple, lines.drop_repeated_runs(df, least, counts=True).collect()))
        assert got == brute(rows, least)
        con = duckdb.connect()
        con.register("documents", df.toPandas())
        assert sorted(con.sql(lines.oracle(least)).fetchall()) == [(d, t, n, g) for d, t, n, g in got]
    assert sum(r[3] for r in got) > 100


def test_every_shared_window_shares_a_fingerprint(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))
    passage = [line() for _ in range(8)]
    rows = [(i, "\n".join([line() for _ in range(rng.randint(0, 5))] + passage + [line() for _ in range(rng.randint(0, 5))])) for i in range(30)]
    marked = lines.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), 50)
    seeds = [{s.k for s in r.seeds} for r in marked.collect()]
    assert set.intersection(*seeds)


def test_odd_rows_and_passages(spark, make_docs, odd_rows):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [*odd_rows, (30, f"own start\n{passage}\nown end"), (31, f"{passage}"), (32, f"a\n{passage}\nb\n{passage}"), (33, "short line\nother"), (34, "short line\nother")]
    docs = make_docs(rows)
    out = lines.drop_repeated_runs(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in got}
    assert text[30] == rows[-5][1] and text[31] == "" and text[32] == "a\nb" and text[33] == text[34] == "short line\nother"
    assert text[1] is None and text[2] == "" and text[None] is None and text[5] == odd_rows[5][1]
    assert lines.drop_repeated_runs(make_docs([])).count() == 0


def test_no_python_in_the_plan(spark, make_docs):
    plan = lines.drop_repeated_runs(make_docs([(1, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
