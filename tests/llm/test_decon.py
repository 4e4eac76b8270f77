import re

from tallyframe.llm import decon


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def shingles(text, k=5):
    words = words_of(text)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(docs, items):
    out = []
    for d, text in docs:
        own = {k: shingles(text, k) for k in range(1, 6)}
        for i, other in items:
            k = min(5, len(words_of(other)))  # a short item is one shingle of its own length
            want = shingles(other, k) if k else set()
            if want and 100 * len(want & own[k]) >= 80 * len(want):
                out.append((d, i, len(want), len(want & own[k])))
    return sorted(out, key=str)


def test_against_brute_force_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    for block in (1 << 20, 200):
        got = decon.find_leaks(docs, items, block=block).collect()
        assert sorted([(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got], key=str) == want
    assert len(want) > 20


def test_threshold_short_items_and_odd_rows(spark, make_docs, odd_rows):
    base = [f"w{i}" for i in range(29)]  # 25 shingles: up to 5 may be missing
    items = spark.createDataFrame([(1, " ".join(base)), (2, "Same  TEXT here"), (3, ""), (4, None), (None, "a b"), (1, " ".join(base))], "item_id int, text string")
    long = ["x%d" % i for i in range(5000)]
    five, six = base.copy(), base.copy()
    five[4] = "q"  # breaks shingles 0..4
    six[5] = "q"  # breaks shingles 1..5
    six[0] = "z"  # and 0
    rows = [*odd_rows, (20, " ".join(long + five + long)), (21, " ".join(long + six + long)), (22, " ".join(base).upper()), (23, "the same text here")]
    got = decon.find_leaks(make_docs(rows), items).collect()
    want = brute([r[:2] for r in rows], [(1, " ".join(base)), (2, "Same  TEXT here"), (None, "a b")])
    assert sorted([(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got], key=str) == want
    assert {(r.doc_id, r.item_id) for r in got} == {(20, 1), (22, 1), (6, 2), (23, 2), (4, None)}
    assert decon.find_leaks(make_docs([]), items).count() == 0
    assert decon.find_leaks(make_docs(rows), items.filter("false")).count() == 0


def test_short_items_inside_long_documents(spark, make_docs):
    items = spark.createDataFrame([(1, "What is love"), (2, "is"), (3, "love what"), (4, "one two three four"), (5, "one two three four five")], "item_id int, text string")
    rows = [(1, "a " * 100 + "what is  love" + " b" * 4), (2, "love"), (3, "one two three four five six"), (4, "one two three"), (5, "what is"), (6, "love")]
    for block in (1 << 20, 2):
        got = decon.find_leaks(make_docs(rows), items, block=block).collect()
        assert sorted([(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in got], key=str) == brute(rows, [tuple(r) for r in items.collect()])
        assert {r.doc_id for r in decon.drop_leaks(make_docs(rows), items, block=block).collect()} == {2, 4, 6}
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (1, 2), (3, 4), (3, 5), (5, 2)}
