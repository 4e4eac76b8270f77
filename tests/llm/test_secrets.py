import base64
import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from tallyframe.llm import secrets


def brute(text):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m.group(2)) >= 12:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return [(secrets.BASE_KINDS[k], s, e) for s, k, e in sorted(spans)]


def check(rows, out):
    assert len(out) == len(rows)
    by = {}
    for doc_id, text in rows:
        by.setdefault(doc_id, []).append(brute(text or ""))
    for r in out:
        want = by[r.doc_id].pop()
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (r.doc_id, r.spans, text)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in want) for k in secrets.BASE_KINDS]
        if not r.n_random:
            assert r.spans == text


def test_base_spans_against_the_plain_patterns(spark, make_docs, odd_rows):
    rng = random.Random(4)
    parts = ["token", "secret", "=", " ", ":", "'", '"', "abcdefghijkl", "Password = ", "AKIA", "ABCDEFGH1234567", "0123456789abcdef", "é", "😀", "api_key", "APIKEY:", "\n", "x", "deadbeef", "..", "passwd"]
    rows = [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))) for i in range(1500)]
    rows += [*(r[:2] for r in odd_rows), (10, "token=secret=abcdefghijklmnop"), (11, "token: secret: abcdefghijklmnop"), (12, "a" * 200_000), (13, "token " * 30_000)]
    check(rows, secrets.find_secrets(make_docs(rows)).collect())
    assert secrets.find_secrets(make_docs([])).count() == 0


def test_table_and_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = secrets.find_secrets(docs)
    check([(r.doc_id, r.text) for r in docs.collect()], out.collect())
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def test_battery_statistics(spark):
    rng = random.Random(9)
    tokens = ["".join(rng.choice("0123456789abcdef") for _ in range(40)), "0123456789abcdef" * 3, "aaaaaaaabbbbbbbb0000" * 2]
    got = [r.t for r in spark.createDataFrame([(t,) for t in tokens], "x string").select(secrets.battery(F.col("x")).alias("t")).collect()]
    for token, t in zip(tokens, got, strict=True):
        x = ["0123456789abcdef".index(c) for c in token]
        n, k = len(x), 16
        chi = k / n * sum(x.count(v) ** 2 for v in range(k)) - n
        df = k - 1
        z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
        assert t.encoding == "hex" and abs(t.p_chi - max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))) < 1e-6
        up = sum(v >= 8 for v in x)
        runs = 1 + sum((a >= 8) != (b >= 8) for a, b in zip(x, x[1:], strict=False))
        mean = 2 * up * (n - up) / n + 1
        z = (runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1))
        assert abs(t.p_runs - min(1, max(1e-12, math.erfc(abs(z) / math.sqrt(2))))) < 1e-6
    assert got[0].p_random > 0.001 and got[1].p_random < 0.001 and got[2].p_random < 0.001


def test_e_bh_bound():
    assert secrets.lowest({0: 990, 40: 10}, 0.01) == 14  # the least b with 2**b * 0.01 * 10 >= 1000
    assert secrets.lowest({0: 1000}, 0.01) is None
    assert secrets.lowest({3: 5}, 0.01) is None


def test_random_strings_are_found_and_words_left(spark, make_docs):
    rng = random.Random(12)
    keys, words = [], ["understanding_of_internationalization", "src/main/python/package/module", "CamelCaseIdentifierNamesAreCommon", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "2024-01-01-some-long-title-of-a-post"]
    for i in range(60):
        keys.append(base64.b64encode(rng.randbytes(30)).decode().replace("=", ""))
        words.append(f"some-{rng.choice(['plain', 'usual'])}-title-with-number-{i}")
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(500 + i, f"see {w} here") for i, w in enumerate(words)]
    out = {r.doc_id: r for r in secrets.find_secrets(make_docs(rows)).collect()}
    found = sum(out[i].n_random for i in range(len(keys)))
    assert found >= 55
    assert not any(out[500 + i].n_random for i in range(len(words)))
    hit = next(r for r in out.values() if r.n_random)
    assert hit.spans == f"random:4:{4 + len(keys[hit.doc_id])}" and hit.encodings == "base64"


def test_positions_of_many_matches(spark):
    import time

    from pyspark.sql import functions as F

    n = 60_000
    rows = spark.createDataFrame([(1, "é " + "0123456789abcdef " * n)], "id int, t string").repartition(1).cache()
    rows.count()
    started = time.time()
    got = rows.select(F.explode(secrets.spans(F.col("t"), "[0-9a-f]+", F.lit(True), 16)).alias("x")).agg(F.count("*").alias("n"), F.sum("x.s").alias("s"), F.sum("x.e").alias("e")).first()
    assert (got.n, got.s, got.e) == (n, sum(2 + 17 * i for i in range(n)), sum(18 + 17 * i for i in range(n)))
    assert time.time() - started < 60  # the square of the matches would take minutes
