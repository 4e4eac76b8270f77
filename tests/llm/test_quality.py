import random
import re
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyframe.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    covered = {i + j for i, g in enumerate(grams) if counts[g] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_against_brute_force():
    rng = random.Random(2)
    texts = [None, "", " ", "\n", "é"]
    for _ in range(400):
        texts.append("".join(rng.choice(["a", "bé", "c#", "漢", " ", " ", "\n", " ", "\t"]) for _ in range(rng.randint(0, 80))))
    for batch in (texts, texts[3:9], texts[:1]):
        found = quality.measure(pa.array(batch, pa.string()))
        got = list(zip(*(found[c].tolist() for c in quality.COUNTS), strict=True))
        assert got == [brute(t or "") for t in batch]


def test_binomial_cdf_is_exact():
    for n, k in ((20, 3), (200, 1), (500, 12)):
        p = Fraction(1, 50)
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(quality.binomial_cdf(k, n, 0.02) - float(want)) < 1e-12


def test_a_path_takes_the_steps_that_pay():
    rng = np.random.default_rng(3)
    good = np.zeros((600, 5), np.int64)
    good[:, 0] = rng.integers(0, 10, 600)
    bad = np.zeros((100, 5), np.int64)
    bad[:60, 2] = rng.integers(50, 90, 60)  # caught by the third rule without loss
    bad[60:, 0] = 30  # and by the first
    cells, is_good = np.concatenate([good, bad]), np.arange(700) < 600
    path = quality.propose(cells, is_good)
    cutoffs = dict(path)
    assert set(cutoffs) == {0, 2} and cutoffs[0] == 29 and cutoffs[2] < 50  # the mildest that catch as much
    assert quality.propose(good, np.ones(600, bool)) == []
    assert quality.propose(cells[:, [1, 1, 1, 1, 1]], is_good) == []  # rules that tell nothing


def test_certified_steps():
    n = quality.enough(0.02, 0.025)
    assert n == 183 and quality.certified([0, 0], n, 0.02, 0.025) == 2 and quality.certified([0], n - 1, 0.02, 0.025) == 0
    assert quality.certified([1, 0], n, 0.02, 0.025) == 0
    assert quality.certified([0, 2, 0, 40, 0], 1000, 0.02, 0.025) == 3
    assert quality.certified([], 1000, 0.02, 0.025) == 0 and quality.certified([0], 0, 0.02, 0.025) == 0


def test_false_rejections_stay_within_the_risk(monkeypatch):
    """Good and bad texts overlap; over many draws the whole set of cutoffs may exceed the risk in a delta of them."""
    monkeypatch.setattr(quality, "PENALTY", 0.01)
    rng, over, some = np.random.default_rng(8), 0, 0

    def draw(n, scale):
        return np.minimum(quality.GRID, rng.exponential(scale, (n, 5))).astype(np.int64)

    truth = draw(200_000, 5)
    for _ in range(120):
        fit, holdout = draw(300, 5), draw(900, 5)
        path = quality.propose(np.concatenate([fit, draw(150, 25)]), np.arange(450) < 300)
        alive, lost = np.ones(len(holdout), bool), []
        for rule, cell in path:
            hit = alive & (holdout[:, rule] > cell)
            lost.append(int(hit.sum()))
            alive &= ~hit
        kept = np.ones(len(truth), bool)
        for rule, cell in path[: quality.certified(lost, len(holdout), 0.02, 0.1)]:
            kept &= truth[:, rule] <= cell
        over += (~kept).mean() > 0.02
        some += not kept.all()
    assert some > 30 and over <= 0.1 * 120 + 3 * (120 * 0.1 * 0.9) ** 0.5


def test_every_language_of_the_tables_is_certified(spark):
    """The verdict, made again by hand from the labels, and its losses among all labelled texts."""
    dir_ = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{dir_}/documents.parquet"), spark.read.parquet(f"{dir_}/labels.parquet")
    labelled = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = quality.score(labelled).cache()
    cutoffs = quality.thresholds(scored, labels)
    assert {lang for lang, _ in cutoffs} == {"en", "de", "fr", "es"}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    lost, caught, seen = Counter(), Counter(), Counter()
    for r in scored.collect():
        over = any(c > cutoffs.get((r.lang, rule), quality.GRID + 1) for rule, c in zip(quality.RULES, r.cells, strict=True))
        seen[r.lang, truth[r.doc_id]] += 1
        (lost if truth[r.doc_id] else caught)[r.lang] += over
    for lang in ("en", "de", "fr", "es"):
        assert lost[lang] <= 0.03 * seen[lang, 1] and caught[lang] >= 0.3 * seen[lang, 0], (lang, lost, caught, seen)


def test_verdicts(spark, make_docs, odd_rows):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    plain = lambda: " ".join(rng.choice(words) for _ in range(30))
    loud = lambda: " ".join(rng.choice(words).upper() + "!!" for _ in range(30))
    rows = [(100 + i, plain()) for i in range(2500)] + [(5000 + i, loud()) for i in range(300)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 5000), 0) for r in rows] + [(100, 1, 0), (101, 0, 0), (None, 1, 0), (102, None, 1)], "doc_id bigint, quality int, toxic int")
    rows += [*odd_rows, (9000, plain()), (9001, loud()), (9002, loud(), "xx"), (9003, "few words here")]
    docs = make_docs(rows)
    out = {r.doc_id: r for r in quality.assess(quality.score(docs), labels).collect()}
    assert out[9000].kept and not out[9001].kept and out[9001].rules_failed in quality.RULES  # one rule catches them all
    assert out[9002].kept, "a stratum without labels rejects nothing by the rules"
    assert not out[9003].kept and out[9003].base_failed and not out[None].kept and not out[5].kept
    assert all(r.kept for i, r in out.items() if i is not None and 100 <= i < 5000)
    kept = quality.filter_quality(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out.values() if r.kept)
    assert quality.assess(quality.score(make_docs([])), labels).count() == 0
    assert quality.filter_quality(make_docs(rows[-4:]), labels.filter("false")).count() == 3


def test_all_labelled_texts_propose_the_path(spark):
    """More labelled texts than a driver's share: the path over Spark's counts is that over arrays of all of them."""
    rng = np.random.default_rng(5)
    n = 40_000
    bad = np.arange(n) % 5 == 0
    cells = np.minimum(quality.GRID, rng.exponential(np.where(bad, 40, 3)[:, None], (n, 5))).astype(np.int64)
    rows = [(lang, c.tolist(), int(not b), int(b)) for lang in ("en", None) for c, b in zip(cells, bad, strict=True)]
    fit = spark.createDataFrame(rows, "lang string, cells array<bigint>, good bigint, bad bigint")
    want = quality.propose(cells, ~bad)
    assert quality.paths_of(fit, ["en", None]) == {"en": want, None: want} and len(want) > 2
    assert quality.paths_of(fit, []) == {} and quality.paths_of(fit.limit(0), ["en"]) == {"en": []}
    scored = fit.filter("lang = 'en'").select(F.monotonically_increasing_id().alias("doc_id"), "lang", "cells", "good").cache()
    labels = scored.select("doc_id", F.col("good").cast("int").alias("quality"))
    cutoffs = quality.thresholds(scored, labels)
    hashed = scored.select("cells", "good", (F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(quality.FIT_SHARE)) == 0).alias("fit")).collect()
    own = [(r.cells, r.good == 1) for r in hashed if r.fit]
    assert len(own) > 10_000
    path = quality.propose(np.array([c for c, _ in own]), np.array([g for _, g in own]))
    strict = {}
    for rule, cell in path:
        strict[quality.RULES[rule]] = min(cell, strict.get(quality.RULES[rule], quality.GRID + 1))
    assert cutoffs == {("en", rule): cell for rule, cell in strict.items()}
