import hashlib
import os
import sys

import numpy as np
import public_tokenizers as P
import tiktoken

sys.path.insert(0, os.path.dirname(__file__))

import test_decon
import test_lines
import test_neardup
import test_quality

import corpus_pipeline
from tallyframe.llm import bpe, quality

DIR = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{DIR}/{name}.parquet")


def test_run_against_brute_force(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    cutoffs = quality.thresholds(quality.score(docs), labels)
    rows = []
    for r in docs.collect():
        n, chars, symbols, dup, repeat = test_quality.brute(r.text)
        if n >= 10 and 100 * repeat <= 20 * n:
            rows.append((r.doc_id, r.text, r.lang))
    if cutoffs:
        kept = {r.doc_id for r in quality.judge(quality.score(docs), cutoffs).filter("kept").collect()}
        rows = [r for r in rows if r[0] in kept]
    rows = [(d, t) for d, t, *_ in test_lines.brute([r[:2] for r in rows], corpus_pipeline.LEAST_WORDS) if t.strip(" \t\n\x0b\x0c\r")]
    component = test_neardup.brute(rows, 5)
    rows = [r for r, (d, _, c) in zip(rows, component, strict=True) if d == c]
    leaks = {d for d, *_ in test_decon.brute(rows, [(r.item_id, r.text) for r in read(spark, "benchmark").collect()])}
    rows = [r for r in rows if r[0] not in leaks]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((d, hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest()) for d, t in rows)
    got = corpus_pipeline.run(spark, DIR).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in got) == want
    assert 0 < len(want) < docs.count() and leaks


def test_stages_on_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs([*odd_rows, *((100 + i, f"a document of more than ten words in all number {i} that stays") for i in range(3))])
    for rows in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, DIR)
            out.collect()
            if name != "bpe":
                assert out.columns == docs.columns and out.dtypes == docs.dtypes
