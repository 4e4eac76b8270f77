import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from tallyframe.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_folds_agree_with_the_library(ranks, library):
    rng = random.Random(3)
    words, pattern = bpe.Words(ranks), regex.compile(P.PATTERN)
    for _ in range(1500):
        n = rng.choice([1, 3, 10, 50, 200])
        text = "".join(rng.choice("abcdehinorst éß  \n\t'!?=0129漢😀  \x85") for _ in range(n))
        assert np.frombuffer(bpe.encode(text, pattern, words), "<u4").tolist() == library.encode_ordinary(text)
    for text in ("=" * 3000, "a" * 3000, "\n" * 2000 + "x", "ab" * 700):
        assert np.frombuffer(bpe.encode(text, pattern, words), "<u4").tolist() == library.encode_ordinary(text)


def test_long_and_short_folds_agree(ranks):
    rng = random.Random(4)
    for _ in range(500):
        word = bytes(rng.choice(b"abcdefin") for _ in range(rng.randint(1, 60)))
        assert bpe._fold_short(word, ranks) == bpe._fold_long(word, ranks)


def test_query_rows(spark, make_docs, odd_rows, library):
    rows = [*odd_rows, (9, "It's 12 o'clock, déjà vu 漢字!")]
    out = bpe.bpe_round_trip(make_docs(rows), PATH, P.PATTERN, with_ids=True).collect()
    assert len(out) == len(rows)
    want = sorted((hashlib.sha256(np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in out)
    assert bpe.bpe_round_trip(make_docs([]), PATH, P.PATTERN).count() == 0
