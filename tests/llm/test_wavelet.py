import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallyframe.llm import wavelet

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_matrix_against_the_plain_sequence():
    rng = np.random.default_rng(1)
    for n, top, bits in ((0, 4, 3), (1, 2, 1), (700, 6, 3), (5000, 40000, 16), (1024, 70000, 17)):
        ids = rng.integers(0, top, n).astype(np.uint16 if bits <= 16 else np.uint32)
        ids[: n // 3] = 1
        shard = wavelet.Shard(wavelet.pack([7], np.array([n]), ids, bits))
        m = shard.matrix
        assert m.decode_all().tolist() == ids.tolist() == m.decode(0, n).tolist()
        assert m.decode(n // 4, n // 2).tolist() == ids[n // 4 : n // 2].tolist()
        for i in rng.integers(0, n, 40) if n else ():
            token = int(ids[i])
            assert m.access(int(i)) == token
            assert m.rank(token, int(i)) == int((ids[:i] == token).sum())
            assert m.count(token, int(i) // 2, int(i)) == int((ids[i // 2 : i] == token).sum())
            places = np.flatnonzero(ids == token)
            k = int(rng.integers(0, len(places)))
            assert m.select(token, k) == places[k]
        assert m.count(top + 1 if top + 1 < 1 << bits else 0, 0, n) == int((ids == (top + 1 if top + 1 < 1 << bits else 0)).sum())
        with pytest.raises(IndexError):
            m.select(int(ids[0]) if n else 0, n)


def test_chunks_encode_like_whole_texts(library):
    rng = random.Random(6)
    encoder = wavelet.Encoder(PATH, 4)
    for _ in range(300):
        texts = ["".join(rng.choice("abzAÉßİΣς 's'llç12.,!  \n\t\r\x85  ́漢😀<|endoftext|>\x1c") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        sizes, ids = encoder(pa.array(texts), 2)
        want = [[*library.encode(text, add_special_tokens=False).ids, 2] for text in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want, texts


def test_new_pieces_go_to_the_library_together(library):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("abcé#'9") for _ in range(rng.randint(3, 9))) for _ in range(1000)) for _ in range(3)]
    texts += ["# a #b ##", "#", " ".join(f"x{'y' * i}" for i in range(200))]
    want = [[*library.encode(text, add_special_tokens=False).ids, 2] for text in texts]
    for mark in (None, library.encode("a").ids[0], -1):  # its own, one that pieces make too, none
        encoder, asked = wavelet.Encoder(PATH, 4), []
        encode, encoder.mark = encoder._encode, encoder.mark if mark is None else mark
        encoder._encode = lambda t: asked.extend(t) or encode(t)  # noqa: B023
        sizes, ids = encoder(pa.array(texts), 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
        if mark is None:
            assert len([t for t in asked if "#" not in t]) == 0 and len(asked) < len([p for p in encoder.known if "#" in p]) + 20


def test_query_rows(spark, make_docs, odd_rows, library):
    rows = [*odd_rows, *((1000 - i, f"some words {i}") for i in range(50))]
    manifest = wavelet.write_shards(make_docs(rows), PATH, roll=20, partitions=4)
    got = wavelet.read_documents(manifest, T.LongType(), 3).collect()
    start, want = 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (-1 if r[0] is None else r[0], r[1])):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert manifest.count() > 10
    empty = wavelet.write_shards(make_docs([]), PATH, partitions=2)
    assert empty.count() == 0 and wavelet.read_documents(empty, T.LongType(), 2).count() == 0


def test_cutting_a_slice_counts_its_letters_in_32_bits():
    texts = pa.array([" ".join(f"word{i % 5000}" for i in range(40_000))] * 4)
    encoder = wavelet.Encoder(PATH, 2)
    encoder.pieces(texts)
    tracemalloc.start()
    encoder.pieces(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 23 * texts.nbytes, peak / texts.nbytes
