"""Token ids of documents in wavelet-matrix shards.

``write_shards`` sorts the documents by doc_id over range partitions, tokenizes every whole text, and rolls files of
about ``roll`` ids. A shard file holds the ids of whole documents in ascending doc_id order as a wavelet matrix: one
bit plane per bit of an id, from the highest down, each plane stably split by the plane before (zeros first), with a
directory of ones per BLOCK bits; planes and directories are compressed one by one. From the one file it answers

* ``access(i)`` the id at a place, ``decode(lo, hi)`` a run, ``decode_all()`` everything,
* ``rank(token, i)`` / ``count(token, lo, hi)`` occurrences, ``select(token, k)`` the place of the k-th.

File: magic, length of the JSON header, header (counts, zeros per plane, lengths of the sections), sections:
doc_ids, null flags, document ends, then plane and directory by plane.

doc_id is an integer. Nulls are empty texts (the end id alone). Rows with a null doc_id come first, repeated doc_ids follow one another;
other columns are ignored; an empty table gives no shards. A document is never split: a shard may exceed ``roll``
by one document.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tallyframe.llm import files
from tallyframe.llm.common import ship
from tallyframe.llm.words import _FOLD, slices, text_buffers

MAGIC = b"TFWM1\0"
BLOCK = 512
ROLL_IDS = 4 << 20
#: Bytes of text whose distinct chunks are encoded at a time.
SLICE = 2 << 20
#: Pieces kept by a worker, some 160 bytes each.
KEPT_PIECES = 1_200_000
#: New pieces are encoded so many in one text, with this sign after each.
JOINED, MARK = 500, "#"
_BLANK, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _kinds() -> np.ndarray:
    """Of each byte: blank, ASCII letter, digit, sign, or what keeps its run whole (other scripts, controls, the
    apostrophe, which the tokenizer joins to endings)."""
    kind = np.full(256, _ODD, np.uint8)
    kind[0x21:0x7F] = _SIGN
    kind[[0x20, 0x0A]] = _BLANK
    kind[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = _LETTER
    kind[ord("0") : ord("9") + 1] = _DIGIT
    kind[ord("'")] = _ODD
    return kind


_KIND = _kinds()

MANIFEST = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("documents", T.LongType()),
        T.StructField("ids", T.LongType()),
        T.StructField("bytes", T.LongType()),
    ]
)


class WaveletMatrix:
    """Planes of ``bits`` bits over ``n`` ids."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]) -> None:
        self.n, self.bits, self.planes, self.zeros, self.ranks = n, bits, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, ranks = [], [], []
        for level in range(bits):
            one = ((ids >> ids.dtype.type(bits - 1 - level)) & ids.dtype.type(1)).astype(bool)
            packed = np.packbits(one, bitorder="little")
            planes.append(packed)
            zeros.append(int(len(one) - np.count_nonzero(one)))
            ranks.append(_directory(packed))
            ids = np.concatenate([np.compress(~one, ids), np.compress(one, ids)])
        return cls(len(ids), bits, planes, zeros, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        block = i // BLOCK
        count = int(self.ranks[level][block])
        start = block * BLOCK // 8
        packed = self.planes[level][start : (i + 7) // 8]
        bits = np.unpackbits(packed, bitorder="little")[: i - block * BLOCK]
        return count + int(np.count_nonzero(bits))

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i >> 3]) >> (i & 7)) & 1

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _walk(self, token: int, i: int) -> int:
        for level in range(self.bits):
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else i - ones
        return i

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before place ``i``."""
        return self._walk(token, i) - self._walk(token, 0)

    def count(self, token: int, lo: int, hi: int) -> int:
        return self.rank(token, hi) - self.rank(token, lo)

    def select(self, token: int, k: int) -> int:
        """Place of occurrence ``k`` (from 0) of ``token``; IndexError if there are fewer."""
        if not 0 <= k < self.rank(token, self.n):
            raise IndexError(k)
        i = self._walk(token, 0) + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            i = self._find(level, one, i - self.zeros[level] if one else i)
        return i

    def _find(self, level: int, one: int, k: int) -> int:
        """Place of the k-th bit equal to ``one`` in a plane."""
        directory = self.ranks[level].astype(np.int64)
        before = directory if one else np.arange(len(directory)) * BLOCK - directory
        block = int(np.searchsorted(before, k, "right")) - 1
        packed = self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8]
        bits = np.unpackbits(packed, bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def decode(self, lo: int, hi: int) -> np.ndarray:
        """The ids of places lo..hi - 1, plane by plane for all of them at once."""
        places = np.arange(lo, hi)
        out = np.zeros(hi - lo, np.uint32)
        for level in range(self.bits):
            bits = np.unpackbits(self.planes[level], bitorder="little")[: self.n]
            ones = np.zeros(self.n + 1, np.int64)
            np.cumsum(bits, out=ones[1:])
            bit = bits[places].astype(bool)
            places = np.where(bit, self.zeros[level] + ones[places], places - ones[places])
            out = out << np.uint32(1) | bit
        return out

    def decode_all(self) -> np.ndarray:
        """All ids: from the last plane up, each split undone by its bits."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], bitorder="little")[: self.n].astype(bool)
            back = np.empty(self.n, kind)
            back[np.flatnonzero(~one)] = ids[: self.zeros[level]]
            back[np.flatnonzero(one)] = ids[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            ids = back
        return ids


def _directory(packed: np.ndarray) -> np.ndarray:
    """Ones before every block (one entry more than there are whole blocks)."""
    padded = np.zeros(-(-max(1, len(packed)) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
    padded[: len(packed)] = packed
    ones = np.bitwise_count(padded.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
    out = np.zeros(len(ones) + 1, np.uint32)
    np.cumsum(ones, out=out[1:])
    return out


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, bits: int, **header: int) -> bytes:
    """The bytes of a shard file."""
    matrix = WaveletMatrix.build(ids.astype(np.uint16 if bits <= 16 else np.uint32), bits)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    sections = [
        squeeze(np.array([d or 0 for d in doc_ids], "<i8").tobytes()),
        squeeze(np.array([d is None for d in doc_ids], np.uint8).tobytes()),
        squeeze(ends.astype("<i8").tobytes()),
    ]
    for plane, directory in zip(matrix.planes, matrix.ranks, strict=True):
        sections += [squeeze(plane.tobytes()), squeeze(directory.astype("<u4").tobytes())]
    head = json.dumps(header | {"n": matrix.n, "bits": bits, "documents": len(doc_ids), "zeros": matrix.zeros, "sections": [len(s) for s in sections]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *sections])


class Shard:
    """A shard file: ``doc_ids``, ``ends`` (ids up to the end of each document), and the matrix."""

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard file")
        at = len(MAGIC) + 4
        size = int.from_bytes(data[at - 4 : at], "little")
        self.header = h = json.loads(data[at : at + size])
        at += size
        expand, parts = zstandard.ZstdDecompressor().decompress, []
        for length in h["sections"]:
            parts.append(expand(data[at : at + length]))
            at += length
        plain = np.frombuffer(parts[0], "<i8").tolist()
        self.doc_ids = [None if null else d for d, null in zip(plain, parts[1], strict=True)]
        self.ends = np.frombuffer(parts[2], "<i8")
        planes = [np.frombuffer(p, np.uint8) for p in parts[3::2]]
        ranks = [np.frombuffer(p, "<u4") for p in parts[4::2]]
        self.matrix = WaveletMatrix(h["n"], h["bits"], planes, h["zeros"], ranks)


def read_shard(uri: str) -> Shard:
    with files.read_stream(uri) as f:
        return Shard(f.read())


class Encoder:
    """Ids of texts by the tokenizers library, as integers of ``width`` bytes.

    The tokenizer drops white space and never joins across it, and within a run of plain ASCII it lower-cases and then cuts
    between letters, single digits and signs. So a slice is cut into such pieces (a run between blanks that holds anything
    else stays whole), the distinct ones are found by Arrow's dictionary encoding, those not met before go through the
    library, and the ids of the texts are gathered from theirs. Up to KEPT_PIECES are kept from slice to slice.
    """

    def __init__(self, path: str, width: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core: the library's threads cost more than they bring
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = f"<u{width}"
        (mark,) = self._encode([MARK])
        self.mark = mark[0] if len(mark) == 1 else -1
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of new pieces: JOINED of them in one text, each followed by MARK, whose id ends theirs."""
        plain = [p for p in new if MARK not in p]
        other = [p for p in new if MARK in p]
        sizes, ids = [self.sizes], [self.ids]
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            found = self._encode([f" {MARK} ".join([*some[j : j + JOINED], ""]) for j in range(0, len(some), JOINED)])
            flat = np.fromiter(chain.from_iterable(found), np.int64, sum(map(len, found)))
            marked = flat == self.mark
            if self.mark < 0 or np.count_nonzero(marked) != len(some):  # a tokenizer that makes the mark of something else too
                plain, other = plain[:i], plain[i:] + other
                break
            sizes.append(np.diff(np.append(-1, np.flatnonzero(marked))) - 1)
            ids.append(flat[~marked].astype(self.kind))
        for i in range(0, len(other), 20_000):
            found = self._encode(other[i : i + 20_000])
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter(chain.from_iterable(found), self.kind, int(sizes[-1].sum())))
        self.known.update(zip(chain(plain, other), range(len(self.known), len(self.known) + len(new)), strict=True))
        self.sizes, self.ids = np.concatenate(sizes), np.concatenate(ids)

    def pieces(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """(the pieces of all texts, number of pieces up to the end of each text)."""
        raw, offsets = text_buffers(texts)
        kind = _KIND[raw]
        inside = kind != _BLANK
        cut = offsets[(offsets > 0) & (offsets < len(raw))]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[cut] = inside[cut]
        runs = np.flatnonzero(first)
        whole = np.zeros(len(raw), bool)  # in a run that is not plain
        if len(runs):
            odd = np.maximum.reduceat(kind == _ODD, runs)
            whole = np.repeat(odd, np.diff(np.append(runs, len(raw))))
            whole = np.concatenate([np.zeros(runs[0], bool), whole])
            turns = ~whole[1:] & inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
            first[1:] |= turns
        starts = np.flatnonzero(first)
        letters = np.where(whole, raw, _FOLD[raw])[inside]
        bounds = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, len(letters)).astype(np.int32)
        made = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(letters.tobytes()))
        return made.dictionary_encode(), np.searchsorted(starts, offsets[1:])

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids), with ``end`` after those of each text."""
        coded, last = self.pieces(texts)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) + len(distinct) > KEPT_PIECES:
            self.forget()
        place = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        if len(new):
            learnt = distinct[new].tolist()
            self._learn(learnt)
            place[new] = np.fromiter(map(self.known.__getitem__, learnt), np.int64, len(learnt))
        # The end id is one piece more, set after the last piece of each text.
        at = np.append((np.cumsum(self.sizes) - self.sizes)[place], len(self.ids))
        sizes, ids = np.append(self.sizes[place], 1), np.append(self.ids, np.array([end], self.kind))
        piece = np.insert(coded.indices.to_numpy().astype(np.int64), last, len(sizes) - 1)
        n = sizes[piece]
        total = np.append(0, np.cumsum(n))
        places = np.repeat(at[piece] - total[:-1], n) + np.arange(total[-1])
        return np.diff(total[np.append(0, last + np.arange(1, len(last) + 1))]), ids[places]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    """The worker's encoder: what one task has learnt serves the next."""
    if (path, width) not in _encoders:
        _encoders.clear()
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, bits: int = 16, roll: int = ROLL_IDS, partitions: int | None = None) -> DataFrame:
    """Write the shards; returns the committed manifest (file, shard, seq, documents, ids, bytes)."""
    spark = ship(docs.sparkSession)
    folder = files.new_folder(spark, "wavelet")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bounds = files.range_bounds(docs, "doc_id", partitions)
    ordered = files.by_range(rows, "doc_id", bounds, partitions).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if bits <= 16 else 4
        encode, shard, seq, before = encoder(tokenizer_path, width), TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def close() -> pa.RecordBatch:
            ends, ids = np.cumsum([len(x) for x in held]), np.concatenate(held)
            held.clear()  # the slices that the documents' ids are parts of
            data = pack(doc_ids, ends, ids, bits, shard=shard, seq=seq, before=before)
            uri = files.put(folder, f"shard-{shard:06d}-{seq:06d}.wm", lambda out: out.write(data))
            row = (uri, shard, seq, len(doc_ids), n, len(data))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=MANIFEST.names)

        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sizes, ids = encode(part.column("text"), end_id)
                for doc_id, own in zip(part.column("doc_id").to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    doc_ids.append(doc_id)
                    held.append(own)
                    n += len(own)
                    if n >= roll:
                        yield close()
                        seq, before, doc_ids, held, n = seq + 1, before + n, [], [], 0
        if doc_ids:
            yield close()

    return files.commit(ordered.mapInArrow(run, MANIFEST), folder)


def read_documents(manifest: DataFrame, id_type: T.DataType, partitions: int) -> DataFrame:
    """From the shard files, per document: doc_id, start, n_tokens, ids_crc32.

    ``start`` adds the ids of earlier range partitions (summed over a table of one row per partition, the
    bound of its broadcast), those of earlier shards of the partition (in the shard's header) and those
    before the document in its shard.
    """
    fields = [
        ("doc_id", id_type),
        ("n_tokens", T.LongType()),
        ("ids_crc32", T.LongType()),
        ("shard", T.IntegerType()),
        ("local", T.LongType()),
    ]

    def read(uri: str) -> Iterator[list]:
        s = read_shard(uri)
        ids = s.matrix.decode_all().astype("<u4")
        starts = np.concatenate([[0], s.ends[:-1]])
        yield [
            s.doc_ids,
            (s.ends - starts).tolist(),
            [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, s.ends, strict=True)],
            [s.header["shard"]] * len(s.doc_ids),
            (starts + s.header["before"]).tolist(),
        ]

    rows = files.map_files(manifest, read, fields, partitions)
    sums = manifest.groupBy("shard").agg(F.sum("ids").alias("total"))
    before = W.Window.orderBy("shard").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = sums.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
