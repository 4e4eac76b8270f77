"""Collocations: phrases of two to four words whose words occur together more often than apart, mined from stripes.

A stripe keys an associative counter by a prefix (one to three words): how often each next word followed it inside a
piece of text. Tasks build the stripes of their texts, stripes of one prefix are merged by adding them element by
element, and a merged stripe holds at once the counts of the prefix's extensions, the prefix's own total (a position at
the end of a piece counts under the empty next word) and the largest extension, which decides whether the prefix is
subsumed to its right.

* A stripe is dealt out in PARTS sub-stripes by a hash of the next word, so that the stripe of a word that makes a third
  of all text is neither one row nor one task. Totals and maxima of sub-stripes are added up afterwards.
* Stripes of two and three words are built only where every phrase of one word less may be frequent: a bitmap of
  2**BITS bits (a fixed size, whatever the data) holds the frequent ones by hash. A wrong bit costs work, never a
  result: counts are made of the words themselves, and what the bitmap leaves out cannot reach the least count.
* Texts longer than FLUSH are cut between pieces, so no phrase is lost and memory stays a multiple of FLUSH.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``. All counts are
per language. A null or empty text has no words; a null language counts as ``und``; a null doc_id and repeated rows
count as any row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import input_bytes, release, ship
from tallyframe.llm.words import mix
from tallyframe.session import cut_lineage

#: Words of a phrase, occurrences of a candidate, percent of its count at which a longer one subsumes it.
LONGEST, LEAST, SUBSUMED = 4, 30, 80
SCALE = 2_000_000
NO_LANGUAGE = "und"
PARTS = 16
FLUSH = 4 << 20
#: Bytes of input whose stripes a task merges: a task that reads texts sends one block to each bucket, so their number
#: follows the data and not the session.
BUCKET, LEAST_BUCKETS = 8 << 20, 8
BITS = 27
CHUNK_BITS = 16

#: Byte classes (0: of a word, 1: between words, 2: between pieces) and lower case of A-Z.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def tokenize(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word ids, distinct words, whether the word before is in the same piece) of lower-cased texts."""
    kind = _CLASS[raw]
    word = kind == 0
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    breaks = (kind == 2).astype(np.int32)
    breaks[inner] += 1  # at the first byte of a text: counted from its first word on
    piece = np.cumsum(breaks, dtype=np.int32)[starts]
    letters = _FOLD[raw[word]]
    at = (np.cumsum(word, dtype=np.int64) - word)[starts]
    bounds = np.append(at, len(letters)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(letters.tobytes())])
    coded = words.dictionary_encode()
    joined = np.zeros(len(starts), bool)
    joined[1:] = piece[1:] == piece[:-1]
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, joined


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang)
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words.to_pylist()], np.uint64)


def _extend(h: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0xD6E8FEB86659FD93) + nxt)


def _marked(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = h >> np.uint64(64 - BITS)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def stripes(raw: np.ndarray, offsets: np.ndarray, k: int, lang: str, bitmap: np.ndarray | None) -> tuple:
    """The stripes of k-word prefixes of some texts: (prefix words, size of each, next words, counts, hash of next).

    ``bitmap`` marks the phrases of k words that may be frequent; without one all prefixes count.
    """
    ids, words, joined = tokenize(raw, offsets)
    n, size = len(ids), len(words)
    hashed = word_hashes(words, lang)
    if k == 1:
        prefix = ids
        nxt = np.full(n, size, np.int64)  # the empty next word at the end of a piece
        nxt[:-1] = np.where(joined[1:], ids[1:], size)
    else:
        m = max(n - k, 0)  # positions of phrases of k + 1 words
        run = np.ones(m, bool)
        for j in range(1, k + 1):
            run &= joined[j : j + m]
        at = np.flatnonzero(run)
        for shift in (0, 1):  # both phrases of k words inside must be marked
            h = hashed[ids[at + shift]]
            for j in range(1, k):
                h = _extend(h, hashed[ids[at + shift + j]])
            at = at[_marked(h, bitmap)]
        prefix, firsts = ids[at], []
        for j in range(1, k):  # dense ids of the prefixes, exact
            seen, prefix = np.unique(prefix * size + ids[at + j], return_inverse=True)
            firsts = [*([seen // size] if j == 1 else (f[seen // size] for f in firsts)), seen % size]
        nxt = ids[at + k]
    code = np.sort(prefix * (size + 1) + nxt)
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    where = np.flatnonzero(new)
    counts = np.diff(np.append(where, len(code)))
    owner, nxt = code[where] // (size + 1), code[where] % (size + 1)
    part = np.append(hashed, np.uint64(0))[nxt] % np.uint64(PARTS)
    names = [owner] if k == 1 else [f[owner] for f in firsts]
    follow = pa.array(np.where(nxt == size, 0, nxt), mask=nxt == size)
    return names, words, words.take(follow), counts, part, _stripe_hash(names, hashed)


def _stripe_hash(names: list[np.ndarray], hashed: np.ndarray) -> np.ndarray:
    return reduce(_extend, [hashed[f] for f in names])


def _blocks(buckets: int, made: tuple) -> Iterator[tuple[int, bytes]]:
    """The entries dealt out by prefix and part: (bucket, packed prefixes, next words and counts)."""
    names, words, follow, counts, part, h = made
    bucket = (mix(h + part) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [*(words.take(pa.array(f[order])) for f in names), follow.take(pa.array(order)), pa.array(counts[order], pa.int64())]
    batch = pa.RecordBatch.from_arrays(columns, [*(f"p{i}" for i in range(len(names))), "next", "count"])
    pack = zstandard.ZstdCompressor(level=1)
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch.slice(bounds[b], bounds[b + 1] - bounds[b]))
        yield b, pack.compress(sink.getvalue())


def _texts(column: pa.Array) -> Iterator[tuple[int, bytes]]:
    """(row, text) with texts longer than FLUSH cut after a separator of pieces."""
    for row, value in enumerate(column.cast(pa.large_binary())):
        text = value.as_buffer()
        if text is None or not text.size:
            continue
        if text.size <= FLUSH:
            yield row, text.to_pybytes()
            continue
        whole = np.frombuffer(text, np.uint8)
        start = 0
        while start < len(whole):
            end = start + FLUSH
            while end < len(whole):
                found = np.flatnonzero(_CLASS[whole[end : end + FLUSH]] == 2)
                if len(found):
                    end += int(found[0]) + 1
                    break
                end += FLUSH
            yield row, whole[start:end].tobytes()
            start = end


def _emit(k: int, buckets: int, known: Broadcast | None):
    """The function of a task: texts -> blocks of stripes, combined per language over about FLUSH bytes."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("block", pa.binary())])

    def flush(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        bitmap = np.frombuffer(known.value, np.uint8) if known else None
        rows = list(_blocks(buckets, stripes(raw, offsets, k, lang, bitmap)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for row, text in _texts(batch.column("text")):
                lang = langs[row]
                held.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= FLUSH or sum(size.values()) >= 2 * FLUSH:
                    largest = max(size, key=size.get)
                    del size[largest]
                    yield from flush(largest, held.pop(largest))
        for lang, texts in held.items():
            yield from flush(lang, texts)
        held.clear()
        release()

    return run


def _merge(k: int, least: int):
    """The function of a task: sub-stripes of equal prefix and part added element by element.

    Gives the extensions with ``least`` occurrences or more and, for one-word prefixes, the total of each sub-stripe.
    """
    schema = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
    prefix = [f"p{i}" for i in range(k)]

    def rows(lang: str, phrases: pa.Array, words: int, f: pa.Array) -> pa.RecordBatch:
        n = len(phrases)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([words] * n, pa.int32()), phrases.cast(pa.string()), f], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        for batch in batches:
            for lang, block in zip(batch.column("lang").to_pylist(), batch.column("block").to_pylist(), strict=True):
                held.setdefault(lang, []).append(block)
        unpack = zstandard.ZstdDecompressor()
        for lang in list(held):
            table = pa.concat_tables([pa.ipc.open_stream(unpack.decompress(b)).read_all() for b in held.pop(lang)])
            merged = table.combine_chunks().group_by([*prefix, "next"], use_threads=False).aggregate([("count", "sum")])
            if k == 1:
                total = merged.group_by(prefix, use_threads=False).aggregate([("count_sum", "sum")]).combine_chunks()
                for batch in total.to_batches():
                    yield rows(lang, batch.column("p0"), 1, batch.column("count_sum_sum"))
            often = merged.filter(pc.and_(pc.is_valid(merged["next"]), pc.greater_equal(merged["count_sum"], least)))
            for batch in often.combine_chunks().to_batches():
                phrase = pc.binary_join_element_wise(*(batch.column(c) for c in [*prefix, "next"]), b" ")
                yield rows(lang, phrase, k + 1, batch.column("count_sum"))
            del table, merged, often
        release()

    return run


def _bitmap(phrases: DataFrame) -> Broadcast:
    """A bitmap of 2**BITS bits with the hashes of ``phrases``, made in chunks by the tasks and broadcast: its size
    does not depend on the data."""
    spark = phrases.sparkSession
    inside = (1 << CHUNK_BITS) - 1

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                h = word_hashes(pa.array([w.encode() for w in phrase.split(" ")]), lang)
                at.append(int(reduce(_extend, [h[j : j + 1] for j in range(len(h))])[0]) >> (64 - BITS))
            yield pa.RecordBatch.from_arrays([pa.array([x >> CHUNK_BITS for x in at], pa.int64()), pa.array([x & inside for x in at], pa.int32())], ["chunk", "bit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, bit = batch.column("chunk").to_numpy(), batch.column("bit").to_numpy()
            for c in np.unique(chunk).tolist():
                chunks.setdefault(c, np.zeros(1 << CHUNK_BITS, bool))[bit[chunk == c]] = True
        for c, on in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    ship(spark)
    made = phrases.select("lang", "phrase").mapInArrow(bits, "chunk bigint, bit int").distinct().repartition("chunk").mapInArrow(fill, "chunk bigint, bits binary")
    whole = np.zeros(1 << (BITS - 3), np.uint8)
    width = 1 << (CHUNK_BITS - 3)
    for row in made.collect():
        whole[row.chunk * width : (row.chunk + 1) * width] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(whole.tobytes())


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, f) of all phrases of up to ``longest`` words with ``least`` occurrences, (lang, n) words)."""
    spark = ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang"), F.lit(NO_LANGUAGE)).alias("lang"), "text").filter("text IS NOT NULL")
    buckets = max(LEAST_BUCKETS, input_bytes(texts) // BUCKET)
    levels, known = [], None
    for k in range(1, longest):
        made = texts.mapInArrow(_emit(k, buckets, known), "lang string, bucket int, block binary")
        merged = made.repartition(buckets, "bucket").mapInArrow(_merge(k, least), "lang string, k int, phrase string, f bigint")
        level = cut_lineage(merged, f"stripes-{k}")
        if known:
            known.destroy()
        if k == 1:
            words = cut_lineage(level.filter("k = 1").groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")), "words")
            total = words.groupBy("lang").agg(F.sum("f").alias("n"))
            levels.append(words.filter(F.col("f") >= least))
            level = level.filter("k = 2")
        levels.append(level)
        known = _bitmap(level) if k + 1 < longest else None
    return reduce(DataFrame.unionByName, levels), total


def collocations(docs: DataFrame, top: int, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by score.

    A candidate cut after its first j words scores floor(2000000 a / (l + r)), with l and r the counts of both halves;
    its lowest-scoring cut counts (the smallest j on ties). Candidates inside a longer one with SUBSUMED percent of their
    count go. Products are decimals: they may pass 64 bits.
    """
    phrases, totals = frequent_phrases(docs, least, longest)
    words = F.split("phrase", " ")
    found = phrases.withColumn("words", words)

    def joined(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    candidates = found.filter("k >= 2")
    counts = phrases.select("lang", "phrase", "f")
    cuts = candidates.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "j", joined(F.lit(1), F.col("j")).alias("head"), joined(F.col("j") + 1, F.col("k") - F.col("j")).alias("rest"))
    head = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rest = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(head, ["lang", "head"]).join(rest, ["lang", "rest"])
    score = F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    cuts = cuts.withColumn("score", score)
    worst = F.min(F.struct("score", "j", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(worst.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # The largest longer candidate around each phrase: (start, length) of every shorter phrase inside one.
    longer = found.filter("k >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    longer = longer.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)))
    inside = longer.select("lang", joined(F.col("start"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    subsumed = F.expr(f"cast(100 as decimal(10,0)) * cast(around as decimal(20,0)) >= cast({SUBSUMED} as decimal(10,0)) * cast(a as decimal(20,0))")
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(subsumed, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(top: int, least: int = LEAST) -> str:
    """DuckDB SQL of ``collocations`` over documents (phrases of up to four words)."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, list_aggregate(list_slice(w, i, i + {k - 1}), 'string_agg', ' ') AS phrase"
        f" FROM (SELECT lang, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM p WHERE len(w) >= {k})"
        for k in range(1, LONGEST + 1)
    )
    return f"""
WITH d AS (
  SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), s AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d
), p AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM s
), g AS ({grams}
), f AS (
  SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= {least}
), t AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2
), x AS (
  SELECT lang, k, phrase, a, w, unnest(generate_series(1, k - 1)) AS j FROM c
), y AS (
  SELECT x.lang, x.phrase, x.a, j, hd.f AS l, rs.f AS r, (x.a * {SCALE}) // (hd.f + rs.f) AS score
  FROM x JOIN f hd ON hd.lang = x.lang AND hd.phrase = array_to_string(list_slice(w, 1, j), ' ')
         JOIN f rs ON rs.lang = x.lang AND rs.phrase = array_to_string(list_slice(w, j + 1, x.k), ' ')
), z AS (
  SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), u AS (
  SELECT lang, k, w, a, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k >= 3
), v AS (
  SELECT lang, w, a, m, unnest(generate_series(1, k - m + 1)) AS i FROM u
), o AS (
  SELECT lang, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, max(a) AS around FROM v GROUP BY ALL
), q AS (
  SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, encode(z.phrase)) AS rank
  FROM z LEFT JOIN o ON o.lang = z.lang AND o.phrase = z.phrase
  WHERE o.around IS NULL OR 100 * o.around < {SUBSUMED} * z.a
)
SELECT q.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, t.n,
       CAST(score AS BIGINT) AS score
FROM q JOIN t ON t.lang = q.lang WHERE rank <= {top}"""
