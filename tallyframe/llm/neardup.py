"""MinHash near-duplicates, with odd sketches to screen banded candidates and exact confirmation of links.

Two documents are linked if their sets of distinct k-word shingles have a Jaccard similarity of ``threshold``
percent or more; a document's component is the smallest doc_id it reaches over links.

1. One pass over the texts gives, per document, its set's size and 128-bit key, BANDS keys of ROWS minima each, and the
   odd sketch: all samples (j, minimum j) folded into SKETCH_BITS parity bits. Where two sets agree in a sample
   its bits cancel, so the ones in the XOR of two sketches tell how many samples differ.
2. Equal sets form a class; only its smallest doc_id goes on, so copies are never compared.
3. Representatives that share a band key form a bucket. Per bucket, everyone is held against one hub only: the
   member that meets the most others over all its buckets (the centre of a family of copies). That is one
   candidate per member and bucket, however large the bucket.
4. Sizes and odd sketches drop candidates far below the threshold (est. similarity under ``threshold`` / 100 -
   MARGIN, six standard errors); the others are confirmed on the full sets, made again from the texts. Each member
   is confirmed against its most similar hub first; the candidates that then still lie in different components follow.
5. Components of the confirmed links are found by alternating large-star and small-star steps. Buckets that
   hold several components go on: those of up to SMALL_BUCKET members are finished with all their pairs
   between different components (at most SMALL_BUCKET / 2 per member), larger ones take the centres of
   HUBS further components as hubs, and again, until a round finds no link between components. The rounds only
   save candidates.
6. All members of large buckets that still hold several components are then finished with an exact join: two
   linked sets share a shingle among the rarest n - ceil(threshold * n / 100) + 1 of each (prefix filter, right in any
   one order of the shingles). The order is by the members of a shingle's cell, of CELLS cells of hashes, cells of one
   component only being the rarest (such shingles link nothing); so a set's rows are its prefix, not all its shingles.
   Every pair of different components that does so, and whose sizes and places leave the threshold possible, is
   screened and confirmed.

A pair at the threshold shares a band with probability 1 - 7e-6. Nothing is capped: the candidates of a round
are linear in the bucket rows, those of step 6 are as many as there are pairs that pass its filters. Joins on a
bucket or hub have one row per key on the other side, so a large group is split among tasks; a shingle of many
members is split into parts of PART members.

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; a text of fewer than k words is one shingle; null, empty and
blank texts have no shingles and are linked with nothing. A null doc_id is linked with nothing, has a null
component and is kept. Rows that share a doc_id but not the text count as one document where they represent a
class. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tallyframe.llm.common import map_batches
from tallyframe.llm.words import mix, shingle_sets, slices
from tallyframe.session import cut_lineage

ROWS, BANDS = 5, 30
SKETCH_BITS = 512
MARGIN = 0.2
SMALL_BUCKET, HUBS = 32, 1
PART = 256
CELLS, BLOCKS = 1 << 20, 64

_random = np.random.default_rng(77)
_A = _random.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_B = _random.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_C = _random.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)


def minima(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(sets, samples) minima of the sets that begin at ``starts`` (none empty) in ``flat``."""
    low = (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), len(_A)), np.uint32)
    for j in range(len(_A)):
        x = (low ^ _B[j]) * _A[j]
        x ^= x >> np.uint32(15)
        x *= _C[j]
        out[:, j] = np.minimum.reduceat(x, starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """(sets, BANDS) keys; the band's number is part of the key."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS)).copy()
    grouped = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, r])
    return keys


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """(sets, SKETCH_BITS / 64) parity words of all samples."""
    n, samples = least.shape
    place = mix(least.astype(np.uint64) + (np.arange(1, samples + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    flips = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + place.astype(np.int64)).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(bool).reshape(n, SKETCH_BITS), axis=1).view(np.uint64)


def similarity(differing: F.Column) -> F.Column:
    """Estimated Jaccard similarity from the ones in the XOR of two odd sketches."""
    share = F.least(2 * differing / F.lit(float(SKETCH_BITS)), F.lit(0.999))
    return 1 + F.lit(SKETCH_BITS / 2) * F.log(1 - share) / F.lit(2.0 * ROWS * BANDS)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, key1, key2, sketch, bands) of every document row; null arrays where there are no shingles."""
    longs = T.ArrayType(T.LongType())
    fields = [
        ("doc_id", docs.schema["doc_id"].dataType),
        ("n", T.LongType()),
        ("key1", T.LongType()),
        ("key2", T.LongType()),
        ("sketch", longs),
        ("bands", longs),
    ]

    def lists(values: np.ndarray, full: np.ndarray) -> pa.Array:
        width = values.shape[1]
        ends = np.concatenate([[0], np.cumsum(full * width)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().view(np.int64)), mask=pa.array(~full))

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in slices(batch, "text", 2 << 20):
            sets = list(shingle_sets(part.column("text"), k))
            n = np.array([len(s) for s in sets], np.int64)
            full = n > 0
            keys = np.zeros((2, len(sets)), np.uint64)
            least = np.zeros((0, ROWS * BANDS), np.uint32)
            if full.any():
                flat = np.concatenate(sets)
                starts = (np.cumsum(n) - n)[full]
                for i, salt in enumerate((0x1B873593CC9E2D51, 0x52DCE729DA3B1E47)):
                    keys[i, full] = np.add.reduceat(mix(flat ^ np.uint64(salt)), starts)
                least = minima(flat, starts)
            yield [part.column("doc_id"), n, *keys.view(np.int64), lists(odd_sketches(least), full), lists(band_keys(least), full)]

    return map_batches(docs.select("doc_id", "text"), run, fields)


def representatives(sketched: DataFrame) -> DataFrame:
    """(id, n, sketch, bands) of the smallest doc_id of each class of equal sets."""
    first = sketched.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key1", "key2").agg(F.min("doc_id").alias("doc_id"))
    return sketched.join(first, ["key1", "key2", "doc_id"]).select(F.col("doc_id").alias("id"), "n", "sketch", "bands")


def buckets(reps: DataFrame) -> DataFrame:
    """(key, id, size, weight) of band keys that representatives share; weight: members of all its buckets."""
    rows = reps.select("id", F.explode("bands").alias("key")).distinct()
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    rows = rows.join(shared, "key")
    return rows.join(rows.groupBy("id").agg(F.sum("size").alias("weight")), "id")


def _best(columns: list[str], rows: DataFrame) -> DataFrame:
    """The heaviest member (smallest id on ties) of each group."""
    best = rows.groupBy(*columns).agg(F.max(F.struct("weight", (-F.col("id")).alias("back"))).alias("best"))
    return best.select(*columns, (-F.col("best.back")).alias("hub"), F.col("best.weight").alias("hub_weight"))


def screened(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """(id, hub, likeness) of the distinct pairs whose sizes and odd sketches leave the threshold possible."""
    thin = reps.select("id", "n", "sketch")
    other = thin.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
    both = pairs.select("id", "hub").distinct().join(thin, "id").join(other, "hub")
    differing = F.aggregate(
        F.zip_with("sketch", "hub_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x
    )
    both = both.filter(100 * F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n"))
    both = both.select("id", "hub", similarity(differing).alias("likeness"))
    return both.filter(F.col("likeness") >= threshold / 100 - MARGIN)


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """The (id, hub) pairs that are links on their full sets."""
    kind = pairs.schema["id"].dataType
    left = texts.select(F.col("doc_id").alias("id"), F.col("text").alias("one"))
    right = texts.select(F.col("doc_id").alias("hub"), F.col("text").alias("two"))
    rows = pairs.select("id", "hub").join(left, "id").join(right, "hub").select("id", "hub", "one", "two")

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in slices(batch, "one"):
            hubs = part.column("two").dictionary_encode()  # a hub's text is hashed once for its run of rows
            sets = list(shingle_sets(hubs.dictionary, k))
            own = shingle_sets(part.column("one"), k)
            keep = []
            for i, (a, h) in enumerate(zip(own, hubs.indices.to_pylist(), strict=True)):
                b = sets[h]
                same = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * same >= threshold * (len(a) + len(b) - same):
                    keep.append(i)
            keep = pa.array(keep, pa.int64())
            yield [part.column("id").take(keep), part.column("hub").take(keep)]

    return map_batches(rows, run, [("id", kind), ("hub", kind)])


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) // np.uint64((1 << 64) // CELLS)).astype(np.int64)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How many ``shingles`` of ``sets`` (component, shingles) fall in each of CELLS cells; 0 where all are of one component."""
    width = CELLS // BLOCKS
    parts = pa.schema([("block", pa.int32()), ("cells", pa.binary()), ("n", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())])
    sums = pa.schema([("block", pa.int32()), ("n", pa.binary())])
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lo, hi = np.zeros(CELLS, np.int64), np.full(CELLS, most), np.full(CELLS, least)
        for batch in batches:
            shingles = batch.column("shingles")
            cell = _cells(shingles.flatten().to_numpy())
            component = np.repeat(batch.column("component").to_numpy(), shingles.value_lengths().to_numpy())
            np.add.at(n, cell, 1)
            np.minimum.at(lo, cell, component)
            np.maximum.at(hi, cell, component)
        for block in range(BLOCKS):
            own = np.flatnonzero(n[block * width : (block + 1) * width])
            if len(own):
                at = own + block * width
                row = (block, own.tobytes(), n[at].tobytes(), lo[at].tobytes(), hi[at].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, parts, strict=True)], schema=parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, lo, hi = held.setdefault(block, (np.zeros(width, np.int64), np.full(width, most), np.full(width, least)))
                own, more, low, high = (np.frombuffer(x, np.int64) for x in row)
                n[own] += more
                lo[own] = np.minimum(lo[own], low)
                hi[own] = np.maximum(hi[own], high)
        for block, (n, lo, hi) in held.items():
            n = np.where(lo < hi, np.minimum(n, np.iinfo(np.uint32).max), 0).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([n.tobytes()])], schema=sums)

    rows = sets.select(F.col("component").cast("long").alias("component"), "shingles")
    rows = rows.mapInArrow(count, "block int, cells binary, n binary, lo binary, hi binary").repartition(BLOCKS, "block")
    out = np.zeros((BLOCKS, width), np.uint32)
    for row in rows.mapInArrow(add, "block int, n binary").collect():  # CELLS numbers, however many sets there are
        out[row.block] = np.frombuffer(row.n, "<u4")
    return out.ravel()


def prefixes(sets: DataFrame, k: int, threshold: int) -> DataFrame:
    """(id, component, n, shingle, place) of the rarest shingles of the sets (id, component, text) that may link them to another component."""
    spark, kind, component = sets.sparkSession, sets.schema["id"].dataType, sets.schema["component"].dataType
    fields = [("id", kind), ("component", component), ("shingles", T.ArrayType(T.LongType()))]

    def make(batch: pa.RecordBatch) -> Iterator[list]:
        for part in slices(batch, "text", 2 << 20):
            made = list(shingle_sets(part.column("text"), k))
            n = np.array([len(s) for s in made], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
            yield [part.column("id"), part.column("component"), lists]

    made = cut_lineage(map_batches(sets.select("id", "component", "text"), make, fields), "sets")
    often = spark.sparkContext.broadcast(frequencies(made))

    def rarest(batch: pa.RecordBatch) -> Iterator[list]:
        shingle = batch.column("shingles").flatten().to_numpy()
        n = batch.column("shingles").value_lengths().to_numpy().astype(np.int64)
        owner, members = np.repeat(np.arange(len(n)), n), often.value[_cells(shingle)]
        by = np.lexsort((shingle, members, owner))
        place = np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n) + 1
        kept = (members[by] > 0) & (place <= (n + threshold * n * -1 // 100 + 1)[owner])
        by, own = by[kept], pa.array(owner[kept])
        yield [batch.column("id").take(own), batch.column("component").take(own), n[owner[kept]], shingle[by], place[kept]]

    fields = [("id", kind), ("component", component), ("n", T.LongType()), ("shingle", T.LongType()), ("place", T.LongType())]
    return cut_lineage(map_batches(made, rarest, fields), "prefixes")


def across(sets: DataFrame, k: int, threshold: int) -> DataFrame:
    """The (id, hub) pairs of different components of ``sets`` (id, component, text) that can be links: none is left out."""
    rows = prefixes(sets, k, threshold)
    mixed = rows.groupBy("shingle").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = mixed.filter("lo <> hi").select("shingle", F.ceil(F.col("members") / PART).alias("parts"))
    rows = rows.join(mixed, "shingle")
    one = rows.withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts")
    two = rows.select(
        "shingle",
        F.col("id").alias("hub"),
        F.col("component").alias("hub_component"),
        F.col("n").alias("hub_n"),
        F.col("place").alias("hub_place"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
    )
    # what the sets can share from this shingle on, against the share that the threshold asks for
    possible = (100 + threshold) * (1 + F.least(F.col("n") - F.col("place"), F.col("hub_n") - F.col("hub_place"))) >= threshold * (F.col("n") + F.col("hub_n"))
    pairs = one.join(two, (one["shingle"] == two["shingle"]) & (one["part"] == two["part"]) & (F.col("id") < F.col("hub")) & (F.col("component") != F.col("hub_component")) & possible)
    return pairs.select("id", "hub").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id of ``edges`` (id, hub): the smallest id connected with it."""
    both = edges.select(F.col("id").alias("u"), F.col("hub").alias("v")).filter("u <> v")
    edges = cut_lineage(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(edges):
        sym = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sym.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = cut_lineage(small, "edges")
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every id points at one smaller id that points nowhere: then the components are found."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` (id, component) after the further links ``more`` (id, hub) between its components."""
    own = found.select("id", "component")
    ends = more.join(own, "id", "left").select(F.coalesce("component", "id").alias("a"), "id", "hub")
    ends = ends.join(own.withColumnsRenamed({"id": "hub", "component": "b"}), "hub", "left")
    ends = ends.select("a", F.coalesce("b", "hub").alias("b"))
    joined = components(ends.select(F.col("a").alias("id"), F.col("b").alias("hub")))
    joined = cut_lineage(joined, "joined").select(F.col("id").alias("component"), F.col("component").alias("smaller"))
    moved = own.join(joined, "component", "left").select("id", F.coalesce("smaller", "component").alias("component"))
    alone = joined.select(F.col("component").alias("id"), F.col("smaller").alias("component")).join(own, "id", "left_anti")
    return cut_lineage(moved.union(alone), "components")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are not known to be in one component."""
    ends = pairs.select("id", "hub").join(found.withColumnRenamed("component", "a"), "id", "left")
    ends = ends.join(found.select(F.col("id").alias("hub"), F.col("component").alias("b")), "hub", "left")
    return ends.filter(F.coalesce("a", "id") != F.coalesce("b", "hub")).select("id", "hub")


def links(docs: DataFrame, sketched: DataFrame, k: int, threshold: int) -> DataFrame | None:
    """(id, component) of the representatives that are linked with another; None without candidates."""
    reps = cut_lineage(representatives(sketched), "reps")
    bucketed = cut_lineage(buckets(reps), "buckets")
    members = bucketed.select(F.col("id").alias("doc_id")).distinct()
    # a sort-merge join at every size: the ids grow with the documents, so no plan should rest on their broadcast
    texts = cut_lineage(docs.select("doc_id", "text").join(members.hint("merge"), "doc_id", "left_semi").distinct(), "texts")

    def linked(pairs: DataFrame) -> DataFrame:
        return cut_lineage(confirmed(pairs, texts, k, threshold), "links")

    centre = _best(["key"], bucketed)
    near = cut_lineage(screened(bucketed.join(centre, "key").filter("id <> hub"), reps, threshold), "near")
    nearest = near.groupBy("id").agg(F.max_by("hub", F.struct("likeness", "hub")).alias("hub"))
    found = cut_lineage(components(linked(nearest)), "components")
    found = merged(found, linked(_apart(near.join(nearest, ["id", "hub"], "left_anti"), found)))
    open_rows, used, first = bucketed, centre.select("key", "hub"), True
    while True:
        labelled = open_rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        labelled = cut_lineage(labelled.select("key", "id", "size", "weight", "component"), "labelled")
        mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
        rest = cut_lineage(labelled.join(mixed.select("key"), "key", "left_semi"), "rest")
        pairs = []
        if first:
            one = rest.filter(F.col("size") <= SMALL_BUCKET)
            two = one.select("key", F.col("id").alias("hub"), F.col("component").alias("hub_component"))
            pairs.append(one.join(two, "key").filter("id < hub AND component <> hub_component").select("id", "hub"))
        large = rest.filter(F.col("size") > SMALL_BUCKET)
        centres = _best(["key", "component"], large.join(used, (large["key"] == used["key"]) & (large["id"] == used["hub"]), "left_anti"))
        order = W.Window.partitionBy("key").orderBy(F.desc("hub_weight"), "hub")
        centres = centres.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HUBS)
        centres = cut_lineage(centres.select("key", "hub", F.col("component").alias("hub_component")), "centres")
        pairs.append(large.join(centres, "key").filter("component <> hub_component").select("id", "hub"))
        more = linked(screened(pairs[0] if len(pairs) == 1 else pairs[0].union(pairs[1]), reps, threshold))
        if more.isEmpty():
            break
        found = merged(found, more)
        used = cut_lineage(used.union(centres.select("key", "hub")), "used")
        open_rows, first = large.drop("component"), False
    left = large.select("id", "component").distinct()
    if left.isEmpty():
        return found
    sets = left.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    return merged(found, linked(screened(across(sets, k, threshold), reps, threshold)))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept."""
    sketched = cut_lineage(sketch(docs, k), "sketched")
    found = links(docs, sketched, k, threshold).withColumnRenamed("id", "class_id")
    thin = sketched.select("doc_id", "n", "key1", "key2")
    first = thin.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key1", "key2").agg(F.min("doc_id").alias("class_id"))
    classes = first.join(found, "class_id", "left").select("key1", "key2", F.coalesce("component", "class_id").alias("component"))
    classes = classes.select(F.col("key1").alias("k1"), F.col("key2").alias("k2"), "component")
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    rows = thin.join(classes, linkable & (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")), "left")
    own = F.coalesce("component", "doc_id")
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )
