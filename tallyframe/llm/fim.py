"""Fill-in-middle rearrangement of documents, as a pipeline of pyarrow.compute steps over whole batches.

A text is cut into n units (code points). Two cuts drawn from the document's id divide it into prefix, middle and
suffix. Per batch:

1. the texts become a list array of units (one string per code point, over the same bytes, nothing copied);
2. the lists are flattened with the index of their parent, and ordinals are counted within each parent;
3. units are filtered by role (ordinal before the first cut, between the cuts, after them);
4. each role's units are rebuilt as lists, one per text, and joined;
5. the pieces and their markers are joined in the order of the document's form.

The units of a text longer than SEGMENT are taken in segments, whose pieces are joined in a second step: memory stays
a multiple of SEGMENT and of the text itself, however long it is.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` <S>suffix<P>prefix<M>middle, ``plain`` the text as it is (texts
that are empty or hold a marker, and the share of documents that the draw leaves plain). Both other forms can be
undone from output and form alone, as a text without markers meets none but its own.

A null text counts as empty; a null doc_id draws as the text "null"; rows with equal ids draw alike; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyframe.llm.common import map_batches
from tallyframe.llm.words import slices, text_buffers

#: The markers of the three parts, and the percentages of plain and of spm documents.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = "1"
#: Bytes of text whose units are expanded at a time.
SEGMENT = 1 << 20


def draws(ids: list, seed: str = SEED) -> np.ndarray:
    """Four numbers of 32 bits per id: the head of the sha256 of ``seed:id``."""
    heads = b"".join(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(heads, ">u4").reshape(-1, 4).astype(np.int64)


def units(raw: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """List array of the code points of each text; the strings lie over the same bytes."""
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)).astype(np.int32)
    bounds = np.searchsorted(at[:-1], offsets).astype(np.int32)
    points = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes()))
    return pa.ListArray.from_arrays(pa.array(bounds), points)


def join_role(flat: pa.Array, parents: np.ndarray, chosen: np.ndarray, n: int) -> pa.Array:
    """The units with role ``chosen``, rebuilt as one list per parent and joined."""
    kept = flat.filter(pa.array(chosen))
    sizes = np.bincount(parents[chosen], minlength=n)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), kept), "")


def _segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, text of each segment): texts cut after at most SEGMENT bytes, between code points."""
    bounds, owner = [0], []
    for text, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a > SEGMENT:
            cut = a + SEGMENT
            while cut > a + SEGMENT - 4 and raw[cut] & 0xC0 == 0x80:
                cut -= 1
            bounds.append(cut)
            owner.append(text)
            a = cut
        bounds.append(b)
        owner.append(text)
    return np.array(bounds, np.int64), np.array(owner, np.int64)


def split_roles(raw: np.ndarray, offsets: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[pa.Array]:
    """[prefix, middle, suffix] of every text: units before ``lo``, before ``hi`` and from ``hi`` on."""
    bounds, owner = _segments(raw, offsets)
    parts: list[list[pa.Array]] = [[], [], []]
    start, done, n = 0, 0, len(owner)
    while start < n:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + SEGMENT, side="right")) - 1)
        a, b = int(bounds[start]), int(bounds[end])
        lists = units(raw[a:b], bounds[start : end + 1] - a)
        flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        sizes = pc.list_value_length(lists).to_numpy()
        own = owner[start:end]
        before = np.cumsum(sizes) - sizes
        base = before - before[np.searchsorted(own, own)]  # a further segment of a text counts on from the one before
        if start and own[0] == owner[start - 1]:
            base[own == own[0]] += done
        ordinals = np.arange(len(flat)) - before[parents] + base[parents]
        text = own[parents]
        roles = (ordinals >= lo[text]).astype(np.int8) + (ordinals >= hi[text])
        for role in range(3):
            parts[role].append(join_role(flat, parents, roles == role, end - start))
        done = int(base[-1] + sizes[-1])
        start = end
    texts = np.searchsorted(owner, np.arange(len(offsets))).astype(np.int32)
    return [pc.binary_join(pa.ListArray.from_arrays(pa.array(texts), pa.concat_arrays(p)), "") if p else pa.array([], pa.string()) for p in parts]


def rearrange(batch: pa.RecordBatch) -> list:
    """doc_id, n, form, prefix_chars, middle_chars, output and restored text of each row."""
    texts = pc.fill_null(batch.column("text"), "").cast(pa.string())
    raw, offsets = text_buffers(texts)
    n = pc.utf8_length(texts).to_numpy().astype(np.int64)
    h = draws(batch.column("doc_id").to_pylist())
    first, second = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    lo, hi = np.minimum(first, second), np.maximum(first, second)
    marked = pc.or_(pc.match_substring(texts, PREFIX), pc.or_(pc.match_substring(texts, SUFFIX), pc.match_substring(texts, MIDDLE)))
    plain = (n == 0) | marked.to_numpy(zero_copy_only=False) | (h[:, 2] % 100 >= PLAIN_FROM)
    spm = h[:, 3] % 100 < SPM_BELOW
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
    prefix, middle, suffix = split_roles(raw, offsets, lo, hi)
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm_out = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(spm), spm_out, psm))
    chars = [pa.array(v, mask=plain) for v in (lo, hi - lo)]
    return [batch.column("doc_id"), n, form, *chars, output, restore(output, form)]


def restore(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts from outputs and forms: parts between the markers, put back in their order."""

    def cut(texts: pa.Array, marker: str) -> tuple[pa.Array, pa.Array]:
        halves = pc.split_pattern(texts, marker, max_splits=1)
        return pc.list_element(halves, 0), pc.list_element(halves, 1)

    whole = output.to_numpy(zero_copy_only=False).copy()
    for kind, second in (("psm", SUFFIX), ("spm", PREFIX)):
        rows = np.flatnonzero(pc.equal(form, kind).to_numpy(zero_copy_only=False))
        if len(rows):
            head, middle = cut(output.take(pa.array(rows)), MIDDLE)
            a, b = cut(pc.utf8_slice_codeunits(head, len(PREFIX)), second)
            prefix, suffix = (a, b) if kind == "psm" else (b, a)
            whole[rows] = pc.binary_join_element_wise(prefix, middle, suffix, "").to_numpy(zero_copy_only=False)
    return pa.array(whole, pa.string())


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and restored (the text, from output and form alone)."""
    fields = [
        ("doc_id", docs.schema["doc_id"].dataType),
        ("n", T.LongType()),
        ("form", T.StringType()),
        ("prefix_chars", T.LongType()),
        ("middle_chars", T.LongType()),
        ("output", T.StringType()),
        ("restored", T.StringType()),
    ]

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for piece in slices(batch, "text"):
            yield rearrange(piece)

    return map_batches(docs.select("doc_id", "text"), run, fields)


def oracle() -> str:
    """DuckDB SQL of the digests (columns of ``op12_fill_in_middle``)."""
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x
  FROM documents
), h AS (
  SELECT doc_id, text, n,
         CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS h4
  FROM d
), f AS (
  SELECT doc_id, text, n, least(c1, c2) AS lo, greatest(c1, c2) AS hi,
         CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                   OR h3 >= {PLAIN_FROM} THEN 'plain' WHEN h4 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, substr(text, 1, lo) AS prefix, substr(text, lo + 1, hi - lo) AS middle, substr(text, hi + 1) AS suffix FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CAST(CASE WHEN form <> 'plain' THEN lo END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN hi - lo END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                        ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p"""
