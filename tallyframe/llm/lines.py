"""Repeated runs of lines, found by winnowing and deleted where they come later. DataFrame operations only.

Lines are cut at \\n; lines without a word neither count nor break a run (they go if they lie inside a deleted
run). The window at a line is the shortest run of lines from it on with ``least`` words or more. A window is
deleted if the same window, line for line, occurs first at an earlier place that does not overlap it (places are
ordered by doc_id, then the text's hash, then the line): the first occurrence stays. All windows of a longer
repeated run are repeated, so the run goes as a whole, whatever its length.

1. Winnowing: seeds are shortest runs of ``least`` / 2 words or more; in each window the seed of smallest hash that
   lies wholly inside is the window's fingerprint. It depends on the window alone, so every place of a window selects it:
   two documents that share a run of ``least`` words are sure to share a fingerprint.
2. Fingerprints that occur twice or more name the documents that may hold a repeated run.
3. In those, positions are joined by the 128-bit hash of whole windows: matches extend both ways as far as
   consecutive windows match. The first place of a window is a minimum, so a passage that a third of all documents share
   is one row after the map side, and no pairs are made.
4. Windows that touch or overlap become one deleted stretch; the rest of the lines is joined again.

A null text stays null and an empty one empty; a null doc_id comes before all others; rows equal in doc_id and
text count as one document and are all treated alike; other columns are kept by ``drop_repeated_runs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

WORD = r"[^\\x20\\x09-\\x0D]+"
PREFIX = "__run_"  # of the columns that this module adds while it works


def _lengths(words: int) -> str:
    """For each line of ``arr``, how many lines the shortest run with ``words`` words has; 0: too few words left."""
    return f"""transform(arr, (s, i) -> aggregate(
        slice(arr, i + 1, {words}), named_struct('w', 0, 'c', 0),
        (a, x) -> IF(a.w >= {words}, a, named_struct('w', a.w + x.n, 'c', a.c + 1)),
        a -> IF(a.w >= {words}, a.c, 0)))"""


def _joined(start: str, count: str) -> str:
    """The line hashes of a run, as one string."""
    return f"array_join(transform(slice(arr, {start} + 1, {count}), x -> x.m), '')"


def fingerprints(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, th, arr, c, seeds) of every distinct document.

    arr: place, hash and words of the lines with words; c: lines of the window at each; seeds: hash and
    line of the windows' fingerprints.
    """
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = rows.withColumn(
        "arr",
        F.expr(
            f"""filter(transform(split(text, '\\n'), (x, p) ->
                named_struct('p', p, 'm', md5(x), 'n', regexp_count(x, '{WORD}'))), s -> s.n > 0)"""
        ),
    ).drop("text")
    rows = rows.withColumn("c", F.expr(_lengths(least))).withColumn("half", F.expr(_lengths(-(-least // 2))))
    rows = rows.withColumn("keys", F.expr(f"transform(half, (n, i) -> IF(n > 0, xxhash64({_joined('i', 'n')}), NULL))"))
    # transform(array(keys), ...)[0] names the keys, so that they are made once and not at each use in a lambda.
    seeds = """transform(array(keys), ks -> array_distinct(filter(transform(c, (n, a) -> IF(n > 0, array_min(filter(
        transform(sequence(0, n - 1), d -> IF(half[a + d] > 0 AND d + half[a + d] <= n,
            named_struct('k', ks[a + d], 'i', a + d), NULL)), s -> s IS NOT NULL)), NULL)), s -> s IS NOT NULL)))[0]"""
    return rows.withColumn("seeds", F.expr(seeds)).select("doc_id", "th", "arr", "c", "seeds")


def repeated_windows(marked: DataFrame) -> DataFrame:
    """(doc_id, th, runs) of the documents that lose lines; runs: first and last line number of the deleted stretches."""
    place = F.struct("doc_id", "th", "i").alias("at")
    seeds = marked.select("doc_id", "th", F.explode("seeds").alias("s")).select("doc_id", "th", F.col("s.k").alias("k"), F.col("s.i").alias("i"))
    twice = seeds.select("k", place).groupBy("k").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).filter("lo < hi").select("k")
    involved = seeds.join(twice, "k", "left_semi").select("doc_id", "th").distinct()
    involved = involved.select(F.col("doc_id").alias("d"), F.col("th").alias("t"))
    rows = marked.select("doc_id", "th", "arr", "c").join(involved, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_semi")
    whole = f"""filter(transform(c, (n, a) -> IF(n > 0, named_struct(
        'i', a, 'n', n, 'k', unhex(md5({_joined("a", "n")})), 'p', arr[a].p, 'q', arr[a + n - 1].p), NULL)), s -> s IS NOT NULL)"""
    windows = rows.select("doc_id", "th", F.explode(F.expr(whole)).alias("s")).select("doc_id", "th", "s.*").distinct()
    windows = cut_lineage(windows, "windows")
    first = windows.groupBy("k").agg(F.min(F.struct("doc_id", "th", "i", "n")).alias("first"), F.count("*").alias("places"))
    first = first.filter("places > 1").select("k", "first")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    later = windows.join(first, "k").filter(~same | (F.col("i") >= F.col("first.i") + F.col("first.n")))
    stretches = later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("p", "q"))).alias("w"))
    # A stretch begins at a window that starts after the one before has ended; windows are in order of both ends.
    begins = "filter(sequence(0, size(w) - 1), j -> j = 0 OR w[j].p > w[j - 1].q + 1)"
    return (
        stretches.withColumn("b", F.expr(begins))
        .withColumn("runs", F.expr("transform(b, (j, x) -> named_struct('p', w[j].p, 'q', IF(x + 1 < size(b), w[b[x + 1] - 1].q, w[size(w) - 1].q)))"))
        .select("doc_id", "th", "runs")
    )


def drop_repeated_runs(docs: DataFrame, least: int = 50, counts: bool = False) -> DataFrame:
    """``docs`` with the later repeated runs of lines cut out of ``text``.

    With ``counts`` two columns follow: n_lines and n_deleted (lines, those without words included).
    """
    marked = cut_lineage(fingerprints(docs, least), "lines")
    runs = repeated_windows(marked).select(*(F.col(c).alias(PREFIX + c) for c in ("doc_id", "th", "runs")))
    rows = docs.withColumn(PREFIX + "h", F.xxhash64("text"))
    joined = rows.join(runs, F.col("doc_id").eqNullSafe(F.col(PREFIX + "doc_id")) & (F.col(PREFIX + "h") == F.col(PREFIX + "th")), "left")
    r, lines = f"{PREFIX}runs", "split(text, '\\n')"
    kept = f"""flatten(transform(sequence(0, size({r})), j -> slice(x,
        IF(j = 0, 0, {r}[j - 1].q + 1) + 1,
        IF(j = size({r}), size(x), {r}[j].p) - IF(j = 0, 0, {r}[j - 1].q + 1))))"""
    text = F.expr(f"CASE WHEN text IS NULL OR {r} IS NULL THEN text ELSE transform(array({lines}), x -> array_join({kept}, '\\n'))[0] END")
    out = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    if counts:
        out.append(F.expr(f"IF(text IS NULL, 0, size({lines}))").cast("bigint").alias("n_lines"))
        out.append(F.expr(f"IF({r} IS NULL, 0, aggregate({r}, 0, (a, s) -> a + s.q - s.p + 1))").cast("bigint").alias("n_deleted"))
    return joined.select(*out)


#: DuckDB: the same windows by plain strings, over the table documents.
ORACLE_TEXT = r"""
WITH cut AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) AS p FROM documents),
spoken AS (SELECT doc_id, p, line, n, row_number() OVER w AS i, sum(n) OVER w AS upto FROM (
    SELECT doc_id, p, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM cut) WHERE n > 0
    WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
ended AS (SELECT a.doc_id, a.i, a.p, min(b.i) AS e, min(b.p) AS q FROM spoken a JOIN spoken b
    ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i < a.i + LEAST_WORDS AND b.upto >= a.upto - a.n + LEAST_WORDS GROUP BY ALL),
windows AS (SELECT a.doc_id, a.i, a.p, a.e, a.q, md5(string_agg(b.line, chr(10) ORDER BY b.i)) AS k FROM ended a JOIN spoken b
    ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.e GROUP BY ALL),
firsts AS (SELECT k, min((doc_id, i, e)) AS f FROM windows GROUP BY k),
later AS (SELECT w.* FROM windows w JOIN firsts USING (k) WHERE w.doc_id <> f[1] OR w.i > f[3]),
gone AS (SELECT DISTINCT c.doc_id, c.p FROM cut c JOIN later l ON c.doc_id = l.doc_id AND c.p BETWEEN l.p AND l.q),
kept AS (SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.p) AS text FROM cut c ANTI JOIN gone USING (doc_id, p) GROUP BY c.doc_id),
sizes AS (SELECT c.doc_id, count(*) AS n_lines, count(g.p) AS n_deleted FROM cut c LEFT JOIN gone g USING (doc_id, p) GROUP BY c.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle(least: int) -> str:
    return ORACLE_TEXT.replace("LEAST_WORDS", str(least))
