"""Quality rules with risk-controlled thresholds.

Every rule is a ratio in [0, 1] of a text (symbols, capitals, marks, repeated words, repeated lines); a rule
rejects what lies above its cutoff. Cutoffs come from labelled texts, per stratum (``lang``), for all rules together:

* a third of the labelled texts (by a hash of their doc_id) proposes a *path*: starting from cutoffs that reject nothing,
  each step lowers one rule's cutoff, the step with the best ratio of bad texts caught to good texts lost first, as long as
  it catches more than PENALTY times what it loses. All texts of that third propose: a step needs only the counts of the
  texts left by (stratum, rule, cell, label), which Spark adds up for all strata at once;
* all other labelled texts are the holdout. Along the path, the exact binomial tail P(Bin(n, risk) <= lost) of the n good
  holdout texts, of which the cutoffs up to that step reject ``lost``, is the p-value of "these cutoffs together reject
  more than their share of good texts";
* the walk stops at the first p-value above ``delta / strata``: fixed-sequence testing along the path, Bonferroni across
  strata, so with probability 1 - delta no stratum rejects more than ``risk`` of its good texts. One path is tested against
  the whole risk, so it is not divided among the rules;
* of the certified steps the last one counts: the path holds only steps that pay.

Only strata that can be certified at the final alpha count: for four strata, 183 good texts in the holdout at a risk of 2 %
and delta of 10 %. A stratum with fewer rejects nothing by the rules, as nothing could be guaranteed.

Every usable label has its part, in the path or in the holdout. Only counts reach the driver: per step at most GRID + 1 for
each stratum and rule, and, of the holdout, those per (stratum, step, label).
Label rows are used once per doc_id; a doc_id whose labels disagree is not used. Nulls and
empty texts have no words (and fail the base rule). A null lang is a stratum of its own. Repeated rows give
repeated rows; other columns are ignored (or kept by ``filter_quality``); empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import map_batches, ship
from tallyframe.llm.words import mix, slices, text_buffers, windows, words
from tallyframe.session import cut_lineage

RULES = ("symbols", "capitals", "marks", "repeats", "lines")
GRID = 200
PENALTY = 50
#: One labelled text in so many (by a hash of its doc_id) proposes a path; all others are the holdout.
FIT_SHARE = 3
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The symbols of the base count, and the marks that shout.
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?~^=_{}[]\\@"


def _member(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _MARK = _member(SYMBOLS), _member(MARKS)
_UPPER = _member(bytes(range(ord("A"), ord("Z") + 1)))
_LOWER = _member(bytes(range(ord("a"), ord("z") + 1)))
_SPACES = " \t\n\x0b\x0c\r"


def _lines(text: str) -> tuple[int, int]:
    """(lines with a word, those of them that equal an earlier line)."""
    found = [line for line in text.split("\n") if line.strip(_SPACES)]
    return len(found), len(found) - len(set(found))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of set bytes in each text."""
    running = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=running[1:])
    return running[offsets[1:]] - running[offsets[:-1]]


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts and rule ratios of every text."""
    raw, offsets = text_buffers(texts)
    starts, ends, hashes = words(raw, offsets, fold=False)
    bounds = np.searchsorted(starts, offsets)
    n_words = np.diff(bounds)
    spelled = np.zeros(len(raw) + 1, np.int8)
    spelled[starts] += 1
    spelled[ends] -= 1  # a word that starts where another ends (text boundary) adds up to 0
    in_word = np.cumsum(spelled[:-1], dtype=np.int8).astype(bool)
    begins = (raw & 0xC0) != 0x80
    word_chars = _per_text(in_word & begins, offsets)
    symbols = _per_text(_SYMBOL[raw], offsets)
    marks = _per_text(_MARK[raw], offsets)
    upper, lower = _per_text(_UPPER[raw], offsets), _per_text(_LOWER[raw], offsets)
    repeats = np.zeros(len(offsets) - 1, np.int64)
    grams = windows(hashes, WINDOW)
    if len(grams):
        row = np.searchsorted(bounds, np.arange(len(grams)), "right") - 1
        whole = np.flatnonzero(np.arange(len(grams)) + WINDOW <= bounds[row + 1])
        keyed = mix(grams[whole] + row[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keyed)
        ranked = keyed[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(ranked), bool)
        twice[1:] |= same
        twice[:-1] |= same
        cover = np.zeros(len(starts) + 1, np.int32)
        at = whole[order[twice]]
        cover[at] += 1
        np.subtract.at(cover, at + WINDOW, 1)
        covered = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(np.cumsum(cover[:-1]) > 0, out=covered[1:])
        repeats = covered[bounds[1:]] - covered[bounds[:-1]]
    lines = np.array([_lines(t or "") for t in texts.to_pylist()], np.int64).reshape(-1, 2)

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.minimum(1.0, part / np.maximum(whole, 1))

    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": word_chars,
        "n_symbols": symbols,
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": repeats,
        "symbols": share(symbols, word_chars),
        "capitals": share(upper, upper + lower),
        "marks": share(marks, word_chars),
        "repeats": share(repeats, n_words),
        "lines": share(lines[:, 1], lines[:, 0]),
    }


def _cells(found: dict[str, np.ndarray]) -> np.ndarray:
    """Grid cell 0..GRID of every rule's ratio: cell c holds ratios in (c - 1, c] / GRID."""
    return np.stack([np.ceil(found[r] * GRID - 1e-9) for r in RULES], axis=1).astype(np.int64)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, counts, cells) of every document row: one pass over the texts."""
    fields = [
        ("doc_id", docs.schema["doc_id"].dataType),
        ("lang", T.StringType()),
        *((c, T.LongType()) for c in COUNTS),
        ("cells", T.ArrayType(T.LongType())),
    ]

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in slices(batch, "text", 1 << 20):
            found = measure(part.column("text"))
            yield [part.column("doc_id"), part.column("lang"), *(found[c] for c in COUNTS), _cells(found).tolist()]

    return map_batches(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text"), run, fields)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def step_of(counts: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> tuple[int, int] | None:
    """The next step (rule, cutoff cell) of a path, from the good and bad texts left in each cell of a rule."""
    best = None
    for rule in range(len(RULES)):
        lost, caught = (left[::-1].cumsum()[::-1] for left in counts(rule))  # at or above a cell
        pays = caught[1:] > PENALTY * lost[1:]  # a cutoff at cell c rejects the cells from c + 1 on
        if not pays.any():
            continue
        ratio = np.where(pays, caught[1:] / (lost[1:] + 0.5), -1.0)
        at = int(np.flatnonzero(ratio == ratio.max())[-1])  # of equal ones the mildest
        step = (float(ratio[at]), -rule, at)
        if best is None or step > best:
            best = step
    return None if best is None else (-best[1], best[2])


def propose(cells: np.ndarray, good: np.ndarray) -> list[tuple[int, int]]:
    """The path (rule, cutoff cell) of a stratum: what each step rejects lies in cells above its cutoff."""
    left, path = np.ones(len(cells), bool), []

    def counts(rule: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.bincount(cells[left & of, rule], minlength=GRID + 1) for of in (good, ~good))

    while (step := step_of(counts)) is not None:
        path.append(step)
        left &= cells[:, step[0]] <= step[1]
    return path


def limits_of(spark: SparkSession, cutoffs: dict[str | None, list[int]]) -> DataFrame:
    """(stratum, limits): the cutoff cell of every rule."""
    return spark.createDataFrame(list(cutoffs.items()), "stratum string, limits array<bigint>")


def paths_of(fit: DataFrame, strata: list[str | None]) -> dict[str | None, list[tuple[int, int]]]:
    """The path of each of ``strata``, as ``propose`` makes it, from (lang, cells, good, bad): texts of these cells."""
    paths: dict[str | None, list[tuple[int, int]]] = {lang: [] for lang in strata}
    limits = {lang: [GRID] * len(RULES) for lang in strata}
    going = list(strata)
    while going:
        left = fit.join(F.broadcast(limits_of(fit.sparkSession, {lang: limits[lang] for lang in going})), F.col("lang").eqNullSafe(F.col("stratum")))
        left = left.filter(F.forall(F.zip_with("cells", "limits", lambda c, m: c <= m), lambda x: x))
        found = {lang: np.zeros((2, len(RULES), GRID + 1), np.int64) for lang in going}
        counted = left.select("lang", "good", "bad", F.posexplode("cells").alias("rule", "cell"))
        for r in counted.groupBy("lang", "rule", "cell").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect():
            found[r.lang][:, r.rule, r.cell] = r.good, r.bad
        steps = {lang: step_of(lambda rule, n=found[lang]: (n[0, rule], n[1, rule])) for lang in going}
        going = [lang for lang in going if steps[lang] is not None]
        for lang in going:
            rule, cell = steps[lang]
            paths[lang].append((rule, cell))
            limits[lang][rule] = min(cell, limits[lang][rule])
    return paths


def certified(lost: list[int], n: int, risk: float, alpha: float) -> int:
    """How many steps of a path are certified; ``lost``: the good holdout texts that each step is the first to reject."""
    total = 0
    for step, more in enumerate(lost):
        total += more
        if n == 0 or binomial_cdf(total, n, risk) > alpha:
            return step
    return len(lost)


def enough(risk: float, alpha: float) -> int:
    """Good holdout texts without which nothing can be certified."""
    return math.ceil(math.log(alpha) / math.log1p(-risk))


def thresholds(scored: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.1) -> dict[tuple[str | None, str], int]:
    """Certified cutoff cells by (stratum, rule)."""
    once = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .filter("quality = other AND quality IN (0, 1)")
        .select("doc_id", "quality")
    )
    marked = scored.select("doc_id", "lang", "cells").dropDuplicates(["doc_id", "lang", "cells"]).join(once, "doc_id")
    draw = F.xxhash64(F.lit("fit"), "doc_id")
    marked = cut_lineage(marked.select("lang", "cells", "quality", (F.pmod(draw, F.lit(FIT_SHARE)) == 0).alias("fit")), "labelled")
    fit = marked.filter("fit").groupBy("lang", "cells").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    fit = cut_lineage(fit, "fit")
    seen = [r.lang for r in fit.select("lang").distinct().collect()]
    holdout = marked.filter("NOT fit")
    n = {r.lang: int(r.n) for r in holdout.groupBy("lang").agg(F.sum("quality").alias("n")).collect() if r.n}
    sizes = sorted((n[lang] for lang in seen if lang in n), reverse=True)
    strata = max([i for i, size in enumerate(sizes, 1) if size >= enough(risk, delta / i)], default=0)
    if not strata:
        return {}
    alpha = delta / strata
    paths = paths_of(fit, [lang for lang in seen if n.get(lang, 0) >= enough(risk, alpha)])
    steps = [(lang, i, rule, cell) for lang, path in paths.items() for i, (rule, cell) in enumerate(path)]
    if not steps:
        return {}
    walk = marked.sparkSession.createDataFrame(steps, "stratum string, step int, rule int, cell bigint")
    walk = walk.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("step", "rule", "cell"))).alias("walk"))
    met = holdout.filter("quality = 1").join(F.broadcast(walk), F.col("lang").eqNullSafe(F.col("stratum")))
    rejecting = F.filter("walk", lambda x: F.get(F.col("cells"), x["rule"]) > x["cell"])
    first = met.select("lang", F.get(rejecting, F.lit(0))["step"].alias("step")).filter("step IS NOT NULL")
    lost = {(r.lang, r.step): int(r["count"]) for r in first.groupBy("lang", "step").count().collect()}
    found: dict[tuple[str | None, str], int] = {}
    for lang, path in paths.items():
        for rule, cell in path[: certified([lost.get((lang, i), 0) for i in range(len(path))], n[lang], risk, alpha)]:
            found[lang, RULES[rule]] = min(cell, found.get((lang, RULES[rule]), GRID + 1))
    return found


def failed() -> F.Column:
    """The base rule: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(scored: DataFrame, cutoffs: dict[tuple[str | None, str], int]) -> DataFrame:
    """``scored`` with base_failed, rules_failed (names) and kept."""
    if cutoffs:
        limits = limits_of(scored.sparkSession, {lang: [cutoffs.get((lang, r), GRID + 1) for r in RULES] for lang in {lang for lang, _ in cutoffs}})
        scored = scored.join(F.broadcast(limits), scored["lang"].eqNullSafe(limits["stratum"]), "left")
    else:
        scored = scored.withColumn("limits", F.lit(None).cast("array<bigint>"))
    names = F.array(*map(F.lit, RULES))
    over = F.zip_with("cells", "limits", lambda c, m: c > m)
    hit = F.filter(F.zip_with(names, over, lambda n, o: F.when(o, n)), lambda n: n.isNotNull())
    return scored.select(
        "doc_id",
        *COUNTS,
        failed().alias("base_failed"),
        F.coalesce(F.array_join(hit, ","), F.lit("")).alias("rules_failed"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("rules_failed") == ""))


def assess(scored: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.1) -> DataFrame:
    """One row per scored document: counts, base_failed, rules_failed, kept.

    ``scored`` is read twice (thresholds, verdicts): pass a written table.
    """
    return judge(scored, thresholds(scored, labels, risk, delta))


def filter_quality(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.1) -> DataFrame:
    """The rows of ``docs`` that pass, all columns; cutoffs are fitted on the labelled documents among them."""
    ship(docs.sparkSession)
    labelled = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id").distinct()
    cutoffs = thresholds(score(docs.join(labelled, "doc_id", "left_semi")), labels, risk, delta)
    limits = {lang: np.array([cutoffs.get((lang, r), GRID + 1) for r in RULES]) for lang in {x for x, _ in cutoffs}}
    none = np.full(len(RULES), GRID + 1)

    @F.pandas_udf(T.BooleanType())
    def passes(text: pd.Series, lang: pd.Series) -> pd.Series:
        out = []
        sizes = text.fillna("").str.len().cumsum() // (1 << 20)
        for _, part in text.groupby(sizes.to_numpy()):
            found = measure(pa.array(part.where(part.notna(), None), pa.string()))
            most = np.stack([limits.get(x if isinstance(x, str) else None, none) for x in lang.loc[part.index]])
            base = (found["n_words"] < 10) | (100 * found["n_repeat_words"] > 20 * found["n_words"])
            out.append(pd.Series(~base & (_cells(found) <= most).all(axis=1), index=part.index))
        return pd.concat(out) if out else pd.Series([], dtype=bool)

    return docs.filter(passes(F.col("text"), F.col("lang").cast("string")))
