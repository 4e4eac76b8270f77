"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests accepts. DataFrame operations only.

The base kinds assign, access and hex are decided by their patterns. The method adds the kind random: runs of 20
or more key characters, none of them overlapping a base span. For each run the encoding is inferred (hex, base32, base36,
base64; plain digits and plain letters are no encodings of keys), and over the encoding's alphabet three tests ask
whether it looks drawn at random: chi-squared against uniform use of the alphabet (Wilson-Hilferty), runs above and below the
alphabet's middle (Wald-Wolfowitz), and serial correlation of neighbours. Fisher's method joins their p-values; a run
that fails at ALPHA is not random.

That a string was not refuted as random is weak evidence when it is short, so discoveries are controlled against the
opposite null, "this is ordinary text": the likelihood ratio of the uniform alphabet against a text model (letter
frequencies, classes of characters that persist) has an expectation of 1 or less under that null, so it is an e-value, and grows with
length. Per stratum of lengths, the e-BH procedure over all runs of the corpus takes the lowest bound (in whole
bits) that keeps the false-discovery rate within ``rate``; only counts per stratum and bits reach the driver.

Positions are code points. A null text counts as empty; a null doc_id is passed through; repeated rows give repeated
rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
ALPHA = 0.001
STRATA = (20, 28, 40, 64, 128)  # lower ends of the length strata
MOST_BITS = 400

#: Patterns, alphabets, share of each letter a..z in ordinary text (percent).
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_-]{20,}"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
ALPHABETS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdefABCDEF", 16),
    "base32": (r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32),
    "base36": (r"^([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 36),
    "base64": (r"^[A-Za-z0-9+/_-]+$", BASE64, 64),
}
PLAIN = r"^([0-9]+|[a-z_/+-]+|[A-Z_/+-]+|[A-Z]?[a-z]+)$"
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1)
STAY = 0.85  # probability that the class of characters (lower, upper, digit, other) persists


def spans(text: Column, pattern: str, may_match: Column, least: int = 0, group: int = 0) -> Column:
    """array<struct<s, e, v>> of the pattern's matches (v: the group) whose group has ``least`` characters or more.

    A match starts behind the pieces and matches before it; lengths are code points.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.transform(F.split(text, pattern), F.length)
    rows = F.arrays_zip(found.alias("m"), values.alias("v"), F.slice(parts, 1, F.size(found)).alias("gap"))
    empty = F.expr("CAST(array() AS array<struct<s: int, e: int, v: string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("s"), end.alias("e"), x["v"].alias("v"))).alias("out"))

    # An array that grows by one is copied each time: positions are counted within runs of sqrt(2 n) matches, and the runs
    # then moved behind each other, so n matches cost n * sqrt(n) copies at most.
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def in_runs(all_rows: Column) -> Column:
        run = F.greatest(F.lit(1), F.ceil(F.sqrt(2 * F.size(all_rows))).cast("int"))
        starts = F.sequence(F.lit(0), F.size(all_rows), run)
        return F.transform(starts, lambda b: F.aggregate(F.slice(all_rows, b + 1, run), zero, step))

    # through a lambda variable, so that the matches are found once and not once a run
    local = F.get(F.transform(F.array(rows), in_runs), F.lit(0))
    nested = F.expr("CAST(array() AS array<array<struct<s: int, e: int, v: string>>>)")

    def behind(acc: Column, x: Column) -> Column:
        at = acc["at"]
        moved = F.transform(x["out"], lambda y: F.struct((y["s"] + at).alias("s"), (y["e"] + at).alias("e"), y["v"].alias("v")))
        return F.struct((at + x["at"]).alias("at"), F.array_append(acc["out"], moved).alias("out"))

    placed = F.aggregate(local, F.struct(F.lit(0).alias("at"), nested.alias("out")), behind, lambda a: F.flatten(a["out"]))
    return F.when(may_match, F.filter(placed, lambda x: F.length(x["v"]) >= least)).otherwise(empty)


def normal_tail(z: Column) -> Column:
    """P(N(0, 1) > z), to about 1e-7 (a rational approximation in t = 1 / (1 + 0.2316419 |z|))."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(token: Column) -> Column:
    """struct<encoding, n, p_chi, p_runs, p_serial, p_random, bits> of a run of key characters."""
    encoding = F.coalesce(*(F.when(token.rlike(p), name) for name, (p, _, _) in ALPHABETS.items()))
    alphabet = F.coalesce(*(F.when(encoding == name, F.lit(a)) for name, (_, a, _) in ALPHABETS.items()))
    k = F.coalesce(*(F.when(encoding == name, F.lit(float(k))) for name, (_, _, k) in ALPHABETS.items()))
    chars = F.regexp_extract_all(token, F.lit("(.)"), F.lit(1))
    letters = F.array(*(F.lit(x / 100) for x in LETTERS))

    def kind(c: Column) -> Column:
        return F.when(c.between("a", "z"), 0).when(c.between("A", "Z"), 1).when(c.between("0", "9"), 2).otherwise(3)

    def within(c: Column) -> Column:
        letter = F.element_at(letters, F.greatest(F.lit(1), F.least(F.lit(26), F.ascii(F.lower(c)) - 96)))
        return F.when(kind(c) <= 1, letter).when(kind(c) == 2, F.lit(0.1)).otherwise(F.lit(0.25))

    def on(t: Column) -> Column:
        n, a, size, chars_of = t["n"], t["alphabet"], t["k"], t["chars"]
        counts = F.transform(F.array_distinct(chars_of), lambda c: F.power(t["n"] - F.length(F.replace(t["token"], c, F.lit(""))), 2))
        squares = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        chi = size / n * squares - n
        df = size - 1
        z_chi = (F.power(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        zero = F.struct(*(F.lit(x).alias(y) for x, y in ((-1.0, "x"), (-1, "kind"), (0.0, "above"), (0.0, "runs"), (0.0, "sx"), (0.0, "sxx"), (0.0, "sxy"), (-1.0, "first"), (0.0, "bits"))))

        def step(acc: Column, c: Column) -> Column:
            x = F.pmod(F.instr(a, c).cast("double") - 1, size)  # hex in capitals repeats its letters
            high = x >= size / 2
            now, new = kind(c), acc["kind"] < 0
            turn = F.when(new, 0.25).when(now == acc["kind"], STAY).otherwise((1 - STAY) / 3)
            return F.struct(
                x.alias("x"),
                now.alias("kind"),
                (acc["above"] + high.cast("double")).alias("above"),
                (acc["runs"] + (new | ((acc["x"] >= size / 2) != high)).cast("double")).alias("runs"),
                (acc["sx"] + x).alias("sx"),
                (acc["sxx"] + x * x).alias("sxx"),
                (acc["sxy"] + F.when(new, 0.0).otherwise(acc["x"] * x)).alias("sxy"),
                F.when(new, x).otherwise(acc["first"]).alias("first"),
                (acc["bits"] - F.log2(size) - F.log2(turn * within(c))).alias("bits"),
            )

        def finish(s: Column) -> Column:
            up, down = s["above"], n - s["above"]
            mean = 2 * up * down / n + 1
            spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
            z_runs = F.when((up == 0) | (down == 0), F.lit(9.0)).otherwise((s["runs"] - mean) / spread)
            variance = n * s["sxx"] - s["sx"] * s["sx"]
            circular = n * (s["sxy"] + s["x"] * s["first"]) - s["sx"] * s["sx"]
            z_serial = F.when(variance <= 0, F.lit(9.0)).otherwise((circular / variance + 1 / (n - 1)) * F.sqrt(n))
            p = [
                F.greatest(normal_tail(z_chi), F.lit(1e-12)),
                F.least(F.lit(1.0), F.greatest(2 * normal_tail(F.abs(z_runs)), F.lit(1e-12))),
                F.least(F.lit(1.0), F.greatest(2 * normal_tail(F.abs(z_serial)), F.lit(1e-12))),
            ]
            y = -(F.log(p[0]) + F.log(p[1]) + F.log(p[2]))
            return F.struct(
                t["encoding"].alias("encoding"),
                t["n"].alias("n"),
                p[0].alias("p_chi"),
                p[1].alias("p_runs"),
                p[2].alias("p_serial"),
                (F.exp(-y) * (1 + y + y * y / 2)).alias("p_random"),
                s["bits"].alias("bits"),
            )

        return F.aggregate(chars_of, zero, step, finish)

    made = F.struct(token.alias("token"), encoding.alias("encoding"), alphabet.alias("alphabet"), k.alias("k"), chars.alias("chars"), F.length(token).cast("double").alias("n"))
    return F.element_at(F.transform(F.array(made), on), 1)


def stratum(n: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(STRATA[1:], 1):
        out = F.when(n >= low, i).otherwise(out)
    return out


def _of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, runs): base spans, and the candidate runs that overlap none, with their battery."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        spans(F.col("text"), ASSIGN, F.col("text").rlike(KEYWORD), 12, 2).alias("assign"),
        spans(F.col("text"), ACCESS, F.col("text").contains("AKIA")).alias("access"),
        spans(F.col("text"), HEX, F.col("text").rlike(HEX)).alias("hex"),
        spans(F.col("text"), RUN, F.col("text").rlike(RUN)).alias("runs"),
    )
    kinds = [_of_kind(F.col(k), i) for i, k in enumerate(BASE_KINDS)]
    rows = rows.select("doc_id", F.array_sort(F.concat(*kinds)).alias("base"), "runs")
    free = F.filter(F.col("runs"), lambda r: ~r["v"].rlike(PLAIN) & ~F.exists("base", lambda b: (b["s"] < r["e"]) & (b["e"] > r["s"])))
    tested = F.transform(free, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), battery(r["v"]).alias("t")))
    return rows.select("doc_id", "base", tested.alias("runs"))


def bounds(scanned: DataFrame, rate: float) -> dict[int, int]:
    """Bits that a discovery needs, by stratum (e-BH at ``rate`` within each stratum)."""
    runs = scanned.select(F.explode("runs").alias("r")).select(
        stratum(F.col("r.t.n")).alias("stratum"),
        F.when(F.col("r.t.p_random") < ALPHA, 0).otherwise(F.greatest(F.lit(0), F.least(F.floor("r.t.bits"), F.lit(MOST_BITS)))).cast("int").alias("bits"),
    )
    tables: dict[int, dict[int, int]] = {}
    for r in runs.groupBy("stratum", "bits").count().collect():
        tables.setdefault(r["stratum"], {})[r["bits"]] = r["count"]
    return {s: found for s, counts in tables.items() if (found := lowest(counts, rate)) is not None}


def lowest(counts: dict[int, int], rate: float) -> int | None:
    """The smallest b with 2**b >= total / (rate * discoveries with b bits or more), or None."""
    total, best, above = sum(counts.values()), None, 0
    for bits in range(max(counts), 0, -1):
        above += counts.get(bits, 0)
        if above and 2**bits * rate * above >= total:
            best = bits
    return best


def find_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """One row per document row: counts by kind, the spans, the digest of the base spans, encodings of the added ones."""
    scanned = cut_lineage(scan(docs), "secrets")
    needed = bounds(scanned, rate)

    def taken(r: Column) -> Column:
        need = F.element_at(F.array(*(F.lit(needed.get(i, MOST_BITS + 1)) for i in range(len(STRATA)))), stratum(r["t"]["n"]) + 1)
        return (r["t"]["p_random"] >= ALPHA) & (F.floor(F.least(r["t"]["bits"], F.lit(MOST_BITS))) >= need)

    added = F.filter("runs", taken)
    rows = scanned.select("doc_id", "base", added.alias("added"))
    extra = _of_kind(F.col("added"), len(BASE_KINDS))
    names = F.array(*map(F.lit, KINDS))

    def written(spans_: Column) -> Column:
        return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")

    return rows.select(
        "doc_id",
        *(_count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)),
        F.size("added").cast("bigint").alias("n_random"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", extra))).alias("spans"),
        F.array_join(F.transform("added", lambda r: r["t"]["encoding"]), ",").alias("encodings"),
    )
