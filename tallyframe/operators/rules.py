"""Ordered rewrite rules as data, folded over each row in one projection.

A rule is a ``select`` and the values it sets; each rule sees what the rules before it made of the row. The rule list is
one literal (parsed once per plan from its JSON text), and one higher-order expression folds it over the row's struct, so
the plan has the same size for three rules and for three thousand. A row carries the numbers of the rules that changed it.

A row meets only the rules that may apply to it. A rule's *key* is a text test whose values it needs in one column; it can
hold because the row came with such a value or because an earlier rule set one, and which rules set what the next ones ask
is known from the list alone. So an index, one more literal, gives for a value the rules that ask for it with all those
that may follow from them: equal values by a hash bucket, patterns by their longest piece without wildcards. Rules without
a key are met by every row. The index only leaves out what can't apply; the fold decides.

A test asks a text, number or date column; of its atoms one must hold (none, if negated), in SQL's three-valued logic:
a test on an empty column neither holds nor, negated, holds.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import _FOLD, _LOWER, _NO_ESCAPE, _UPPER, Atom, FilterContext, SpecError, Test, read_spec

HITS = "_rules"
TEXTS = ("Payee", "Account", "Category", "Memo", "Subcategory")
NUMBERS = ("Amount", "Date")
SETS = ("Category", "Subcategory", "Memo", "Payee", "Date")
_ATOM = "struct<kind: string, text: string, sub: string, lo: decimal(20,4), hi: decimal(20,4)>"
_RULES = f"array<struct<no: int, guard: int, value: string, tests: array<struct<col: int, negated: boolean, atoms: array<{_ATOM}>>>, sets: array<string>, Category: string, Subcategory: string, Memo: string, Payee: string, Date: string>>"
_ENTRIES = "array<struct<col: int, value: string, rules: array<int>>>"
_INDEX = f"struct<always: array<int>, buckets: array<{_ENTRIES}>, pieces: {_ENTRIES}>"
#: Rule numbers in the index; where rules that follow from each other make more, those rules are met by every row.
MOST_FOLLOWING = 1 << 20
_EPOCH = date(1970, 1, 1)


def _number(value) -> str:
    return str((value - _EPOCH).days if isinstance(value, date) else value)


def _atom(atom: Atom) -> dict:
    match atom.kind:
        case "is" | "blank":
            return {"kind": atom.kind, "text": atom.arg}
        case "like":
            return {"kind": "like", "text": atom.arg.translate(_FOLD)}
        case "between":
            return {"kind": "between", "lo": _number(atom.arg[0]), "hi": _number(atom.arg[1])}
        case "on":  # a category with all its subcategories
            return {"kind": "is", "text": atom.arg[1].arg}
        case "all":
            (_, category), (_, sub) = (a.arg for a in atom.arg)
            return {"kind": "pair", "text": category.arg, "sub": sub.arg}
    return {"kind": atom.kind, "lo": _number(atom.arg)}


def _test(test: Test) -> dict:
    if test.column in TEXTS:
        col = TEXTS.index(test.column)
    elif test.column in NUMBERS:
        col = NUMBERS.index(test.column)
    else:
        raise SpecError(f"rewrites cannot select on {test.column}")
    return {"col": col, "negated": test.negated, "atoms": [_atom(a) for a in test.atoms]}


def _key(tests: Sequence[dict]) -> tuple[int, list[tuple[str, str]]] | None:
    """(column, [("is" or "like", value or piece)]) of the first test that needs one of some values in a text column."""
    for t in tests:
        if t["negated"] or any(a["kind"] not in ("is", "pair", "like") for a in t["atoms"]):
            continue
        asked = []
        for a in t["atoms"]:
            text = a["text"] if isinstance(a["text"], str) else json.dumps(a["text"])
            asked.append(("like", max(re.split("[%_]", text), key=len)) if a["kind"] == "like" else ("is", text))
        if all(kind == "is" or (value and _NO_ESCAPE not in value) for kind, value in asked):
            return t["col"], asked
    return None


def _index(keys: Sequence[tuple | None], assignments: Sequence[Mapping[str, object]]) -> dict:
    """The rules that a row may meet, by what it comes with."""

    def brings(sets: Mapping[str, object], key: tuple | None) -> bool:
        value = None if key is None else sets.get(TEXTS[key[0]])
        return value is not None and any(str(value) == v if kind == "is" else v in str(value).translate(_FOLD) for kind, v in key[1])

    following: list[set[int]] = [{i} for i in range(len(keys))]
    always = {i for i, key in enumerate(keys) if key is None}
    for i in reversed(range(len(keys))):
        for j in range(i + 1, len(keys)):
            if j not in following[i] and brings(assignments[i], keys[j]):
                following[i] |= following[j]
        if sum(map(len, following[i:])) > MOST_FOLLOWING:
            always |= {j for j in range(1, len(keys)) if any(brings(assignments[k], keys[j]) for k in range(j))}
            following = [{j} for j in range(len(keys))]
            break
    entries = [(kind, {"col": key[0], "value": v, "rules": sorted(following[i])}) for i, key in enumerate(keys) if i not in always for kind, v in key[1]]
    equal = [e for kind, e in entries if kind == "is"]
    buckets: list[list[dict]] = [[] for _ in range(1 << max(4, len(equal).bit_length()))]
    for e in equal:
        buckets[zlib.crc32(e["value"].encode()) % len(buckets)].append(e)
    return {"always": sorted(set().union(*(following[i] for i in always))), "buckets": buckets, "pieces": [e for kind, e in entries if kind == "like"]}


def rules_literal(rules: Sequence[Mapping], assignments: Sequence[Mapping[str, object]], ctx: FilterContext) -> tuple[Column, Column]:
    """All rules as one literal array, and the rules a row may meet (see ``_met``); ``assignments`` are the values each one sets."""
    made, keys = [], []
    for i, (rule, sets) in enumerate(zip(rules, assignments, strict=True)):
        tests = read_spec(rule["select"], ctx)
        if any(t.of_account for t in tests):
            raise SpecError("rewrites cannot select on account attributes")
        asked = [_test(t) for t in tests]
        keys.append(_key(asked))
        # a plain equality is the rule's guard: most rules are settled by this one comparison
        guard = next((t for t in asked if not t["negated"] and len(t["atoms"]) == 1 and t["atoms"][0]["kind"] == "is"), None)
        values = {c: None if v is None else str(v) for c, v in sets.items()}
        rest = [t for t in asked if t is not guard]
        key = {"guard": guard["col"], "value": guard["atoms"][0]["text"]} if guard else {}
        made.append({"no": i, **key, "tests": rest, "sets": list(values), **values})
    return F.from_json(F.lit(json.dumps(made)), _RULES), _met(_index(keys, assignments))


def _met(index: dict) -> Column:
    """The numbers, ascending, of the rules that a row of texts may meet."""
    literal = F.from_json(F.lit(json.dumps(index)), _INDEX)

    def equal(col: int) -> Column:
        text = F.col(TEXTS[col])
        bucket = F.get(literal["buckets"], (F.crc32(text) % len(index["buckets"])).cast("int"))
        return F.coalesce(F.filter(bucket, lambda e: (e["col"] == col) & (e["value"] == text)), F.array().cast(_ENTRIES))

    def holding(col: int) -> Column:
        # the folded text is bound to a variable: in the filter's place it would be folded again for each piece
        folded = F.array(F.translate(F.col(TEXTS[col]), _UPPER, _LOWER))
        return F.flatten(F.transform(folded, lambda text: F.filter(literal["pieces"], lambda e: (e["col"] == col) & F.contains(text, e["value"]))))

    found = [equal(c) for c in sorted({e["col"] for bucket in index["buckets"] for e in bucket})]
    found += [holding(c) for c in sorted({e["col"] for e in index["pieces"]})]
    numbers = [F.array(literal["always"]), *(F.transform(entries, lambda e: e["rules"]) for entries in found)]
    return F.array_sort(F.array_distinct(F.flatten(F.concat(*numbers))))


def _holds(row: Column, test: Column) -> Column:
    text = F.get(row["texts"], test["col"])
    number = F.when(test["col"] == 0, row["Amount"].cast("decimal(20,4)")).otherwise(F.unix_date(row["Date"]).cast("decimal(20,4)"))
    sub = F.get(row["texts"], F.lit(TEXTS.index("Subcategory")))

    def one(a: Column) -> Column:
        kind = a["kind"]
        return (
            F.when(kind == "is", text == a["text"])
            .when(kind == "blank", text.isNull())
            .when(kind == "like", F.like(F.translate(text, _UPPER, _LOWER), a["text"], F.lit(_NO_ESCAPE)))
            .when(kind == "pair", (text == a["text"]) & F.when(a["sub"].isNull(), sub.isNull()).otherwise(sub == a["sub"]))
            .when(kind == "between", number.between(a["lo"], a["hi"]))
            .when(kind == "=", number == a["lo"])
            .when(kind.isin("!", "!="), number != a["lo"])
            .when(kind == "<", number < a["lo"])
            .when(kind == "<=", number <= a["lo"])
            .when(kind == ">", number > a["lo"])
            .when(kind == ">=", number >= a["lo"])
        )

    found = F.exists(test["atoms"], one)
    return F.when(test["negated"], ~found).otherwise(found)


def fold_rules(txns: DataFrame, rules: Column, met: Column) -> DataFrame:
    """``txns`` after all rules, with the numbers of those that applied to each row in ``_rules``. ``met``: of the rules that may."""
    start = F.struct(F.array(*map(F.col, TEXTS)).alias("texts"), F.col("Amount"), F.col("Date"), F.array().cast("array<int>").alias(HITS))

    def step(row: Column, rule: Column) -> Column:
        def value(c: str) -> Column:
            old = row["Date"] if c == "Date" else F.get(row["texts"], F.lit(TEXTS.index(c)))
            if c not in SETS:
                return old
            return F.when(F.array_contains(rule["sets"], c), F.to_date(rule["Date"]) if c == "Date" else rule[c]).otherwise(old)

        texts = F.array(*map(value, TEXTS))
        changed = F.struct(texts.alias("texts"), row["Amount"].alias("Amount"), value("Date").alias("Date"), F.concat(row[HITS], F.array(rule["no"])).alias(HITS))
        guarded = rule["guard"].isNull() | (F.get(row["texts"], rule["guard"]) == rule["value"])
        return F.when(guarded & F.forall(rule["tests"], lambda t: _holds(row, t)), changed).otherwise(row)

    # behind a one-element generator, so that the fold is not repeated for each column read from it
    folded = txns.withColumn("_row", F.explode(F.array(F.aggregate(F.transform(met, lambda no: F.get(rules, no)), start, step))))
    texts = {c: F.get(F.col("_row.texts"), F.lit(i)) for i, c in enumerate(TEXTS) if c in SETS}
    return folded.withColumns({**texts, "Date": F.col("_row.Date"), HITS: F.col(f"_row.{HITS}")}).drop("_row")
