"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

``find_pii(docs)`` scans every whole ``text``. The kinds email, ip, card and phone are decided by
pattern and checksum alone (they are always reported); the kinds iban and ssn need a score of
``threshold`` or more, made of a prior, a checksum bonus and the words around the span, and are left
out where they overlap one of the first four. Every scan is linear in the text, however it is made.

Nulls and empty texts have no spans. A null doc_id is passed through; repeated rows give repeated
rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyframe.llm.common import map_batches
from tallyframe.llm.words import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only begin where a run of digits begins, so no run is read twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

#: Prior score, checksum bonus, words that raise the score when they stand near.
SCORES = {
    "email": (0.8, 0.1, ("mail", "e-mail", "contact", "write", "address")),
    "ip": (0.5, 0.2, ("ip", "host", "server", "address", "login")),
    "card": (0.3, 0.4, ("card", "visa", "credit", "payment", "debit", "cvv")),
    "phone": (0.5, 0.1, ("phone", "call", "tel", "mobile", "fax")),
    "iban": (0.2, 0.5, ("iban", "bank", "account", "transfer", "bic", "swift")),
    "ssn": (0.2, 0.1, ("ssn", "social", "security", "tax", "tin")),
}
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 48
_NEAR = {kind: re.compile(rf"\b(?:{'|'.join(map(re.escape, s[2]))})\b", re.IGNORECASE) for kind, s in SCORES.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rearranged = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in rearranged)) % 97 == 1


def _small(part: str) -> bool:
    value = part.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each '@' with the run of local characters before it; found by '@', so runs are read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(kind number, start, end) of the four base kinds."""
    out = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def added_spans(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, checksum holds) proposed beside the base kinds."""
    if not _DIGIT.search(text):
        return []
    out = []
    for m in _IBAN.finditer(text):
        plain = m.group().replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain):
            out.append((m.start(), m.end(), "iban", True))
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            out.append((m.start(), m.end(), "ssn", False))
    return out


def score(text: str, start: int, end: int, kind: str, checked: bool) -> float:
    prior, bonus, _ = SCORES[kind]
    near = f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}"
    return min(1.0, prior + bonus * checked + CONTEXT_BONUS * bool(_NEAR[kind].search(near)))


def scan(text: str, threshold: float) -> list[tuple[int, int, str, float]]:
    """All reported spans with their score, by start and then by kind."""
    spans = [(s, e, k, score(text, s, e, k, True)) for s, e, k in base_spans(text)]
    extra = []
    for s, e, kind, checked in added_spans(text):
        if not any(s < e2 and s2 < e for s2, e2, *_ in spans):
            value = score(text, s, e, kind, checked)
            if value >= threshold:
                extra.append((s, e, kind, value))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans + extra, key=lambda x: (x[0], order[x[2]]))


def written(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, *_ in spans)


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document row: counts by kind, the spans with scores, and the digest of the base spans."""
    fields = [
        ("doc_id", docs.schema["doc_id"].dataType),
        *((f"n_{k}", T.LongType()) for k in KINDS),
        ("base_sha256", T.StringType()),
        ("spans", T.StringType()),
        ("scores", T.StringType()),
    ]

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in slices(batch, "text"):
            found = [scan(t or "", threshold) for t in part.column("text").to_pylist()]
            base = [[x for x in spans if x[2] in BASE_KINDS] for spans in found]
            yield [
                part.column("doc_id"),
                *([sum(x[2] == k for x in spans) for spans in found] for k in KINDS),
                [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base],
                [written(spans) for spans in found],
                [",".join(f"{x[3]:.2f}" for x in spans) for spans in found],
            ]

    return map_batches(docs.select("doc_id", "text"), run, fields)
