import hashlib
import random
import re

from tallyframe.llm import pii


def brute(text):
    """The four base kinds by the plain patterns."""
    spans = []

    def luhn(d):
        t = 0
        for i, c in enumerate(d[::-1]):
            x = int(c) * (1 + i % 2)
            t += x - 9 if x > 9 else x
        return t % 10 == 0

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            spans.append((m.start(), 3, m.end()))
    return [(pii.BASE_KINDS[k], s, e) for s, k, e in sorted(spans)]


def test_base_spans_equal_the_plain_patterns_on_random_text():
    rng = random.Random(5)
    parts = ["a.b@c.d", "@", "x@y", "é", "4111 1111 1111 1111", "4111-1111", "1.2.3.4", "300.1.1.1", ".", "-", " ", "+1 (829) 555-0199", "+", "(", "00012", "_z@q-w.co.uk", "..", "9" * 13, "1.2.3.4.5.6.7.8.9"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        got = sorted((s, pii.BASE_KINDS.index(k), e) for s, e, k in pii.base_spans(text))
        assert [(pii.BASE_KINDS[k], s, e) for s, k, e in got] == brute(text), text


def test_added_kinds_need_checksum_and_context():
    iban, wrong = "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"
    assert [x[2] for x in pii.scan(f"pay to {iban} now", 0.5)] == ["iban"]
    assert pii.scan(f"bank account {wrong} iban", 0.5) == []
    assert [x[2] for x in pii.scan("her social security number 123-45-6789", 0.5)] == ["ssn"]
    assert pii.scan("part 123-45-6789 of it", 0.5) == []
    assert pii.scan("ssn 666-45-6789", 0.5) == []


def test_context_raises_the_score():
    far, near = pii.scan("see 4111111111111111 there", 0.5)[0][3], pii.scan("credit card 4111111111111111", 0.5)[0][3]
    assert near > far


def test_odd_rows_and_real_documents(spark, make_docs, odd_rows):
    out = pii.find_pii(make_docs(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    assert all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in out)
    assert pii.find_pii(make_docs([])).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find_pii(docs).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in pii.BASE_KINDS]


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "9" * 300_000, "1." * 150_000, "+1((" * 80_000, "a@" * 150_000, "1-" * 150_000):
        pii.scan(text, 0.5)
