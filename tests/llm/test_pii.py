"""Base spans against the patterns as they are written, checks, scores, and texts that would hold a plain pattern up."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quire.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(digits) <= 19 and checksum(digits) or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


WORDS = st.sampled_from(["a", "é", "😀", "@", ".", "-", "+", " ", "(", ")", "1", "0", "25", "256", "4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "x@y.z", "a@b", "1.2.3.4", "999", "..", "@@", "+1 (555) 010-9999", "%", "_", "\n", "00"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(WORDS, max_size=14).map("".join))
def test_base_same_as_patterns(text):
    assert list(pii.base_spans(text)) == brute(text)


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="a@.-+ 0159()é", max_size=60))
def test_base_same_as_patterns_on_any_text(text):
    assert list(pii.base_spans(text)) == brute(text)


ACCOUNTS = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606", "ES91 2100 0418 4502 0005 1332"]


@pytest.mark.parametrize("account", ACCOUNTS)
def test_bank_accounts(account):
    text = f"Pay é to {account}. Thanks"
    assert [x[:3] for x in pii.spans_of(text)] == [("iban", 9, 9 + len(account))]
    wrong = text.replace(account, account[:-1] + ("1" if account[-1] != "1" else "2"))
    assert not [x for x in pii.spans_of(wrong) if x[0] == "iban"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("My SSN is 123-45-6789.", [("ssn", "123-45-6789")]),
        ("Part 123-45-6789 shipped", []),
        ("SSN 000-45-6789 or 900-12-1234", []),
        ("call me: tel. 030 1234 5678", [("phone", "030 1234 5678")]),
        ("from 1990 to 2001 12 345", []),
        ("phone order no 030 1234 5678", []),
        ("amex card 3782 822463 10005 ok", [("card", "3782 822463 10005")]),
        ("number 378282246310005 ok", []),
        ("build 1.2.3.4 of x@y.org", [("email", "x@y.org"), ("ip", "1.2.3.4")]),
        ("card 4111 1111 1111 1112", []),
        ("numbers 98079157628044 90 and 1234567890", []),
    ],
)
def test_scored_spans(text, want):
    assert [(k, text[s:e]) for k, s, e, *_ in pii.spans_of(text)] == want


def test_context_moves_scores():
    near = lambda text: pii.spans_of(text)[0][3]
    assert near("server 10.0.0.1") > near("xyz 10.0.0.1") > near("version 10.0.0.1")


def test_no_text_takes_long():
    long = [c * 300_000 for c in ("1", "a", "1.", "a.", "@", "a@", "a@a", "+1", "+1 ", "1 ", "1-", "1.1.1", "AB12", "(1", "123-45-")] + ["phone " + c * 200_000 for c in ("1", "12 ", "12-", "(12)", "12  ")]
    for text in long:
        began = time.time()
        pii.spans_of(text)
        assert time.time() - began < 8, text[:20]


def test_table(spark):
    rows = [(1, "a@b.co, +1 (555) 010-9999, 1.2.3.4, 4111111111111111"), (2, None), (3, ""), (None, "x@y.zz"), (1, "a@b.co, +1 (555) 010-9999, 1.2.3.4, 4111111111111111"), (4, "é" * 100_000 + " 😀 q@w.er"), (5, "IBAN DE89370400440532013000")]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, spans string, base int")
    out = pii.digest(pii.find_pii(df)).collect()
    assert len(out) == len(rows)
    hashed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        base = brute(t)
        spans = [(k, s, e) for k, s, e, *_ in pii.spans_of(t or "")]
        want.append((i, *(sum(x[0] == k for x in base) for k in PATTERNS), hashed(",".join(f"{k}:{s}:{e}" for k, s, e in base)), ",".join(f"{k}:{s}:{e}" for k, s, e in spans)))
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))
    masked = {r.doc_id: r.masked_text for r in pii.find_pii(df, mask=True).collect()}
    assert masked[5] == "IBAN [IBAN]" and masked[2] is None and masked[3] == "" and masked[None] == "[EMAIL]"
    assert masked[1] == "[EMAIL], [PHONE], [IP], [CARD]"


def test_query_table_same_as_patterns(spark):
    """All texts of a table, and nothing but base spans in them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in pii.find_pii(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert found == {i: brute(t) for i, t in texts.items()}


def test_empty_table(spark):
    assert pii.digest(pii.find_pii(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
