"""Planted notices, whole, on one line, wrapped and in comments, among prose; and the notices of the test documents."""

import random
import re
import textwrap

import pytest

from quire.llm import license_scan as ls

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def model(spark):
    return ls.train(spark)


def prose(r: random.Random, n: int) -> str:
    words = "the old man walked along a quiet river and spoke of many things to his child while public people read about software copies made for free use in common places".split()
    return " ".join(r.choice(words) for _ in range(n)).capitalize() + "."


def test_every_template_has_an_anchor():
    assert all(any(a in t for a in ls.ANCHORS) for ts in ls.TEMPLATES.values() for t in ts)


def test_planted_notices(spark, model):
    r = random.Random(1)
    rows, want = [], {}
    for family, notes in ls.TEMPLATES.items():
        for note in notes:
            for form in range(4):
                text = note[0].upper() + note[1:]
                if form == 1:
                    text = textwrap.fill(text, 70)
                elif form == 2:
                    text = "/*\n" + "\n".join(f" * {x}" for x in textwrap.wrap(text, 64)) + "\n */"
                elif form == 3:
                    text = "\n".join(f"# {x}" for x in textwrap.wrap(text.upper(), 72))
                before, after = (prose(r, r.choice([8, 60])) for _ in range(2))
                want[len(rows)] = family
                rows.append((len(rows), f"{before}\n\n{text}\n#\n{after}"))
    clean = len(rows)
    rows += [(clean + i, "\n".join(prose(r, r.choice([5, 30, 200])) for _ in range(6))) for i in range(100)]
    found: dict[int, set] = {}
    for x in ls.scan_licenses(spark.createDataFrame(rows, SCHEMA), model).filter("confirmed").collect():
        found.setdefault(x.doc_id, set()).add(x.family)
    assert not [d for d in found if d >= clean]
    right = sum(found.get(d) == {f} for d, f in want.items())
    assert right >= 0.95 * len(want), [(d, want[d], found.get(d)) for d in want if found.get(d) != {want[d]}]


def test_notices_of_the_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {(x.doc_id, x.family) for x in ls.scan_licenses(docs, model).filter("confirmed").collect()}
    signs = {"apache-2.0": r"apache license, version 2\.0", "mit": r"\bmit license", "gpl-3.0": r"gnu general public license, version 3", "cc-by": r"\bcc by 4\.0", "cc-by-sa": r"cc by-sa", "cc-by-nc": r"cc by-nc", "bsd": r"\bbsd\b"}
    want = {(d.doc_id, f) for d in docs.collect() for f, p in signs.items() if re.search(p, (d.text or "").lower())}
    assert want and found == want


def test_paragraphs(spark):
    text = "a b\nc\n\n \nd\n***\ne\n" + "x" * 121 + "\nf\n"
    out = spark.createDataFrame([(1, text)], SCHEMA).select(ls.paragraphs("text").alias("p")).first().p
    assert [x.strip("\n") for x in out if x.strip()] == ["a b\nc", "d", "e", "x" * 121, "f"]


def test_edge_cases(spark, model):
    rows = [(1, None), (2, ""), (None, "Licensed under the MIT License."), (3, "Licensed under the MIT License."), (3, "Licensed under the MIT License."), (4, "word " * 30000 + "\n\nReleased under the MIT License.\n")]
    docs = spark.createDataFrame([(*x, "y", 2) for x in rows], SCHEMA + ", family string, p int")
    out = sorted((x.doc_id is None, x.doc_id or 0, x.family) for x in ls.scan_licenses(docs, model).collect())
    assert out == [(False, 3, "mit"), (False, 3, "mit"), (False, 4, "mit"), (True, 0, "mit")]
    assert ls.scan_licenses(docs.limit(0), model).count() == 0
