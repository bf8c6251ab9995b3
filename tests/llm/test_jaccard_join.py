"""The join against brute force, and its defined edge cases."""

import random

import pytest

from quire.llm import jaccard_join as jj
from quire.llm.jaccard_join import jaccard_join


def brute(texts: dict[int, str], width: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {}
    for k, t in texts.items():
        w = t.encode().lower().split()
        n = min(width, len(w))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {k: k for k in texts}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


def some_texts(seed: int) -> dict[int, str]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out: list[str] = ["", "   ", "one", "One", "one two", "a b c", "A b C"]
    for _ in range(40):
        text = [r.choice(words) for _ in range(r.choice([3, 8, 12, 20, 25, 60, 150, 700]))]
        for _ in range(r.choice([1, 1, 3, 12])):
            out.append(" ".join(text))
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                text = list(text)
                text[r.randrange(len(text))] = r.choice(words)
    r.shuffle(out)
    return dict(enumerate(out))


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 5, 80)])
def test_same_as_brute_force(spark, seed, width, percent):
    texts = some_texts(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(docs, width, percent).collect()}
    assert found == brute(texts, width, percent)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_a_common_passage_and_a_common_shingle(spark, monkeypatch, width, percent):
    """Buckets far larger than a block, whose nodes are of many components, and near copies that share only those and few others."""
    monkeypatch.setattr(jj, "BLOCK", 7)
    r = random.Random(5)
    words, passage = [f"w{i}" for i in range(3000)], [f"p{i}" for i in range(60)]
    texts = []
    for i in range(150):
        text = [r.choice(words) for _ in range(r.choice([30, 60, 90]))]
        at = r.randrange(len(text))
        text[at:at] = passage if i % 2 else passage[:width]
        texts.append(" ".join(text))
        if not i % 3:
            for _ in range(3):
                text = list(text)
                for _ in range(max(1, len(text) // 60)):
                    text[r.randrange(len(text))] = r.choice(words)
                texts.append(" ".join(text))
    texts = dict(enumerate(texts))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join(docs, width, percent).collect()}
    assert found == brute(texts, width, percent)


def test_nulls_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d", 7, "x"), (2, None, None, None), (3, "A  b\tC d", 1, "y"), (3, "A  b\tC d", 1, "y"), (None, "a b c d", 2, "z")], "doc_id long, text string, node long, key string")
    found = sorted(jaccard_join(docs).collect(), key=repr)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in found) == [(False, 1, 2, 1), (False, 2, 0, 2), (False, 3, 2, 1), (False, 3, 2, 1), (True, 0, 2, None)]


def test_empty_table(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
