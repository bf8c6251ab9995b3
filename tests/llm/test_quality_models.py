"""The word bigram model against dictionaries, fold by fold; the verdicts of both quality operators against their losses."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import kneser_ney as kn
from quire.llm.quality_classifier import classify_quality, trusted_ids
from quire.llm.quality_rules import apply_rules, plain

SCHEMA = "doc_id long, text string, lang string"


def by_hand(training: list[list[str]], vocabulary: set[str]):
    """log P(word | word before) of an interpolated modified Kneser-Ney model, from dictionaries."""
    token = lambda w: w if w in vocabulary else kn.shape(w.encode())
    pairs = Counter((token(a) if a else None, token(b)) for words in training for a, b in zip([None, *words], words, strict=False))
    followed = Counter(b for _, b in pairs)

    def off(counts):
        t = Counter(counts)
        y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0
        d = [min(max(i - (i + 1) * y * t[i + 1] / t[i] if t[i] else i / 2, 0.05), i - 0.05) for i in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1] if c else 0

    high, low, after = off(pairs.values()), off(followed.values()), defaultdict(list)
    for (a, _), c in pairs.items():
        after[a].append(c)
    size = sum(followed.values())

    def log(a, b):
        a, b = token(a) if a else None, token(b)
        p = (followed[b] - low(followed[b]) + sum(map(low, followed.values())) / kn.TOKENS) / size if size else 1 / kn.TOKENS
        if a in after:
            p = (pairs[a, b] - high(pairs[a, b]) + sum(map(high, after[a])) * p) / sum(after[a])
        return math.log(p)

    return log


def some_docs(seed: int, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    words = ["the", "a", "old", "river,", "spoke", "é", "to", "Child.", "42", "x&y"]
    out = [(i, " ".join(r.choice(words) if r.random() < 0.9 else f"new{r.randrange(99)}" for _ in range(r.choice([1, 5, 40]))), r.choice(["en", "en", None])) for i in range(n)]
    return [*out, (900, out[0][1], out[0][2]), (901, None, "en"), (902, " \n", "xx"), (903, "unseen language", "yy"), (None, "the old", "en"), (5, *out[5][1:])]


@pytest.mark.parametrize(("seed", "shard_events"), [(1, 10**9), (2, 100)])
def test_losses_same_as_by_hand(spark, monkeypatch, seed, shard_events):
    monkeypatch.setattr(kn, "UNIT_EVENTS", 300)
    rows = some_docs(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    used = F.col("doc_id") % 4 < 3
    folds = {r.row: r.fold for r in kn.prepared(docs).collect()}
    of = {(r.doc_id, r.lang, r.text): r.row for r in kn.prepared(docs).collect()}
    found = [(r.row, r.n_words, r.loss) for r in kn.document_scores(docs, used, shard_events=shard_events).collect()]
    assert sorted(x[0] for x in found) == sorted(of[d, lang or "", t] for d, t, lang in rows)
    trained = [(d, (t or "").split(), lang or "") for d, t, lang in rows if d is not None and d % 4 < 3]
    want = {}
    for lang in {lang or "" for _, _, lang in rows}:
        own = [(d, w) for d, w, x in trained if x == lang]
        seen = Counter(w for _, words in own for w in set(words))
        vocabulary = {w for w, n in seen.items() if n > 1}
        fold = {d: folds[of[d, lang, t]] for d, t, x in rows if (x or "") == lang and d is not None}
        parts = [[w for d, w in own if fold[d] == f] for f in (0, 1)]
        if not all(any(p) for p in parts):
            parts = [[*parts[0], *parts[1]]] * 2
        models = [by_hand(parts[1], vocabulary), by_hand(parts[0], vocabulary)]
        for d, t, x in rows:
            words, row = (t or "").split(), of[d, lang, t] if (x or "") == lang else None
            if row is not None:
                log = models[folds[row]]
                want[row] = (len(words), -sum(log(a, b) for a, b in zip([None, *words], words, strict=False)) / len(words) if words else None)
    for row, n, loss in found:
        assert n == want[row][0]
        assert (loss is None and want[row][1] is None) or math.isclose(loss, want[row][1], rel_tol=1e-5)


def prose(r: random.Random, n: int, follows: dict) -> list[str]:
    out = [r.choice(list(follows))]
    while len(out) < n:
        out.append(r.choice(follows[out[-1]]))
    return out


def test_shuffled_words_score_worse(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    follows = {w: r.sample(words, 4) for w in words}
    texts = [prose(r, 80, follows) for _ in range(120)]
    rows = [(i, " ".join(t), "en") for i, t in enumerate(texts)] + [(1000 + i, " ".join(r.sample(t, len(t))), "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    loss = {x.doc_id: x.loss for x in kn.document_scores(docs, F.col("doc_id") < 60).collect()}
    assert min(loss[1000 + i] for i in range(120)) > max(loss[i] for i in range(120)) + 0.5
    kept = {x.doc_id: x.kept for x in classify_quality(docs, spark.range(60).toDF("doc_id")).collect()}
    assert all(kept[i] for i in range(120)) and not any(kept[1000 + i] for i in range(120))


def test_classifier_verdicts_follow_from_losses(spark):
    sf = "/root/testdata/sf0.01"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in trusted_ids(labels).collect()}
    bad = {r.doc_id for r in labels.filter("quality = 0").collect()}
    out = classify_quality(docs, trusted_ids(labels), quantile=0.9, slack=1.5).collect()
    for lang in {r.lang for r in out}:
        own = sorted(math.floor(r.loss / 0.001) for r in out if r.lang == lang and r.doc_id in good and r.loss is not None)
        limit = own[math.ceil(len(own) * 0.9) - 1] * 0.001 + math.log(1.5)
        for r in out:
            if r.lang == lang:
                assert math.isclose(r.limit, limit, abs_tol=0.0011)
                assert r.kept == (r.loss is not None and r.loss <= r.limit)
    out = {r.doc_id: r.kept for r in classify_quality(docs, trusted_ids(labels)).collect()}
    assert np.mean([out[d] for d in good]) >= 0.98
    assert np.mean([out[d] for d in bad]) <= 0.4  # the rest repeat themselves, which the quality rules find


def test_rules_verdicts_follow_from_losses(spark):
    sf = "/root/testdata/sf0.01"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    fit = {r.doc_id for r in docs.collect() if plain([r.text.encode()])[0]}
    out = apply_rules(docs).collect()
    for lang in {r.lang for r in out}:
        own = sorted(math.floor(r.loss / 0.001) for r in out if r.lang == lang and r.doc_id in fit and not r.base_failed)
        low, high = (own[max(0, math.ceil(len(own) * q) - 1)] * 0.001 for q in (0.005, 0.99))
        for r in out:
            if r.lang == lang:
                assert math.isclose(r.low, low - math.log(2), abs_tol=0.0011) and math.isclose(r.high, high + math.log(2), abs_tol=0.0011)
                assert r.kept == (not r.base_failed and r.low <= r.loss <= r.high)
    kept = {r.doc_id: r.kept for r in out}
    assert np.mean([kept[r.doc_id] for r in labels.filter("quality = 1").collect()]) >= 0.97
    assert np.mean([kept[r.doc_id] for r in labels.filter("quality = 0").collect()]) <= 0.2


def test_plain(spark):
    rows = [(1, "Some prose, as it is written. " * 5, "en"), (2, "the&&& old*** man### " * 5, "en"), (3, "ALL CAPS!! NO PROSE!! " * 5, "en"), (4, None, "en"), (5, " ", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [d for d, t, _ in rows if plain([(t or "").encode()])[0]] == [1]
    out = {r.doc_id: r for r in apply_rules(docs).collect()}
    assert len(out) == 5 and out[4].base_failed and out[5].base_failed and out[5].lang == ""


def test_more_languages_than_a_pass_holds(spark, monkeypatch):
    """Each language has its own model, however many there are."""
    r = random.Random(11)
    rows = [(100 * k + i, " ".join(r.choices([f"w{k}x{j}" for j in range(12)], k=30)), f"l{k}") for k in range(5) for i in range(8)] + [(9000, "w0x1 w0x2 other", "none"), (9001, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    score = lambda: sorted((x.doc_id, x.n_words, x.loss and round(x.loss, 5)) for x in kn.document_scores(docs, F.col("doc_id") < 9000).collect())
    want = score()
    monkeypatch.setattr(kn, "LANGUAGES", 2)
    assert score() == want and len(want) == len(rows)
