"""The corpus pipeline stage by stage, each against what its operator decides, and its edge cases."""

import random
import zlib
from collections import Counter
from itertools import combinations

import corpus_pipeline as cp
import numpy as np
import pytest
from quire.llm.common import tokenizer_path
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    clean = "the old man walked along the quiet river and spoke of many things to the child"
    rows = [(i, " ".join([clean, *(f"word{i}{j}" for j in range(40))]), "en", "a", 1) for i in range(6)]
    near = rows[0][1].replace("quiet", "silent")
    rows += [(10, near, "en", "b", 1), (11, rows[1][1], "en", "b", 1), (12, None, None, None, None), (13, "", "en", "a", 0), (None, rows[2][1], "en", "c", 5)]
    return spark.createDataFrame(rows, COLUMNS)


def test_stages_return_the_columns_of_documents(spark, docs):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "quality rules", "line dedup", "n-gram Jaccard join", "best-fit packing"]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_filters_keep_clean_documents_and_drop_empty_ones(spark, docs):
    for stage in (cp.quality_classifier, cp.quality_rules):
        left = {r.doc_id for r in stage(spark, docs, SF).collect()}
        assert not left & {12, 13}
    assert {0, 1, 2, 3, 4, 5, 10, 11, None} <= {r.doc_id for r in cp.quality_rules(spark, docs, SF).collect()}


def test_line_dedup_takes_effect(spark, docs):
    out = {r.doc_id: r for r in cp.line_dedup(spark, docs, SF).collect()}
    assert out[11].text == "" and out[11].n_chars == 0
    assert out[12].text is None and out[12].n_chars is None and out[1].n_chars == len(out[1].text)
    assert out[None].text and len(out) == 11


def test_one_document_of_each_group_stays(spark, docs):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in cp.jaccard(spark, docs, SF).collect()) == sorted([(False, i) for i in (0, 1, 2, 3, 4, 5, 12, 13)] + [(True, 0)])


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ids = {r.doc_id for r in out.collect()}
    assert ids and ids <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def brute_force(rows: list[tuple], junk: set) -> list[tuple]:
    """(doc_id, piece, start, length, ids_crc32) that the pipeline should leave of rows (doc_id, text), with the documents the two models reject given."""
    kept = {}
    for d, t in rows:
        w = (t or "").split()
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {x for x, n in Counter(windows).items() if n > 1}
        repeated = {j for i, x in enumerate(windows) if x in twice for j in range(i, i + 5)}
        if d not in junk and len(w) >= 10 and 100 * len(repeated) <= 20 * len(w):
            kept[d] = t
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    holders: dict[str, set] = {}
    for d, t in kept.items():
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(d)
    for d, t in kept.items():
        kept[d] = "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or len(holders[key(x)]) == 1 or min(holders[key(x)]) == d)
    sets = {}
    for d, t in kept.items():
        w = t.lower().split()
        n = min(5, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {d: d for d in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(kept), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    encoder = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = []
    for d, t in kept.items():
        if find(d) == d:
            ids = np.array([*encoder.encode(t, add_special_tokens=False).ids, 0], "<u4")
            out += [(d, i, 2048 * i, len(x), zlib.crc32(x.tobytes())) for i in range(-(-len(ids) // 2048)) for x in [ids[2048 * i : 2048 * i + 2048]]]
    return sorted(out)


def test_run_same_as_brute_force(spark, tmp_path):
    """Clean prose with exact and near copies, shared lines and passages, repeats, short and long texts; and noise that both models must reject."""
    r = random.Random(7)
    words = ["".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.choice([1, 2, 2, 3]))) for _ in range(300)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared, passage = line(12), line(60)
    texts = ["\n".join(line(r.choice([8, 15, 25])) for _ in range(r.choice([3, 6, 12]))) for _ in range(70)]
    texts += [texts[0], texts[1], texts[1] + " end", *(texts[i].replace(" ", "\n", 1) + f" more{i}" for i in range(2, 14))]
    texts += [f"{line(20)}\n{shared}\n{passage}\n{line(20)}" for _ in range(6)] + [f"{line(30)}\n  {shared.capitalize()}\t" for _ in range(4)]
    texts += [" ".join([line(6)] * 10), line(5), "", None, "\n".join(line(20) for _ in range(400))]
    clean = len(texts)
    texts += [" ".join(f"zq{r.randrange(10**6)}x&&&" for _ in range(60)) for _ in range(8)]
    rows = list(enumerate(texts))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    want = brute_force(rows, set(range(clean, len(texts))))
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out) == want
    fill = Counter()
    for x in out:
        fill[x.sequence_id] += x.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1
