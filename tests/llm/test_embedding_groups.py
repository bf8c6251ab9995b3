"""Near-dedup of embeddings where lists are full of closer neighbours, and where the descent finds nothing."""

import numpy as np

from quire.llm import embedding_dedup
from quire.llm.embedding_dedup import near_duplicates


def groups(size, count=2):
    """Pairs of groups of distinct vectors: cosine 0.99 within a group, 0.96 across a pair, near 0 otherwise."""
    dim = 2 * size + 2 * count
    x = []
    for p in range(count):
        for g in range(2):
            for i in range(size):
                v = np.zeros(dim)
                v[2 * p], v[2 * p + 1] = np.sqrt(0.99 * (1 + 0.96 / 0.99) / 2), (1 - 2 * g) * np.sqrt(0.99 * (1 - 0.96 / 0.99) / 2)
                v[2 * count + g * size + i] = 0.1
                x.append(v)
    order = np.random.default_rng(3).permutation(len(x))
    return np.array(x)[order], (np.arange(len(x)) // (2 * size))[order]


def check(spark, size):
    x, pair = groups(size)
    near = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.95
    assert near.sum(1).tolist() == [2 * size] * len(x)
    out = near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    first = {p: int(np.flatnonzero(pair == p)[0]) for p in set(pair.tolist())}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {i: (2 * size - 1, first[p], first[p] == i) for i, p in enumerate(pair.tolist())}


def test_full_lists_do_not_hide_links(spark):
    check(spark, 40)


def test_exact_search_when_the_descent_finds_nothing(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "start", lambda nodes, *_, **__: nodes.sparkSession.createDataFrame([], "a long, b long, sim double"))
    check(spark, 12)


def test_repeated_ids(spark):
    """Rows of one id and different vectors are vectors of their own; components are named by the smallest id, whichever vector has it."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (4, [0.01, 1.0]), (1, [1.0, 0.0]), (0, [-1.0, 0.0]), (0, [0.0, -1.0]), (9, [0.01, -1.0]), (5, [0.0, -1.0]), (6, [1.0, 1.0]), (6, [-1.0, 1.0]), (7, None)]
    out = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    fine = sorted({(i, tuple(v)) for i, v in rows if v})
    x = np.array([v for _, v in fine])
    near = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.95
    reach = np.linalg.matrix_power(near.astype(int), len(fine)) > 0
    want = [(i, int(near[k].sum()) - 1, min(fine[j][0] for j in np.flatnonzero(reach[k]))) for k, (i, _) in enumerate(fine)] + [(7, 0, 7)]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
