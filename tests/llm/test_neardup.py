import numpy as np

from claimweir.llm.neardup import close_pairs, near_duplicates, projections
from claimweir.llm.shared import table
from tests.llm.helpers import Groups


def brute(rows, threshold=0.98):
    links, groups, by = {i: 0 for i, _, _ in rows}, Groups({i for i, _, _ in rows}), {}
    for i, v, label in rows:
        by.setdefault((label, len(v)), []).append((i, np.array(v, float)))
    for own in by.values():
        x = np.array([v for _, v in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            links[own[a][0]] += 1
            links[own[b][0]] += 1
            groups.link(own[a][0], own[b][0])
    return {i: (links[i], groups.of(i)) for i in links}


def test_links_equal_brute_force(spark, sf):
    vectors = table(spark, sf, "embeddings")
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(vectors).collect()}
    assert found == brute([(r.vec_id, r.embedding, r.label) for r in vectors.collect()])


def test_clusters_across_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr("claimweir.llm.neardup.BLOCK", 64)
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((4, 24))
    x = np.vstack([centres[k % 4] + draw.standard_normal((90, 24)) * 0.12 for k in range(6)] + [np.repeat(centres[:1], 200, axis=0)])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    found = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5))
    want = brute(rows)
    assert sum(n for n, _ in want.values()) > 10_000
    assert {r.vec_id: (r.n_links, r.component_id) for r in found.collect()} == want


def test_no_pair_at_the_threshold_is_lost():
    draw = np.random.default_rng(4)
    for size in (2, 5, 64, 100):
        x = draw.standard_normal((300, size))
        y = x + draw.standard_normal((300, size)) * np.linalg.norm(x, axis=1, keepdims=True) * 0.19 / np.sqrt(size)
        i, j = close_pairs(x, y, 0.98)
        a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(k.tolist() for k in np.nonzero(a @ b.T >= 0.98)), strict=True))
        assert np.allclose(projections(size).T @ projections(size), np.eye(min(size, 64)))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [2.0, 0.0, 0.0], 1), (4, None, 1), (5, [0.0] * 3, 1), (6, [nan, 1.0, 1.0], 1), (7, [1.0, None, 0.0], 1),
        (8, [1.0, 0.0, 0.0], None), (9, [1.0, 0.1, 0.0], 1), (10, [1.0, 0.0, 0.0], 2), (11, [1.0, 0.0], 1), (12, [], 1), (13, [inf, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS block", "1 AS links")
    found = {r[0]: tuple(r)[1:] for r in near_duplicates(vectors).collect()}
    linked = {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 9: (3, 1, False), None: (0, None, False)}
    assert found == {i: (0, i, True) for i, _, _ in rows} | linked
    assert near_duplicates(vectors.filter("false")).collect() == []
