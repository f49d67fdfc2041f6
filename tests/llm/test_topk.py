"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest

from millrace.llm import topk


def brute(rows, queries, k):
    out = []
    for query_id, query in queries:
        scores = {(-sum(a * b for a, b in zip(query, v)), i) for i, v in rows if i != query_id and len(v) == len(query)}
        out += [(query_id, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def run(spark, rows, every, k=5):
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, block int, norm double")
    vectors = topk.integer_vectors(table)
    found = topk.top_k(vectors, vectors.where(f"vec_id % {every} = 0"), k).collect()
    return sorted(tuple(r) for r in found)


def integers(rows):
    good = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    return [(i, list(v)) for i, v in good]


@pytest.mark.parametrize("case", ["normal", "spread", "few", "equal", "negative"])
def test_against_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(topk, "LONGEST", 16)
    monkeypatch.setattr(topk, "BLOCK", 40)
    rng = np.random.default_rng(1)
    n = 4 if case == "few" else 300
    vectors = rng.normal(0, 0.3, (n, 8))
    if case == "spread":
        vectors *= 2.0 ** rng.integers(-6, 6, (n, 1))
    if case == "equal":
        vectors[50:250] = vectors[0]
    if case == "negative":
        vectors = -np.abs(vectors) * np.where(np.arange(n)[:, None] % 10, -1, 1)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    good = integers(rows)
    assert run(spark, rows, 10) == brute(good, [r for r in good if r[0] % 10 == 0], 5)


def test_edge_cases(spark):
    rows = [(0, [0.0, 0.0]), (10, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, None), (5, [None, 1.0])]
    rows += [(6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (8, []), (None, [5.0, 5.0]), (30, [1.0, 2.0, 3.0]), (9, [-1e6, 3e6])]
    rows += [(40, [float("-inf"), 0.0]), (50, None)]
    good = integers(rows)
    found = run(spark, rows, 10)
    assert found == brute(good, [r for r in good if r[0] % 10 == 0], 5)
    assert not [r for r in found if r[0] in (30, 40, 50)]


def test_empty_table(spark):
    assert run(spark, [], 10) == []


def test_products_are_exact_or_refused():
    a = np.array([[2.0**40, 1.0]])
    assert topk.products(a, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 1]]
    with pytest.raises(OverflowError):
        topk.products(a, a)


def test_pruning_leaves_out_vectors():
    rng = np.random.default_rng(0)
    vectors = rng.normal(0, 50, (2000, 16)).round()
    block = topk.Block(np.arange(2000), vectors, np.linalg.norm(vectors, axis=1))
    query = vectors[5]
    norm = float(np.linalg.norm(query))
    scores = vectors @ query
    least = 0.9 * norm * float(block.norms[0])
    left = block.candidates(query, norm, least)
    assert set(block.ids[left]) >= set(np.flatnonzero(scores >= least))
    assert len(left) < 500
    assert len(block.candidates(query, norm, 0.3 * norm * float(block.norms[0]))) < 2000
