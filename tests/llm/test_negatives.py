"""Hard-negative mining against brute force."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import negatives

NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def integers(rows):
    """vec_id -> (label, vector) of usable rows, as float32 holds them."""
    kept = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in vector])
        kept[vec_id] = min(kept.get(vec_id, row), row)
    return kept


def brute(rows, every, positives=5, negatives=5):
    kept, out = integers(rows), []
    for anchor, (label, vector) in kept.items():
        if anchor % every:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(vector, other)), vec_id, own == label)
            for vec_id, (own, other) in kept.items() if vec_id != anchor and len(other) == len(vector)
        )
        for high, positive, _ in [row for row in scored if row[2]][:positives]:
            inside = [row for row in scored if not row[2] and -80 * high <= -100 * row[0] <= -100 * high][:negatives]
            out += [(anchor, positive, rank, vec_id, -high, -score) for rank, (score, vec_id, _) in enumerate(inside, 1)]
    return sorted(out)


def run(spark, rows, every):
    schema = "vec_id long, label int, embedding array<float>, vector string, width int"
    table = spark.createDataFrame([(i, label, v, "clash", 1) for i, label, v in rows], schema)
    vectors = negatives.labelled_vectors(table)
    found = negatives.hard_negatives(vectors, vectors.where(F.col("vec_id") % every == 0))
    assert found.columns == list(NAMES)
    return sorted(tuple(row) for row in found.collect())


@pytest.mark.parametrize("case", ["normal", "equal", "one label", "many labels", "negative"])
def test_against_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    monkeypatch.setattr(negatives, "PRODUCTS", 200)
    rng = np.random.default_rng(7)
    vectors, labels = rng.normal(0, 0.4, (300, 6)), rng.integers(0, 4, 300)
    if case == "equal":
        vectors[40:240] = vectors[0]
    if case == "one label":
        labels[20:] = 1
    if case == "many labels":
        labels = rng.integers(0, 150, 300)
    if case == "negative":
        vectors = -np.abs(vectors) * np.where(np.arange(300)[:, None] % 10, -1, 1)
    rows = [(int(i) - 20, int(label), [float(x) for x in v]) for i, (label, v) in enumerate(zip(labels, vectors))]
    expected = brute(rows, 10)
    assert run(spark, rows, 10) == expected
    assert expected


def test_ties_repeats_and_unusable_rows(spark):
    rows = [(0, 1, [1.0, 1.0]), (10, 1, [1.0, 1.0]), (10, 1, [1.0, 1.0]), (3, 2, [1.0, 1.0]), (1, 2, [1.0, 1.0]), (2, 1, [0.9, 1.0])]
    rows += [(4, None, [1.0, 1.0]), (None, 2, [1.0, 1.0]), (5, 2, None), (6, 2, []), (7, 2, [None, 1.0]), (8, 2, [float("nan"), 1.0])]
    rows += [(9, 2, [float("inf"), 1.0]), (11, 2, [1.0, 1.0, 1.0]), (20, 5, [1.0, 1.0]), (30, 1, [0.0, 0.0]), (12, 4, [1.0, 0.8]), (12, 3, [1.0, 0.9])]
    found = run(spark, rows, 10)
    assert found == brute(rows, 10)
    assert [row[3] for row in found if row[:2] == (0, 10)] == [1, 3, 20, 12]  # ties by id, then a lower score
    assert not [row for row in found if row[0] == 20]  # no positive


def test_empty_table(spark):
    assert run(spark, [], 10) == []


def test_large_products_stay_exact():
    big = 2.0**40
    assert negatives.integer_products(np.array([[big, 1.0]]), np.array([[2.0**20, 3.0]])).tolist() == [[2**60 + 3]]
    with pytest.raises(OverflowError):
        negatives.integer_products(np.array([[big, 1.0]]), np.array([[big, 3.0]]))


def test_iterator_holds_only_open_windows():
    """Negatives of one anchor are read one by one; windows close when they are full or passed."""
    read = []

    def keys():
        for score, kind, vec_id in [(100, 0, 5), (100, 1, 1), (99, 1, 2), (98, 0, 6), (90, 1, 3), (79, 1, 4), (78, 1, 7), (10, 1, 8)]:
            read.append(vec_id)
            yield negatives._KEY.pack(2**63, negatives._HIGH - score, kind, vec_id + 2**63)

    found = negatives.opened_windows(keys(), positives=2, negatives=3)
    assert next(found) == (0, 5, 1, 1, 100, 100)
    assert read == [5, 1]
    assert list(found) == [(0, 5, 2, 2, 100, 99), (0, 5, 3, 3, 100, 90), (0, 6, 1, 3, 98, 90), (0, 6, 2, 4, 98, 79)]


def test_keys_sort_as_anchor_score_kind_id():
    rows = [(a, s, k, i) for a in (-3, 0, 2**62) for s in (-5, 0, 2**50) for k in (0, 1) for i in (-1, 0, 9)]
    packed = sorted(
        key for a, s, k, i in rows for key in negatives._packed(np.array([a]), np.array([s]), k, np.array([i]))
    )
    unpacked = [struct.unpack(">QQBQ", key) for key in packed]
    order = sorted(rows, key=lambda row: (row[0], -row[1], row[2], row[3]))
    assert [(a - 2**63, 2**63 - 1 - s, k, i - 2**63) for a, s, k, i in unpacked] == order
