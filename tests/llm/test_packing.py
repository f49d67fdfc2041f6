"""Packing: tokens, cuts, and packings against their constraints and lower bound."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def expected_pieces(rows, capacity=1024):
    tokenizer, out = Tokenizer.from_file(VOCABULARY), []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = sorted({0, *range(len(ids), 0, -capacity)})
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    return sorted(out, key=repr)


def check(packed, rows, capacity=1024):
    found = packed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == expected_pieces(rows, capacity)
    bins = {}
    for row in found:
        bins.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bins = check(packing.pack_documents(docs, VOCABULARY), rows)
    total = sum(p[3] for p in expected_pieces(rows))
    assert bins <= 1.01 * -(-total // 1024) + 1


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "<|endoftext|> special <|endoftext|>"), (4, "é ü 漢字 🙂 \x00\t\n")]
    rows += [(5, "long text " * 40_000), (5, "long text " * 40_000), (6, "x" * 3000), (7, "same"), (7, "same"), (7, "other")]
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, key int, offset int, sequence_id int")
    check(packing.pack_documents(docs, VOCABULARY), rows)
    check(packing.pack_documents(docs, VOCABULARY, 16), rows, 16)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, VOCABULARY).collect() == []


def brute_bound(lengths, capacity=1024):
    lengths, best = np.array(lengths, np.int64), 0
    for small in range(capacity // 2 + 1):
        large = lengths > capacity - small
        middle = ~large & (lengths > capacity // 2)
        rest = lengths[(lengths <= capacity // 2) & (lengths >= small)].sum()
        room = middle.sum() * capacity - lengths[middle].sum()
        best = max(best, large.sum() + middle.sum() + max(0, -(-(rest - room) // capacity)))
    return best


def test_lower_bound():
    rng = np.random.default_rng(6)
    for high in (50, 300, 1024):
        lengths = rng.integers(1, high + 1, 400)
        assert packing.least_bins(lengths, 1024) == brute_bound(lengths)
        assert packing.least_bins(lengths, 1024) <= len(np.unique(packing.evolve(lengths, [], 1024, (1,))))


@pytest.mark.parametrize("count", [0, 1, 3000])
def test_pack_is_near_the_bound(spark, count):
    rng = np.random.default_rng(count)
    lengths = rng.integers(1, 1025, count).tolist()
    items = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "key long, length long")
    packed = packing.pack(packing.staged(items, "items")).toPandas()
    assert sorted(packed.key) == list(range(count))
    fill = packed.groupby("sequence_id").length.sum()
    assert (fill <= 1024).all()
    assert len(fill) <= 1.01 * brute_bound(lengths)


def test_crossover_keeps_pieces_and_capacity():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 400, 200)
    a, b = packing._fresh(lengths, 1024, None), packing._fresh(lengths, 1024, rng)
    for _ in range(20):
        child = packing.crossover(lengths, a, b, 1024, rng)
        assert (child >= 0).all() and np.bincount(child, lengths).max() <= 1024
        a, b = b, child


def test_evolution_beats_best_fit():
    rng = np.random.default_rng(4)
    better = 0
    for seed in range(5):
        lengths = rng.integers(200, 700, 150)
        plain = packing._fresh(lengths, 1024, None)
        best = packing.evolve(lengths, [], 1024, (seed,), 60)
        assert best.max() <= plain.max()
        better += packing._fitness(lengths, best, 1024) > packing._fitness(lengths, plain, 1024)
    assert better >= 3


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four " * 30)], "doc_id long, text string")
    cut = packing.staged(packing.pieces(docs, VOCABULARY, 16), "pieces")
    rows = packing.sequences(packing.pack(cut, 16)).collect()
    assert sum(len(r.ids) for r in rows) == 4 * sum(r.length for r in cut.collect())
    assert all(len(r.ids) <= 64 for r in rows)
