"""Rule statistics against brute force, and the isolation forest on rows it has not learned from."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "one", "a b c d e f g h a b c d e f g h", "x " * 9, "a a a a a a a a", "ab c   d e \x1c\x1d é ü 漢字 😀",
    "l\nl\nl \n\nl\n \n", "# $ a% <b> | & *", "\r\nline\r\nline\r\n", "w " * 5_000 + "end", " ".join(map(str, range(20_000))) + " 1 2 3 4 5 6 7 8",
    "a b c d e f g h i j a b c d e f g X c d e f g h i j", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 1 2 3 4 5 6 7 8 9",
]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_counts(text):
    assert quality.statistics(None if text is None else text.encode())[:5] == brute(text)


def test_counts_of_random_words():
    rng = np.random.default_rng(3)
    for size in (7, 8, 9, 16, 50, 400):
        for letters in (1, 2, 3, 5):
            text = " ".join(rng.choice(list("abcde")[:letters], size))
            assert quality.statistics(text.encode())[:5] == brute(text)
    words = rng.integers(0, 2, 60)
    for window in (2, 3, 5, 7):
        runs = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
        inside = {i + j for i in range(len(words) - window + 1) if runs[tuple(words[i : i + window])] > 1 for j in range(window)}
        assert quality.repeated_words(words, window) == len(inside)


def test_query_against_brute_force(spark, tables):
    from millrace.llm.queries import op13_quality

    texts = {row.doc_id: row.text for row in table(spark, tables, "documents").collect()}
    rows = op13_quality(spark, tables).collect()
    assert sorted(row.doc_id for row in rows) == sorted(texts)
    for row in rows:
        expected = brute(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected
        assert row.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (row.base_failed and row.kept)
    assert rows == op13_quality(spark, tables).collect()


def test_held_out_rows(spark):
    """Learned from two thirds of the labels, the forest keeps the clean documents of the rest and
    finds the bad ones that pass the hard rules."""
    directory = "/root/testdata/sf0.01"
    docs, labels = table(spark, directory, "documents"), table(spark, directory, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    forest = quality.train(docs, labels.where(~held_out))
    truth = {row.doc_id: row.quality for row in labels.collect()}
    rows = [row for row in quality.judged(docs, forest).collect() if zlib.crc32(str(row.doc_id).encode()) % 3 == 1]
    passed = [(truth[row.doc_id], row.kept) for row in rows if row.doc_id in truth and not row.base_failed]
    clean, bad = [kept for label, kept in passed if label == 1], [kept for label, kept in passed if label == 0]
    assert len(clean) > 80 and len(bad) > 5
    assert sum(clean) >= 0.97 * len(clean)
    assert sum(bad) <= 0.2 * len(bad)


def test_forest_isolates_what_differs():
    rng = np.random.default_rng(5)
    usual = np.clip(rng.normal([0.4, 0, 0, 0.05, 0.9, 0.03, 0], 0.01, (500, 7)), 0, 1)
    odd = usual[:20].copy()
    odd[:, 1] = 0.6
    forest = quality.grow(usual)
    assert forest.scores(odd).min() > forest.scores(usual).max()
    assert forest.scores(usual[:0]).shape == (0,)


def test_threshold_keeps_clean_rows():
    rng = np.random.default_rng(6)
    counts = np.zeros((400, 9), np.int64)
    counts[:, 0], counts[:, 1], counts[:, 5], counts[:, 6] = 100, rng.integers(480, 520, 400), 10, 90
    clean = np.arange(400) % 8 > 0
    counts[~clean, 2] = 250
    forest = quality.calibrated(counts, clean)
    odd = forest.anomalous(quality.features(counts))
    assert odd[~clean].all() and odd[clean].mean() <= 0.01
    # Nothing clean, or nothing at all, calibrates nothing.
    for rows, labels in ((counts[~clean], clean[~clean]), (counts[:0], clean[:0])):
        assert not quality.calibrated(rows, labels).anomalous(quality.features(counts)).any()
    # Only clean rows: none of those held back is lost.
    assert quality.calibrated(counts[clean], clean[clean]).anomalous(quality.features(counts[clean])).mean() < 0.02


def test_nulls_repeats_and_clashing_columns(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good), (1, good), (None, good), (2, None), (3, "few words"), (4, "again and again, we go on and " * 20)]
    docs = spark.createDataFrame([(i, t, 1.0, "x", 7) for i, t in rows], "doc_id long, text string, score double, kept string, n_words int")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0), (3, 0, 0), (3, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    forest = quality.train(docs, labels)
    found = sorted(((r.doc_id, r.n_words, r.base_failed, r.kept) for r in quality.judged(docs, forest).collect()), key=str)
    assert found == sorted(
        [(1, 40, False, True), (1, 40, False, True), (None, 40, False, True), (2, 0, True, False), (3, 2, True, False), (4, 140, True, False)], key=str
    )
    kept = quality.accepted(docs, forest)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r.text == good)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    forest = quality.train(docs, labels)
    assert quality.judged(docs, forest).collect() == []
    assert quality.accepted(docs, forest).collect() == []
    one = spark.createDataFrame([(1, " ".join(map(str, range(50))))], "doc_id long, text string")
    assert quality.judged(one, forest).first().kept
