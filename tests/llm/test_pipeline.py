"""The pipeline, stage by stage, against brute-force versions of its stages."""

import hashlib

import corpus_pipeline as pipeline
import pytest
from test_decontaminate import best_part
from test_nearcopies import brute_kept
from test_packing import check
from test_substring import brute as brute_substring

from millrace.llm import decontaminate as dc
from millrace.llm.common import staged


@pytest.fixture(scope="module")
def states(spark):
    """What goes into and comes out of every stage."""
    directory = "/root/testdata/sf0.001"
    frames = [spark.read.parquet(f"{directory}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        frames.append(staged(stage(spark, frames[-1], directory), "test"))
    return frames


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns(states):
    assert all(frame.schema.simpleString() == states[0].schema.simpleString() for frame in states[:-1])
    assert [name for name, _ in pipeline.STAGES][1] == "SimHash near-dedup"


def test_language_id_keeps_clean_documents(states):
    assert texts(states[1]) == texts(states[0])


def test_one_of_each_group_stays(states):
    before = texts(states[1])
    kept, pairs = brute_kept(sorted(before.items()))
    assert texts(states[2]) == {d: before[d] for d in kept}
    assert pairs and len(kept) < len(before)


def test_passages_go(states):
    before, after = texts(states[2]), states[3].collect()
    expected = {doc: (n, gone, digest) for doc, n, gone, digest in brute_substring(sorted(before.items()))}
    assert {r.doc_id for r in after} == {d for d, (n, gone, _) in expected.items() if gone < n}
    for row in after:
        n, gone, digest = expected[row.doc_id]
        assert hashlib.sha256(" ".join(row.text.split()).encode()).hexdigest() == digest
        assert gone or row.text == before[row.doc_id]
        assert row.n_chars == len(row.text)


def test_benchmark_documents_go(spark, states):
    before, after = texts(states[3]), texts(states[4])
    items = [dc.normal(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    for doc in set(before) - set(after):
        low = dc.normal(before[doc])
        assert any(i in low for i in items) or min(best_part(i, low) - dc.budget(len(i)) for i in items) <= 0
    for doc, text in after.items():
        assert before[doc] == text and not any(i in dc.normal(text) for i in items)


def test_all_that_is_left_is_packed(states):
    check(states[5], list(texts(states[4]).items()))


def test_run(spark, states):
    found = pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, found.collect())) == sorted(map(key, states[5].collect()))


def test_odd_rows(spark):
    words = " ".join(f"the word{i}" for i in range(40))
    rows = [(1, words, "en"), (1, words, "en"), (1, "another text of the same id", "en"), (None, words, None), (2, None, "en")]
    rows += [(3, "", "en"), (4, "99 !!", "xx"), (5, words + " and the end", "en"), (6, "x " * 50_000, "en"), (7, "und der die das", "de")]
    docs = spark.createDataFrame([(d, t, lang, "s", 1, 2.0, True) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, fp double, whole boolean")
    for _, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, "/root/testdata/sf0.001"), "odd")
        if "text" in docs.columns:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "whole"]
    assert 1 in {r.doc_id for r in docs.collect()}


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "e f g h"), (None, "e f g h"), (2, "a b c d")], "doc_id long, text string")
    assert sorted(map(tuple, pipeline.near_dedup(spark, docs, "").collect()), key=repr) == [(1, "a b c d"), (None, "e f g h")]


def test_ties_of_repeated_rows_are_defined(spark):
    """Of rows with one id and text the same stays, however they come."""
    rows = [(1, "a b c d", lang, n) for lang in ("fr", None, "en") for n in (3, 1, 2)]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, n_chars long").repartition(4)
        assert list(map(tuple, pipeline.near_dedup(spark, docs, "").collect())) == [(1, "a b c d", "en", 1)]


def test_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, "/root/testdata/sf0.001"), "empty")
    assert docs.count() == 0
