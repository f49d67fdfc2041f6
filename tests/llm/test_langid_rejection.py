"""Language ID: texts of languages that were not learned are rejected, clean ones stay."""

import pytest

from millrace.llm import langid


@pytest.fixture(scope="module")
def texts(spark):
    found = {}
    for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect():
        found.setdefault(row.lang, []).append(row.text)
    return found


@pytest.mark.parametrize("learned", [["de"], ["de", "en"]])
def test_left_out_languages_are_rejected(texts, learned):
    model = langid.fit([(name, text[:1500]) for k in range(90) for name in learned for text in texts[name][k : k + 1]])
    for name, some in texts.items():
        rejected = [model.judge(text)[2] for text in some[60:100]]
        assert sum(rejected) == 0 if name in learned else sum(rejected) >= 38


def test_one_mixed_row_does_not_end_rejection(texts):
    rows = [(name, text[:1500]) for k in range(80) for name in texts for text in texts[name][k : k + 1]]
    mixed = " ".join(texts[name][101][:300] for name in texts)
    model = langid.fit([("en", mixed), *rows])
    assert all(threshold > 0.4 for threshold in model.threshold.values())
    assert model.judge("Привет, как дела? Это текст на другом языке, которого модель не видела никогда.")[2]


def test_rows_are_dropped(spark, texts):
    model = langid.fit([("de", text[:1500]) for text in texts["de"][:90]])
    docs = spark.createDataFrame([(1, texts["de"][95]), (2, texts["fr"][95])], "doc_id long, text string")
    assert [row.doc_id for row in langid.accepted(docs, model).collect()] == [1]
    assert {row.doc_id: row.rejected for row in langid.predictions(docs, model).collect()} == {1: False, 2: True}
