"""Language ID: held-out accuracy, whole texts, calibration and edge cases."""

import math
import zlib

import numpy as np
import pytest

from millrace.llm import langid
from millrace.llm import queries


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return queries.language_model(documents)


def test_held_out_accuracy_and_calibration(spark, documents):
    found = queries.QUERIES["op8_langid"](spark, "/root/testdata/sf0.01").toPandas()
    truth = documents.select("doc_id", "lang").toPandas()
    both = found.merge(truth, on="doc_id")
    assert len(both) == documents.count()
    assert (both.held_out == both.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert abs(held.score.mean() - (held.lang == held.lang_pred).mean()) < 0.05
    assert both.score.between(0, 1).all()
    assert both.rejected.sum() == 0


def test_training_ignores_held_out_rows(spark, documents, model):
    changed = documents.selectExpr(
        "doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1, 'zz', lang) as lang", "text"
    )
    again = queries.language_model(changed)
    assert again.languages == model.languages
    assert (again.table == model.table).all() and again.threshold == model.threshold


def test_edge_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (None, "The and of this that was ing"), (5, "ö"), (6, "the and " * 400_000)]
    docs = spark.createDataFrame([(d, t, "xx", 0.5, True) for d, t in rows] * 2, "doc_id long, text string, lang_pred string, score double, readable boolean")
    found = langid.predictions(docs, model).collect()
    assert len(found) == 12
    by_id = {row.doc_id: row for row in found}
    assert all(by_id[d].lang_pred == "und" and by_id[d].score == 0 and by_id[d].rejected for d in (1, 2, 3))
    assert by_id[None].lang_pred == "en" == by_id[6].lang_pred
    assert by_id[5].lang_pred in model.languages
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {row.doc_id for row in kept.collect()} >= {None, 6}
    assert {row.doc_id for row in kept.collect()}.isdisjoint({1, 2, 3})


def test_slices_add_up(monkeypatch):
    text = "Über allen Gipfeln ist Ruh, in allen Wipfeln " * 50
    whole = np.sort(np.concatenate(list(langid.subwords(text))))
    monkeypatch.setattr(langid, "_SLICE", 64)
    assert (np.sort(np.concatenate(list(langid.subwords(text)))) == whole).all()
    words = (" " + " ".join(text.lower().split()) + " ").encode()
    three = sum(1 for i in range(len(words) - 2) if words[i + 1] != 32)
    four = sum(1 for i in range(len(words) - 3) if 32 not in words[i + 1 : i + 3])
    assert len(whole) == three + four


def brute_judge(model, text):
    """The forward pass subword by subword, in plain Python."""
    raw = (" " + " ".join(text.lower().split()) + " ").encode()
    total, count, new = list(map(float, model.bias * 0)), 0, 0
    for size, mixer in ((3, 0), (4, 0x5BD1E995)):
        for at in range(len(raw) - size + 1):
            if b" " in raw[at + 1 : at + size - 1]:
                continue
            bucket = ((int.from_bytes(raw[at : at + size]) ^ mixer) * 2654435761 % 2**32) >> 16
            total = [a + float(b) for a, b in zip(total, model.table[bucket])]
            count, new = count + 1, new + (not model.seen[bucket])
    logits = [(a / count + float(b)) / model.temperature for a, b in zip(total, model.bias)]
    best = max(range(len(logits)), key=lambda k: (logits[k], -k))
    chance = 1 / sum(math.exp(x - logits[best]) for x in logits)
    language = model.languages[best]
    share = model.unseen[language]
    return language, chance, chance < model.threshold[language] or new > share * count + 3 * math.sqrt(count * share * (1 - share))


def test_against_a_plain_forward_pass(spark):
    found = {r.doc_id: r for r in queries.QUERIES["op8_langid"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = queries.language_model(docs)
    rows = docs.collect()
    assert len(found) == len(rows)
    for row in rows:
        if row.text and any(c.isalpha() for c in row.text):
            language, chance, rejected = brute_judge(model, row.text)
            got = found[row.doc_id]
            assert (got.lang_pred, got.rejected) == (language, rejected) and got.score == pytest.approx(chance)
        else:
            assert found[row.doc_id].lang_pred == "und"


def test_sample_is_whole_texts_once_each(spark, monkeypatch):
    """The rows with the smallest hashes, copies once, counted to their last word."""
    taken = []
    monkeypatch.setattr(langid, "learn", lambda rows: taken.extend(rows))
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 3)
    rows = [(d, "abc " * 5000 + f"end{d}", lang) for d in range(20) for lang in ("x", "y")]
    docs = spark.createDataFrame(rows + rows[:8] * 30 + [(50, None, "x"), (51, "t", None), (52, "1", "y")], "doc_id long, text string, lang string")
    langid.train(docs)
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", f"xxhash64(doc_id, {langid.SEED}) AS h").collect()}
    first = sorted(range(20), key=hashes.get)[:3]
    expected = sorted((lang, tuple(langid.counted(text)[1])) for d, text, lang in rows if d in first)
    assert sorted((lang, tuple(counts)) for lang, _, counts in taken) == expected


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    empty = langid.train(none)
    some = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert [tuple(row) for row in langid.predictions(some, empty).collect()] == [(1, "und", 0.0, True)]
    assert langid.predictions(none, empty).collect() == []
    one = langid.fit([("en", "a text")])
    assert one.predict("anything") == ("en", 1.0)
