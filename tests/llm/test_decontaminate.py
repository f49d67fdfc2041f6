"""Benchmark decontamination against brute-force edit distances."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import decontaminate as dc


def best_part(item, text):
    """Least edit distance of ``item`` to any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=90))
def test_myers_is_the_edit_distance(item, text):
    scores = [len(item), *dc.Pattern(item).scores(text, False)]
    assert min(scores) == best_part(item, text)


def edited(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "z" + text[at + 1 :]])
    return text


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["the", "of", "and", "inth", "erat", "onst", "hand", "ble"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(12 + i % 9)) for i in range(25)] + [(90, None), (91, ""), (92, "short"), (93, "the of and"), (94, "of inth"), (95, "Hand"), (3, line(15)), (None, line(14))]
    docs = []
    for doc in range(120):
        text = line(rng.randrange(0, 60))
        if doc % 3:
            item = rng.choice([t for _, t in items if t and len(t) > 20])
            text += rng.choice([" ", "\n\t", ""]) + edited(rng, item, rng.randrange(0, 9)).upper() + " " + line(rng.randrange(0, 9))
        docs.append((doc, text))
    docs += [(500, None), (501, ""), (None, items[0][1]), (600, items[1][1]), (600, items[1][1]), (502, line(20_000) + " " + items[2][1])]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = sorted(((r.doc_id, r.item_id, r.edits) for r in dc.matches(frame, bench).collect()), key=repr)
    expected = []
    for doc, text in docs:
        for item, passage in items:
            a, b = dc.normal(passage or ""), dc.normal(text or "")
            if 0 < len(a) < 32 and re.search(rf"\b{re.escape(a)}\b", b):
                expected.append((doc, item, 0))
            elif len(a) >= 32 and len(b) < 5000:
                d = best_part(a, b)
                if d <= int(len(a) * 0.08):
                    expected.append((doc, item, d))
    assert [f for f in found if f[0] != 502 or f[1] in (93, 94, 95)] == sorted(expected, key=repr)
    assert (502, 2, 0) in found
    hit = {r[0] for r in found}
    kept = [r.doc_id for r in dc.clean(frame, bench).collect()]
    assert sorted(kept, key=repr) == sorted((d for d, _ in docs if d not in hit), key=repr)
    assert dc.clean(frame, bench).columns == frame.columns


def test_spans(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    text = "one two\n three " + item.replace("epsilon", "epsilom") + " four five"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(8, item)], "item_id long, text string")
    assert [tuple(r) for r in dc.matches(frame, bench).collect()] == [(1, 8, 1, 3, 17)]


def test_short_items(spark):
    items = [(1, "Is 7 prime?"), (2, "cat"), (3, "猫が好き"), (4, "a"), (5, "  "), (6, "x" * 31), (7, "y" * 32)]
    docs = [(1, "so: IS  7\nprime? yes"), (2, "concatenate category"), (3, "the cat, sat"), (4, "私は猫が好きです"), (5, "This 7 prime?")]
    docs += [(6, "b-a"), (7, "x" * 30), (8, "x" * 32), (9, "x" * 31), (10, "y" * 31), (11, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r)[:3] for r in dc.matches(frame, bench).collect()) == [(1, 1, 0), (3, 2, 0), (4, 3, 0), (6, 4, 0), (9, 6, 0), (10, 7, 1)]
    assert sorted(r.doc_id for r in dc.clean(frame, bench).collect()) == [2, 5, 7, 8, 11]


def test_a_long_item(spark):
    """An item of 12,000 characters with 30 edits, in a longer text and alone."""
    rng = random.Random(8)
    item = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1600))
    other = " ".join(f"v{rng.randrange(10**6)}" for _ in range(900))
    frame = spark.createDataFrame([(1, f"{other} {edited(rng, item, 30)} {other}"), (2, item), (3, other)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = {r.doc_id: r.edits for r in dc.matches(frame, bench).collect()}
    assert set(found) == {1, 2} and found[2] == 0 and 0 < found[1] <= 30


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert dc.matches(none, no_items).collect() == [] == dc.matches(some, no_items).collect()
    assert dc.clean(some, no_items).count() == 1


def test_passes_cover_all_items(spark, monkeypatch):
    monkeypatch.setattr(dc, "PASS_CHARS", 100)
    items = [(i, " ".join(f"w{i}x{k}" for k in range(10))) for i in range(12)]
    docs = spark.createDataFrame([(i, "say " + t) for i, t in items], "doc_id long, text string")
    found = dc.matches(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i) for i in range(12)]
