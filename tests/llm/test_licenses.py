"""Licence scans against brute force."""

import math
import re

import pytest

from millrace.llm import licenses as lic


def brute(files, templates=lic.TEMPLATES):
    files = [(p, t) for p, t in files if p is not None]
    texts = [t for _, t in files if t is not None]
    vocabulary = {w for _, t in templates for w in lic._words(t)}
    held = [set(lic._words(t)) for t in texts]
    idf = {w: math.log((len(texts) + 1) / (sum(w in h for h in held) + 1)) + 1 for w in vocabulary}
    rare = math.log(len(texts) + 1) + 1

    def vector(text):
        words = lic._words(text)
        return {w: words.count(w) * idf.get(w, rare) for w in set(words)}

    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    shapes = {n: vector(t) for n, t in templates}

    def closest(text):
        v = vector(text)
        if not v:
            return (0, "")
        return min((-round(sum(x * v.get(w, 0) for w, x in t.items()) / norm(t) / norm(v), 6), n) for n, t in shapes.items())

    headers, holders = {}, {}
    for path, text in files:
        for line in (text or "").split("\n"):
            best = closest(line)
            if -best[0] >= lic.HEADER:
                headers[path] = min(headers.get(path, best), best)
        best, directory = closest(text or ""), path.rpartition("/")[0]
        if -best[0] >= lic.FILE:
            holders[directory] = min(holders.get(directory, best), best)
    out = []
    for path in {p for p, _ in files}:
        if path in headers:
            out.append((path, headers[path][1], "header", -headers[path][0], None))
            continue
        at = path.rpartition("/")[0]
        while at not in holders and at:
            at = at.rpartition("/")[0]
        if at in holders:
            out.append((path, holders[at][1], "inherited", -holders[at][0], at))
        else:
            out.append((path, None, "none", None, None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in lic.scan(df).collect()), key=repr)


def test_edge_cases(spark):
    notice = dict(lic.TEMPLATES)
    plain = "some words of a text that has nothing to do with it\n"
    files = [
        ("LICENSE", notice["MIT"]), ("a/x.txt", plain), ("a/b/LICENSE", notice["GPL-3.0"] + "."), ("a/b/c/d.txt", plain * 3),
        ("a/b/e.txt", plain + "  # " + notice["Apache-2.0"].upper() + "\n" + plain), ("a/bb/f.txt", plain), ("a/b/n.txt", None),
        ("a/b/o.txt", ""), (None, notice["MIT"]), ("g/h.txt", plain * 2000 + notice["CC-BY-NC-4.0"]), ("g/h.txt", plain), ("g/h.txt", plain),
        ("g/two", notice["CC-BY-4.0"]), ("g/one", notice["CC-BY-SA-4.0"]), ("g/i", "license"), ("g/j", "under the of 2.0 version"), ("//", plain), ("/root", plain),
    ]
    frame = spark.createDataFrame([(p, t, "x", 1) for p, t in files], "path string, text string, license string, unit int")
    assert found(frame) == brute(files)


def test_without_root_licence(spark):
    files = [("a", "words"), ("b/c", "Released under the MIT License"), ("b/d/e", "words")]
    rows = found(spark.createDataFrame(files, "path string, text string"))
    assert rows == brute(files)
    assert ("a", None, "none", None, None) in rows


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "path string, text string")) == []


def test_needed_terms_are_enough():
    weights = {w: 1.0 + len(w) / 5 for _, t in lic.TEMPLATES for w in lic._words(t)}
    vectors = lic.template_vectors(lic.TEMPLATES, weights)
    needed = lic.needed_terms(vectors, 0.4)
    for vector in vectors.values():
        assert math.sqrt(sum(w * w for word, w in vector.items() if word not in needed)) < 0.4


@pytest.mark.parametrize("name", ["sf0.001"])
def test_documents(spark, name):
    frame = spark.read.parquet(f"/root/testdata/{name}/documents.parquet").selectExpr(
        "concat_ws('/', source, lang, cast(floor(doc_id / 1000) as string), cast(doc_id as string)) as path", "text"
    )
    rows = found(frame)
    assert rows == brute([(r.path, r.text) for r in frame.collect()])
    marked = {r.path for r in frame.collect() if re.search("icensed under|Released under the MIT", r.text)}
    assert {r[0] for r in rows if r[2] == "header"} >= marked
