"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import pytest
import xxhash

from millrace.llm import components, simhash
from millrace.llm.components import connected


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fp) -> component of each row."""
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (doc, _), x in zip(rows, label):
        least[x] = min((d for d in (least.get(x), doc) if d is not None), default=None)
    return [least[x] for x in label]


def expected(texts):
    rows = [(doc, brute_fingerprint(text)) for doc, text in texts]
    return sorted(
        ((doc, f"{fp:016x}", comp) for (doc, fp), comp in zip(rows, brute_components(rows))), key=repr
    )


def found(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def test_edge_cases(spark):
    words = [f"w{i}" for i in range(400)]
    near = words[:399] + ["other"]
    texts = [
        (5, " ".join(words)), (3, "\t".join(words)), (9, " ".join(near)), (None, " ".join(words)),
        (7, None), (2, ""), (8, " \n\x0b"), (4, "One"), (6, "one"), (1, "a b"), (10, "É é"), (10, "É é"),
        (None, "lonely text without an id"), (11, "x " * 50_000), (12, "a\x1cb c\xa0d e"),
    ]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in texts], "doc_id long, text string, fp int, label int")
    assert found(simhash.near_duplicates(docs)) == expected(texts)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("capacity", [simhash.CAPACITY, 7])
def test_links_of_random_fingerprints(spark, capacity):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, np.uint64)
    flips = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (12, 2))]
    flips += [f ^ 5 for f in flips[:60]]
    fps = sorted({*map(int, base), *flips})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    labels = {row.node % 2**64: row.label % 2**64 for row in connected(simhash.links(distinct, 2, capacity)).collect()}
    brute = brute_components([(i, f) for i, f in enumerate(fps)])
    group = {}
    for f, comp in zip(fps, brute):
        group.setdefault(comp, set()).add(f)
    for members in group.values():
        got = {labels.get(f, f) for f in members}
        assert len(got) == 1
    assert len({labels.get(f, f) for f in fps}) == len(group)


def test_tree_search_is_exact():
    rng = np.random.default_rng(1)
    nodes = np.unique(rng.integers(0, 2**12, 500, np.uint64) << np.uint64(20))
    queries = rng.integers(0, 2**12, 80, np.uint64) << np.uint64(20)
    child = simhash.build_tree(nodes)
    pairs = {(int(q), int(n)) for a, b in simhash.search_tree(nodes, child, queries, 2) for q, n in zip(a, b)}
    near = np.bitwise_count(queries[:, None] ^ nodes[None, :]) <= 2
    assert pairs == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_long_path_is_one_component(spark):
    links = spark.range(300).selectExpr("id + 1 as a", "id as b")
    assert {row.label for row in connected(links).collect()} == {0}


def test_rounds_of_few_links_are_few_files(spark, conf, monkeypatch):
    """However many pieces a shuffle has, also where adaptive execution may not merge them."""
    conf("spark.sql.shuffle.partitions", "40")
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files, stage = [], components.staged

    def counted(df, label):
        back = stage(df, label)
        files.append(len(back.inputFiles()))
        return back

    monkeypatch.setattr(components, "staged", counted)
    links = spark.range(300).where("id % 100 > 0").selectExpr("id as a", "id - 1 as b")
    labels = {row.node: row.label for row in connected(links).collect()}
    assert labels == {node: node // 100 * 100 for node in range(300)}
    assert max(files) == 1
    # Of more rows than a task takes, each round has several.
    files.clear()
    monkeypatch.setattr(components, "ROWS", 100)
    assert {row.node: row.label for row in connected(links).collect()} == labels
    assert min(files) > 1 and max(files) <= 3


def test_query_on_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    texts = [(row.doc_id, row.text) for row in docs.collect()]
    assert found(simhash.near_duplicates(docs)) == expected(texts)
