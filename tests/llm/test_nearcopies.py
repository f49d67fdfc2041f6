"""Near copies of the pipeline against brute-force Jaccard similarities."""

import itertools
import random

import corpus_pipeline as pipeline
import numpy as np
import pytest

from millrace.llm import forest, nearcopies


def brute_kept(texts):
    """texts: (doc_id, text) with different ids -> ids of the first of each group, number of similar unequal pairs."""
    sets = []
    for _, text in texts:
        words = (text or "").encode().lower().split()
        sets.append({*zip(*(words[k:] for k in range(5)))} if len(words) >= 5 else {tuple(words)} if words else set())
    label, pairs = list(range(len(texts))), 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
            pairs += sets[i] != sets[j]
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    first = {}
    for (doc, _), x in zip(texts, label):
        first[x] = min(first.get(x, doc), doc)
    return sorted(first.values()), pairs


def kept(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect())


def edited(words, rng, changes):
    words = list(words)
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"e{rng.random()}"
    return " ".join(words)


def test_edited_texts_and_chains(spark):
    rng, texts = random.Random(5), []
    for _ in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        texts += [" ".join(base)] + [edited(base, rng, n) for n in (1, 2, 3, 4, 5, 6, 9, 15)]
    drift = [f"d{i}" for i in range(300)]
    texts += [" ".join(drift[i : i + 200]) for i in range(0, 100, 10)]
    texts += ["", None, " \n", "one", "One", "a b c d", "a b c e", "x " * 50_000, "x " * 6]
    texts = list(enumerate(texts))
    rng.shuffle(texts)
    expected, pairs = brute_kept(texts)
    assert pairs > 60
    assert kept(spark, texts) == expected


@pytest.mark.parametrize("pivots", [0, 1])
def test_pairs_left_after_the_pivots(spark, pivots, monkeypatch):
    monkeypatch.setattr(nearcopies.near_links, "__defaults__", (*nearcopies.near_links.__defaults__[:-1], pivots))
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    texts = list(enumerate([edited(base, rng, 4) for _ in range(60)]))
    assert kept(spark, texts) == brute_kept(texts)[0]


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_documents(spark, name):
    docs = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    expected, pairs = brute_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert pairs
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == expected


def test_blocks_of_a_bucket(spark, monkeypatch):
    """Texts that share much and stay below the threshold, with some near copies among them, in
    buckets of many parts: what tasks hand on are links, not pairs."""
    monkeypatch.setattr(nearcopies, "PART_NODES", 16)
    monkeypatch.setattr(nearcopies, "COLUMNS", 64)
    rng = random.Random(8)
    template = [f"t{i}" for i in range(160)]
    texts = [" ".join(template + [f"own{i}-{j}" for j in range(40)]) for i in range(90)]
    texts += [edited(text.split(), rng, 3) for text in texts[:20]]
    texts = list(enumerate(texts))
    expected, pairs = brute_kept(texts)
    assert pairs >= 15 and len(expected) < len(texts)
    assert kept(spark, texts) == expected


def test_common_counts():
    rng = random.Random(9)
    sets = [np.array(sorted(rng.sample(range(300), n)), np.int64) for n in (0, 1, 5, 120, 120, 299)]
    expected = [[len(set(a) & set(b)) for b in sets] for a in sets]
    counts = nearcopies.common_counts(sets)
    shared = [[n if i != j else None for j, n in enumerate(row)] for i, row in enumerate(expected)]
    assert [[int(n) if i != j else None for j, n in enumerate(row)] for i, row in enumerate(counts)] == shared


def test_candidates_come_from_the_trees(spark, monkeypatch):
    """With a radius of no bits, only texts of the same shingles are one."""
    rng = random.Random(10)
    base = [f"w{i}" for i in range(200)]
    texts = list(enumerate([" ".join(base)] * 2 + [edited(base, rng, 1) for _ in range(5)]))
    assert kept(spark, texts) == [0]
    monkeypatch.setattr(nearcopies, "radius", lambda similarity: 0)
    assert kept(spark, texts) == [0, *range(2, 7)]


def test_groups_of_a_forest():
    """Trees of several shards against all pairs; a dense group is not searched pair by pair."""
    for seed in range(6):
        draw, n, radius = np.random.default_rng(seed), 300, 12 + 4 * seed
        prints = draw.integers(0, 2**62, (2, 20)).astype(np.uint64)[:, draw.integers(0, 20, n)]
        for _ in range(40):
            flip = np.uint64(1) << draw.integers(0, 64, (2, n)).astype(np.uint64)
            prints ^= np.where(draw.random((2, n)) < 0.4, flip, np.uint64(0))
        shard, sizes = np.sort(draw.integers(0, 3, n)), draw.integers(80, 120, n)
        linked = np.bitwise_count(prints[:, :, None] ^ prints[:, None, :]).sum(0) <= radius
        linked &= (shard[:, None] == shard) & (np.minimum(sizes[:, None], sizes) >= 0.8 * np.maximum(sizes[:, None], sizes) - 1e-9)
        label = np.arange(n)
        while (label != (label := np.where(linked, label, n).min(1))).any():
            pass
        found, _ = forest.groups(shard, prints, sizes, radius, 0.8)
        assert ((found[:, None] == found) == (label[:, None] == label)).all()
    draw = np.random.default_rng(7)
    copies = np.repeat(draw.integers(0, 2**62, (2, 1)).astype(np.uint64), 2000, axis=1)
    copies[0] ^= np.arange(2000, dtype=np.uint64)
    found, visited = forest.groups(np.zeros(2000, np.int64), copies, np.full(2000, 100), 39, 0.8)
    assert len(set(found)) == 1 and visited < 2000


def test_trees_prune():
    """A search with a small radius leaves most of a tree out."""
    prints = np.random.default_rng(8).integers(0, 2**63, (2, 4000)).astype(np.uint64)
    _, visited = forest.groups(np.zeros(4000, np.int64), prints, np.full(4000, 100), 2, 0.8)
    assert visited < 4000 * 4000 / 2 / 2


@pytest.mark.parametrize("rows", [1_000, 200_000, 10_000_000])
def test_recall_of_the_trees(spark, rows):
    """Pairs of five-word similarity of 0.8 to 0.85 share a group, with the pieces for any size of table."""
    rng, texts = random.Random(11), []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(base), edited(base, rng, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sketches = nearcopies.sketches(docs, nearcopies.cuts(rows, 0.8)).cache()
    node = {r.doc_id: r.node for r in sketches.collect()}
    keys = {}
    for row in nearcopies.tree_groups(sketches).collect():
        keys.setdefault(row.node, set()).add(row.key)
    hits, pairs = 0, 0
    for i in range(0, len(texts), 2):
        a, b = (nearcopies.shingles(text.encode()) for text in texts[i : i + 2])
        common = len(np.intersect1d(a, b))
        if 0.8 <= common / (len(a) + len(b) - common) <= 0.85:
            pairs += 1
            hits += bool(keys.get(node[i], set()) & keys.get(node[i + 1], set()))
    sketches.unpersist()
    assert pairs > 40 and hits >= 0.95 * pairs
