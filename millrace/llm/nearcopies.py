"""Near copies by the Jaccard similarity of their word shingles, found by SimHash and BK-trees.

A wide SimHash is taken of the different shingles of a text. At a similarity of 0.8 the angle between
two texts lets 15 % of its bits differ, unlike texts differ in half of them. The first ``WIDTH`` bits
are the fingerprint, the others are cut into pieces. As in ``simhash``, a shard is one value
of one piece and holds BK-trees; a search by fingerprint finds who is within the radius. No choice
of few pieces makes that radius exact, so there are as many pieces as leave two texts at
the similarity without a common shard with a chance of ``MISS``. The bits of a piece grow with the
logarithm of the rows, so that a shard keeps about ``TREE`` fingerprints at any size.

Texts with the same shingles are one node. What the trees of a shard connect is a group. Groups are
not compared pair by pair from the start: every group has a pivot of its own that meets all its
nodes, counted exactly on the texts, so that a large group of copies, which shares shards of many
pieces, is connected over many pivots at once. What is left unconnected in a group then is compared
whole, in blocks: a task holds the shingles of its nodes once, counts what they have in common
by products of matrices, and hands on links alone, no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_staged, staged
from millrace.llm.components import connected, in_few_tasks
from millrace.llm.forest import WIDTH, groups
from millrace.llm.simhash import first_rows
from millrace.operators.joins import splittable_join

SHINGLE, SIMILARITY = 5, 0.8
# Chance that two texts at the similarity share no shard, fingerprints of a shard on average, and
# standard deviations between the bits that differ at the similarity and the radius.
MISS, TREE, DEVIATIONS = 1e-4, 128, 4.6
# Fingerprints of a shard that one task searches; a larger shard is cut into parts.
CAPACITY = 8_192
# Bits that pieces are taken from; where they need more, bits are used again in other company.
POOL = 1_024
# Rounds with one pivot a group before all pairs left. Each ends with components of all links so
# far, which is a chain of jobs; the pivots of the pieces do what further rounds would.
PIVOTS = 1
# Nodes and shingles of a part of a bucket, and different shingles in a matrix.
PART_NODES, PART_SHINGLES, COLUMNS = 512, 1_000_000, 1_024
_SEED = 42
# Shingles whose bits are counted at a time: counts of 255 rows fit in a byte.
_BATCH, _ROWS = 16 * 255, 255
# Fingerprints that are searched together, and texts that are held as Python values at a time.
_TOGETHER, _TEXTS = 4_096, 512


def agreement(similarity: float) -> float:
    """The share of SimHash bits in which sets of this Jaccard similarity agree, or more do: the
    cosine is least for sets of equal size."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float) -> int:
    """Bits of a fingerprint that may differ."""
    share = 1 - agreement(similarity)
    return math.ceil(WIDTH * share + DEVIATIONS * math.sqrt(WIDTH * share * (1 - share)))


def cuts(rows: int, similarity: float) -> np.ndarray:
    """The bits, counted after those of the fingerprint, of every piece for a table of ``rows``."""
    bits = max(1, round(math.log2(max(rows, 1) / TREE)))
    pieces = math.ceil(math.log(MISS) / math.log1p(-(agreement(similarity) ** bits)))
    pool, draw = min(bits * pieces, POOL), np.random.default_rng(_SEED)
    turns = [draw.permutation(pool) for _ in range(-(-bits * pieces // pool))]
    return np.concatenate(turns)[: bits * pieces].reshape(pieces, bits)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different hashes of the shingles of a UTF-8 text, in order; words as in SimHash."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    grams = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(gram), _SEED) for gram in grams), np.uint64))


def _mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` further hashes of every hash, by the last steps of SplitMix64."""
    mixed = hashes[:, None] + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed ^= mixed >> np.uint64(shift)
        mixed *= np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(31))


def sketch(hashes: np.ndarray, words: int) -> np.ndarray:
    """The bits (0 or 1) of the SimHash of ``words`` words of a set of shingles: a bit is 1 if it is set
    in over half their hashes."""
    ones = np.zeros(64 * words, np.int64)
    for begin in range(0, len(hashes), _BATCH):
        mixed = _mixed(hashes[begin : begin + _BATCH], words)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        for row in range(0, len(bits), _ROWS):
            ones += bits[row : row + _ROWS].sum(0, dtype=np.uint8)
    return (2 * ones > len(hashes)).astype(np.uint8)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(begin, _TEXTS) for batch in batches for begin in range(0, batch.num_rows, _TEXTS))


def sketches(docs: DataFrame, places: np.ndarray, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tag (a hash of the text), node (a hash of its set of shingles), low and high (the
    fingerprint), size and shards (number and value of each of the pieces ``places``) of every row of
    ``docs``."""
    words = -(-(WIDTH + int(places.max()) + 1) // 64)
    weights, numbers = 1 << np.arange(places.shape[1]), np.arange(len(places)) << 32

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            nodes, prints, sizes, shards = [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingles(text, shingle)
                bits = sketch(hashes, words)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), _SEED))
                prints.append(np.packbits(bits[:WIDTH], bitorder="little").view("<i8"))
                sizes.append(len(hashes))
                shards.append(numbers + bits[WIDTH + places] @ weights)
            low, high = np.array(prints, np.int64).reshape(-1, 2).T
            columns = [batch.column("doc_id"), batch.column("tag"), pa.array(np.array(nodes, np.uint64).view(np.int64))]
            columns += [pa.array(low), pa.array(high), pa.array(sizes, pa.int64()), pa.array(shards, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "node", "low", "high", "size", "shards"])

    marked = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"))
    return marked.mapInArrow(compute, "doc_id long, tag long, node long, low long, high long, size long, shards array<long>")


def tree_groups(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """key, node, size of all groups of several of the ``nodes`` (node, low, high, size, shards) that
    links of fingerprints connect within a shard.

    A shard of more than ``CAPACITY`` is cut into parts by hash, and every two of them meet in a task.
    """
    keyed = nodes.select("node", "low", "high", "size", F.explode("shards").alias("shard"))
    parts = keyed.groupBy("shard").count().where(F.col("count") > CAPACITY)
    # Staged, as few rows that Spark then sends to all of the others.
    parts = staged(parts.select("shard", F.ceil(F.col("count") / CAPACITY).cast("int").alias("parts")), "near-parts")
    cut = splittable_join(keyed, parts, ["shard"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("node", "shard"), F.col("parts")).cast("int")
    # Parts meet in twos, which compares them with themselves as well.
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: other != F.col("part"))
    )
    met = cut.withColumn("part", part).withColumn("other", F.explode(others))
    order = ["shard", "i", "j"]
    dealt = met.select("shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "low", "high", "size")
    most = radius(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, i, j, node, low, high, size in _whole_shards(batches):
            began = np.concatenate([[True], (shard[1:] != shard[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            found, _ = groups(np.cumsum(began), np.stack([low, high]).view(np.uint64), size, most, similarity)
            several = np.flatnonzero(np.bincount(found, minlength=len(found))[found] > 1)
            head = found[several]
            columns = [pa.array(column[head]) for column in (shard, i, j, node)] + [pa.array(node[several]), pa.array(size[several])]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "i", "j", "head", "node", "size"])

    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A number, as the work in a row is far more than its bytes tell adaptive execution.
    found = dealt.repartition(tasks, *order).sortWithinPartitions(*order, "node")
    found = found.mapInArrow(run, "shard long, i int, j int, head long, node long, size long")
    return found.select(F.xxhash64("shard", "i", "j", "head").alias("key"), "node", "size")


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of a sorted stream, in portions that end with a run of equal shard, i, j."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([column.to_numpy(zero_copy_only=False) for column in batch.columns])
        if sum(len(columns[0]) for columns in held) < _TOGETHER:
            continue
        whole = [np.concatenate(parts) for parts in zip(*held)]
        differs = np.logical_or.reduce([column != column[-1] for column in whole[:3]])
        end = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if end:
            yield [column[:end] for column in whole]
        held = [[column[end:] for column in whole]]
    if held:
        yield [np.concatenate(parts) for parts in zip(*held)]


def _shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, shingles of the texts that stand for ``nodes`` (_doc, _tag)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            sets = [shingles(text, shingle) for text in batch.column("text").to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), _SEED) for s in sets], np.uint64).view(np.int64)
            columns = [pa.array(nodes), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"))
    found = rows.join(nodes, same, "left_semi").select("text").mapInArrow(compute, "node long, shingles array<long>")
    # Rows of one doc_id and text come more than once.
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sets have a Jaccard similarity of ``similarity`` or more."""
    first, second = (sets.select(F.col("node").alias(end), F.col("shingles").alias(f"of_{end}")) for end in "ab")
    both = splittable_join(splittable_join(pairs, first, ["a"]), second, ["b"])
    common = F.size(F.array_intersect("of_a", "of_b"))
    whole = F.size("of_a") + F.size("of_b") - common
    return both.where(common >= F.lit(similarity) * whole - 1e-9).select("a", "b")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets have in common; exact, as counts are below 2**24."""
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    _, columns, times = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = times > 1
    columns, owners = (np.cumsum(shared) - 1)[columns[shared[columns]]], owners[shared[columns]]
    order = np.argsort(columns, kind="stable")
    columns, owners = columns[order], owners[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(columns, [begin, begin + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owners[low:high], columns[low:high] - begin] = 1
        total += has @ has.T
    return total


def _block_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links a, b between nodes of one group (key, node, size, label) whose labels differ and whose sets
    are similar, one at least for every two labels that have such nodes.

    A large group is cut into parts by hash, and every two parts meet in one task; so what a
    task holds is bounded, while the number of tasks grows with the square of a group's parts.
    """
    count = F.greatest(F.ceil(F.count("*") / PART_NODES), F.ceil(F.sum("size") / PART_SHINGLES), F.lit(1))
    parts = members.groupBy("key").agg(count.cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")
    placed = splittable_join(members.select("key", "node", "label"), parts, ["key"]).withColumn("part", part)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = placed.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "label")
    held = splittable_join(cells, sets, ["node"])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, labels, part = (table[name].to_numpy() for name in ("node", "label", "part"))
        column = table["shingles"].combine_chunks()
        hashes = [item.values.to_numpy(zero_copy_only=False) for item in column]
        common, sizes = common_counts(hashes), np.array([len(h) for h in hashes], np.float64)
        similar = np.stack([row >= similarity * (size + sizes - row) - 1e-9 for row, size in zip(common, sizes)])
        similar &= labels[:, None] < labels[None, :]
        if part.min() < part.max():  # within a part its nodes meet in another task
            similar &= part[:, None] != part[None, :]
        first, second = np.nonzero(similar)
        _, once = np.unique(np.stack([labels[first], labels[second]], 1), axis=0, return_index=True)
        return pa.table({"a": pa.array(nodes[first[once]], pa.int64()), "b": pa.array(nodes[second[once]], pa.int64())})

    return held.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_links(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, pivots: int = PIVOTS) -> DataFrame | None:
    """Links a, b between ``nodes`` (node, low, high, size, shards, first) that connect what the similar
    pairs connect; None where no two nodes meet."""
    members = staged(tree_groups(nodes, similarity), "near-members")
    if members.isEmpty():
        drop_staged(members)
        return None
    met = members.select("node").distinct()
    named = nodes.join(met, "node", "left_semi").select(F.col("first.doc_id").alias("_doc"), F.col("first.tag").alias("_tag"))
    sets = staged(_shingle_sets(docs, named, shingle), "near-sets")
    able = F.least("size", "size_2") >= F.lit(similarity) * F.greatest("size", "size_2") - 1e-9
    ends = (F.least("node", "node_2").alias("a"), F.greatest("node", "node_2").alias("b"))
    links, open_members, kept = None, members.withColumn("label", F.col("node")), []
    for number in range(pivots):
        # Another order in every group and round.
        order = F.xxhash64("node", "key", F.lit(number))
        one = F.min(F.struct(order.alias("order"), "node", "size", "label")).alias("one")
        others = open_members.groupBy("key").agg(one).select("key", *[F.col(f"one.{n}").alias(f"{n}_2") for n in ("node", "size", "label")])
        pairs = splittable_join(open_members, others, ["key"]).where((F.col("label") != F.col("label_2")) & able).select(*ends).distinct()
        found = staged(_verified(pairs, sets, similarity), "near-found")
        links = found if links is None else links.union(found)
        labels = connected(links)
        marked = splittable_join(members, labels, ["node"], "left").withColumn("label", F.coalesce("label", "node"))
        # Groups in which all are connected are done.
        open_ = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        open_members = staged(in_few_tasks(splittable_join(marked, open_, ["key"]), members.count()), "near-open")
        kept.append(open_members)
    rest = staged(_block_links(open_members, sets, similarity), "near-found")
    drop_staged(sets, members, *kept)
    return rest if links is None else links.union(rest)


def classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, tag, label of every row of ``docs``: label is equal for the rows that are connected
    over pairs of a similarity of ``similarity`` or more."""
    places = cuts(docs.count(), similarity)
    marked = staged(sketches(docs, places, shingle), "near-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tag")).alias("first")
    # The sketch follows from the node.
    same = [F.first(name).alias(name) for name in ("low", "high", "size", "shards")]
    nodes = staged(marked.groupBy("node").agg(first, *same), "near-nodes")
    links = near_links(docs, nodes, shingle, similarity)
    drop_staged(nodes)
    rows = marked.select("doc_id", "tag", "node")
    if links is None:
        return rows.withColumnRenamed("node", "label")
    found = splittable_join(rows, connected(links), ["node"], "left")
    return found.select("doc_id", "tag", F.coalesce("label", "node").alias("label"))


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs``, with all its columns, of every group of near copies; which one, and
    what becomes of null ids and repeated rows, is as in ``simhash.first_of_each``. Texts without
    words are one group; a text of fewer than ``shingle`` words is one shingle."""
    return first_rows(docs, staged(classes(docs, shingle, similarity), "near-classes"))
