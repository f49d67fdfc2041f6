"""Near-duplicates by SimHash fingerprints, linked with BK-trees.

Two fingerprints that differ in ``radius`` bits or fewer agree on at least one of
``radius + 1`` pieces of their bits. So the trees are sharded by piece: a shard holds the
distinct fingerprints that share one value of one piece, in trees of at most ``capacity``
nodes, and every tree of a shard is sent to all the fingerprints of that shard. A BK-tree
keeps its children by their integer Hamming distance to the parent; a search for fingerprints
within the radius at distance d from a node follows only the edges from d - radius to
d + radius. Fingerprints stay on the executors throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_staged, staged
from millrace.llm.components import connected
from millrace.operators.joins import splittable_join

BITS = 64
SHINGLE = 3
RADIUS = 2
CAPACITY = 20_000
_SEED = 42
# Shingles whose bits are counted at a time.
_BATCH = 65_536
# Nodes that a batch of searches may visit at most.
_VISITS = 2_000_000


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: a bit is 1 if it is set in over half the hashes of its shingles.

    Words are what stands between ASCII white space, A-Z in lower case; a text of fewer than
    ``shingle`` words is one shingle, one without words has fingerprint 0.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    grams = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(gram), _SEED) for gram in grams), "<u8")
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), _BATCH):
        part = hashes[begin : begin + _BATCH].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, tag (a hash that tells the texts of a repeated doc_id apart) and fp (the fingerprint
    as a signed long) of every row of ``docs``."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(text, shingle) for text in batch.column("text").to_pylist()], np.uint64)
            columns = [batch.column("doc_id"), batch.column("tag"), pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "fp"])

    marked = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"))
    return marked.mapInArrow(compute, "doc_id long, tag long, fp long")


def build_tree(nodes: np.ndarray) -> np.ndarray:
    """A BK-tree over distinct fingerprints, rooted at the first: child[i, d] is the child of
    node i at distance d, or -1. Built level by level: fingerprints of one subtree are grouped by
    their distance to its root, and the first of each group becomes the child.
    """
    n = len(nodes)
    child = np.full((n, BITS + 1), -1, np.int32)
    group_root = np.zeros(n, np.int32)  # the node whose subtree a fingerprint is in
    rest = np.arange(1, n, dtype=np.int32)
    while len(rest):
        parents = group_root[rest]
        distance = np.bitwise_count(nodes[rest] ^ nodes[parents])
        key = parents.astype(np.int64) * (BITS + 1) + distance
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        heads = rest[first]
        child[group_root[heads], distance[first]] = heads
        group_root[rest] = heads[inverse]
        keep = np.ones(len(rest), bool)
        keep[first] = False
        rest = rest[keep]
    return child


def search_tree(nodes: np.ndarray, child: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple]:
    """Pairs (query number, node number) within ``radius``, level by level for all queries."""
    asked = np.arange(len(queries), dtype=np.int32)
    at = np.zeros(len(queries), np.int32)
    while len(asked):
        distance = np.bitwise_count(queries[asked] ^ nodes[at]).astype(np.int16)
        near = distance <= radius
        yield asked[near], at[near]
        edges = [(child[at, np.clip(distance + k, 0, BITS)], (distance + k >= 0) & (distance + k <= BITS)) for k in range(-radius, radius + 1)]
        follow = [(asked[ok & (to >= 0)], to[ok & (to >= 0)]) for to, ok in edges]
        asked = np.concatenate([f[0] for f in follow])
        at = np.concatenate([f[1] for f in follow])


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of every set after joining a[i] with b[i]."""
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def _links(queries: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links that connects what pairs of a query and a node within ``radius`` connect."""
    everyone, place = np.unique(np.concatenate([nodes, queries]), return_inverse=True)
    of_node, of_query = place[: len(nodes)], place[len(nodes) :]
    parent = np.arange(len(everyone))
    child = build_tree(nodes)
    step = max(1, _VISITS // len(nodes))
    for begin in range(0, len(queries), step):
        for q, n in search_tree(nodes, child, queries[begin : begin + step], radius):
            parent = _roots(parent, of_query[begin + q], of_node[n])
    moved = np.flatnonzero(parent != np.arange(len(everyone)))
    return everyone[moved], everyone[parent[moved]]


def links(distinct: DataFrame, radius: int = RADIUS, capacity: int = CAPACITY) -> DataFrame:
    """Links a, b between the distinct fingerprints ``fp`` that connect all within ``radius`` bits.

    A forest per shard and tree instead of all pairs, with the same components. A shard of n
    fingerprints is cut into ceil(n / capacity) parts by hash; each part is one tree, and meets
    each part of the shard as queries, so that no task holds more than about two parts.
    """
    width, pieces = BITS // (radius + 1), radius + 1
    bounds = [(k * width, BITS if k == radius else (k + 1) * width) for k in range(pieces)]

    def cut(low: int, high: int):
        return F.shiftrightunsigned(F.shiftleft("fp", BITS - high), BITS - high + low)

    keyed = distinct.select(
        "fp", F.posexplode(F.array(*[cut(low, high) for low, high in bounds])).alias("piece", "value")
    )
    counted = (
        keyed.groupBy("piece", "value").count().where("count > 1")
        .withColumn("parts", F.ceil(F.col("count") / capacity).cast("int")).drop("count")
    )
    members = keyed.join(counted, ["piece", "value"]).withColumn(
        "part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    )
    # Pairs of parts (tree, asker), tree <= asker: a link is found from either of its ends.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = members.withColumn("other", other).select(
        "piece",
        "value",
        F.least("part", "other").alias("tree"),
        F.greatest("part", "other").alias("asker"),
        (F.col("part") <= F.col("other")).alias("is_node"),
        (F.col("part") >= F.col("other")).alias("is_query"),
        "fp",
    )

    order = ["piece", "value", "tree", "asker"]
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, is_node, is_query in _runs(batches, order, ["fp", "is_node", "is_query"]):
            fps = fp.view(np.uint64)
            a, b = _links(fps[is_query], fps[is_node], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    # A number, as the work in a row is far more than its bytes tell adaptive execution.
    dealt = met.repartition(tasks, *order).sortWithinPartitions(*order, "fp")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """``columns`` of every run of equal ``keys`` (integers) in a sorted stream of batches."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in keys], axis=1)
        values = [batch.column(name).to_numpy(zero_copy_only=False) for name in columns]
        begins = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(begins, begins[1:]):
            if held and (begin or (key[0] != last).any()):
                yield [np.concatenate(parts) for parts in zip(*held)]
                held = []
            held.append([value[begin:end] for value in values])
        last = key[-1]
    if held:
        yield [np.concatenate(parts) for parts in zip(*held)]


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, tag, fp, label, component_id of every row of ``docs``: label is equal for the rows
    whose fingerprints are reached over links, component_id their smallest doc_id."""
    marked = staged(fingerprints(docs, shingle), "simhash-fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "simhash-distinct")
    found = staged(links(distinct.select("fp"), radius, capacity), "simhash-links")
    linked = connected(found)
    drop_staged(found)
    # Only linked fingerprints get a row: (fp, label), and the smallest document per label.
    labelled = distinct.join(linked, distinct["fp"] == linked["node"]).select("fp", "label", "smallest")
    named = labelled.groupBy("label").agg(F.min("smallest").alias("component_id"))
    renamed = labelled.join(named, "label").select(F.col("fp").alias("linked_fp"), "label", "component_id")
    all_classes = distinct.join(renamed, distinct["fp"] == renamed["linked_fp"], "left").select(
        "fp",
        F.coalesce("label", "fp").alias("label"),
        F.when(F.col("label").isNull(), F.col("smallest")).otherwise(F.col("component_id")).alias("component_id"),
    )
    # Copies of one text may be a third of all rows.
    return splittable_join(marked, all_classes, ["fp"], "left")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, capacity: int = CAPACITY
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id among all rows whose fingerprints are reached over links
    of ``radius`` or fewer differing bits. Null texts and texts without words have fingerprint
    0 and are linked like any other. A row without doc_id is kept and linked, but names no
    component: one of such rows alone has a null component_id. Repeated rows are kept. No
    rows give no rows. Other columns are ignored.

    Copies collapse into one fingerprint before anything is compared; what moves is 24 bytes a
    document, and texts are read once where they lie.
    """
    return classes(docs, shingle, radius, capacity).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs``, with all its columns, of every component: that with the smallest
    doc_id (null only if all are), of several the one with the smallest hash of its text, then the
    first by its columns as JSON."""
    return first_rows(docs, staged(classes(docs, shingle, radius), "simhash-classes"))


def first_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of ``docs`` that ``first_of_each`` takes of every label of ``found`` (doc_id, tag, label)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tag")).alias("first")
    winners = found.groupBy("label").agg(first).select(F.col("first.doc_id").alias("_doc"), F.col("first.tag").alias("_tag"))
    # Of rows of one doc_id and text, usually none, the one stays whose columns come first as JSON.
    repeated = staged(
        found.groupBy("doc_id", "tag").count().where("count > 1").select(F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag")),
        "simhash-repeated",
    )
    record = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("record")
    rows = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("tag"), record)
    same = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tag") == F.col("_tag"))
    won = rows.join(winners, same, "left_semi")
    several = won.join(repeated, same, "left_semi").groupBy("doc", "tag").agg(F.min_by("record", F.to_json("record")).alias("record"))
    return won.join(repeated, same, "left_anti").union(several.select("doc", "tag", "record")).select("record.*")
