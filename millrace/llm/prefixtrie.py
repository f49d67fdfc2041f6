"""Conversation prefix trie from ternary search trees over range shards.

Every different turn gets a number, and a conversation becomes a sequence of them. The sequences are
sorted and cut into ranges; each range becomes a ternary search tree, balanced by inserting the
median of its sequences first. An iterative traversal adds up members, leaves and savings. Only nodes
on the paths of a shard's first and last sequence can continue in other shards: these, and nothing else, are
merged between shards.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, drop_staged, staged
from millrace.operators.joins import splittable_join

# Turns of the different sequences in a shard, bytes of member ids that stand in one row, and rows
# that a task hands on at once.
SHARD_TURNS, PIECE, ROWS = 50_000, 65_536, 8_192
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, words: each conversation's turns as numbers of the dictionary, in order, and
    the words of their texts.

    Turns are ordered by turn (null first), then role, then a digest of role and text; null role or
    text counts as empty, repeated rows are turns of their own, rows without conv_id take no part.
    Different turns have different numbers, as the dictionary is over a 256-bit digest of role and text; no text is
    shuffled. A conversation's numbers stand in one row.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().alias("numbered"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        F.regexp_count(text, F.lit(f"[^{SPACES}]+")).alias("words"),
    )
    turns = staged(turns, "trie-turns")
    dictionary = staged(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    # One first turn may open a third of all conversations.
    found = splittable_join(turns, dictionary, ["digest"])
    order = F.struct("numbered", "turn", "role", "digest", "id", "words")
    listed = found.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("turns"))
    sequences = staged(listed.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words")), "trie-sequences")
    drop_staged(turns, dictionary)
    return sequences


def shared_openings(sequences: DataFrame, group: int = 20, longest: int = 4) -> DataFrame:
    """``sequences`` rebuilt: the first h turns of conversation c - c % ``group``, then those of c
    after its own first h, where h is the CRC-32 of the decimal c modulo ``longest``. A remainder
    has the sign of c, as in SQL."""
    h = (F.crc32(F.col("conv_id").cast("string")) % longest).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    opening = [F.slice(name, 1, longest - 1).alias(f"opening_{name}") for name in ("ids", "words")]
    openings = sequences.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), *opening)

    def rebuilt(name: str):
        head = F.coalesce(F.slice(F.col(f"opening_{name}"), F.lit(1), F.col("h")), F.array().cast(sequences.schema[name].dataType))
        rest = F.slice(F.col(name), F.col("h") + 1, F.greatest(F.size(name) - F.col("h"), F.lit(0)))
        return F.concat(head, rest).alias(name)

    joined = sequences.withColumn("h", h).withColumn("base", base).join(openings, "base", "left")
    return joined.select("conv_id", rebuilt("ids"), rebuilt("words"))


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_PIECES = pa.schema([
    ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("least", pa.int64()), ("n", pa.int64()), ("members", pa.string()),
])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sequence that follow each other become one, with their conv_ids as a text, cut
    every ``PIECE`` characters."""

    def rows() -> Iterator[dict]:
        piece, ids, size = None, [], 0
        for row in _ordered(batches):
            if piece is not None and (row["ids"] != piece["ids"] or size >= PIECE):
                yield piece | {"n": len(ids), "members": ",".join(ids)}
                piece = None
            if piece is None:
                piece, ids, size = {"ids": row["ids"], "words": row["words"], "least": row["conv_id"]}, [], 0
            ids.append(str(row["conv_id"]))
            size += len(ids[-1]) + 1
        if piece is not None:
            yield piece | {"n": len(ids), "members": ",".join(ids)}

    return _batches(rows(), _PIECES)


@dataclass
class Ended:
    """One sequence and those that end with it."""

    ids: list[int]
    words: list[int]
    n: int
    least: int
    sha256: str


def ended_sequences(pieces: Iterator[dict]) -> Iterator[Ended]:
    """Different sequences from their pieces, in order; member ids are hashed as they come."""
    ids, words, n, least, digest = None, [], 0, 0, None
    for row in pieces:
        if row["ids"] != ids:
            if ids is not None:
                yield Ended(ids, words, n, least, digest.hexdigest())
            ids, words, n, least, digest = row["ids"], row["words"], 0, row["least"], hashlib.sha256()
        digest.update((("," if n else "") + row["members"]).encode())
        n += row["n"]
    if ids is not None:
        yield Ended(ids, words, n, least, digest.hexdigest())


@dataclass
class Tree:
    """A ternary search tree: ``equal`` leads to the next turn, ``low`` and ``high`` to others in its
    place. Node 0 is the root before all turns."""

    turn: list[int] = field(default_factory=lambda: [0])
    words: list[int] = field(default_factory=lambda: [0])
    low: list[int] = field(default_factory=lambda: [-1])
    equal: list[int] = field(default_factory=lambda: [-1])
    high: list[int] = field(default_factory=lambda: [-1])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    ends: dict[int, Ended] = field(default_factory=dict)

    def insert(self, ended: Ended) -> None:
        node = 0
        for turn, words in zip(ended.ids, ended.words):
            side, at = self.equal, node
            while side[at] >= 0:
                at = side[at]
                if turn == self.turn[at]:
                    break
                side = self.low if turn < self.turn[at] else self.high
            else:
                side[at] = at = self._added(node, turn, words)
            node = at
        self.ends[node] = ended

    def _added(self, parent: int, turn: int, words: int) -> int:
        for column, value in (
            (self.turn, turn), (self.words, words), (self.low, -1), (self.equal, -1), (self.high, -1),
            (self.parent, parent), (self.depth, self.depth[parent] + 1),
        ):
            column.append(value)
        return len(self.turn) - 1

    def path(self, ids: Sequence[int]) -> list[int]:
        """The nodes of an inserted sequence, from the root."""
        nodes = [0]
        for turn in ids:
            at = self.equal[nodes[-1]]
            while self.turn[at] != turn:
                at = self.low[at] if turn < self.turn[at] else self.high[at]
            nodes.append(at)
        return nodes

    def order(self) -> list[int]:
        """All nodes, each after the one it continues."""
        visited, waiting = [], [0]
        while waiting:
            node = waiting.pop()
            visited.append(node)
            waiting += [side[node] for side in (self.high, self.low, self.equal) if side[node] >= 0]
        return visited


def balanced(sequences: Sequence[Ended]) -> Tree:
    """The tree of sorted sequences: the median goes in first, then the medians of both halves."""
    tree, waiting = Tree(), [(0, len(sequences))]
    while waiting:
        begin, end = waiting.pop()
        if begin < end:
            middle = (begin + end) // 2
            tree.insert(sequences[middle])
            waiting += [(middle + 1, end), (begin, middle)]
    return tree


# Kinds of rows that a shard hands on.
INNER, EDGE, STEP = 0, 1, 2
_NODES = pa.schema([
    ("kind", pa.int32()), ("shard", pa.int32()), ("side", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("words", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
])
_NODE_TYPES = (
    "kind int, shard int, side int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, words long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)


def shard_nodes(sequences: Sequence[Ended], shard: int) -> Iterator[dict]:
    """Rows of one shard: its inner nodes, whole; its edge nodes (those on the paths of its first
    and its last sequence), with what they have inside the shard besides edge nodes; and the
    steps of both paths. Edge nodes are named by a chained digest of their turns."""
    if not sequences:
        return
    tree = balanced(sequences)
    size = len(tree.turn)
    names: dict[int, bytes] = {}
    paths = [tree.path(sequences[place].ids) for place in (0, -1)]
    for side, path in enumerate(paths):
        name = b""
        for node in path:
            name = hashlib.sha256(name + struct.pack(">q", tree.turn[node])).digest() if node else b"\0"
            names[node] = name
            yield {"kind": STEP, "shard": shard, "side": side, "node": name, "depth": tree.depth[node]}
    least: list[int | None] = [None] * size
    n, children, leaves, saved = [0] * size, [0] * size, [0] * size, [0] * size
    for node in reversed(tree.order()):
        if ended := tree.ends.get(node):
            n[node] += ended.n
            least[node] = ended.least if least[node] is None else min(least[node], ended.least)
        parent = tree.parent[node]
        if node not in names:
            leaves[node] += not children[node]
            saved[node] += (n[node] - 1) * tree.words[node]
            children[parent] += 1
        if parent >= 0:
            n[parent] += n[node]
            least[parent] = least[node] if least[parent] is None else min(least[parent], least[node])
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
    for node in range(size):
        ended, parent = tree.ends.get(node), tree.parent[node]
        row = {
            "conv_id": least[node], "depth": tree.depth[node], "n_convs": n[node], "n_children": children[node],
            "n_leaves": leaves[node], "saved_tokens": saved[node], "ends_sha256": ended.sha256 if ended else None,
        }
        if node in names:
            yield row | {"kind": EDGE, "node": names[node], "parent": names.get(parent), "words": tree.words[node]}
        elif parent in names:
            yield row | {"kind": INNER, "parent": names[parent]}
        else:
            yield row | {"kind": INNER, "parent_conv_id": least[parent]}


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sequences = list(ended_sequences(_ordered(batches)))
    return _batches(shard_nodes(sequences, TaskContext.get().partitionId()), _NODES)


def _merged_edges(nodes: DataFrame) -> DataFrame:
    """node, conv_id, … of every edge node, from all shards it is in.

    What edge nodes count for below each other is summed along the paths: every edge node is
    counted on one path that holds it, and a path's running sum, from its end, is what it adds
    to each of its nodes. So no node meets all its ancestors.
    """
    edges = nodes.where(F.col("kind") == EDGE)
    sums = [F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(name).alias(name) for name in ("parent", "depth", "words", "ends_sha256")]
    merged = edges.groupBy("node").agg(*same, *sums, F.min("conv_id").alias("conv_id"))
    merged = staged(merged, "trie-edges")
    below = merged.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("edge_children"))
    n_children = F.col("n_children") + F.coalesce("edge_children", F.lit(0))
    merged = merged.join(below, "node", "left").withColumn("n_children", n_children).drop("edge_children")

    steps = nodes.where(F.col("kind") == STEP).select("shard", "side", "node", "depth")
    place = F.struct("shard", "side")
    counted = steps.groupBy("node").agg(F.min(place).alias("counted"))
    own = merged.join(counted, "node").select(
        "node", "counted", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    walked = splittable_join(steps, own, ["node"])
    from_the_end = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    here = place == F.col("counted")
    running = [F.sum(F.when(here, F.col(name)).otherwise(0)).over(from_the_end).alias(name) for name in ("leaf", "saved")]
    totals = walked.select("node", *running).groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    return merged.join(totals, "node").withColumns(
        {"n_leaves": F.col("n_leaves") + F.col("leaf"), "saved_tokens": F.col("saved_tokens") + F.col("saved")}
    )


_RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, ids, words): its smallest member,
    depth, the parent's smallest member (root: null), members, children, childless nodes below
    or at it, tokens saved below and at it (each node's members but one, times the words of its
    last turn), and the SHA-256 of the ids of the members that end here.

    The root (depth 0) has all conversations as members, also those without turns; no
    conversations, no root. A member with several rows counts with each.
    """
    spark = sequences.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sequences = staged(sequences, "trie-rebuilt")  # the ranges below are found by reading it once more
    dealt = sequences.repartitionByRange(tasks, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    pieces = staged(dealt.mapInArrow(_pieces, "ids array<long>, words array<int>, least long, n long, members string"), "trie-pieces")
    turns = pieces.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    ranges = pieces.repartitionByRange(max(1, -(-turns // shard_turns)), "ids").sortWithinPartitions("ids", "least")
    nodes = staged(ranges.mapInArrow(_shards, _NODE_TYPES), "trie-nodes")
    edges = staged(_merged_edges(nodes), "trie-merged")
    drop_staged(sequences, pieces)
    parents = edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("known_conv_id"))
    inner = nodes.where(F.col("kind") == INNER)
    deep = inner.where("parent IS NULL").select(*_RESULT)
    # The root may have more children than any other node.
    below = splittable_join(inner.where("parent IS NOT NULL"), parents, ["parent"])
    shallow = below.withColumn("parent_conv_id", F.col("known_conv_id")).select(*_RESULT)
    merged = splittable_join(edges.drop("parent_conv_id"), parents.withColumnRenamed("known_conv_id", "parent_conv_id"), ["parent"], "left")
    return (
        deep.unionByName(shallow).unionByName(merged.select(*_RESULT))
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    )
