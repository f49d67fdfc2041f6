"""Best-fit packing by a grouping genetic algorithm.

Documents become token ids, long ones pieces. Pieces are spread over blocks of a size that one
task holds; every block is one bin-packing problem. Several islands evolve populations of
packings of the same block from different seeds. Crossover injects whole well-filled bins of
one parent into the other, removes pieces that are then packed twice together with their bins,
and best-fits the pieces displaced. After each epoch the best packing of an island migrates to the
next island of its block. The bins that the best packings leave poorly filled are dissolved, and
their pieces packed once more in blocks of their own.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import drop_staged, staged

CAPACITY, END = 1024, 2
ISLANDS, EPOCHS, POPULATION, OFFSPRING = 2, 2, 5, 10
# Pieces of one block, and the fill under which a bin is dissolved once.
BLOCK, POOR = 24_000, 0.999
_SPECIAL = "<|endoftext|>"
# Pieces of one partition and bins of one block are numbered below 2 to these powers.
_KEY_BITS, _BIN_BITS = 36, 20


def _encoder(vocabulary: str):
    """Token ids of a text: those of the vocabulary file read by ``tokenizers``.

    The same vocabulary as ranks gives the same ids four times as fast; only a text that spells
    out a special token, which ranks do not have, goes through the vocabulary file.
    """
    import base64
    import pathlib

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    lines = pathlib.Path(vocabulary).with_suffix(".tiktoken").read_bytes().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(vocabulary)

    def encode(text: str) -> list[int]:
        if _SPECIAL in text:
            return slow.encode(text, add_special_tokens=False).ids
        return quick.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """key, doc_id, piece (from 0), start, length, ids of every row of ``docs`` (doc_id, text).

    ids are unsigned 32-bit little-endian token ids, ``end`` after the last one of a document; a
    null text is empty and so one ``end``. Only a document of more than ``capacity`` ids is cut,
    into pieces of exactly ``capacity`` of which the first may be shorter. ``key`` is unique, also
    among repeated rows: it counts within a partition of ``docs``, so write what is to be joined
    by it (``pack`` is given a written table).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key = _encoder(vocabulary), TaskContext.get().partitionId() << _KEY_BITS
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end], "<u4")
                begin, stop, piece = 0, (len(ids) - 1) % capacity + 1, 0
                while begin < len(ids):
                    for column, value in zip(columns, (key, doc, piece, begin, stop - begin, ids[begin:stop].tobytes())):
                        column.append(value)
                    key, begin, stop, piece = key + 1, stop, stop + capacity, piece + 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(cut, "key long, doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, order: np.ndarray, room: list[int], capacity: int, bins: np.ndarray) -> None:
    """Puts the pieces ``order`` into the fullest bins they fit in, or new ones; ``room`` and
    ``bins`` (the bin of every piece) are changed in place."""
    free = sorted((space, number) for number, space in enumerate(room) if space > 0)
    for piece in order.tolist():
        length = int(lengths[piece])
        at = bisect.bisect_left(free, (length, -1))
        if at < len(free):
            space, number = free.pop(at)
        else:
            space, number = capacity, len(room)
            room.append(capacity)
        bins[piece] = number
        room[number] = space - length
        if space > length:
            bisect.insort(free, (space - length, number))


def _fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins: few and full bins are best."""
    fill = np.bincount(bins, lengths) / capacity
    return float((fill**2).sum() / max(1, (fill > 0).sum()))


def _renumber(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def _fresh(lengths: np.ndarray, capacity: int, rng: np.random.Generator | None) -> np.ndarray:
    """A packing by best fit, longest first; with ``rng`` the order is blurred."""
    blur = rng.uniform(0, capacity / 8, len(lengths)) if rng else 0
    bins = np.zeros(len(lengths), np.int32)
    best_fit(lengths, np.argsort(-(lengths + blur), kind="stable"), [], capacity, bins)
    return bins


def crossover(lengths: np.ndarray, base: np.ndarray, donor: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """``base`` with some of the best-filled bins of ``donor`` injected whole.

    Bins of ``base`` that hold an injected piece are dissolved, and so are a few of its worst; their
    other pieces are best-fitted, longest first or nearly so.
    """
    fill = np.bincount(donor, lengths)
    good = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = rng.permutation(good)[: max(1, int(len(good) * rng.uniform(0.02, 0.5)))]
    injected = np.isin(donor, chosen)
    own = np.bincount(base, lengths)
    gone = np.zeros(len(own), bool)
    gone[base[injected]] = True
    worst = np.argsort(own, kind="stable")[: max(1, int(len(own) * rng.uniform(0, 0.3)))]
    gone[worst] = True
    displaced = np.flatnonzero(gone[base] & ~injected)
    child = np.where(injected, donor + len(own), base).astype(np.int32)
    child[displaced] = -1
    kept = child >= 0
    child[kept] = _renumber(child[kept])
    count = int(child.max()) + 1 if kept.any() else 0
    room = (capacity - np.bincount(child[kept], lengths[kept], minlength=count)).astype(int).tolist()
    blur = rng.uniform(0, rng.choice([0, 2, 16, 128]), len(displaced))
    best_fit(lengths, displaced[np.argsort(-lengths[displaced] - blur, kind="stable")], room, capacity, child)
    return child


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins (Martello and Toth): no two large pieces share one, and what small
    ones hold beyond the room beside the middle ones needs more."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    number = np.append(np.cumsum(counts[::-1])[::-1], 0)
    amount = np.append(np.cumsum((counts * np.arange(capacity + 1))[::-1])[::-1], 0)
    half, best = capacity // 2, 0
    for small in range(half + 1):
        room = (number[half + 1] - number[capacity - small + 1]) * capacity - (amount[half + 1] - amount[capacity - small + 1])
        rest = amount[small] - amount[half + 1]
        best = max(best, int(number[half + 1]) + max(0, -(-int(rest - room) // capacity)))
    return best


def evolve(lengths: np.ndarray, settlers: list[np.ndarray], capacity: int, seed: tuple, offspring: int = OFFSPRING) -> np.ndarray:
    """The best packing after some generations on an island that starts with ``settlers``."""
    rng = np.random.default_rng(seed)
    least = least_bins(lengths, capacity)
    people = [*settlers, *([] if settlers else [_fresh(lengths, capacity, None)])]
    people += [_fresh(lengths, capacity, rng) for _ in range(POPULATION - len(people))]
    scored = sorted(((_fitness(lengths, p, capacity), k, p) for k, p in enumerate(people)), key=lambda x: (-x[0], x[1]))
    for step in range(offspring):
        if len(np.unique(scored[0][2])) <= least:
            break
        a, b = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        a, b = min(a, b), max(a, b)
        child = crossover(lengths, scored[a][2], scored[b][2], capacity, rng)
        scored.append((_fitness(lengths, child, capacity), len(people) + step, child))
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:POPULATION]
    return scored[0][2]


def _blocks(items: DataFrame, count: int, seed: int) -> DataFrame:
    """block, key, length: the pieces (key, length) spread over blocks of about ``BLOCK``.

    The block is a hash of the unique key, so that no document, source or length makes a large one.
    """
    blocks = max(1, -(-count // BLOCK))
    return items.select(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(blocks)).alias("block"), "key", "length")


_PACKED = "block long, island int, key long, length int, bin int, score double"


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch on every (block, island): state is key, length, bin (null before the first)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("settler", "ascending")])
        settler = table.column("settler").to_numpy()
        first = table.filter(pa.array(settler == settler.min()))
        lengths = first.column("length").to_numpy().astype(np.int64)
        packings = [
            table.filter(pa.array(settler == s)).column("bin").to_numpy().astype(np.int32)
            for s in np.unique(settler)
            if s >= 0
        ]
        block, island = first.column("block")[0].as_py(), first.column("island")[0].as_py()
        best = _renumber(evolve(lengths, packings, capacity, (block % 2**63, island, epoch)))
        score = _fitness(lengths, best, capacity)
        return pa.table(
            {
                "block": first.column("block"),
                "island": first.column("island"),
                "key": first.column("key"),
                "length": first.column("length"),
                "bin": pa.array(best, pa.int32()),
                "score": pa.array(np.full(len(best), score)),
            }
        )

    return state.groupBy("block", "island").applyInArrow(run, _PACKED)


def _solved(blocked: DataFrame, capacity: int) -> DataFrame:
    """block, key, length, bin: the best packing that the islands of every block found."""
    islands = F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)]))
    state = blocked.select(
        "block", islands.alias("island"), "key", F.col("length").cast("int").alias("length"),
        F.lit(0).alias("bin"), F.lit(-1).alias("settler"),
    )
    earlier = []
    for epoch in range(EPOCHS):
        packed = staged(_epoch(state, capacity, epoch), "packing-epoch")
        drop_staged(*earlier)
        earlier = [packed]
        stay = packed.select("block", "island", "key", "length", "bin", F.col("island").alias("settler"))
        move = packed.select(
            "block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "key", "length", "bin",
            F.col("island").alias("settler"),
        )
        state = stay.union(move)
    best = packed.groupBy("block").agg(F.max_by("island", F.struct("score", -F.col("island"))).alias("island"))
    result = staged(packed.join(best, ["block", "island"]).select("block", "key", "length", "bin"), "packing-solved")
    drop_staged(packed)
    return result


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (a written table with key, unique, and length, from 1 to ``capacity``) with
    sequence_id and offset: sequences of at most ``capacity``, gapless from 0, as few as the
    search finds. Other columns stay; none may be named like the two.

    A piece that fills a sequence is one, with its key as id; other sequences have negative ids.
    The search moves the key and length of a piece alone. No rows give no rows.
    """
    number = lambda turn: -1 - ((F.col("block") * 2**_BIN_BITS + F.col("bin")) * 2 + turn)
    small = items.where(F.col("length") < capacity).select("key", "length")
    first = _solved(_blocks(small, small.count(), 1), capacity)
    fills = first.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    poor = first.join(fills.where(F.col("fill") < POOR * capacity), ["block", "bin"]).select("key", "length")
    poor = staged(poor, "packing-poor")
    again = _solved(_blocks(poor, poor.count(), 2), capacity)
    drop_staged(poor)
    kept = first.join(fills.where(F.col("fill") >= POOR * capacity), ["block", "bin"])
    placed = kept.select("key", "length", number(0).alias("sequence_id")).union(
        again.select("key", "length", number(1).alias("sequence_id"))
    )
    before = Window.partitionBy("sequence_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.select(
        F.col("key").alias("placed_key"), "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    )
    joined = items.join(offsets, items["key"] == offsets["placed_key"], "left").drop("placed_key")
    return joined.withColumns(
        {"sequence_id": F.coalesce("sequence_id", "key"), "offset": F.coalesce("offset", F.lit(0)).cast("long")}
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the token ids of every sequence of ``packed`` pieces that hold theirs."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda all_, part: F.concat(all_, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    Every row of ``docs`` (doc_id, text) is a document: null doc_ids stay null, null and empty
    texts are one end token, repeated rows are packed each. Other columns are ignored.
    """
    cut = pieces(docs, vocabulary, capacity)
    written = staged(cut.select("key", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "packing-pieces")
    return pack(written, capacity).drop("key")
