"""Substring dedup: windows of words that repeat across documents, found by doubling.

Level by level: windows that repeat at one length alone are extended to twice that length (the
last level to the wanted length), until the wanted length is reached or none survives. The
first level does not look at every short window: of the short windows inside a wanted one only
the one with the smallest hash is taken, which is the same one in every place where the wanted
window stands. So about a quarter of the positions move, and no repeat is missed.

Windows of the first level are compared by 64 bits, which can only add candidates; longer ones,
and so those of the wanted length, by 96 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import drop_staged, staged
from millrace.operators.joins import splittable_join

WINDOW = 13
# No first level is longer than this many words.
FIRST = 8
# Bytes of text looked at together, and words hashed together.
_BYTES, _WORDS = 2 << 20, 1 << 15
# A word up to this many bytes is hashed by a random number for each byte in each place.
_SHORT = 64
_rng = np.random.default_rng(0)
_LETTERS = _rng.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(0, 2**63, _SHORT, np.uint64) * np.uint64(2) + np.uint64(1)
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_LETTERS[~_SOLID] = 0


class Words:
    """The words of some texts, one after the other: hash, number of the text, place in it."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b" ".join(texts), np.uint8)
        ends = np.cumsum([len(text) + 1 for text in texts])
        solid = _SOLID[data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        at = np.flatnonzero(begin)
        self.text = np.searchsorted(ends, at, side="right")
        self.first = np.searchsorted(at, ends - [len(text) + 1 for text in texts])
        self.hashes = np.empty(len(at), np.uint64)
        for low in range(0, len(at), _WORDS):
            part = at[low : low + _WORDS]
            stop = at[low + _WORDS] if low + _WORDS < len(at) else len(data)
            self.hashes[low : low + _WORDS] = self._hashed(data[part[0] : stop], part - part[0], solid[part[0] : stop])

    @staticmethod
    def _hashed(data: np.ndarray, at: np.ndarray, solid: np.ndarray) -> np.ndarray:
        sizes = np.add.reduceat(solid, at, dtype=np.int64)
        place = np.arange(len(data)) - np.repeat(at, np.diff(at, append=len(data)))
        hashes = np.add.reduceat(_LETTERS[data] * _PLACES[np.minimum(place, _SHORT - 1)], at)
        hashes += sizes.astype(np.uint64) * _PLACES[0]
        for k in np.flatnonzero(sizes > _SHORT):
            hashes[k] = xxhash.xxh64_intdigest(data[at[k] : at[k] + sizes[k]].tobytes())
        hashes ^= hashes >> np.uint64(32)
        return hashes * _PLACES[1]

    def whole(self, places: np.ndarray, length: int) -> np.ndarray:
        """Those of ``places`` at which ``length`` words of one text begin."""
        places = places[places + length <= len(self.text)]
        return places[self.text[places] == self.text[places + length - 1]]


def _portions(batches: Iterator[pa.RecordBatch], name: str, limit: int = _BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``limit`` bytes of the column ``name``, so that
    few texts are Python objects at a time; a longer text is a piece by itself."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(name)), 0).to_numpy()
        begin, size = 0, 0
        for k, length in enumerate(sizes.tolist()):
            size += length
            if size >= limit:
                yield batch.slice(begin, k + 1 - begin)
                begin, size = k + 1, 0
        if begin < len(sizes):
            yield batch.slice(begin)


def lengths(window: int) -> list[int]:
    """Window lengths of the levels: each at most twice the one before, the last is ``window``."""
    chain = [window]
    while chain[0] > FIRST:
        chain.insert(0, (chain[0] + 1) // 2)
    return chain


def _hashes(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of every window of ``length`` word hashes."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(seed).integers(0, 2**63, length, np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(n, np.uint64)
    for k, factor in enumerate(factors):
        total += words[k : k + n] * factor
    total ^= total >> np.uint64(31)
    total *= np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(29))


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` hashes the place of the smallest, the leftmost of equals."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = hashes[:n].copy(), np.arange(n)
    for k in range(1, width):
        less = hashes[k : k + n] < least
        least[less] = hashes[k : k + n][less]
        place[less] = np.flatnonzero(less) + k
    return place


def _chosen(words: Words, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the short windows, places of the wanted windows, the place of the short window
    that stands for each of them)."""
    hashes = _hashes(words.hashes, length, 1)
    places = words.whole(np.arange(max(0, len(words.hashes) - window + 1)), window)
    return hashes, places, _least(hashes, window - length + 1)[places]


def _sent(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


def _first_windows(docs: DataFrame, length: int, window: int) -> DataFrame:
    """h, doc, at: the windows of the first level."""
    names = ["h", "doc", "at"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches, "text"):
            words = Words(part.column("text").to_pylist())
            hashes, _, at = _chosen(words, length, window)
            at = at[np.diff(at, prepend=-1) != 0]
            text = words.text[at]
            inside = (at - words.first[text]).astype(np.int32)
            yield _sent([hashes[at], part.column("doc").to_numpy()[text], inside], names)

    return docs.mapInArrow(cut, "h long, doc long, at int")


def _longer_windows(packed: DataFrame, length: int, before: int, window: int, first: bool) -> DataFrame:
    """h, g, doc, tag, at: windows of ``length`` that candidates of length ``before`` (places) allow."""
    names = ["h", "g", "doc", "tag", "at"]

    def allowed_windows(words: Words, allowed: np.ndarray) -> np.ndarray:
        if first and length == window:  # a window stands or falls with the short one chosen in it
            _, places, at = _chosen(words, before, window)
            return places[allowed[at]]
        if first:  # not all short windows were looked at: take what is near one that repeats
            near = np.cumsum(np.concatenate([np.zeros(window, int), allowed, np.zeros(window + 1, int)]))
            at = np.flatnonzero(near[2 * window : 2 * window + len(allowed)] > np.concatenate([[0], near])[: len(allowed)])
        else:
            at = np.flatnonzero(allowed[: len(allowed) - length + before] & allowed[length - before :])
        return words.whole(at, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text = zstandard.ZstdDecompressor().decompress
        for part in _portions(batches, "packed", _BYTES // 3):
            words = Words([open_text(data) for data in part.column("packed").to_pylist()])
            held = part.column("places")
            at = held.flatten().to_numpy() + np.repeat(words.first, pa.compute.list_value_length(held).to_numpy())
            # Texts of a repeated doc_id share their places: some lie outside this text.
            allowed = np.zeros(len(words.hashes) + 1, bool)
            allowed[np.minimum(at, len(words.hashes))] = True
            at = allowed_windows(words, allowed[:-1])
            if len(at):
                text = words.text[at]
                docs, tags = part.column("doc").to_numpy()[text], part.column("tag").to_numpy()[text]
                h = _hashes(words.hashes, length, 2)[at]
                g = (_hashes(words.hashes, length, 3)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                yield _sent([h, g, docs, tags, (at - words.first[text]).astype(np.int32)], names)

    return packed.mapInArrow(cut, "h long, g int, doc long, tag long, at int")


def _repeated(windows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """places (and ``by``): windows whose keys stand in several documents.

    The first and last document of a window are combined before the shuffle, so that a window
    of very many documents is no hot key there; the join with them is left to adaptive
    execution, which splits it.
    """
    ends = windows.groupBy(*keys).agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    met = splittable_join(windows, ends, keys)
    if "tag" in by:  # the last level: only what stands in a document before
        met = met.where("doc > least")
    # A set, as rows of a repeated doc_id send the same places: no more than its longest text has words.
    return met.groupBy(*by).agg(F.collect_set("at").alias("places"))


def _packed(texts: DataFrame) -> DataFrame:
    """``texts`` with the text compressed, to be moved: all columns but text, and packed."""
    others = [name for name in texts.columns if name != "text"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for part in _portions(batches, "text"):
            data = [None if text is None else press(text) for text in part.column("text").to_pylist()]
            columns = [part.column(name) for name in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(data, pa.binary())], [*others, "packed"])

    kinds = [f"{name} {texts.schema[name].dataType.simpleString()}" for name in others]
    return texts.mapInArrow(pack, ", ".join([*kinds, "packed binary"]))


def _identified(docs: DataFrame) -> DataFrame:
    """doc, tag (of the text, to tell texts of a repeated doc_id apart), text (bytes)."""
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def _copies(texts: DataFrame) -> DataFrame:
    """doc, tag of every text that a document with a smaller doc_id holds unchanged."""
    marked = texts.where("doc IS NOT NULL AND text IS NOT NULL").select("doc", "tag", F.md5("text").alias("digest"))
    marked = staged(marked.select("doc", "tag", F.unhex("digest").alias("digest")).distinct(), "substring-digests")
    least = marked.groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    copies = staged(marked.join(least, "digest").where("doc > least").select("doc", "tag"), "substring-copies")
    drop_staged(marked)
    return copies


def _covered(places: list[int], window: int, words: int) -> np.ndarray:
    """Which of ``words`` words the windows starting at ``places`` cover."""
    steps = np.zeros(words + 1, np.int64)
    at = np.array([p for p in places if p + window <= words], np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + window, -1)
    return np.cumsum(steps)[:words] > 0


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, tag, whole, places: what of the texts in ``docs`` (doc_id, text) also stands before.

    ``places``: where a window starts that also starts in a document with a smaller doc_id.
    ``whole``: the whole text stands unchanged in such a document; then there are no places.
    ``tag`` tells the texts of a repeated doc_id apart. Rows without doc_id or text take no part.
    """
    texts = _identified(docs).where("doc IS NOT NULL AND text IS NOT NULL")
    copies = _copies(texts)
    # Documents whose every text is a copy need no windows: the first copy holds the same.
    only_copies = (
        texts.select("doc", "tag").distinct().join(copies.withColumn("copy", F.lit(1)), ["doc", "tag"], "left")
        .groupBy("doc").agg(F.count("*").alias("texts"), F.count("copy").alias("copies"))
        .where("texts = copies").select("doc")
    )
    chain = lengths(window)
    places = _repeated(_first_windows(texts.select("doc", "text"), chain[0], window), ["h"], ["doc"])
    places = places.join(only_copies, "doc", "left_anti")
    known: list[DataFrame] = []
    for before, length in zip(chain, [*chain[1:], window]):
        # Places are written, windows are not: they are many, and soon cut from the texts again.
        known.append(staged(places, "substring-places"))
        packed = _packed(texts).join(known[-1], "doc").select("doc", "tag", "packed", "places")
        found = _longer_windows(packed, length, before, window, len(known) == 1)
        places = _repeated(found, ["h", "g"], ["doc", "tag"] if length == window else ["doc"])
        if length == window:
            break
    alone = places.join(copies, ["doc", "tag"], "left_anti").select("doc", "tag", F.lit(False).alias("whole"), "places")
    result = staged(alone.union(copies.select("doc", "tag", F.lit(True), F.lit(None).cast("array<int>"))), "substring-found")
    drop_staged(copies, *known)
    return result


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with what is left of its text: record (a struct of all columns but
    text, so that no name clashes), kept (the words that stay, joined by one space), n_words,
    n_removed, whole_text (the text itself where no word goes, else null).

    A word goes if a window of ``window`` words covers it whose words also start in a document
    with a smaller doc_id; all windows are judged on the input. Words are what stands between
    ASCII white space. A text shorter than a window loses nothing; a null text has no words and
    ``kept`` is empty. Rows without doc_id lose nothing and are no earlier document. Of equal
    doc_ids neither is the smaller. No rows give no rows.
    """
    found = repeats(docs, window)
    others = [F.col(f"`{name}`") for name in docs.columns if name != "text"]
    rows = docs.select(
        F.col("doc_id").alias("doc"),
        F.xxhash64(F.col("text").cast("binary")).alias("tag"),
        F.struct(*others).alias("record"),
        F.col("text").cast("binary").alias("text"),
    )
    joined = _packed(rows).join(found, ["doc", "tag"], "left").select("record", "packed", "whole", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_text = zstandard.ZstdDecompressor().decompress
        for part in _portions(batches, "packed", _BYTES // 3):
            rows = []
            for data, whole, places in zip(*(part.column(name).to_pylist() for name in ("packed", "whole", "places"))):
                text = None if data is None else open_text(data)
                words = text.split() if text else []
                left = words
                if whole and len(words) >= window:
                    left = []
                elif places:
                    covered = _covered(places, window, len(words)).tolist()
                    left = [word for word, out in zip(words, covered) if not out]
                rows.append((b" ".join(left), len(words), len(words) - len(left), text if len(left) == len(words) else None))
            kept, sizes, gone, same = zip(*rows) if rows else ((), (), (), ())
            columns = [part.column("record"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64())]
            columns += [pa.array(gone, pa.int64()), pa.array(same, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["record", "kept", "n_words", "n_removed", "whole_text"])

    kind = rows.schema["record"].dataType.simpleString()
    return joined.mapInArrow(cut, f"record {kind}, kept string, n_words long, n_removed long, whole_text string")


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``."""
    return remove_repeats(docs.select("doc_id", "text"), window).select(
        F.col("record.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
