"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a text with up to k edits (``rate`` of its length). Split into k + 1 pieces,
at least one of them is then found unchanged. All pieces are looked up at once by an
Aho-Corasick automaton; around every hit the whole item is verified with Myers' bit-parallel
edit distance. Both sides are compared in lower case with every run of white space as one space.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.08
# Items of fewer characters are found with edits in clean texts by chance; they may have none,
# and have to stand between word borders.
SHORT = 32
# From here on letters need no gap between words (Chinese, Japanese and their like).
_NO_GAPS = "\u2e80"
# Characters of items that one pass over the documents looks for.
PASS_CHARS = 8_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(length: int, rate: float = RATE) -> int:
    """Edits that an item of ``length`` characters may have."""
    return int(length * rate) if length >= SHORT else 0


def bordered(text: str, begin: int, end: int) -> bool:
    """Whether no word of ``text`` goes on over either end of a part of it."""
    inside = (place for place in (begin, end) if 0 < place < len(text))
    return not any(all(c.isalnum() and c < _NO_GAPS for c in text[place - 1 : place + 1]) for place in inside)


class Pattern:
    """Myers' edit distance of one pattern to parts of a text."""

    def __init__(self, text: str) -> None:
        self.length, self.masks = len(text), defaultdict(int)
        for place, letter in enumerate(text):
            self.masks[letter] |= 1 << place
        self.masks = dict(self.masks)

    def scores(self, text: str, anchored: bool) -> Iterator[int]:
        """After each character, the least distance of the pattern to a part of ``text`` that ends
        there: any such part, or with ``anchored`` the one from the start of ``text``."""
        full, high = (1 << self.length) - 1, 1 << (self.length - 1)
        plus, minus, score, masks = full, 0, self.length, self.masks
        for letter in text:
            equal = masks.get(letter, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (~(horizontal | plus) & full)
            down = plus & horizontal
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            up = (up << 1) | anchored
            down <<= 1
            plus = (down | ~(vertical | up)) & full
            minus = up & vertical & full
            yield score


class Matcher:
    """Finds items (number -> normal text) in texts."""

    def __init__(self, items: dict[int, str], rate: float = RATE) -> None:
        self.items, self.rate = items, rate
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, item in items.items():
            count = budget(len(item), rate) + 1
            cuts = [len(item) * k // count for k in range(count + 1)]
            for begin, end in zip(cuts, cuts[1:]):
                pieces[item[begin:end]].append((number, begin))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.pieces = bool(pieces)
        self.patterns: dict[tuple[int, bool], Pattern] = {}

    def _pattern(self, number: int, reverse: bool) -> Pattern:
        key = (number, reverse)
        if key not in self.patterns:
            self.patterns[key] = Pattern(self.items[number][::-1] if reverse else self.items[number])
        return self.patterns[key]

    def _unchanged(self, text: str, number: int, starts: list[int]) -> int | None:
        """The first of ``starts`` at which the item stands as it is."""
        item = self.items[number]
        for begin in starts:
            if begin >= 0 and text.startswith(item, begin) and (len(item) >= SHORT or bordered(text, begin, begin + len(item))):
                return begin
        return None

    def _verify(self, text: str, number: int, first: int, last: int) -> tuple[int, int] | None:
        """(edits, end) of the best occurrence that starts within the budget around ``first`` to ``last``."""
        length = len(self.items[number])
        k = budget(length, self.rate)
        low = max(0, first - k)
        best = None
        for place, score in enumerate(self._pattern(number, False).scores(text[low : last + length + k], False)):
            if score <= k and (best is None or score < best[0]):
                best = score, low + place + 1
        return best

    def _start(self, text: str, number: int, edits: int, end: int) -> int:
        """Where the longest occurrence with ``edits`` edits that ends at ``end`` starts."""
        reach = text[max(0, end - len(self.items[number]) - edits) : end][::-1]
        if edits == len(self.items[number]):
            return end
        scores = self._pattern(number, True).scores(reach, True)
        return end - max(length for length, score in enumerate(scores, 1) if score == edits)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, edits, first word, end word) of the best occurrence of every item found in a
        normal text; the leftmost of equals."""
        if not self.pieces or not text:
            return []
        begins: dict[int, set[int]] = defaultdict(set)
        for last, (length, places) in self.automaton.iter(text):
            for number, offset in places:
                begins[number].add(last - length + 1 - offset)
        found = []
        for number, starts in sorted(begins.items()):
            places, k = sorted(starts), budget(len(self.items[number]), self.rate)
            begin, best = self._unchanged(text, number, places), None
            if begin is not None:
                best = 0, begin + len(self.items[number])
            elif k:
                # Starts that lie close together are looked at in one go.
                gaps = [0, *(at for at in range(1, len(places)) if places[at] - places[at - 1] > k), len(places)]
                runs = ((places[a], places[b - 1]) for a, b in zip(gaps, gaps[1:]))
                best = min(filter(None, (self._verify(text, number, *run) for run in runs)), default=None)
            if best:
                begin = self._start(text, number, *best)
                first = text.count(" ", 0, begin) + (begin < len(text) and text[begin] == " ")
                found.append((number, best[0], first, text.count(" ", 0, max(begin, best[1] - 1)) + 1))
        return found


def _passes(benchmark: DataFrame, rate: float) -> Iterator[dict]:
    """The items in portions that fit into a task: item numbers and normal texts, with item_ids."""
    usable = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    chars = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-chars // PASS_CHARS))
    for number in range(passes):
        part = usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number)
        rows = [(row.item_id, normal(row.text)) for row in part.orderBy("item_id", "text").collect()]
        rows = [row for row in rows if row[1]]
        yield {"ids": [row[0] for row in rows], "items": dict(enumerate(row[1] for row in rows)), "rate": rate}


def _matcher(portion: dict) -> Matcher:
    """The matcher of a portion, made once in a worker process and kept with the broadcast value."""
    if "matcher" not in portion:
        portion["matcher"] = Matcher(portion["items"], portion["rate"])
    return portion["matcher"]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) found
    in it: doc_id, item_id, edits, first_word, end_word (words of the text between white space).

    Every item that occurs with up to ``budget`` edits is found, wherever it stands in the text;
    one of fewer than ``SHORT`` characters where it stands unchanged between word borders.
    Null and empty texts hold nothing; items without text take no part. Rows without doc_id are searched and have a null doc_id. Repeated
    rows are repeated results; repeated items count once. Empty tables give no rows.

    The documents are read once per ``PASS_CHARS`` characters of items, without a shuffle.
    """
    spark, found = docs.sparkSession, None
    for portion in _passes(benchmark, rate):
        shared = spark.sparkContext.broadcast(portion)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matcher = shared.value["ids"], _matcher(shared.value)
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    rows += [(doc, ids[hit[0]], *hit[1:]) for hit in matcher.find(normal(text or ""))]
                columns = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "edits", "first_word", "end_word"])

        part = docs.select("doc_id", "text").mapInArrow(
            search, "doc_id long, item_id long, edits int, first_word int, end_word int"
        )
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item of ``benchmark`` is found."""
    spark = docs.sparkSession
    for portion in _passes(benchmark, rate):
        shared = spark.sparkContext.broadcast(portion)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                yield batch.filter(pa.array(np.array([not matcher.find(normal(text or "")) for text in texts], bool)))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
