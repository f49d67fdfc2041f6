"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its subwords (runs of 3 and 4 bytes inside a word and
its two boundaries, in lower case, hashed into ``BUCKETS``); a linear layer and a softmax turn
the mean into probabilities. Both are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows. A temperature fitted on rows held back from training makes the
probabilities calibrated. A text is rejected if its probability, or the share of its subwords
that training has seen, is below what the same rows show for the language predicted; the second
also tells foreign texts where one or two languages are learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
BUCKET_BITS, WIDTH = 16, 16
BUCKETS = 1 << BUCKET_BITS
# The bounded sample: rows per language, rows in all. Their whole texts are read.
ROWS_PER_LANGUAGE, ROWS = 400, 20_000
# Parts of a language that the sample is first taken from.
PARTS = 256
EPOCHS, HELD_BACK, SEED = 4, 4, 17
EMBEDDING_RATE, LAYER_RATE, BIAS_RATE = 60.0, 1.0, 0.1
# A text is rejected if it scores this much below the low quantile of the rows held back that were
# predicted rightly as its language, in log odds, and is less likely than not to be in it.
MARGIN, LIKELY, LOW = 1.0, 0.5, 0.05
# It is rejected too if its share of unseen subwords exceeds, by DEVIATIONS standard deviations of a
# text of its length, the middle between two shares: the high quantile of the rows held back (by as
# many deviations of its rank, so of few rows it is the largest), and the share FOREIGN of
# the buckets that training has not seen, as languages of one script have about half their subwords
# in common.
FOREIGN, DEVIATIONS = 0.5, 3.0
# Bytes of a text that are looked at together.
_SLICE = 1 << 20


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the subwords of a text, slice by slice."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").split()) + b" ", np.uint8)
    for begin in range(0, max(1, len(raw) - 2), _SLICE):
        part = raw[begin : begin + _SLICE + 3].astype(np.uint32)
        gap = part == 32
        three = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        keep = ~gap[1:-1]
        keep[_SLICE:] = False
        four = (three[:-1] << 8) | part[3:]
        both = ~(gap[1:-2] | gap[2:-1])
        both[_SLICE:] = False
        mixed = np.concatenate([three[keep], four[both] ^ np.uint32(0x5BD1E995)])
        mixed *= np.uint32(2654435761)
        yield mixed >> np.uint32(32 - BUCKET_BITS)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different buckets of a text and how many of its subwords each holds."""
    counts = np.zeros(BUCKETS, np.int64)
    for buckets in subwords(text):
        counts += np.bincount(buckets, minlength=BUCKETS)
    places = np.flatnonzero(counts)
    return places, counts[places]


@dataclass
class Model:
    """Predicts from the sum over subwords of a row of ``table``: embeddings times linear layer."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    # Least probability and largest share of unseen subwords by language.
    threshold: dict[str, float] = field(default_factory=dict)
    unseen: dict[str, float] = field(default_factory=dict)
    seen: np.ndarray | None = None

    def _sums(self, text: str) -> tuple[np.ndarray, int, int]:
        """Logits, number of subwords, and how many of them training has not seen."""
        total, count, new = np.zeros(len(self.languages)), 0, 0
        for buckets in subwords(text):
            total += self.table[buckets].sum(axis=0, dtype=np.float64)
            count += len(buckets)
            new += 0 if self.seen is None else len(buckets) - int(np.count_nonzero(self.seen[buckets]))
        return total / max(count, 1) + self.bias, count, new

    def logits(self, text: str) -> np.ndarray:
        return self._sums(text)[0]

    def predict(self, text: str) -> tuple[str, float]:
        """The likeliest language (the first in order of equals) and its probability."""
        return self.judge(text)[:2]

    def judge(self, text: str) -> tuple[str, float, bool]:
        """Language and probability as ``predict`` has them, and whether the text is rejected."""
        logits, count, new = self._sums(text)
        best, chance = _softmax_top(logits / self.temperature)
        language = self.languages[best]
        share = self.unseen.get(language, 1.0)
        most = share * count + DEVIATIONS * np.sqrt(count * share * (1 - share))
        return language, chance, bool(chance < self.threshold.get(language, 0.0) or new > most)


def _softmax_top(logits: np.ndarray) -> tuple[int, float]:
    best = int(logits.argmax())
    return best, float(1.0 / np.exp(logits - logits[best]).sum())


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model from (language, text) rows; the same rows in the same order give the same model."""
    return learn([(language, *counted(text)) for language, text in rows])


def learn(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """A model from (language, buckets, counts) rows, as ``counted`` has them."""
    languages = sorted({row[0] for row in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(SEED)
    known = [(languages.index(language), places, counts / counts.sum(), int(counts.sum())) for language, places, counts in rows if len(places)]
    # Of each language, as the sample may have them in turns.
    order, taken, held = [0] * len(languages), [], []
    for row in known:
        order[row[0]] += 1
        (taken if order[row[0]] % HELD_BACK else held).append(row)
    embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias = rng.normal(0, 0.1, (WIDTH, len(languages))), np.zeros(len(languages))
    steps, step = EPOCHS * len(taken), 0
    for _ in range(EPOCHS):
        for at in rng.permutation(len(taken)):
            target, places, shares, _ = taken[at]
            rate = 1 - step / steps
            step += 1
            mean = shares @ embedding[places]
            logits = mean @ layer + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[target] -= 1
            back = layer @ error
            layer -= rate * LAYER_RATE * np.outer(mean, error)
            bias -= rate * BIAS_RATE * error
            embedding[places] -= rate * EMBEDDING_RATE * np.outer(shares, back)
    model = Model(languages, (embedding @ layer).astype(np.float32), bias)
    model.seen = np.zeros(BUCKETS, bool)
    for _, places, *_ in taken:
        model.seen[places] = True
    return _calibrated(model, held)


def _most_unseen(unseen: np.ndarray, counts: np.ndarray, seen: np.ndarray) -> float:
    """The largest share of unseen subwords that a text of a language may have, from the rows of it
    that were held back (how many of their subwords are unseen, and of how many)."""
    rows = len(unseen)
    if not rows:
        return 1.0
    # The least share with which each row would not be rejected (Wilson's lower bound).
    part, more = unseen / counts, DEVIATIONS**2 / counts
    needed = np.sort((part + more / 2 - np.sqrt(more * part * (1 - part) + more**2 / 4)) / (1 + more))
    rank = np.ceil(rows * (1 - LOW) + DEVIATIONS * np.sqrt(rows * LOW * (1 - LOW)))
    high = needed[min(rows, int(rank)) - 1]
    return float(max(high, (high + FOREIGN * np.mean(~seen)) / 2))


def _calibrated(model: Model, held: list[tuple[int, np.ndarray, np.ndarray, int]]) -> Model:
    """``model`` with the temperature that makes the rows held back likeliest, and the thresholds."""
    if not held:
        return model
    logits = np.array([shares @ model.table[places].astype(np.float64) + model.bias for _, places, shares, _ in held])
    target = np.array([row[0] for row in held])
    counts = np.array([row[3] for row in held])
    unseen = np.array([shares[~model.seen[places]].sum() * count for _, places, shares, count in held])

    def loss(temperature: float) -> float:
        scaled = logits / temperature
        scaled -= scaled.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(target)), target]).mean())

    model.temperature = min(np.geomspace(0.5, 20, 121), key=loss)
    tops = [_softmax_top(row / model.temperature) for row in logits]
    for number, language in enumerate(model.languages):
        right = [k for k, (best, _) in enumerate(tops) if best == number == target[k]]
        if not right:
            model.threshold[language] = LIKELY
            continue
        low = float(np.quantile([tops[k][1] for k in right], LOW))
        odds = np.log(low / max(1 - low, 1e-12)) - MARGIN
        model.threshold[language] = min(LIKELY, float(1 / (1 + np.exp(-odds))))
        model.unseen[language] = _most_unseen(unseen[right], counts[right], model.seen)
    return model


def train(labelled: DataFrame) -> Model:
    """A model learned from a bounded sample of ``labelled`` (doc_id, text, lang).

    Rows without a language, or without a letter in their text, are not learned from; repeated rows
    are learned once. Of every language the ``ROWS_PER_LANGUAGE`` rows with the smallest hashes
    are taken, ``ROWS`` in all.

    The sample is chosen by hashes, so that no text is shuffled. Then its whole texts are found
    again and counted by the tasks that read them; the driver receives counts of at most
    ``BUCKETS`` buckets a row.
    """
    keys = ["lang", "order", "digest"]
    usable = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select(
        "lang", F.xxhash64("doc_id", F.lit(SEED)).alias("order"), F.xxhash64("text").alias("digest"), "text"
    )
    # In two steps, or a language that most tasks hold would send one task rows from all of them.
    rows = usable.select(*keys, F.pmod("order", F.lit(PARTS)).alias("part"))
    for group in (["lang", "part"], ["lang"]):
        first = Window.partitionBy(*group).orderBy("order", "digest")
        rows = rows.withColumn("place", F.dense_rank().over(first)).where(F.col("place") <= ROWS_PER_LANGUAGE)
        rows = rows.dropDuplicates([*group, "order", "digest"])
    sample = rows.orderBy("place", "lang").limit(ROWS).select(*keys, "place")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                places, counts = counted(batch.column("text")[row].as_py())
                rest = [pa.array([places], pa.list_(pa.int32())), pa.array([counts], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(row, 1) for k in range(4)] + rest, [*keys, "place", "buckets", "counts"])

    # At most ROWS rows of four short columns are broadcast.
    found = usable.join(F.broadcast(sample), keys).select(*keys, "place", "text")
    schema = "lang string, order long, digest long, place int, buckets array<int>, counts array<long>"
    learned = found.mapInArrow(count, schema).dropDuplicates(keys).orderBy("place", "lang").toArrow()
    columns = [learned.column(name) for name in ("lang", "buckets", "counts")]
    return learn([(lang.as_py(), buckets.values.to_numpy(), counts.values.to_numpy()) for lang, buckets, counts in zip(*columns)])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and rejected of every row of ``docs`` (doc_id, text).

    A text that is null or has no letter is ``und`` with score 0 and rejected, as is every text
    if nothing was learned. Whole texts are read; no other column has a part in it. Null doc_ids
    and repeated rows stay; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            languages, scores, rejected = [], [], []
            for text, readable in zip(batch.column("text").to_pylist(), batch.column("readable").to_pylist()):
                language, score, out = model.judge(text) if readable and model.languages else (UNKNOWN, 0.0, True)
                languages.append(language)
                scores.append(score)
                rejected.append(out)
            columns = [batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    readable = docs.select("doc_id", "text", has_letter(F.col("text")).alias("readable"))
    return readable.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            sure = [not model.judge(text)[2] for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(sure, pa.bool_()))

    readable = docs.where(has_letter(F.col("text")))
    return readable.mapInArrow(keep, docs.schema) if model.languages else readable.where("false")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: the CRC-32 of its id as text modulo 3 is 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
