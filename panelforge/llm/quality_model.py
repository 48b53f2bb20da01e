"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are words between white space, lower-cased, and each word's shape (runs of letters as ``a``, of digits as ``0``,
other characters once). Features are hashed uni- and bigrams of either; a bigram of two equal words is one feature of its
own. A feature's value is its share among the text's n-grams of its kind, so a score is a bias plus two means of weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import bounded_sample

BITS = 18
#: Labelled rows on which the model is fitted, about: a bounded sample chosen by a hash of the row.
TRAIN_ROWS = 6_000
EPOCHS, ALPHA, BETA, L1, L2 = 2, 0.5, 1.0, 0.001, 0.01
#: Values are shares times this.
SCALE = 20.0
#: Words scored at once, about.
GROUP_BYTES = 750_000

_RUNS = re.compile(r"([^\W\d_]+)|(\d+)|(.)\3*", re.S)


def shape(word: str) -> str:
    return _RUNS.sub(lambda m: "a" if m[1] else "0" if m[2] else m[3], word)


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of texts: (first text, number of texts, hashed n-grams, index of each one's text in the group, their value)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        before = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, before + GROUP_BYTES, "right")))
        split = pc.utf8_split_whitespace(pc.utf8_lower(texts.slice(a, b - a)))
        bounds = split.offsets.to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(b - a), np.diff(bounds))
        coded = split.flatten().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        filled = np.array([bool(x) for x in names], bool)[codes] if names else np.zeros(0, bool)
        owner, codes = owner[filled], codes[filled]
        words = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names], np.uint32)
        shapes = np.array([zlib.crc32(shape(x).encode("utf-8", "surrogatepass"), 1) for x in names], np.uint32)
        parts = []
        for kind, one in enumerate((words, shapes)):
            single = one[codes] if names else np.zeros(0, np.uint32)
            inside = owner[1:] == owner[:-1]
            pair = (single[:-1] * np.uint32(0x85EBCA6B) ^ single[1:] * np.uint32(0xC2B2AE35)) + np.uint32(kind)
            pair[single[:-1] == single[1:]] = 0xABCDEF12 + kind
            hashed = np.concatenate([single, pair[inside]])
            who = np.concatenate([owner, owner[1:][inside]])
            share = np.bincount(who, minlength=b - a)
            parts.append((_bucket(hashed), who, SCALE / share[who]))
        yield a, b - a, *(np.concatenate(x) for x in zip(*parts, strict=True))
        a = b


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return ((hashed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


class Leader:
    """Follow-the-regularised-leader, proximal form, with per-coordinate rates. The last coordinate is the bias."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _rows(docs: DataFrame) -> DataFrame:
    """``label, tie, at, value``: each labelled text's distinct features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, count, hashed, who, value in features(batch.column(1)):
                pair, where = np.unique(who.astype(np.int64) << 32 | hashed, return_inverse=True)
                total = np.bincount(where, value).astype(np.float32)
                cuts = np.searchsorted(pair, np.arange(count + 1, dtype=np.int64) << 32)
                seen = (pair & (1 << 32) - 1).astype(np.int32)
                at = [seen[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                values = [total[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                part = batch.slice(start, len(at))
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(0), pa.array(at, pa.binary()), pa.array(values, pa.binary())], ["label", "doc_id", "at", "value"])

    return docs.mapInArrow(common.lean(run), "label int, doc_id long, at binary, value binary")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights (the bias last) from ``labels`` (doc_id, quality 0/1; other values and nulls are left out).

    The sample, about ``train_rows`` labelled ids whatever the table's size, is broadcast to find its texts (of rows with
    one doc_id the least text), and one task learns from it in the order of a hash. Of labels that contradict each other the
    lower one counts. Without labelled texts all weights are 0.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    sample = bounded_sample(marked.groupBy("doc_id").agg(F.min("label").alias("label")), train_rows, "doc_id")
    texts = common.id_and_text(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows.sort(key=lambda r: (zlib.crc32(str(r[1]).encode()), r[1], r[2]))
        leader = Leader(1 << BITS)
        for _ in range(EPOCHS):
            for label, _, at, value in rows:
                leader.learn(np.frombuffer(at, np.int32), np.frombuffer(value, np.float32).astype(np.float64), label)
        yield pa.RecordBatch.from_arrays([pa.array([leader.weights().astype(np.float32).tobytes()], pa.binary())], ["weights"])

    (row,) = _rows(texts).repartition(1).mapInArrow(common.lean(fit), "weights binary").collect() or (None,)
    return np.frombuffer(row["weights"], np.float32).copy() if row else np.zeros((1 << BITS) + 1, np.float32)


def score_texts(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.full(len(texts), float(weights[-1]))
    for start, count, hashed, who, value in features(texts):
        out[start : start + count] += np.bincount(who, weights[hashed] * value, count)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def classify(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score, predicted`` of every whole text; empty and null texts score by the bias alone.

    Repeated rows give repeated rows, an empty table none; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in common.slices(b)):
            score = score_texts(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return common.id_and_text(docs).mapInArrow(common.lean(run), "doc_id long, score double, predicted int")


def keep_accepted(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of ``docs`` that the model predicts as 1, all columns, whatever their names.

    Only texts go to Python, in small batches. A null or empty text scores by the bias alone; repeated rows get one verdict;
    an empty table gives an empty one.
    """
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            whole = pa.RecordBatch.from_arrays([texts], ["text"])
            good = [score_texts(part.column(0), shared.value) >= 0.5 for part in common.slices(whole, 0)]
            yield pa.array(np.concatenate(good) if good else np.zeros(0, bool))

    @F.arrow_udf("boolean")
    def accepted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from common.lean(scored)(batches)

    return docs.where(accepted(F.col("text").cast("string")))
