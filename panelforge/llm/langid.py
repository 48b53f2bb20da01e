"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is folded to lower-case letters with every other character as a blank, with a blank at either end; its n-grams of
``ORDERS`` characters (none that is all blanks, or has a blank inside) are hashed to ``BUCKETS`` buckets. Training counts
buckets by language; the matrix of log-probabilities is broadcast, and numpy gathers and sums its rows for batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDERS = (2, 3)
BUCKETS = 1 << 16
#: Documents on which the model is fitted, about: a bounded sample of the training fold, chosen by a hash of the row.
TRAIN_DOCS = 20_000
#: Cells of the broadcast matrix at most (languages x buckets).
MAX_CELLS = 1 << 26
#: n-grams that a posterior takes as independent evidence; more only count in proportion.
EVIDENCE = 60
#: n-grams scored at once.
SLICE = 1 << 20

UNDETERMINED = "und"
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to folded code point: letters to themselves (texts are lower-cased before), all else to a blank."""
    if not _FOLD:
        table = np.full(0x110000, 32, np.uint32)
        letters = np.array([i for i in range(0x110000) if chr(i).isalpha()], np.uint32)
        table[letters] = letters
        _FOLD.append(table)
    return _FOLD[0]


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: (index of the text, bucket) of each n-gram, texts in order; and which texts have a letter."""
    a = 0
    while a < len(texts):
        b, chars = a, 0
        while b < len(texts) and (b == a or chars + len(texts[b]) <= SLICE):
            chars += len(texts[b])
            b += 1
        codes = [np.frombuffer(f" {x.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") for x in texts[a:b]]
        sizes = np.array([len(x) for x in codes])
        flat = _fold()[np.concatenate(codes)]
        ends = np.cumsum(sizes)
        has = np.logical_or.reduceat(flat != 32, ends - sizes)
        owner = np.repeat(np.arange(a, b), sizes)
        left = np.repeat(ends, sizes) - np.arange(len(flat))
        for n in ORDERS:
            blank = flat == 32
            count = len(flat) - n + 1
            keep = left[:count] >= n
            for k in range(1, n - 1):
                keep &= ~blank[k : k + count]
            keep &= ~(blank[:count] & blank[n - 1 : n - 1 + count]) if n > 2 else ~(blank[:count] & blank[1 : 1 + count])
            value = np.full(count, n, np.uint32)
            for k in range(n):
                value = (value ^ flat[k : k + count]) * np.uint32(0x9E3779B1)
                value ^= value >> np.uint32(15)
            at = np.flatnonzero(keep)
            yield owner[at], (value[at] >> np.uint32(16)).astype(np.int64) if BUCKETS == 1 << 16 else value[at] % BUCKETS, np.flatnonzero(has) + a
        a = b


def count_grams(texts: DataFrame) -> DataFrame:
    """``lang, bucket, n`` summed over ``texts`` (lang, text); a task adds up before it sends anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                total = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, bucket, _ in grams([t for t, x in zip(texts_, langs, strict=True) if x == lang]):
                    total += np.bincount(bucket, minlength=BUCKETS)
        for lang, total in counts.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen), pa.array(total[seen])], ["lang", "bucket", "n"])

    return texts.mapInArrow(common.lean(run), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """``langs`` in ascending order and the matrix of log-probabilities, buckets x languages."""

    def __init__(self, langs: list[str], matrix: np.ndarray):
        self.langs, self.matrix = langs, matrix

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text (``und`` if null or without a letter) and its probability."""
        n = len(texts)
        total, size, has = np.zeros((n, max(len(self.langs), 1))), np.zeros(n), np.zeros(n, bool)
        for owner, bucket, lettered in grams([x or "" for x in texts]) if self.langs else ():
            has[lettered] = True
            for k in range(0, len(owner), SLICE):
                who, what = owner[k : k + SLICE], bucket[k : k + SLICE]
                begins = np.flatnonzero(np.diff(who, prepend=-1))
                total[who[begins]] += np.add.reduceat(self.matrix[what], begins, axis=0)
                size[who[begins]] += np.diff(np.append(begins, len(who)))
        scaled = total * (np.minimum(size, EVIDENCE) / np.maximum(size, 1))[:, None]
        weight = np.exp(scaled - scaled.max(1, keepdims=True))
        best = total.argmax(1)
        score = np.where(has, weight[np.arange(n), best] / weight.sum(1), 0.0)
        return [self.langs[k] if h else UNDETERMINED for k, h in zip(best, has, strict=True)], score


def bounded_sample(rows: DataFrame, bound: int, *key: str) -> DataFrame:
    """About ``bound`` of the rows, chosen by a hash of ``key`` wherever they stand."""
    n = rows.count()
    if n <= bound:
        return rows
    part = F.pmod(F.xxhash64(*key, F.lit("sample")), F.lit(1 << 30))
    return rows.where(part < int(bound / n * (1 << 30)))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on documents with a text and a ``lang``; without any the model knows no language.

    Languages come from all rows. Each is fitted on about ``train_docs`` / languages of its documents, chosen by a hash of
    id and text wherever they stand, or on all of them if it has fewer. Their n-grams are counted once.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_CELLS // BUCKETS + 1).collect()}
    langs = sorted(sizes)
    if len(langs) * BUCKETS > MAX_CELLS:
        raise ValueError(f"{len(langs)} languages or more: the matrix would have over {MAX_CELLS} cells")
    matrix = np.ones((BUCKETS, max(len(langs), 1)))
    if langs:
        below = [int(min(1.0, train_docs / len(langs) / sizes[x]) * (1 << 30)) for x in langs]
        shares = docs.sparkSession.createDataFrame(list(zip(langs, below, strict=True)), "lang string, below long")
        part = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30))
        sample = rows.join(F.broadcast(shares), "lang").where(part < F.col("below")).select("lang", "text")
        table = count_grams(sample).toArrow()
        at = {x: k for k, x in enumerate(langs)}
        matrix[table["bucket"].to_numpy(), [at[x] for x in table["lang"].to_pylist()]] += table["n"].to_numpy()
    return Model(langs, np.log(matrix / matrix.sum(0)).astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    A null or letterless text, and any text under a model without languages, gives ``und`` and 0. Equal scores go to the
    language that sorts first. Repeated rows give repeated rows; an empty table none; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in common.slices(b)):
            langs, score = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return common.id_and_text(docs).mapInArrow(common.lean(run), "doc_id long, lang_pred string, score double")
