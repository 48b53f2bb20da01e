"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

File format (``write_store``): a folder of Parquet files, so any file system that Spark writes to can hold it and Spark's
committer makes retries safe. A row is a block of consecutive documents in ascending ``doc_id`` order:

``part, block``  order of the blocks; ``doc_ids, sizes``  the documents and how many values each has;
``n_values, start``  values in the block, and before it within its part;
``control``  two bits a value, four values a byte, low bits first: bytes of the value less one;
``data``  the values' little-endian bytes, one to four each.

A value is the rank of an id by descending corpus frequency (ties: smaller id first), so frequent ids take one byte.
``ranks`` (one row: ids in order of rank) stands beside the blocks. Decoding looks the lengths of four values up in a
256-row table for each control byte and gathers the bytes with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import binary_array, crc_u32, encoder, ids_of

#: Values in a block at most, unless one document alone has more.
BLOCK_VALUES = 1 << 18

#: Bytes of each of the four values that a control byte describes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1

ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("tie", T.LongType())])
BLOCKS = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("part", "block", "start", "n_values")]
    + [T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType()))]
    + [T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())]
)


def compress(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    used = np.arange(4) < size[:, None]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decompress(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The reverse of ``compress``, by table lookup."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    at = np.cumsum(size) - size
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``doc_id``, ``ids`` (bytes) with the end id, and a tie-break for equal doc_ids. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        for batch in (x for b in batches for x in common.slices(b)):
            flat, bounds = e.encode(batch.column(1))
            n = len(bounds) - 1
            flat = np.insert(flat, bounds[1:], end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_array(flat, bounds + np.arange(n + 1)), batch.column(2)], ["doc_id", "ids", "tie"])

    source = common.id_and_text(docs).withColumn("tie", F.monotonically_increasing_id())
    return source.mapInArrow(common.lean(run), ENCODED)


def _ranks(ids: DataFrame, vocab: int, dtype: np.dtype) -> list[int]:
    """All ids of the vocabulary by descending count over the whole corpus. At most ``vocab`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            total += np.bincount(ids_of(batch.column(0), dtype)[0], minlength=vocab)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(common.lean(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocab, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return np.lexsort([np.arange(vocab), -counts]).tolist()


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Encode all documents and write the store's blocks and ranks under ``path``.

    Two passes: ids are made once and kept as a table; their counts over all documents fix the ranks (a list as long as
    the vocabulary, broadcast in the closure); then ids are range-partitioned by ``doc_id`` and packed. An empty table
    gives an empty store. Repeated doc_ids are kept side by side; null doc_ids stand first.
    """
    spark = docs.sparkSession
    e = encoder(tokenizer_path)
    dtype, vocab = e.dtype, max(e.vocab, end_id + 1)
    ids = common.written(encode_documents(docs, tokenizer_path, end_id), "ids")
    by_rank = _ranks(ids, vocab, dtype)
    rank_of = np.empty(vocab, np.uint32)
    rank_of[by_rank] = np.arange(vocab, dtype=np.uint32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        held_values = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held, held_values
            control, data = compress(rank_of[np.frombuffer(b"".join(x for _, x in held), dtype)])
            sizes = [len(x) // dtype.itemsize for _, x in held]
            row = {"part": part, "block": block, "start": start, "n_values": held_values, "doc_ids": [d for d, _ in held], "sizes": sizes, "control": control, "data": data}
            block, start, held, held_values = block + 1, start + held_values, [], 0
            return pa.RecordBatch.from_pylist([row], schema=_ARROW_BLOCKS)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(raw) // dtype.itemsize
                if held and held_values + n > BLOCK_VALUES:
                    yield flush()
                held.append((doc, raw))
                held_values += n
        if held:
            yield flush()

    n = common.partitions(spark)
    ordered = ids.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    ordered.mapInArrow(common.lean(pack), BLOCKS).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(by_rank,)], "ids array<int>").write.parquet(f"{path}/ranks")
    common.dropped(ids)


_ARROW_BLOCKS = pa.schema(
    [(x, pa.int64()) for x in ("part", "block", "start", "n_values")] + [("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]
)


def read_store(spark, path: str) -> DataFrame:
    """``doc_id, start, ids`` (unsigned 32-bit bytes) of every document in the store; ``start`` counts all ids before it.

    Only the parts' totals (a row for each file written) come to the driver.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    by_rank = np.array(spark.read.parquet(f"{path}/ranks").first()["ids"], np.uint32)
    totals = blocks.groupBy("part").agg(F.sum("n_values").alias("n")).orderBy("part").collect()
    before, at = {}, 0
    for r in totals:
        before[r["part"]] = at
        at += r["n"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = by_rank[decompress(row["control"], row["data"], row["n_values"])]
                bounds = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
                start = before[row["part"]] + row["start"] + bounds[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), binary_array(ids.astype("<u4"), bounds)], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(common.lean(unpack), "doc_id long, start long, ids binary")


def digest(store: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the ids that were read back."""
    return store.select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))


def token_id_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the store, read it back, and return one digest row for each document."""
    spark = docs.sparkSession
    path = path or common.fresh_path(spark, "token-store")
    write_store(docs, tokenizer_path, end_id, path)
    return digest(read_store(spark, path))


__all__ = ["compress", "crc_u32", "decompress", "digest", "encode_documents", "read_store", "token_id_store", "write_store"]
