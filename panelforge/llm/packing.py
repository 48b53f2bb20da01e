"""Packing along a space-filling curve.

Every document becomes a vector of hashed token counts, projected to ``DIMS`` dimensions by a fixed random matrix. The
projections are scaled by their mean and deviation over the whole corpus, cut into ``2**BITS`` steps, and numbered along a
Hilbert curve. Documents are range-sorted by that number, and each partition's ids, one document after the other, are cut
into sequences of ``length`` ids, so neighbours on the curve share sequences. A partition's last ids (fewer than
``length``) become sequences whose lengths are powers of two; nothing is padded.
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
from .tokens import binary_array, crc_u32, encoder

DIMS, BITS, BUCKETS, SEED = 4, 10, 1 << 16, 20_240

VECTORS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField(f"p{k}", T.DoubleType()) for k in range(DIMS)] + [T.StructField("tie", T.LongType())])
PIECES = T.StructType([T.StructField(x, T.LongType()) for x in ("doc_id", "start", "length")] + [T.StructField("ids", T.BinaryType())] + [T.StructField(x, T.LongType()) for x in ("doc_tokens", "sequence_id", "offset")])


def projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def bucket_of(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(16)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each row of non-negative integers (below ``2**bits``) along the Hilbert curve of its dimension.

    Goes from the highest bit down: each bit in which a coordinate is set inverts the lower bits of the first coordinate,
    else these are exchanged with the coordinate's; the Gray code of what results, bit by bit, is the position.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dims):
            on = (x[d] >> bit & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[d] >> bit & 1)
    return key


def document_vectors(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Ids (with the end id) of each whole text and its projected hashed count vector, divided by the number of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer_path)
        matrix = projection()[bucket_of(np.arange(max(e.vocab, end_id + 1)))]
        for batch in (x for b in batches for x in common.slices(b)):
            flat, bounds = e.encode(batch.column(1))
            n = len(bounds) - 1
            flat, bounds = np.insert(flat, bounds[1:], end_id), bounds + np.arange(n + 1)
            points = np.add.reduceat(matrix[flat], bounds[:-1], axis=0) / np.diff(bounds)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_array(flat, bounds), *(pa.array(points[:, k].astype(float)) for k in range(DIMS)), batch.column(2)], VECTORS.names)

    return common.id_and_text(docs).withColumn("tie", F.monotonically_increasing_id()).mapInArrow(common.lean(run), VECTORS)


def _cut(sizes_left: int, length: int) -> list[int]:
    """Lengths of the last sequences: the powers of two that make up what is left."""
    return [1 << b for b in range(length.bit_length(), -1, -1) if sizes_left >> b & 1]


def _pieces(part: int, docs: Iterator[tuple[int | None, np.ndarray]], length: int) -> Iterator[tuple]:
    """Pieces (doc_id, start, ids, doc_tokens, sequence, offset) of one partition's documents in order."""
    sequence, fill, open_pieces = 0, 0, []
    for doc, ids in docs:
        at = 0
        while at < len(ids):
            take = min(length - fill, len(ids) - at)
            open_pieces.append((doc, at, ids[at : at + take], len(ids), sequence, fill))
            at, fill = at + take, fill + take
            if fill == length:
                yield from open_pieces
                sequence, fill, open_pieces = sequence + 1, 0, []
    ends = np.cumsum([0, *_cut(fill, length)])
    for doc, start, ids, total, _, offset in open_pieces:
        at = offset
        while at < offset + len(ids):
            k = int(np.searchsorted(ends, at, "right")) - 1
            stop = min(int(ends[k + 1]), offset + len(ids))
            yield doc, start + at - offset, ids[at - offset : stop - offset], total, sequence + k, at - int(ends[k])
            at = stop


def pack_sequences(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their ids: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are bytes of the vocabulary's width. A null text counts as empty (its end id alone); repeated rows are packed
    each by itself; null doc_ids are kept; an empty table gives no pieces; only ``doc_id`` and ``text`` are read, so other
    columns may have any names. One very long document spans as many sequences as it needs. ``sequence_id`` is the
    partition number above the sequence's number in it.
    """
    spark = docs.sparkSession
    dtype = encoder(tokenizer_path).dtype
    vectors = common.written(document_vectors(docs, tokenizer_path, end_id), "vectors")
    stats = vectors.agg(*(f(F.col(f"p{k}")).alias(f"{f.__name__}{k}") for k in range(DIMS) for f in (F.avg, F.stddev_pop))).first()
    mean = np.array([stats[f"avg{k}"] or 0.0 for k in range(DIMS)])
    scale = np.array([stats[f"stddev_pop{k}"] or 1.0 for k in range(DIMS)])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(2 + k).to_numpy() for k in range(DIMS)], 1)
            steps = np.clip((np.tanh((points - mean) / scale / 1.5) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert_key(steps.astype(np.int64))), batch.column(2 + DIMS)], ["doc_id", "ids", "key", "tie"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = ((d, np.frombuffer(x, dtype)) for b in batches for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        held: list[tuple] = []
        for piece in _pieces(part, rows, length):
            held.append(piece)
            if len(held) == 4096:
                yield _batch(part, held)
                held = []
        if held:
            yield _batch(part, held)

    keyed = vectors.mapInArrow(common.lean(keys), "doc_id long, ids binary, key long, tie long")
    ordered = keyed.repartitionByRange(common.partitions(spark), "key", "doc_id", "tie").sortWithinPartitions("key", "doc_id", "tie")
    return ordered.select("doc_id", "ids").mapInArrow(common.lean(pack), PIECES)


def _batch(part: int, pieces: list[tuple]) -> pa.RecordBatch:
    doc, start, ids, total, sequence, offset = zip(*pieces, strict=True)
    columns = [
        pa.array(doc, pa.int64()),
        pa.array(start, pa.int64()),
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([x.tobytes() for x in ids], pa.binary()),
        pa.array(total, pa.int64()),
        pa.array(np.array(sequence, np.int64) + (part << 36)),
        pa.array(offset, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, PIECES.names)


def digest(pieces: DataFrame, dtype: np.dtype) -> DataFrame:
    """The pieces with ``ids_crc32`` (as unsigned 32-bit ids) in place of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [crc_u32(np.frombuffer(x, dtype)) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2)), pa.array(crc, pa.int64()), *(batch.column(k) for k in (4, 5, 6))], _DIGEST)

    return pieces.mapInArrow(common.lean(run), ", ".join(f"{x} long" for x in _DIGEST))


_DIGEST = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
