"""What the text operators share: the shared work folder, written tables, and input checks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``; without it a job on a cluster ends here, as executors don't see each
    other's local folders. Only in local mode (tests) a temporary folder is made and kept in the session's settings, so that
    one session uses one folder.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.conf.get("panelforge.work.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="panelforge-")
        spark.conf.set("panelforge.work.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/panelforge/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._panelforge_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing will read again."""
    for df in frames:
        path = getattr(df, "_panelforge_path", None)
        if path:
            removed(df.sparkSession, path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more: it does so when the driver's garbage is
    collected, which can take longer than many rounds of small jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch that holds texts, about.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, not only their rows: both the executor's JVM and its worker hold copies of a batch
    outside of the heap. A lower bound that the session already has stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).lower().rstrip("b") or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def id_and_text(docs: DataFrame, *, null_text: str | None = "") -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string): other columns, whatever their names, can't clash afterwards."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    if null_text is not None:
        text = F.coalesce(text, F.lit(null_text))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def without_ids(docs: DataFrame, ids: DataFrame, most_bytes: int = 32_000_000) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in the written table ``ids`` (doc_id long); rows without doc_id stay.

    Columns may have any names: rows are held as one struct during the join. The ids are broadcast if they are within
    ``most_bytes``, else the join shuffles.
    """
    once = ids.select("doc_id").distinct()
    once = F.broadcast(once) if ids.count() * 16 <= most_bytes else once
    rows = docs.select(F.struct("*").alias("row"))
    left = rows.join(once, F.col("row")["doc_id"].cast("long") == F.col("doc_id"), "left_anti")
    return left.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value, body):
    """Bind a column so that the SQL expression ``body(value)`` evaluates it once, however often it refers to it."""
    return F.transform(F.array(value), body)[0]


def crc_fold(doc_id: str, folds: int):
    """crc32 of the id as text, modulo ``folds``: the fold that the train/held-out split uses."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def lean(run):
    """``run`` (batches to batches) for an Arrow map; its worker gives memory back when the task ends.

    Workers live on for the next task, and their allocators keep what one task needed at most: beside a full heap that is
    what an executor runs out of.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def slices(batch, column: int = 1, most: int = 1_000_000):
    """A record batch in pieces with about ``most`` bytes in one column (a longer value stands alone)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, a = np.cumsum(sizes, dtype=np.int64), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def split_words(texts: pa.Array, lower: bool = False) -> pa.Array:
    """Lists of what lies between ASCII white space (0x09-0x0D, 0x20); parts between adjacent ones are empty strings.

    Nulls must be filled. ``lower`` turns A-Z to a-z. Arrow's own functions aren't used: ascii_split_whitespace also cuts at
    bytes 0x85 and 0xA0, inside of UTF-8 characters, and ascii_lower of a slice has offsets beyond its data.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy() if data is not None else np.zeros(0, np.uint8)
    raw[(raw - np.uint8(9)) < 5] = 32
    if lower:
        raw[(raw - np.uint8(65)) < 26] += 32
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((at - at[0]).tobytes()), pa.py_buffer(raw)])
    return pc.split_pattern(plain, " ")


LONG, STRING, DOUBLE, BINARY = T.LongType(), T.StringType(), T.DoubleType(), T.BinaryType()
