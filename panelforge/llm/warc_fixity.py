"""WARC archives and their Merkle fixity audit.

``write_archive`` lays pages out as WARC/1.1 response records, in order of page_id, over segment files of bounded size, and
writes a copy. A copy is a table of files' records: ``segment, offset, record`` (bytes). A segment's tree has the records'
SHA-256 hashes as leaves; a node of level ``k`` covers the ordered offsets of ``RANGE * FANOUT**k`` bytes and hashes what
its children cover, each with its first offset, in order. The root of a copy hashes the segments' tops.

``audit`` compares the roots of two copies. If they differ it descends level by level, at each one comparing only nodes
below a mismatch, down to the records: corrupt ones, and those that a copy lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of records in a segment file, about; bytes of offsets under a lowest node; children of a higher one.
SEGMENT_BYTES = 1 << 25
RANGE = 1 << 18
FANOUT = 16


def record(url: Column, page_id: Column, html: Column) -> Column:
    """A page as one WARC response record (text). Null fields count as empty; line breaks in a url become blanks."""
    body = F.coalesce(html.cast("string"), F.lit(""))
    target = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\r\n]", " ")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        target,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``segment, offset, length, page_id, record``: records in order of page_id over segments of about equal bytes.

    Pages are range-partitioned, so that no task holds more than its range whatever the keys; a partition's records follow
    one another, and a new segment begins wherever ``segment_bytes`` are exceeded. Repeated rows are archived as often as
    they occur, a null page_id first.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), record(F.col("url"), F.col("page_id"), F.col("html")).cast("binary").alias("record"), F.monotonically_increasing_id().alias("tie"))
    ordered = rows.repartitionByRange(common.partitions(spark), "page_id", "tie").sortWithinPartitions("page_id", "tie")

    def place(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            start = at + np.cumsum(size) - size
            at += int(size.sum())
            segment = start // segment_bytes
            first = segment * segment_bytes
            yield pa.RecordBatch.from_arrays([pa.array(part + segment), pa.array(start - first), pa.array(size), batch.column(0), batch.column(1)], ["segment", "offset", "length", "page_id", "record"])

    return ordered.select("page_id", "record").mapInArrow(common.lean(place), "segment long, offset long, length long, page_id long, record binary")


def write_archive(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    archive(pages, segment_bytes).write.option("compression", "zstd").parquet(path)


def read_copy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_warc(copy: DataFrame, path: str) -> None:
    """The copy as plain ``.warc`` text files, a file for each partition and run of segments; records must be text."""
    ordered = copy.repartitionByRange(common.partitions(copy.sparkSession), "segment", "offset").sortWithinPartitions("segment", "offset")
    whole = ordered.select(F.expr("substring(cast(record as string), 1, char_length(cast(record as string)) - 4)").alias("value"))
    whole.write.option("lineSep", "\r\n\r\n").text(path)


def leaves(copy: DataFrame) -> DataFrame:
    """``segment, offset, hash`` of every record, hashed where it is read."""
    return copy.select("segment", "offset", F.sha2("record", 256).alias("hash"))


def _parents(level: DataFrame, span: int) -> DataFrame:
    """Nodes one level up: each hashes its children's offsets and hashes in order. A node has a bounded number of children:
    at the lowest level the records that begin in ``RANGE`` bytes, above at most ``FANOUT`` nodes."""
    child = F.concat(F.col("offset").cast("string"), F.lit(":"), F.col("hash"))
    grouped = level.groupBy("segment", (F.floor(F.col("offset") / span) * span).cast("long").alias("start"))
    kids = grouped.agg(F.array_sort(F.collect_list(F.struct("offset", child.alias("text")))).alias("kids"))
    return kids.select("segment", F.col("start").alias("offset"), F.sha2(F.array_join(F.transform("kids", lambda k: k["text"]), "|"), 256).alias("hash"))


def _spans(longest: int) -> list[int]:
    out = [RANGE]
    while out[-1] <= longest:
        out.append(out[-1] * FANOUT)
    return out


def build_tree(copy: DataFrame, longest: int) -> list[DataFrame]:
    """The levels of a copy's forest, leaves first; the last has one node a segment. Each is written once."""
    levels = [common.written(leaves(copy), "leaves")]
    for span in _spans(longest):
        levels.append(common.written(_parents(levels[-1], span), "nodes"))
    return levels


def root(tops: DataFrame) -> str:
    """The copy's root: tops are hashed into buckets, so that one task never gathers all segments, and buckets into one."""
    named = F.concat_ws(":", F.col("segment").cast("string"), F.col("hash"))
    buckets = tops.groupBy(F.pmod("segment", F.lit(64)).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(named)), "|"), 256).alias("hash"))
    rows = sorted((r["bucket"], r["hash"]) for r in buckets.collect())
    import hashlib

    return hashlib.sha256("|".join(f"{b}:{h}" for b, h in rows).encode()).hexdigest()


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """``segment, offset, damage`` of each record on which two copies differ: ``altered``, ``only_left`` or ``only_right``.

    Equal roots give an empty result without reading further. A segment that one copy lacks mismatches at the top, and all
    its records are reported. Empty copies are equal. Only ``segment, offset, record`` are read; each (segment, offset)
    must be unique in a copy, as it is in a file.
    """
    longest = max((c.agg(F.max("offset")).first()[0] or 0) for c in (left, right))
    trees = [build_tree(c, longest) for c in (left, right)]
    spans = [None, *_spans(longest)]
    spark = left.sparkSession
    none = spark.createDataFrame([], "segment long, offset long, damage string")
    if root(trees[0][-1]) == root(trees[1][-1]):
        return none
    suspects = None
    for level in range(len(spans) - 1, -1, -1):
        a, b = trees[0][level], trees[1][level]
        if suspects is not None:
            span = spans[level + 1]
            under = suspects.select("segment", F.col("offset").alias("start"))
            a, b = (x.withColumn("start", (F.floor(F.col("offset") / span) * span).cast("long")).join(under, ["segment", "start"], "left_semi").drop("start") for x in (a, b))
        both = a.select("segment", "offset", F.col("hash").alias("x")).join(b.select("segment", "offset", F.col("hash").alias("y")), ["segment", "offset"], "full")
        damage = F.when(F.col("y").isNull(), "only_left").when(F.col("x").isNull(), "only_right").otherwise("altered")
        suspects = common.written(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("segment", "offset", damage.alias("damage")), "suspects")
        if level == 0:
            return suspects
    return none


def with_damage(copy: DataFrame, every: int = 64) -> DataFrame:
    """A replica with known damage, as a test of the audit: the last byte of a record's payload is changed in each record
    whose page_id has crc32 (as text) 5 modulo ``every``, and records with 6 are lost."""
    fold = F.crc32(F.col("page_id").cast("string").cast("binary")) % every
    size = F.octet_length("record")
    # the byte before the closing blank lines: bit 0 is flipped by exchanging it for a byte that differs
    tail = F.expr("substring(record, octet_length(record) - 4, 1)")
    other = F.when(tail == F.unhex(F.lit("21")), F.unhex(F.lit("23"))).otherwise(F.unhex(F.lit("21")))
    changed = F.concat(F.substring(F.col("record"), F.lit(1), size - 5), other, F.expr("substring(record, octet_length(record) - 3, 4)"))
    kept = copy.where(F.coalesce(fold != 6, F.lit(True)))
    return kept.withColumn("record", F.when(fold == 5, changed).otherwise(F.col("record")))


def audited_pages(pages: DataFrame) -> DataFrame:
    """Archive ``pages``, damage a replica, audit it: ``page_id, record_bytes, record_sha256, status`` for each page.

    ``status`` is what the audit finds by descending from the roots: ``intact``, ``altered`` or ``only_left`` (lost in the
    replica). Null urls and bodies are archived as empty; an empty table gives no rows.
    """
    spark = pages.sparkSession
    good, bad = common.fresh_path(spark, "copy-a"), common.fresh_path(spark, "copy-b")
    write_archive(pages, good)
    first = read_copy(spark, good)
    with_damage(first).select("segment", "offset", "record").write.option("compression", "zstd").parquet(bad)
    found = audit(first, read_copy(spark, bad))
    rows = first.select("segment", "offset", "page_id", F.col("length").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
    return rows.join(found, ["segment", "offset"], "left").select("page_id", "record_bytes", "record_sha256", F.coalesce("damage", F.lit("intact")).alias("status"))


ORACLE_SQL = r"""
WITH body AS (
  SELECT page_id, coalesce(html, '') AS b, regexp_replace(coalesce(url, ''), '[\r\n]', ' ', 'g') AS u FROM pages
), rec AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
      || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || u || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(b)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || b
      || chr(13) || chr(10) || chr(13) || chr(10) AS r
  FROM body
), bits AS (
  SELECT page_id, r, encode(coalesce(page_id::VARCHAR, '')) AS k FROM rec
), crc AS (
  SELECT page_id, r, page_id IS NOT NULL AS named,
    list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, octet_length(k) + 1), lambda i: ascii(decode(k)[i])::UBIGINT)),
      lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS c
  FROM bits
)
SELECT page_id, strlen(r)::BIGINT AS record_bytes, sha256(r) AS record_sha256,
       CASE WHEN named AND xor(c, 4294967295::UBIGINT) % 64 = 5 THEN 'altered' WHEN named AND xor(c, 4294967295::UBIGINT) % 64 = 6 THEN 'only_left' ELSE 'intact' END AS status
FROM crc
"""
