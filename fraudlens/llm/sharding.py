"""Contiguous shards of balanced byte size.

Rows are range-partitioned and sorted by (doc_id, checksum, size) and numbered by
their partition; bytes and rows are summed per partition, the running sums of
these totals (one row a partition) give each partition's offset, and a running
sum inside each partition gives each row its first byte in the whole order. The
byte line is cut into ``shards`` equal parts, and a row belongs to the part that
holds its middle byte: shards are contiguous, and differ from the target by less
than the largest row.

Defined results: texts have no length limit; other columns, whatever their names, are not read; a null text has no
bytes (a row still counts one); null doc_ids come first; repeated rows stand next to each other and may be cut apart;
an empty table gives no rows. Only the id, size and checksum of a row are moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.llm.common import staged, text_or_empty

SHARDS = 16


def slim_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32): UTF-8 bytes plus one, and their unsigned CRC-32."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))


def byte_offsets(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, size, text_crc32) with ``before``, the bytes of all rows before it in the order."""
    # The random number only spreads rows that are equal in all three; any order of them is the same order.
    parts = staged(rows.withColumn("r", F.rand(5)).repartitionByRange("doc_id", "text_crc32", "size", "r")
                   .withColumn("part", F.spark_partition_id()).drop("r"), "ranges")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.sum("size").alias("bytes")).select(
        "part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0).cast("long")).alias("offset"))
    # one row a partition, and there are at most spark.sql.shuffle.partitions of them
    inside = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))) \
        .join(F.broadcast(offsets), "part").withColumn("before", F.col("offset") + F.col("inside")) \
        .select("doc_id", "size", "text_crc32", "part", "before")


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot numbers the rows of a shard from 0 in order."""
    placed = byte_offsets(staged(slim_rows(docs, id_col, text_col), "sizes"))
    total = placed.agg((F.max(F.col("before") + F.col("size"))).alias("t")).first()["t"] or 1
    cut = placed.withColumn("shard", F.expr(f"int(({shards} * (2 * before + size)) div {2 * total})"))
    # A partition holds a few shards' rows: number them inside (part, shard), then add what earlier partitions have.
    counts = cut.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("first"))
    inside = Window.partitionBy("part", "shard").orderBy("before", "doc_id")
    return cut.withColumn("k", F.row_number().over(inside)).join(F.broadcast(first), ["shard", "part"]) \
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("k") - 1).alias("slot"))


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    return assign(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


#: The rows of :func:`report` over ``documents``. CRC-32 goes byte by byte through its table, which the
#: reversed polynomial 0xEDB88320 gives; rows equal in id, checksum and size may stand in any order.
ORACLE = f"""
WITH RECURSIVE steps(byte, c, k) AS (
    SELECT b, b, 0 FROM range(256) r(b)
    UNION ALL
    SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
slim AS (
    SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size, xor(list_reduce(
        list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
        lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
    FROM texts, crc_table),
line AS (
    SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before,
        sum(size) OVER () AS total
    FROM slim),
cut AS (SELECT *, CAST({SHARDS} * (2 * before + size) // (2 * total) AS INTEGER) AS shard FROM line)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    CAST(row_number() OVER (PARTITION BY shard ORDER BY before) - 1 AS BIGINT) AS slot,
    CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""
