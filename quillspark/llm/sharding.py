"""Operator 1, sharding: global byte-size prefix sums from per-partition totals, cut at equal targets.

Rows are ranged by id (nulls last; ties by checksum and size), each range is summed, the few range totals give
each range its offset, and a row's global prefix is its offset plus the running sum inside its range. A row goes
to the shard in which the middle of its byte interval falls, so shards are contiguous and differ from the equal
target by at most about one row. Texts never move: only id, size and checksum are shuffled.

Defined results: a null text counts as no bytes (its checksum is that of the empty text); null ids come last;
repeated rows each get a slot of their own; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import cut


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    ranged = cut(sized.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "sharding")
    before, inside = (Window.orderBy("_range"), Window.partitionBy("_range").orderBy(*order))
    offsets = (
        ranged.groupBy("_range")
        .agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        .select("_range", *(F.coalesce(F.sum(c).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{c}_before") for c in ("_bytes", "_rows")), F.sum("_bytes").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    )
    placed = ranged.join(F.broadcast(offsets), "_range").select(  # one row for each range partition
        "doc_id", "size", "text_crc32",
        (F.col("_bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("_start"),
        (F.col("_rows_before") + F.row_number().over(inside) - 1).alias("_row"), "_total",
    )
    cuts = placed.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((2 * _start + size) * {shards}) div (2 * _total)")).cast("int"))
    first = cuts.groupBy("shard").agg(F.min("_row").alias("_first"))
    return cuts.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"))  # one row for each shard


def query(spark, sf_dir: str) -> DataFrame:
    found = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no crc32, so the checksum is folded over the bytes, half a byte at a time. The 16 steps are fixed values of the IEEE polynomial.
NIBBLES = [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]


def _half(x: str) -> str:
    return f"xor(({x}) // 16, {NIBBLES}[(({x}) % 16 + 1)::BIGINT]::UBIGINT)"


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes."""
    found = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: ('0x' || p)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {found}), lambda a, b: {_half(_half('xor(a, b)'))}), 4294967295::UBIGINT)::BIGINT"


ORACLE = f"""
WITH s AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
p AS (SELECT *, sum(size) OVER w - size AS start, sum(size) OVER () AS total, row_number() OVER w AS n FROM s
  WINDOW w AS (ORDER BY doc_id NULLS LAST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, least(39, ((2 * start + size) * 40) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM c
"""
