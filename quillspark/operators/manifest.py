"""Manifests of tables: an order-free digest of a multiset of rows, the comparison of two runs, and publication in two phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of a row's hash that make its number: 60 bits, which a long holds.
DIGITS = 15


def row_number_of(cols: list[str]) -> Column:
    """A row's number: the first DIGITS of the md5 of its values, each with its length, nulls apart from all of them."""
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.conv(F.substring(F.md5(F.concat_ws("|", *map(part, cols))), 1, DIGITS), 16, 10).cast("long")


def multiset_digest(df: DataFrame, by: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """rows, row_sum and row_xor of the rows' numbers (per group of by): equal for equal multisets, whatever their order and partitions.

    A changed, added or lost row changes the sum; two rows that repeat each other leave the xor but not the count. Sums of
    parts add up, xors of parts combine, so digests of days or shards merge. Columns count by their text.
    """
    numbered = df.withColumn("_n", row_number_of(cols or sorted(c for c in df.columns if c not in (by or []))))
    return numbered.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("_n").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("row_sum"), F.coalesce(F.bit_xor("_n"), F.lit(0)).cast("long").alias("row_xor"))


def merged(digests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Digests of parts as the digest of the whole."""
    return digests.groupBy(*(by or [])).agg(F.sum("rows").alias("rows"), F.sum("row_sum").cast("decimal(38,0)").alias("row_sum"), F.bit_xor("row_xor").alias("row_xor"))


def same_rows(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """Each group of two runs (digests with by) that differs: only_first, only_second or changed."""
    a = first.select(*by, F.struct("rows", "row_sum", "row_xor").alias("a"))
    b = second.select(*(F.col(c).alias(f"_{c}") for c in by), F.struct("rows", "row_sum", "row_xor").alias("b"))
    joined = a.join(b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "full_outer")
    told = F.when(F.col("b").isNull(), "only_first").when(F.col("a").isNull(), "only_second").when(F.col("a") != F.col("b"), "changed")
    return joined.withColumn("difference", told).filter("difference IS NOT NULL").select(*(F.coalesce(c, f"_{c}").alias(c) for c in by), "difference")


class NotPublished(Exception):
    """The staged rows are not the planned ones; nothing was published."""


def publish(df: DataFrame, path: str, run: str) -> DataFrame:
    """Write df below path and make it the published state in two phases; returns the rows as published.

    Phase 1 stages the rows in a folder of the run (over what an earlier, lost try of it left) and reads them back: their
    digest must be that of df. Phase 2 adds one row to the manifests. A reader sees the last run with a manifest, so a try
    that dies in phase 1 or before the end of phase 2 shows nothing, and a run published twice shows the same rows once.
    df must give the same rows when it is worked out twice.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}/runs/{run}"
    df.write.mode("overwrite").parquet(staged)
    back = spark.read.schema(df.schema).parquet(staged)
    planned, found = (tuple(multiset_digest(x).first()) for x in (df, back))
    if planned != found:
        raise NotPublished(f"run {run}: {found[0]} rows staged, {planned[0]} planned")
    done = _manifests(spark, path)
    if done is None or done.filter(F.col("run") == run).isEmpty():
        number = 0 if done is None else done.agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0] + 1
        spark.createDataFrame([(run, number, *found)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifests")
    return back


MANIFEST = "run string, number long, rows long, row_sum decimal(38,0), row_xor long"


def _manifests(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifests")
    except AnalysisException:  # nothing was published yet
        return None


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the last published run; null if there is none."""
    found = _manifests(spark, path)
    last = found and found.orderBy(F.desc("number"), F.desc("run")).first()
    return spark.read.parquet(f"{path.rstrip('/')}/runs/{last['run']}") if last else None
