"""Overlaps of intervals, such as byte ranges of a file, without comparing pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.ranges import RANGES, _equal, with_range


def overlapping(df: DataFrame, by: list[str], start: str, end: str, ranges: int = RANGES) -> DataFrame:
    """df with overlaps: whether a row's half-open interval [start, end) shares a place with that of another row of its group; ends that touch don't.

    A sweep: in the order of beginnings an interval meets an earlier one if the greatest end so far lies behind its
    beginning, and a later one if the next beginning lies before its end. Empty, backward and null intervals overlap nothing. Groups are cut
    into ranges of position, whose greatest ends and first beginnings are carried across in a window over groups x ranges
    rows, so a group that holds most of the table is worked on in parts; repeated rows overlap each other.
    """
    real = F.coalesce(F.col(start) < F.col(end), F.lit(False))
    ranged = with_range(df.withColumn("_real", real), [start], ranges=ranges)
    at = [*by, "_range"]
    totals = ranged.filter("_real").groupBy(*at).agg(F.max(end).alias("_most"), F.min(start).alias("_least"))
    along = Window.partitionBy(*by).orderBy("_range")
    borders = totals.select(*(F.col(c).alias(f"_k_{c}") for c in at), F.max("_most").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.lead("_least").over(along).alias("_after"))
    inside = Window.partitionBy(*at, "_real").orderBy(start, end)
    before = F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    after = F.coalesce(F.lead(start).over(inside), F.col("_after"))
    joined = ranged.join(borders, _equal(at), "left")
    hit = F.coalesce(before > F.col(start), F.lit(False)) | F.coalesce(after < F.col(end), F.lit(False))
    return joined.withColumn("overlaps", F.col("_real") & hit).drop("_before", "_after", "_real", "_range", *(f"_k_{c}" for c in at))
