"""Threads, themes, relations, timelines, lineages, references and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def thread_gaps(df: DataFrame, thread: str, unit: str, least: int = 3) -> DataFrame:
    """Dormant stretches: at least so many units between two appearances of a thread."""
    once = df.select(thread, unit).distinct()
    nxt = once.withColumn("next_unit", F.lead(unit).over(Window.partitionBy(thread).orderBy(unit)))
    return nxt.withColumn("gap", F.col("next_unit") - F.col(unit) - 1).filter(F.col("gap") >= least)


def thread_matrix(df: DataFrame, thread: str, unit: str, units: list) -> DataFrame:
    """Presence of each thread in the listed units, as columns u<unit>."""
    p = df.groupBy(thread).pivot(unit, units).agg(F.count(F.lit(1)))
    return p.select(thread, *(F.coalesce(F.col(str(u)), F.lit(0)).alias(f"u{u}") for u in units))


def thread_shape(df: DataFrame, thread: str, unit: str) -> DataFrame:
    """Units per thread, strength (5 and more, 2 to 4, 1), whether it dangles and whether it reaches the last unit."""
    g = df.groupBy(thread).agg(F.count_distinct(unit).alias("units"), F.min(unit).alias("first"), F.max(unit).alias("last"))
    end = df.agg(F.max(unit)).first()[0]
    strength = F.when(F.col("units") >= 5, "dominant").when(F.col("units") >= 2, "recurring").otherwise("single")
    return g.withColumns({"strength": strength, "dangling": F.col("units") <= 2, "reaches_end": F.col("last") == F.lit(end)})


def convergence(df: DataFrame, thread: str, unit: str) -> DataFrame:
    return df.groupBy(unit).agg(F.count_distinct(thread).alias("threads")).filter("threads >= 2").withColumn("dense", F.col("threads") >= 3)


def pair_matrix(cast: DataFrame, edges: DataFrame, group: str, name: str) -> DataFrame:
    """All unordered pairs of a group's names (a cast is short): described, none, or undefined. edges: group, a, b, kind."""
    a, b = cast.select(group, F.col(name).alias("a")), cast.select(group, F.col(name).alias("b"))
    pairs = a.join(b, group).filter("a < b")
    told = edges.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind").groupBy(group, "a", "b").agg(F.min("kind").alias("kind"))
    state = F.when(F.col("kind").isNull(), "undefined").when(F.col("kind") == "none", "none").otherwise("described")
    return pairs.join(told, [group, "a", "b"], "left").withColumn("state", state)


def timeline_order(df: DataFrame, part: str, story: str, date: str) -> DataFrame:
    """Story and date order of events (undated ones stay in story order), and whether they differ."""
    by_story = F.row_number().over(Window.partitionBy(part).orderBy(story))
    by_date = F.row_number().over(Window.partitionBy(part).orderBy(F.col(date).asc_nulls_last(), F.col(story)))
    return df.withColumns({"story_pos": by_story, "date_pos": by_date}).withColumn("moved", F.col("story_pos") != F.col("date_pos"))


def chronology_conflicts(df: DataFrame, part: str, order: str, date: str) -> DataFrame:
    """Entries dated before the entry that they follow."""
    prev = F.lag(date).over(Window.partitionBy(part).orderBy(order))
    return df.withColumn("previous", prev).filter(F.col("previous") > F.col(date))


def descendants(edges: DataFrame, roots: DataFrame, most: int = 64) -> DataFrame:
    """(root, node, depth) reachable from roots (column node) over edges (parent, child), nearest depth; rounds end when nothing is new."""
    found = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    front = found
    for depth in range(1, most + 1):
        front = front.join(edges.select(F.col("parent").alias("node"), F.col("child").alias("_c")), "node").select("root", F.col("_c").alias("node")).distinct().join(found, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def contradictions(df: DataFrame, child: str, parent: str, kind: str) -> DataFrame:
    return df.groupBy(child, kind).agg(F.count_distinct(parent).alias("parents")).filter("parents > 1")


def reference_density(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.groupBy(src, dst).agg(F.count("*").alias("n"))


def numbering_faults(df: DataFrame, part: str, number: str) -> DataFrame:
    """Missing stretches and repeats of a numbering."""
    g = df.groupBy(part, number).agg(F.count("*").alias("n"))
    nxt = F.lead(number).over(Window.partitionBy(part).orderBy(number))
    steps = g.withColumn("next_number", nxt)
    gaps = steps.filter(F.col("next_number") - F.col(number) > 1).select(part, F.lit("missing").alias("kind"), (F.col(number) + 1).alias("first"), (F.col("next_number") - 1).alias("last"))
    return gaps.unionByName(g.filter("n > 1").select(part, F.lit("duplicate").alias("kind"), F.col(number).alias("first"), F.col(number).alias("last")))


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left_only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right_only")))


def dangling_references(refs: DataFrame, targets: DataFrame, ref: str, key: str) -> DataFrame:
    return refs.join(targets.select(F.col(key).alias("_k")).distinct(), F.col(ref) == F.col("_k"), "left_anti")


def confirmed_rank(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Strongest statement per pair: confirmed over implied over undefined (column state)."""
    rank = F.when(F.col("state") == "confirmed", 0).when(F.col("state") == "implied", 1).otherwise(2)
    return facts.groupBy(*keys).agg(F.element_at(F.array(F.lit("confirmed"), F.lit("implied"), F.lit("undefined")), F.min(rank) + 1).alias("state"))
