"""Drift between recorded and derived state, staleness, history logs, sessions and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG = r"^(\S+) \| ([^|]+?) \| (.*?)(?: \| )?outcome=(\S+)\s*$"


def recorded_vs_derived(recorded: DataFrame, derived: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Rows whose recorded value is off by more than the tolerance, or that one side lacks."""
    j = recorded.select(key, "recorded").join(derived.select(key, "derived"), key, "full_outer")
    delta = F.col("derived") - F.col("recorded")
    return j.withColumn("delta", delta).filter(F.col("delta").isNull() | (F.abs("delta") > tolerance))


def stale(derived: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """State of a derived surface (key, at) against its newest source (key, at, name): missing, stale (strictly older) or fresh."""
    newest = sources.groupBy(key).agg(F.max("at").alias("source_at"), F.max_by("name", F.struct("at", "name")).alias("cause"))
    j = derived.select(key, F.col("at").alias("derived_at")).join(newest, key, "full_outer")
    state = F.when(F.col("derived_at").isNull(), "missing").when(F.col("derived_at") < F.col("source_at"), "stale").otherwise("fresh")
    return j.withColumn("state", state)


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """ts, command, fields, outcome of log lines; malformed ones are null there."""
    get = lambda n: F.nullif(F.regexp_extract(line, LOG, n), F.lit(""))
    ok = F.col(line).rlike(LOG)
    return lines.withColumns({"ts": get(1).try_cast("timestamp"), "command": get(2), "fields": F.when(ok, F.str_to_map(F.regexp_replace(get(3), r" \| ", "|"), F.lit(r"\|"), F.lit("="))), "outcome": get(4), "malformed": ~ok})


def last_rows(df: DataFrame, part: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(part).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def sessions(df: DataFrame, part: str, order: list[str], marker: Column) -> DataFrame:
    """Sessions begin after each marker row: number, first and last time, rows and markers."""
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = df.withColumn("session", F.coalesce(F.sum(F.when(marker, 1).otherwise(0)).over(w), F.lit(0)))
    return numbered.groupBy(part, "session").agg(F.min(order[0]).alias("started"), F.max(order[0]).alias("ended"), F.count("*").alias("actions"))


def session_gaps(df: DataFrame, part: str, days: int = 7) -> DataFrame:
    """Sessions (part, session, started, ended) that start more than so many days after the one before."""
    prev = F.lag("ended").over(Window.partitionBy(part).orderBy("session"))
    return df.withColumn("days", F.datediff("started", prev)).filter(F.col("days") > days)


def compare_units(before: DataFrame, after: DataFrame, keys: list[str], text: str = "text", most: int = 10) -> DataFrame:
    """Changes by place (white space ignored) and their number per first key; the first so many are given."""
    norm = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    a, b = before.select(*keys, norm.alias("_a")), after.select(*keys, norm.alias("_b"))
    j = a.join(b, keys, "full_outer")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    w = Window.partitionBy(keys[0])
    return j.withColumn("kind", kind).filter("kind IS NOT NULL").withColumns({"changes": F.count("*").over(w), "n": F.row_number().over(w.orderBy(*keys[1:]))}).filter(F.col("n") <= most).drop("_a", "_b", "n")


def stage_buckets(units: DataFrame, key: str) -> DataFrame:
    """First incomplete stage of planned, drafted, reviewed, submitted per unit, and its bucket."""
    order = ["planned", "drafted", "reviewed", "submitted"]
    first = F.coalesce(*(F.when(~F.coalesce(F.col(c), F.lit(False)), c) for c in order), F.lit("complete"))
    bucket = F.when(F.col("submitted") | F.col("reviewed"), "done").when(F.col("planned") | F.col("drafted"), "in_progress").otherwise("untouched")
    return units.select(key, first.alias("next_stage"), bucket.alias("bucket"))


def worst_verdict(findings: DataFrame, by: str, ranks: list[tuple[str, str]]) -> DataFrame:
    """Verdict per group from the worst severity; ranks: (severity, verdict) from worst to least."""
    rank = F.coalesce(*(F.when(F.col("severity") == s, n) for n, (s, _) in enumerate(ranks)), F.lit(len(ranks)))
    return findings.groupBy(by).agg(F.element_at(F.array(*(F.lit(v) for _, v in ranks), F.lit("none")), F.min(rank) + 1).alias("verdict"))


def unregistered_names(df: DataFrame, known: DataFrame, id_col: str, text: str, least: int = 3) -> DataFrame:
    """Capitalised words inside sentences that no registry (column name) holds, in at least so many documents."""
    each = df.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<=[\p{Ll},] )(\p{Lu}\p{Ll}{2,})"), F.lit(1)))).alias("name"))
    return each.groupBy("name").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least).join(known.select("name").distinct(), "name", "left_anti")


def conflict_markers(df: DataFrame, id_col: str, text: str) -> DataFrame:
    each = df.filter(F.col(text).rlike(r"(?m)^(<<<<<<<|=======|>>>>>>>)")).select(id_col, F.posexplode(F.split(text, "\n")).alias("n", "s"))
    return each.filter(F.col("s").rlike("^(<<<<<<<|=======|>>>>>>>)")).select(id_col, (F.col("n") + 1).alias("line"), F.substring("s", 1, 7).alias("marker"))


def newest_not_undone(saves: DataFrame, undone: DataFrame, part: str) -> DataFrame:
    """Newest save (part, hash, ts) that was not undone (part, hash)."""
    return saves.join(undone.select(part, "hash").distinct(), [part, "hash"], "left_anti").groupBy(part).agg(F.max_by("hash", F.struct("ts", "hash")).alias("hash"), F.max("ts").alias("ts"))
