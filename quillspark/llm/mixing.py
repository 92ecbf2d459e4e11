"""Operator 8, mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Targets: each source has a weight; a share of all words is divided by weight; no source gets more than a limit
   times its own size, and what it cannot take is divided again (solved at once, by sorting sources by size / weight).
2. Blocks: the documents of a source are shuffled (by the md5 of their id) and laid end to end; each run of
   BLOCK words is a block.
3. Schedule: slot i of 2^m maps, by the van der Corput sequence (the bits of i reversed), through the cumulative block
   counts to a source; slots past the last source are skipped. The sequence of length 2^m hits each of its 2^m cells
   exactly once, so each source gets exactly the blocks that it needs, evenly spread over the schedule.
4. Slots are ranked per source; rank r stands for block r modulo the source's blocks, of pass r div blocks; the last
   block is cut at the target. Joined to the documents' blocks this gives the words that each document gives.

All running sums and ranks are in two levels (see shared.running), so no task holds all rows of a hot source.

Defined results: a null text has no words; a source of null comes last; documents without words give none; an empty
table gives an empty result; repeated rows each have a place of their own; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import WORD, cut, running

#: Words of a block; a source's shuffle is dealt to 4096 buckets by the first three digits of the md5.
BLOCK = 256
DIGITS = 3
#: Slots that one row is unrolled into at a time.
CHUNK = 65536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: int = 2) -> DataFrame:
    """One row per source: sid (0 from the first by code point, null last), source, source_size, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    by = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), "sid")
    all_of = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.withColumns({
        "_level": (F.sum("source_size").over(all_of) * share - limit * F.coalesce(F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)),
        "_cap": limit * F.col("source_size") / F.col("_w"),
        "_n": F.row_number().over(by),
    }).withColumn("_level", F.min_by(F.when(F.col("_level") <= F.col("_cap"), F.col("_level")), F.when(F.col("_level") <= F.col("_cap"), F.col("_n"))).over(all_of))
    target = F.least(limit * F.col("source_size").cast("double"), F.coalesce(F.col("_level") * F.col("_w"), limit * F.col("source_size").cast("double")))
    return filled.select("sid", "source", "source_size", F.round(target, 6).alias("target"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per slot in use: slot (its place in the mix), sid, rank, pass, block, words (that it takes of the block)."""
    goal = F.round("target").cast("long")
    sized = targets.select(
        "sid", "source_size", goal.alias("_goal"), F.ceil(F.col("source_size") / block).cast("long").alias("_blocks"),
    ).withColumn("_need", F.when(F.col("_goal") <= F.col("source_size"), F.ceil(F.col("_goal") / block)).otherwise(F.col("_blocks") + F.ceil((F.col("_goal") - F.col("source_size")) / block)).cast("long"))
    by = Window.orderBy("sid")
    ranged = sized.withColumns({"_from": F.sum("_need").over(by) - F.col("_need"), "_all": F.sum("_need").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    ranged = ranged.filter("_need > 0").withColumn("_bits", F.greatest(F.lit(1), F.length(F.bin(F.col("_all") - 1))))
    chunks = ranged.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (_need - 1) div {CHUNK})"))).repartition("sid", "_chunk")
    cells = chunks.withColumn("_cell", F.explode(F.expr(f"sequence(_from + _chunk * {CHUNK}, _from + least(_need, (_chunk + 1) * {CHUNK}) - 1)")))
    slots = cells.withColumn("slot", F.conv(F.reverse(F.lpad(F.bin("_cell"), F.col("_bits"), F.lit("0"))), 2, 10).cast("long"))
    slots = slots.withColumns({"_bucket": F.expr("shiftright(slot, greatest(_bits - 12, 0))"), "_one": F.lit(1)})
    ranked = running(slots, ["sid"], "_bucket", [F.col("slot")], {"rank": "_one"})
    placed = ranked.withColumns({"pass": F.expr("rank div _blocks"), "block": F.expr("rank % _blocks")})
    words = F.expr(f"least({block}, source_size - block * {block}, _goal - pass * source_size - block * {block})")
    return placed.select("slot", "sid", "rank", "pass", "block", words.alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: int = 2, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per document."""
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mixing")
    targets = cut(source_targets(sized, weights, share, limit), "mixing-targets")
    keyed = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keyed = keyed.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_bucket", F.substring("_key", 1, DIGITS))
    laid = cut(running(keyed, ["sid"], "_bucket", [F.col("_key"), F.col("doc_id"), F.col("size")], {"_start": "size"}), "mixing-laid")
    parts = laid.filter("size > 0").select("sid", "_start", "size", F.explode(F.expr(f"sequence(_start div {block}, (_start + size - 1) div {block})")).alias("block"))
    used = schedule(targets, block).groupBy("sid", "block").agg(F.collect_list("words").alias("_words"))  # a block is used limit times at most
    give = F.expr(f"aggregate(_words, 0L, (n, w) -> n + greatest(0L, least(_start + size, block * {block} + w) - greatest(_start, block * {block})))")
    # Unrolled rows are planned as if they were as few as the rows that they come from; without the hints they would be broadcast.
    taken = parts.join(used.hint("merge"), ["sid", "block"]).groupBy("sid", "_start").agg(F.sum(give).alias("_taken"))
    out = laid.join(taken.hint("merge"), (laid["sid"] == taken["sid"]) & (laid["_start"] == taken["_start"]) & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s),
l AS (SELECT *, row_number() OVER o AS n, 2 * source_size / w AS cap,
  ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - 2 * (sum(source_size) OVER o - source_size)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
  FROM r WINDOW o AS (ORDER BY source_size / w, sid ROWS UNBOUNDED PRECEDING)),
v AS (SELECT arg_min(level, n) FILTER (WHERE level <= cap) AS level FROM l),
t AS (SELECT source, source_size, round(least(2.0::DOUBLE * source_size, coalesce(v.level * w, 2.0::DOUBLE * source_size)), 6) AS target FROM l, v),
p AS (SELECT d.*, t.source_size, t.target, round(t.target)::BIGINT AS goal, (sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (goal // source_size) * size + greatest(0, least(stop, goal % source_size) - (stop - size)) END::BIGINT AS taken FROM p
"""
