"""Scaffold validation and clean-up, assembly in order, eligibility of matter, and renumbering plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.ranges import running

#: Scaffold marks by kind; template variables in double braces are never flagged.
MARKS = [("fill_in", r"\[Fill in"), ("delete_note", r"\[Delete if not applicable:"), ("alternate", r"^\s*Alternate [12]:"), ("conflict", r"^(?:<<<<<<<|=======|>>>>>>>)")]


def scaffold_markers(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """line and kind of scaffold marks, and of first-level headings after the first."""
    each = df.select(id_col, F.posexplode(F.split(text, "\n")).alias("n", "s"))
    kind = F.coalesce(*(F.when(F.col("s").rlike(p), k) for k, p in MARKS), F.when(F.col("s").rlike(r"^# \S"), "heading"))
    marks = each.withColumn("kind", kind).filter("kind IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy(id_col, "kind").orderBy("n"))
    return marks.withColumn("nth", nth).filter("kind <> 'heading' OR nth > 1").select(id_col, (F.col("n") + 1).cast("long").alias("line"), F.when(F.col("kind") == "heading", "duplicate_heading").otherwise(F.col("kind")).alias("kind"))


def cleanup(text: Column) -> Column:
    """Text without mark lines, alternate blocks (to a blank line, the next alternate or a heading) and later first-level headings.

    One pass over the lines: the state says whether an alternate block is open and whether a heading was seen.
    """
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("alt"), F.lit(False).alias("head"), F.lit(True).alias("first"))

    def step(s, ln):
        alternate, heading, h1, blank = ln.rlike(r"^\s*Alternate [12]:"), ln.rlike(r"^#+ \S"), ln.rlike(r"^# \S"), F.trim(ln) == ""
        inside = alternate | (s["alt"] & ~blank & ~heading)
        drop = inside | ln.rlike(r"\[Fill in|\[Delete if not applicable:") | (h1 & s["head"])
        return F.struct(F.when(drop, s["out"]).otherwise(F.concat(s["out"], F.when(s["first"], F.lit("")).otherwise(F.lit("\n")), ln)).alias("out"), inside.alias("alt"), (s["head"] | h1).alias("head"), (s["first"] & drop).alias("first"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda s: s["out"])


def assemble(parts: DataFrame, key: str, order: list[str], text: str = "text", sep: str = "\n\n") -> DataFrame:
    """One text per key, its parts in order. A key's parts meet in one row, as the result does."""
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_t")))), lambda x: x["_t"]), sep).alias("text"), F.count("*").alias("parts"))


def assembly_order(files: DataFrame, outline: DataFrame) -> DataFrame:
    """Sections in order: front matter by its number, body by the outline, back matter by name; outline units without a draft are missing.

    files: project_id, section (front, body, back), name, unit; outline: project_id, unit, pos.
    """
    body = outline.join(files.filter("section = 'body'").select("project_id", "unit", "name"), ["project_id", "unit"], "left").select("project_id", F.lit(1).alias("rank"), F.col("pos").cast("long").alias("n"), "name", F.col("name").isNull().alias("missing"))
    number = F.coalesce(F.regexp_extract("name", r"^(\d+)", 1).try_cast("long"), F.lit(1 << 40))
    rest = files.filter("section <> 'body'").select("project_id", F.when(F.col("section") == "front", 0).otherwise(2).alias("rank"), F.when(F.col("section") == "front", number).otherwise(0).alias("n"), "name", F.lit(False).alias("missing"))
    return body.unionByName(rest).withColumn("pos", F.row_number().over(Window.partitionBy("project_id").orderBy("rank", "n", F.col("name").asc_nulls_last())))


def eligible_matter(elements: DataFrame, level: str) -> DataFrame:
    """Elements (name, min_level, pos) that a level holds: minimum within balanced within maximum."""
    rank = lambda c: F.when(c == "minimum", 0).when(c == "balanced", 1).otherwise(2)
    return elements.filter(rank(F.col("min_level")) <= rank(F.lit(level)))


def move_unit(units: DataFrame, part: str, pos: str, source: int, to: int) -> DataFrame:
    """Numbers after a unit moves: those between shift by one."""
    p = F.col(pos)
    new = F.when(p == source, to).when((p > source) & (p <= to), p - 1).when((p < source) & (p >= to), p + 1).otherwise(p)
    return units.withColumn("new_pos", new.cast("long")).withColumn("changed", F.col("new_pos") != p)


def insert_units(units: DataFrame, pos: str, at: int, many: int = 1) -> DataFrame:
    """Numbers after so many units come in before the place at: what stands there or later moves on."""
    p = F.col(pos)
    return units.withColumn("new_pos", F.when(p >= at, p + many).otherwise(p).cast("long")).withColumn("changed", F.col("new_pos") != p)


def remove_units(units: DataFrame, pos: str, first: int, last: int) -> DataFrame:
    """Numbers after the units from first to last go: null for them, later ones move up."""
    p = F.col(pos)
    return units.withColumn("new_pos", F.when(p < first, p).when(p > last, p - (last - first + 1)).cast("long")).withColumn("changed", ~F.col("new_pos").eqNullSafe(p))


def merge_units(units: DataFrame, part: str, pos: str, first: int, text: str = "text", rule: str = "\n\n---\n\n") -> DataFrame:
    """Each part's units with first and the one behind it as one text (a rule between them), later ones moved up: part, new_pos, text, merged.

    Only the two units of each part meet; a part without the second keeps its units.
    """
    p = F.col(pos)
    behind = units.filter(p == first + 1).select(F.col(part).alias("_part"), F.col(text).alias("_text"))
    pair = units.filter(p == first).join(behind, F.col(part).eqNullSafe(F.col("_part")), "left")
    joined = pair.select(part, p.cast("long").alias("new_pos"), F.when(F.col("_part").isNull() & F.col("_text").isNull(), F.col(text)).otherwise(F.concat_ws(rule, text, "_text")).alias("text"), F.col("_text").isNotNull().alias("merged"))
    rest = units.filter((p != first) & (p != first + 1)).select(part, F.when(p > first, p - 1).otherwise(p).cast("long").alias("new_pos"), F.col(text).alias("text"), F.lit(False).alias("merged"))
    return joined.unionByName(rest)


def split_point(df: DataFrame, key: str, order: str, share: float) -> DataFrame:
    """The part of a unit with which the share of its words is reached."""
    totals = df.groupBy(F.col(key).alias("_key")).agg(F.sum("words").alias("total"))
    upto = running(df, [key], [order], {"upto": F.col("words")}).join(totals, F.col(key).eqNullSafe(F.col("_key")))
    return upto.filter(F.col("upto") >= share * F.col("total")).groupBy(key).agg(F.min(order).alias("split_at"))


def screenplay_kind(line: Column, before: Column) -> Column:
    """Kind of a screenplay line: heading, transition, character, parenthetical, dialogue, action."""
    return (
        F.when(F.trim(line) == "", "blank").when(line.rlike(r"(?i)^(INT|EXT|EST|INT\./EXT|I/E)[. ]"), "scene_heading").when(line.rlike(r"^[A-Z ]+TO:$"), "transition")
        .when(line.rlike(r"^\(.*\)$"), "parenthetical").when((F.coalesce(F.trim(before), F.lit("")) == "") & line.rlike(r"^[A-Z][A-Z0-9 .'()-]+$"), "character").when(F.trim(F.coalesce(before, F.lit(""))).rlike(r"^[A-Z][A-Z0-9 .'()-]+$|^\(.*\)$"), "dialogue").otherwise("action")
    )
