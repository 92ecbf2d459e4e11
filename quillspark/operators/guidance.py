"""Smaller rules: health lights, orientation snapshots, guesses of kinds, identities, save messages, payload complexity, artifact plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.text import slug


def clean_metadata_elements(text: Column) -> Column:
    """Markup without the bodies of tool elements, of metadata elements with a provenance value, and without data-ai attributes."""
    tool = rf"(?is)<([\w:.-]*{rules.ORDINARY_TOOL}[\w:.-]*)\b([^>]*)>.*?</\1>"
    told = rf"(?is)<([\w:.-]*{rules.FIELD}[\w:.-]*)\b(?=[^>]*>(?:(?!</\1>).)*?{rules.PROVENANCE}|[^>]*{rules.PROVENANCE})([^>]*)>.*?</\1>"
    own = rf"(?is)<([\w:.-]*{rules.PROVENANCE}[\w:.-]*)\b([^>]*)>.*?</\1>"
    out = text
    for pattern in (tool, told, own):
        out = F.regexp_replace(out, pattern, "<$1$2></$1>")
    return F.regexp_replace(out, r"""(?i)\sdata-ai[\w:.-]*=(?:"[^"]*"|'[^']*')""", "")


def artifact_plans(df: DataFrame, path: str = "rel_path") -> DataFrame:
    """Output path of each cleaned copy, and whether another source would write there too (case aside)."""
    stem, ext = F.regexp_replace(path, r"\.[^./]*$", ""), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    planned = df.withColumn("output", F.concat(F.lit("cleaned/"), stem, F.lit("-cleaned"), F.lower(ext)))
    return planned.withColumn("conflict", F.count("*").over(Window.partitionBy(F.lower("output"))) > 1)


def action_outcome(actionable: Column, applied: Column, residual: Column) -> Column:
    return F.when(~actionable, "not_actionable").when(~applied, "planned").when(residual > 0, "residual").otherwise("removed_verified")


def safe_apply(df: DataFrame) -> DataFrame:
    """What a safe run does with each candidate (command, lane, requested, found): ran, ready, skipped, suggested, agent_candidate or manual_gate."""
    kind = F.when(F.col("lane") == "manual-gated", "manual_gate").when(F.col("lane").isin("agent-ready", "agent-or-local"), "agent_candidate").when(F.col("lane") == "read-only", "suggested").when(~F.col("found"), "skipped").when(F.col("requested"), "ran").otherwise("ready")
    return df.withColumn("kind", kind)


def style_record_errors(r: Column) -> Column:
    """Faults of a remote style record (struct): counts and measures not negative, shares at most 1, a known band; short texts carry no measures."""
    share = lambda n: F.when(~F.coalesce(r[n].between(0, 1), F.lit(False)), n)
    positive = lambda n: F.when(~F.coalesce(r[n] >= 0, F.lit(False)), n)
    full = F.array_compact(F.array(positive("word_count"), positive("sentence_count"), positive("burstiness_cv"), share("lexical_diversity"), positive("ai_ngram_density"), share("score"), F.when(~F.coalesce(r["band"].isin("CLEAN", "LOW", "MEDIUM", "HIGH"), F.lit(False)), "band")))
    return F.when(r["status"] == "insufficient_length", F.array_compact(F.array(positive("word_count")))).when(r["status"] == "ok", full).otherwise(F.array(F.lit("status")))


def suspicious(total: Column, score: Column) -> Column:
    return (F.coalesce(total, F.lit(0)) > 0) | (F.coalesce(score, F.lit(0.0)) >= 0.65)


def health_lights(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A light per check (red condition, yellow condition), and the worst of them."""
    lights = {n: F.when(red, "red").when(yellow, "yellow").otherwise("green") for n, (red, yellow) in checks.items()}
    out = df.withColumns(lights)
    held = F.array(*(F.col(n) for n in lights))
    return out.withColumn("worst", F.when(F.array_contains(held, "red"), "red").when(F.array_contains(held, "yellow"), "yellow").otherwise("green"))


def severity_tally(df: DataFrame, by: str) -> DataFrame:
    s = F.upper("severity")
    return df.groupBy(by).agg(*(F.count_if(s == k).alias(k.lower()) for k in ("DRIFT", "WARNING", "INFO")))


def save_message(command: Column, unit: Column) -> Column:
    """Message of a save by the last command; ordered cases."""
    u = F.coalesce(F.concat(F.lit(" unit "), unit.cast("string")), F.lit(""))
    return F.when(command == "draft", F.concat(F.lit("Draft"), u)).when(command == "plan", F.concat(F.lit("Plan"), u)).when(command == "editor-review", F.concat(F.lit("Review"), u)).when(command == "translate", F.concat(F.lit("Translate"), u)).when(command == "export", F.lit("Export")).when(command.isNull(), F.lit("Checkpoint")).otherwise(F.concat(F.lit("Work: "), command))


def snapshot(log: DataFrame, part: str, order: str, n: int = 5) -> DataFrame:
    """The last n log rows of each part as one text (newest first), failures among them, and the last command."""
    w = Window.partitionBy(part).orderBy(F.desc(order))
    last = log.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n)
    return last.groupBy(part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "command"))), lambda x: x["command"]), " < ").alias("recent"), F.count_if(F.col("outcome") != "ok").alias("failed"), F.min_by("command", "_n").alias("last_command"))


def identity(df: DataFrame, title: list[str], author: list[str], lang: list[str]) -> DataFrame:
    """Title, author, language and slug by the first value that is there."""
    first = lambda cols, other: F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cols), F.lit(other))
    out = df.withColumns({"title": first(title, "Untitled"), "author": first(author, "Unknown"), "language": F.lower(first(lang, "en"))})
    return out.withColumn("slug", slug(F.col("title")))


def guess_work_type(text: Column) -> Column:
    """Kind of a work by its marks."""
    n = lambda p: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p))
    return F.when(n(r"(?m)^(?:INT|EXT)\. ") > 0, "screenplay").when(n(r"(?m)^\d+:\d+ ") >= 3, "scripture").when(n(r"(?im)^(?:abstract|references)\b") >= 2, "paper").when(n(r"(?m)^```") >= 2, "technical").when(n(r"(?im)^#+ chapter\b") > 0, "novel").otherwise("prose")


def arc_type(units: Column, marks: Column) -> Column:
    """Arc by the first rule that fits the number of units and the marks (array) found."""
    has = lambda m: F.array_contains(marks, m)
    return F.when(units <= 1, "single").when(has("cycle"), "cyclical").when(has("journey") & (units >= 12), "journey").when(has("mystery"), "mystery").when(units >= 9, "five_act").otherwise("three_act")


def snippets(df: DataFrame, term: str, id_col: str, text: str, around: int = 20) -> DataFrame:
    """First place of a term in each document (from 0), with the text around it."""
    at = F.instr(F.lower(text), term.lower())
    return df.filter(at > 0).select(id_col, (at - 1).cast("long").alias("at"), F.substring(text, F.greatest(F.lit(1), at - around), at - F.greatest(F.lit(1), at - around) + len(term) + around).alias("snippet"))


def track_lookup(tracks: DataFrame, label: str) -> DataFrame:
    """Tracks of a label (case aside); merged ones have no ahead and behind counts."""
    live = F.col("status") != "merged"
    return tracks.filter(F.lower("label") == label.lower()).withColumns({"ahead": F.when(live, F.col("ahead")), "behind": F.when(live, F.col("behind"))})


def proposal_tally(decisions: DataFrame, responses: DataFrame) -> DataFrame:
    """Passages per decision and response (a passage without either is open)."""
    j = decisions.select("passage", "decision").join(responses.select("passage", "response"), "passage", "full_outer")
    return j.groupBy(F.coalesce("decision", F.lit("open")).alias("decision"), F.coalesce("response", F.lit("open")).alias("response")).agg(F.count("*").alias("n"))


def rewrite_refs(text: Column, forms: dict[str, str], prefix: str = "cmd") -> Column:
    """Command references /prefix:a:b in a text in another form; forms: kind -> replacement with $1 (dashes for colons)."""
    flat = F.regexp_replace(text, rf"/{prefix}:([a-z0-9-]+):([a-z0-9-]+)", rf"/{prefix}:$1-$2")
    return F.regexp_replace(flat, rf"/{prefix}:([a-z0-9-]+)", forms.get("flat", "/$1"))
