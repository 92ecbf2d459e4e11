"""Progress and review tables: pipeline position, ledger roll-ups, save history, themes, traditions, ages, glossaries, settings, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.operators import records

# The stages of a work, and what a save's message becomes in the history (first match wins).
STAGES = ["seed", "voice", "outline", "discuss", "plan", "draft", "review", "revise", "publish", "translate"]
SAVES = [
    (r"^Saved after drafting (.*)$", "Drafted $1"), (r"^Saved after editor review of (.*)$", "Reviewed $1"), (r"^Saved after revising (.*)$", "Revised $1"), (r"^Saved after planning (.*)$", "Planned $1"),
    (r"^Saved after discussing (.*)$", "Discussed $1"), (r"^Saved work in progress on (.*)$", "Work in progress on $1"), (r"^Saved: (.*)$", "$1"), (r"^Initial save of (.*)$", "Started $1"),
]
SEVERITY = {"high": 3, "medium": 2, "low": 1}
SETTINGS_DEFAULTS = {"scope": "global", "install_mode": "interactive", "profile": "full"}


def pipeline_position(df: DataFrame, key: str, done: dict[str, Column], translated: bool = True) -> DataFrame:
    """Each project's first incomplete stage: index (from 1), stage and track, that stage in brackets; null if all are done.

    done: stage -> whether it is complete (null: not). A missing translation is no incomplete stage of a project without target languages.
    """
    open_ = [F.when(~F.coalesce(done[s], F.lit(False)), k) for k, s in enumerate(STAGES, 1) if translated or s != "translate"]
    at = F.array_min(F.array_compact(F.array(*open_)))
    track = F.concat_ws(" > ", *(F.when(F.col("index") == k, f"[{s}]").otherwise(s) for k, s in enumerate(STAGES, 1)))
    return df.select(key, at.alias("index")).select(key, "index", F.get(F.array(*map(F.lit, STAGES)), F.col("index") - 1).alias("stage"), track.alias("track"))


def ledger_rollup(units: DataFrame, levels: list[str], bucket: str, words: str) -> DataFrame:
    """Units, done, in progress and words of each group of levels, of all outer ones and in total; level: how many are summed over; heading as the ledger has it."""
    n = lambda v: F.count_if(F.col(bucket) == v)
    out = units.rollup(*levels).agg(F.count("*").alias("units"), n("done").alias("done"), n("in progress").alias("in_progress"), F.coalesce(F.sum(words), F.lit(0)).alias("words"), F.bit_count(F.grouping_id()).cast("long").alias("level"))
    more = F.when(F.col("in_progress") > 0, F.concat(F.lit(", "), "in_progress", F.lit(" in progress"))).otherwise("")
    return out.withColumn("heading", F.concat(F.lit("("), "done", F.lit("/"), "units", F.lit(" done"), more, F.lit(")")))


def save_history(log: DataFrame, part: str, order: list[str], message: str, limit: int = 20) -> DataFrame:
    """The last saves of each part, newest first: n, action. Commits that are no saves (tracks, proposals, merges) are left out before the limit."""
    action = F.col(message)
    told = F.lit(None).cast("string")
    for pattern, new in reversed(SAVES):
        told = F.when(action.rlike(pattern), F.regexp_replace(action, pattern, new)).otherwise(told)
    saves = log.filter(action.rlike("^(Saved|Initial save)")).withColumn("action", F.coalesce(told, action))
    return saves.withColumn("n", F.row_number().over(Window.partitionBy(part).orderBy(*(F.desc(c) for c in order)))).filter(F.col("n") <= limit).select(part, "n", *order, "action")


def theme_strength(themes: DataFrame, units: DataFrame, mentions: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """(part, theme, units, strength) of every theme (part, theme), dormant ones too; and the units (part, unit) without any theme.

    mentions: part, unit, theme, repeats allowed; those of unlisted themes don't count.
    """
    known = mentions.join(themes.select(part, "theme").distinct(), [part, "theme"], "left_semi").select(part, "unit", "theme").distinct()
    counted = known.groupBy(part, "theme").agg(F.count("*").alias("units"))
    strength = F.lit(rules.THEME_BANDS[-1][0])
    for name, least in reversed(rules.THEME_BANDS[:-1]):
        strength = F.when(F.col("units") >= least, name).otherwise(strength)
    every = themes.select(part, "theme").distinct().join(counted, [part, "theme"], "left").withColumn("units", F.coalesce("units", F.lit(0).cast("long")))
    return every.withColumn("strength", strength), units.select(part, "unit").distinct().join(known.select(part, "unit").distinct(), [part, "unit"], "left_anti")


def annotation_counts(notes: DataFrame, tradition: str, passage: str) -> DataFrame:
    """Annotated passages and annotations of each tradition."""
    return notes.groupBy(tradition, passage).agg(F.count("*").alias("n")).groupBy(tradition).agg(F.count("*").alias("passages"), F.sum("n").alias("annotations"))


def age_conflicts(mentions: DataFrame, people: DataFrame, person: str, date: str, age: str, born: str, slack: int = 0) -> DataFrame:
    """Mentions whose stated age is not the whole years from the person's birth (within slack): expected, and mentions dated before it."""
    joined = mentions.join(people.select(F.col(person).alias("_p"), F.col(born).alias("_born")), F.col(person) == F.col("_p"))
    years = F.floor(F.months_between(date, "_born") / 12).cast("long")
    return joined.withColumn("expected", years).filter((F.abs(F.col(age) - F.col("expected")) > slack) | (F.col(date) < F.col("_born"))).drop("_p", "_born")


def conflicting_terms(glossary: DataFrame, term: str, translation: str) -> DataFrame:
    """Terms with several translations, or with none: translations (sorted, a term's own few), kind."""
    plain = glossary.select(F.trim(term).alias("term"), F.nullif(F.trim(translation), F.lit("")).alias("_t")).distinct()
    found = plain.groupBy("term").agg(F.count("_t").alias("n"), F.sort_array(F.collect_set("_t")).alias("translations"))
    return found.filter("n <> 1").withColumn("kind", F.when(F.col("n") == 0, "untranslated").otherwise("several")).drop("n")


def severity_report(flags: DataFrame, by: str, category: str, severity: str, least: str = "low", top: int = 3) -> DataFrame:
    """Flags of at least this severity: for each group the totals by severity and its top categories (ties by name)."""
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.lower(severity))
    kept = flags.filter(rank >= SEVERITY[least])
    counted = kept.groupBy(by, category).agg(F.count("*").alias("n"), *(F.count_if(F.lower(severity) == s).alias(s) for s in SEVERITY))
    placed = counted.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), category)))  # a row for each category
    tops = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= top, F.struct("_r", F.col(category).alias("c"))))), lambda x: x["c"]), ", ")
    return placed.groupBy(by).agg(F.sum("n").alias("flags"), *(F.sum(s).alias(s) for s in SEVERITY), tops.alias("top"))


def migrate_settings(json: Column, defaults: dict[str, str] = SETTINGS_DEFAULTS) -> Column:
    """Settings of any age as a map of JSON texts: runtimes from an old runtime, scope, install_mode and profile by default; other fields stay. Null unless it is an object."""
    v = F.try_parse_json(json)
    own = F.transform_values(records.fields(v), lambda _, x: F.to_json(x))
    old = records.text(records.field(v, "runtime"))
    runtimes = F.when(F.length(old) > 0, F.to_json(F.array(old))).otherwise("[]")
    filled = F.create_map(F.lit("runtimes"), runtimes, *(F.lit(x) for k, d in defaults.items() for x in (k, f'"{d}"')))
    missing = F.map_filter(filled, lambda k, _: ~F.map_contains_key(own, k))
    return F.when(own.isNotNull(), F.map_concat(own, missing))


def inventory(commands: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref, skill, category, description, hint) of commands (ref, description, hint) with what a registry (key, category, description) knows, and the skills that several refs share."""
    key = F.regexp_replace("ref", "^/?[a-z]+:", "")
    own = commands.select("ref", F.replace(key, F.lit(":"), F.lit("-")).alias("skill"), F.replace(key, F.lit(":"), F.lit("-")).alias("_key"), F.nullif(F.trim("description"), F.lit("")).alias("_own"), "hint")
    known = registry.select(F.col("key").alias("_key"), F.col("category").alias("_category"), F.col("description").alias("_known"))
    plain = F.regexp_replace(F.regexp_replace("ref", "^/?[a-z]+:", ""), "[:-]", " ")
    joined = own.join(known, "_key", "left").select("ref", "skill", F.coalesce("_category", F.lit("uncategorized")).alias("category"), F.coalesce("_own", "_known", plain).alias("description"), "hint")
    return joined, joined.groupBy("skill").agg(F.count("*").alias("refs"), F.min("ref").alias("first")).filter("refs > 1")


def voice_harness(scores: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Per fixture: samples, agreeing ones, and ok: whether every sample passes as expected (columns keys and expected_pass)."""
    joined = scores.join(expected, keys)
    return joined.groupBy("fixture_id").agg(F.count("*").alias("samples"), F.count_if(F.col("passed") == F.col("expected_pass")).alias("agreeing"), F.bool_and(F.col("passed") == F.col("expected_pass")).alias("ok"))
