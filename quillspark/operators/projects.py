"""Project signals, the priority router, the automation plan and the progress ledger, from one table of project files.

project_files: project_id, rel_path, size (bytes), mtime, text. Everything a project needs comes from one grouping by
project_id with conditional aggregates; unit sets are as large as a project has units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.text import contains_any, js_trim, lines, percent, progress_bar, unit_number

AGENT_LANE = ["plan", "draft", "editor-review", "research", "voice-check", "continuity-check", "translate", "back-translate", "beta-reader", "quick-write", "map-manuscript"]
LOCAL_LANE = ["save", "scan", "health", "sync", "validate", "check-notes", "progress", "session-report"]
MANUAL_LANE = ["prepublish-review", "publish", "export", "track merge", "undo"]
CATEGORY_LANE = {
    "core": ("mixed", 3), "navigation": ("read-only", 1), "quality": ("agent-or-local", 3), "character_world": ("local-helper", 2), "structure": ("local-helper", 2), "structure_management": ("manual-gated", 4), "review": ("agent-or-local", 3),
    "illustration": ("local-helper", 2), "publishing": ("manual-gated", 4), "translation": ("agent-or-local", 3), "sacred_exclusive": ("agent-or-local", 3), "utility": ("local-helper", 2), "session": ("local-helper", 2), "collaboration": ("manual-gated", 4),
}


def _under(*folders: str) -> Column:
    return F.col("rel_path").rlike(f"^(?:{'|'.join(folders)})/")


def _ext(*exts: str) -> Column:
    return F.lower(F.regexp_extract("rel_path", r"(\.[^./]*)$", 1)).isin(*exts)


def _is(*paths: str) -> Column:
    return F.col("rel_path").isin(*paths)


def _any(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def _units(c: Column) -> Column:
    return F.sort_array(F.collect_set(c))


def signals(files: DataFrame) -> DataFrame:
    """One row per project with a struct or column per signal: state of plan, reviews, style guide, notes, tracks, publishing, history, context, export, save."""
    f = files.withColumns({"name": F.element_at(F.split("rel_path", "/"), -1), "text": F.coalesce("text", F.lit(""))})
    draft = _under("drafts") & _ext(".md")
    in_plans = F.col("rel_path").rlike("^(?:plans/)?[^/]+$")
    last_line = F.element_at(F.filter(lines(F.col("text")), lambda s: s != ""), -1)
    body = F.filter(F.transform(lines(F.col("text")), js_trim), lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("---"))
    template = F.lit(False)
    for p in rules.STYLE_PLACEHOLDERS:
        template = template | F.col("text").rlike(p)
    config = F.from_json("text", "target_languages array<string>, translation struct<target_languages:array<string>>, translations array<string>, voice struct<calibrated:boolean>", {"mode": "PERMISSIVE"})
    cfg = f.withColumns({"_cfg": F.when(_is("config.json"), config), "_tracks": F.when(_is("tracks.json"), F.from_json("text", "tracks array<struct<status:string>>"))})
    source = draft | _is("STATE.md", "OUTLINE.md", "RECORD.md", "STYLE-GUIDE.md")
    langs = lambda c: F.coalesce(F.size(c), F.lit(0))
    g = cfg.groupBy("project_id").agg(
        _any(_is("STATE.md")).alias("has_state"),
        F.count_if(draft).alias("drafts"),
        _units(F.when(in_plans, unit_number(F.col("name"), r"PLAN\.md"))).alias("planned"),
        _units(F.when(draft, unit_number(F.col("name"), r"DRAFT\.md"))).alias("drafted"),
        _units(F.when(_under("reviews") & _ext(".md", ".txt"), unit_number(F.col("name"), r"(?:REVIEW|EDITOR-NOTES)\.md"))).alias("reviewed"),
        F.count_if(_under("reviews", "reports", "voice", "continuity", "translation") & _ext(".md", ".txt") & contains_any(F.col("text"), rules.REVIEW_KEYWORDS)).alias("review_signals"),
        F.count_if(((_under("notes") & _ext(".md", ".txt")) | _is("NOTES.md", "TODO.md")) & contains_any(F.col("text"), ["TODO", "FIXME", "UNRESOLVED", "QUESTION:", "NOTE:"])).alias("notes_pending"),
        F.count_if(_under("proposals") & _ext(".md")).alias("proposals"),
        F.coalesce(F.max(F.size(F.filter("_tracks.tracks", lambda t: ~F.coalesce(t["status"] == "merged", F.lit(False))))), F.lit(0)).alias("active_tracks"),
        F.max(F.when(_is("STYLE-GUIDE.md"), F.when(template | (F.size(body) < 8), "template").otherwise("filled"))).alias("style"),
        _any(F.col("_cfg.voice.calibrated")).alias("calibrated"),
        (F.count_if(_under("translation")) + F.coalesce(F.max(langs("_cfg.target_languages") + langs("_cfg.translation.target_languages") + langs("_cfg.translations")), F.lit(0))).alias("translations"),
        F.count_if(_under("front-matter") & _ext(".md")).alias("front"), F.count_if(_under("back-matter") & _ext(".md")).alias("back"),
        _any(_is("marketing/BLURB.md", "marketing/blurb.md", "output/blurb.md")).alias("blurb"),
        _any(_is("build/ebook-cover.jpg", "build/ebook-cover.png") | (_under("illustrations/cover") & _ext(".md"))).alias("cover"),
        _any(_is("reviews/PREPUBLISH-REVIEW.md", "PREPUBLISH-REVIEW.md")).alias("prepublish"),
        _any(_is("reviews/PLATFORM-COMPLIANCE.md", "PLATFORM-COMPLIANCE.md")).alias("compliance"),
        _any(_is("HISTORY.log")).alias("has_history"),
        F.coalesce(F.max(F.when(_is("HISTORY.log"), last_line.rlike(r"(?i)\b(fail|failed|error|blocked)\b"))), F.lit(False)).alias("last_failed"),
        F.max(F.when(_is("CONTEXT.md"), F.col("mtime"))).alias("context_at"), F.max(F.when(_is("STATE.md"), F.col("mtime"))).alias("state_at"),
        F.max(F.when(draft, F.col("mtime"))).alias("draft_at"), F.max(F.when(source, F.col("mtime"))).alias("source_at"),
        F.max(F.when(_under("output", "build", "exports"), F.col("mtime"))).alias("output_at"),
        F.array_sort(F.collect_set(F.when(_is(*rules.CORE_FILES), F.col("rel_path")))).alias("core"),
    )
    some = F.col("drafts") > 0
    undrafted, unreviewed = F.array_except("planned", "drafted"), F.array_except("drafted", "reviewed")
    gap = lambda c, name: F.when(some & ~c, name)
    gaps = F.array_compact(F.array(gap(F.col("front") > 0, "front-matter"), gap(F.col("back") > 0, "back-matter"), gap(F.col("blurb"), "blurb"), gap(F.col("cover"), "cover-art")))
    stale_state, stale_draft = F.coalesce(F.col("context_at") < F.col("state_at"), F.lit(False)), F.coalesce(F.col("context_at") < F.col("draft_at"), F.lit(False))
    return g.withColumns({"undrafted": undrafted, "unreviewed": unreviewed, "gaps": gaps, "missing_core": F.array_except(F.array(*map(F.lit, rules.CORE_FILES)), "core")}).withColumns({
        "plan_state": F.when(F.size("planned") == 0, "missing").when(F.size("drafted") == 0, "ready-to-draft").when(F.size("undrafted") > 0, "partially-drafted").otherwise("covered"),
        "review_state": F.when(~some, "none").when(F.size("unreviewed") == F.size("drafted"), "missing").when(F.size("unreviewed") > 0, "partial").otherwise("covered"),
        "style_state": F.when(F.col("style").isNull(), "missing").when(F.col("style") == "template", "template").when(F.col("calibrated"), "calibrated").otherwise("profiled-unverified"),
        "track_state": F.when(F.col("proposals") > 0, "proposal-ready").when(F.col("active_tracks") > 0, "active").otherwise("none"),
        "publishing_state": F.when(F.size("gaps") > 0, "gaps").when(some & ~F.col("prepublish"), "editorial-review-needed").when(some & ~F.col("compliance"), "compliance-needed").when(some, "ready").otherwise("not-started"),
        "context_state": F.when(F.col("context_at").isNull(), "missing").when(stale_state | stale_draft, "stale").otherwise("fresh"),
        "context_suggest": F.when(F.col("context_at").isNull(), "save").when(stale_state, "scan").when(stale_draft, "save"),
        "export_state": F.when(F.col("output_at").isNull(), F.when(F.col("source_at").isNull(), "none").otherwise("missing")).when(F.col("source_at") > F.col("output_at"), "stale").otherwise("fresh"),
        "save_state": F.when(some & ~F.col("has_history"), "unsaved").otherwise("clean"),
        "readiness": F.when(F.size("missing_core") > 0, "incomplete").otherwise("ready"),
    })


def _with_unit(command: str, units: str) -> Column:
    first = F.get(units, F.lit(0))
    return F.when(first > 0, F.concat(F.lit(f"{command} "), first.cast("string"))).otherwise(command)


def route(signals_: DataFrame, has_project: Column | None = None) -> DataFrame:
    """command: the first of the ordered rules that holds, and its number."""
    c = F.col
    chain = [
        (~has_project if has_project is not None else F.lit(False), F.lit("new-work")), (~c("has_state"), F.lit("scan")), (c("last_failed"), F.lit("troubleshoot")),
        (c("context_state") == "stale", F.coalesce("context_suggest", F.lit("scan"))), (c("track_state") == "proposal-ready", F.lit("editor-review --proposal")),
        (c("style_state").isin("missing", "template"), F.lit("profile-writer")), (c("style_state") == "profiled-unverified", F.lit("voice-test")),
        (c("plan_state").isin("ready-to-draft", "partially-drafted"), _with_unit("draft", "undrafted")), (c("review_signals") > 0, F.lit("editor-review")), (c("notes_pending") > 0, F.lit("check-notes")),
        (c("drafts") == 0, F.lit("plan")), (c("review_state").isin("missing", "partial"), _with_unit("editor-review", "unreviewed")), (c("translations") > 0, F.lit("back-translate")),
        ((c("publishing_state") == "gaps") & (c("export_state") == "missing"), F.get("gaps", F.lit(0))), (c("publishing_state") == "editorial-review-needed", F.lit("prepublish-review")),
        (c("publishing_state") == "compliance-needed", F.lit("compliance-check")), (c("export_state").isin("stale", "missing"), F.lit("export")), (c("save_state") != "clean", F.lit("save")),
    ]
    command, number = F.when(*chain[0]), F.when(chain[0][0], 1)
    for n, (cond, value) in enumerate(chain[1:], 2):
        command, number = command.when(cond, value), number.when(cond, n)
    return signals_.withColumns({"command": command.otherwise("next"), "rule": number.otherwise(len(chain) + 1)})


def _keep_first(items: Column) -> Column:
    """Without nulls and later repeats."""
    return F.array_distinct(F.array_compact(items))


def automation(routed: DataFrame) -> DataFrame:
    """mode and the three candidate lists, each command once in the order in which it came up. context_budget is a column if known."""
    c, base = F.col, F.substring_index("command", " ", 1)
    budget = c("context_budget") if "context_budget" in routed.columns else F.lit("ok")
    drafting, reviewing = c("plan_state").isin("ready-to-draft", "partially-drafted"), c("review_state").isin("missing", "partial")
    agents = _keep_first(F.array(F.when(base.isin(AGENT_LANE), c("command")), F.when(drafting, _with_unit("draft", "undrafted")), F.when(reviewing, _with_unit("editor-review", "unreviewed")), F.when(c("translations") > 0, F.lit("back-translate"))))
    local = _keep_first(F.array(F.when(base.isin(LOCAL_LANE), c("command")), F.when(c("context_state") == "stale", F.coalesce("context_suggest", F.lit("scan"))), F.when(budget == "critical", F.lit("thread")).when(budget == "tight", F.lit("save")), F.when(c("notes_pending") > 0, F.lit("check-notes")), F.when(c("save_state") != "clean", F.lit("save"))))
    manual = _keep_first(F.array(F.when(base.isin(MANUAL_LANE), c("command")), F.when(c("publishing_state") == "gaps", F.lit("publish")), F.when(c("publishing_state") == "editorial-review-needed", F.lit("prepublish-review")), F.when(c("track_state") == "proposal-ready", F.lit("editor-review --proposal")).when(c("track_state") == "active", F.lit("track"))))
    mode = F.when(F.array_contains(manual, c("command")), "manual-gated").when(F.size(agents) > 0, "agent-ready").when(F.size(local) > 0, "local-helper").otherwise("read-only")
    return routed.withColumns({"mode": mode, "agents": agents, "local": local, "manual": manual})


def context_budget(files: DataFrame) -> DataFrame:
    """Core files, the newest 3 plans, 5 drafts and 3 reviews: files, bytes, tokens (bytes / 4, up), state, and the five largest."""
    core = F.col("rel_path").isin("STYLE-GUIDE.md", "CONTEXT.md", "STATE.md", "OUTLINE.md", "RECORD.md", "WORK.md", "config.json")
    role = F.when(core, "core").when(_under("plans") & _ext(".md"), "plan").when(_under("drafts") & _ext(".md"), "draft").when(_under("reviews") & _ext(".md", ".txt"), "review")
    ranked = files.withColumn("role", role).filter("role IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("project_id", "role").orderBy(F.desc("mtime"), "rel_path")))
    kept = ranked.filter((F.col("role") == "core") | (F.col("n") <= F.when(F.col("role") == "draft", 5).otherwise(3)))
    out = kept.groupBy("project_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.slice(F.sort_array(F.collect_list(F.struct("size", "rel_path")), False), 1, 5).alias("_top"))
    tokens = F.ceil(F.col("bytes") / 4)
    state = F.when(tokens >= 120_000, "critical").when(tokens >= 80_000, "tight").when(tokens >= 45_000, "watch").otherwise("ok")
    return out.select("project_id", "files", "bytes", tokens.alias("tokens"), state.alias("state"), F.transform("_top", lambda x: x["rel_path"]).alias("largest"))


def ledger(files: DataFrame) -> DataFrame:
    """Deliverable progress per project: counts per stage, done, in progress, untouched, percent, bar and the unit sets."""
    f = files.withColumns({"name": F.element_at(F.split("rel_path", "/"), -1), "text": F.coalesce("text", F.lit(""))})
    root = ~F.col("rel_path").contains("/")
    refs = lambda pattern: F.flatten(F.transform(F.filter(lines(F.col("text")), lambda s: s.rlike(pattern)), lambda s: F.regexp_extract_all(s, F.lit(rules.UNIT_REFERENCE), F.lit(1)))).cast("array<int>")
    review = F.coalesce(F.when(F.col("rel_path").rlike("^reviews/[^/]+$"), unit_number(F.col("name"), r"REVIEW\.md")), F.when(root, unit_number(F.col("name"), r"EDITOR-NOTES\.md")))
    # a unit's review is the file under reviews (the last by name); notes at the root stand in only where there is none
    reviews = f.select("project_id", review.alias("unit"), F.struct((~root).alias("nested"), "name").alias("rank"), contains_any(F.col("text"), rules.OPEN_REVIEW_KEYWORDS).alias("open")).filter("unit IS NOT NULL").groupBy("project_id", "unit").agg(F.max_by("open", "rank").alias("open"))
    reviewed = reviews.groupBy("project_id").agg(_units(F.col("unit")).alias("reviewed"), _units(F.when(F.col("open"), F.col("unit"))).alias("keyword_open"))
    table, numbered = F.regexp_count("text", F.lit(r"(?m)^\|\s*\d+\s*\|")), F.regexp_count("text", F.lit(r"(?m)^\s*\d+[.)]\s+\S"))
    empty = F.expr("cast(array() as array<int>)")
    each = f.groupBy("project_id").agg(
        _units(F.when(F.col("rel_path").rlike("^drafts/body/[^/]+$"), unit_number(F.col("name"), r"DRAFT\.md"))).alias("drafted"),
        _units(F.when(F.col("rel_path").rlike("^(?:plans/)?[^/]+$"), unit_number(F.col("name"), r"PLAN\.md"))).alias("planned"),
        F.coalesce(F.max(F.when(_is("STATE.md"), refs(rules.STATE_SUBMITTED))), empty).alias("_sub"), F.coalesce(F.max(F.when(_is("STATE.md"), refs(rules.STATE_OPEN))), empty).alias("_open"),
        F.coalesce(F.max(F.when(_is("OUTLINE.md"), F.when(table > 0, table).otherwise(numbered))), F.lit(0)).alias("outline"),
    )
    positive = lambda c: F.sort_array(F.array_distinct(F.filter(c, lambda u: u > 0)))
    j = each.join(reviewed, "project_id", "left").withColumns({"reviewed": F.coalesce("reviewed", empty), "submitted": positive("_sub"), "open": F.array_union(positive("_open"), F.coalesce("keyword_open", empty))})
    j = j.withColumn("open", F.sort_array(F.array_except("open", "submitted")))
    j = j.withColumns({"done": F.sort_array(F.array_union("submitted", F.array_except("reviewed", "open"))), "worked": F.array_union(F.array_union("planned", "drafted"), F.array_union("reviewed", "submitted"))})
    total = F.greatest("outline", F.size("worked"), F.coalesce(F.array_max("worked"), F.lit(0))).cast("long")
    n = lambda c: F.size(c).cast("long")
    return j.withColumn("total", total).select(
        "project_id", "total", n("planned").alias("n_planned"), n("drafted").alias("n_drafted"), n("reviewed").alias("n_reviewed"), n("submitted").alias("n_submitted"), n("done").alias("n_done"),
        n(F.array_except("worked", "done")).alias("in_progress"), F.greatest(F.lit(0), F.col("total") - F.size("worked")).alias("untouched"), percent(F.size("done"), F.col("total")).alias("percent"),
        progress_bar(F.size("done"), F.col("total")).alias("bar"), "planned", "drafted", "reviewed", "submitted", "open", "done",
    )


def lanes(commands: DataFrame) -> DataFrame:
    """Lane and level of each command (name, category): agent, then local, then manual, then by category, else read-only."""
    cat = F.create_map(*(F.lit(x) for k, (lane, level) in CATEGORY_LANE.items() for x in (k, f"{lane}|{level}")))
    found = F.when(F.col("name").isin(AGENT_LANE), "agent-ready|3").when(F.col("name").isin(LOCAL_LANE), "local-helper|2").when(F.col("name").isin(MANUAL_LANE), "manual-gated|4").otherwise(F.coalesce(F.try_element_at(cat, F.col("category")), F.lit("read-only|1")))
    return commands.withColumns({"lane": F.substring_index(found, "|", 1), "level": F.substring_index(found, "|", -1).cast("int")})


def route_edges(lists: DataFrame, commands: DataFrame, families: DataFrame) -> DataFrame:
    """Edges of the route graph: consecutive entries of intent lists (an unknown entry breaks the chain) and dependency chains, and hub to member.

    lists: kind (intent or dependency), label, names array; families: label, hub, members array.
    """
    known = commands.select(F.col("name").alias("k")).distinct()
    steps = lists.select("kind", "label", F.posexplode(F.filter("names", lambda x: x.isNotNull())).alias("pos", "src"))
    pairs = steps.withColumn("dst", F.lead("src").over(Window.partitionBy("kind", "label").orderBy("pos"))).filter("dst IS NOT NULL").select("kind", "label", "src", "dst")
    hubs = families.select(F.lit("family").alias("kind"), "label", F.col("hub").alias("src"), F.explode("members").alias("dst")).filter("src <> dst")
    both = pairs.unionByName(hubs).distinct()
    return both.join(known, F.col("src") == F.col("k"), "left_semi").join(known, F.col("dst") == F.col("k"), "left_semi")
