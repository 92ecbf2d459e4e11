"""Queries of project signals, routing and ledgers over a file table made from documents (an adaptation), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import projects as p


def project_files(spark, sf):
    """Each source is a project; its documents are drafts, plans, reviews, notes and outputs by doc_id, with state files besides."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"project_id": F.col("source"), "u": (F.col("doc_id") / 20).cast("int") + 1})
    k, u = F.col("doc_id") % 7, F.col("u").cast("string")
    path = (
        F.when(k == 0, F.concat(F.lit("plans/"), u, F.lit("-unit-PLAN.md"))).when(k.isin(1, 2), F.concat(F.lit("drafts/body/"), u, F.lit("-unit-DRAFT.md"))).when(k == 3, F.concat(F.lit("reviews/"), u, F.lit("-unit-REVIEW.md")))
        .when(k == 4, F.concat(u, F.lit("-root-EDITOR-NOTES.md"))).when(k == 5, F.concat(F.lit("notes/"), u, F.lit(".md"))).otherwise(F.concat(F.lit("exports/"), u, F.lit(".epub")))
    )
    body = F.concat("text", F.when(F.col("doc_id") % 11 == 0, "\nTODO: fix").otherwise(""))
    made = docs.select("project_id", path.alias("rel_path"), F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") * 60 + 1_000_000).alias("mtime"), body.alias("text"))
    pid = F.substring("project_id", 4, 9).cast("int")
    projects = docs.select("project_id").distinct().withColumn("n", pid)
    state = [
        ("STATE.md", F.lit("| submit | Scene 3 | Submitted\nawaiting revision: chapter 2, unit #5"), F.col("n") % 5 != 4, 2_000_000), ("OUTLINE.md", F.lit("| 1 | a |\n| 2 | b |\n| 60 | c |"), F.col("n") % 2 == 0, 900_000),
        ("CONTEXT.md", F.lit("c"), F.col("n") % 3 != 0, F.when(F.col("n") % 4 == 1, 1_500_000).otherwise(3_000_000)), ("HISTORY.log", F.when(F.col("n") % 9 == 8, "a\nsave failed").otherwise("a\nsave ok\n"), F.col("n") % 2 == 1, 2_000_000),
        ("STYLE-GUIDE.md", F.when(F.col("n") % 6 == 5, "TBD").otherwise("a\nb\nc\nd\ne\nf\ng\nh\ni"), F.col("n") % 7 != 6, 900_000), ("config.json", F.when(F.col("n") % 8 != 7, '{"voice":{"calibrated":true}}').otherwise("not json"), F.lit(True), 900_000),
    ]
    for name, text, cond, at in state:
        made = made.unionByName(projects.filter(cond).select("project_id", F.lit(name).alias("rel_path"), F.lit(10).cast("long").alias("size"), (F.lit(at) if isinstance(at, int) else at).cast("long").alias("mtime"), text.alias("text")))
    return made


def ledger(spark, sf):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    found = p.ledger(project_files(spark, sf))
    return found.select(*(c for c in found.columns if c not in ("planned", "drafted", "reviewed", "submitted", "open", "done")), *map(join, ("planned", "drafted", "reviewed", "submitted", "open", "done")))


def _routed(spark, sf):
    return p.automation(p.route(p.signals(project_files(spark, sf))))


def project_signals(spark, sf):
    return p.signals(project_files(spark, sf)).select("project_id", "plan_state", "review_state", "style_state", "context_state", "export_state", "save_state", "publishing_state", "review_signals", "notes_pending", "drafts", F.size("undrafted").cast("long").alias("undrafted"), F.size("unreviewed").cast("long").alias("unreviewed"))


def route_choice(spark, sf):
    return _routed(spark, sf).select("project_id", "command", "rule", "mode")


def automation_plan(spark, sf):
    lists = {n: F.array_join(n, ",").alias(n) for n in ("agents", "local", "manual")}
    return _routed(spark, sf).select("project_id", *lists.values())


def budget_topk(spark, sf):
    found = p.context_budget(project_files(spark, sf))
    return found.select("project_id", "files", "bytes", "tokens", "state", F.array_join("largest", ",").alias("largest"))


COMMANDS = [("draft", "core"), ("plan", "core"), ("save", "session"), ("export", "publishing"), ("help", "navigation"), ("polish", "quality"), ("odd", "none"), ("undo", "session")]


def command_lanes(spark, sf):
    """Uses of commands by lane; each event stands for a use of one of eight."""
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("category")) for n, c in COMMANDS))
    uses = spark.read.parquet(f"{sf}/events.parquet").select("event_type", F.element_at(listed, (F.col("event_id") % len(COMMANDS) + 1).cast("int")).alias("c")).select("event_type", "c.*")
    return p.lanes(uses).groupBy("event_type", "name", "category", "lane", "level").agg(F.count("*").alias("uses"))


def route_graph(spark, sf):
    """Chains are the event types of each user in order (an adaptation); families hold the types by their first letter."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    lists = events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("names")).select(F.lit("intent").alias("kind"), F.col("user_id").cast("string").alias("label"), "names")
    types = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("name")).distinct()
    families = types.groupBy(F.substring("name", 1, 1).alias("label")).agg(F.min("name").alias("hub"), F.array_sort(F.collect_set("name")).alias("members"))
    edges = p.route_edges(lists, types.filter("name <> 'click'"), families)
    return edges.groupBy("kind", "src", "dst").agg(F.count("*").alias("edges"))


QUERIES = {f.__name__: f for f in (ledger, project_signals, route_choice, automation_plan, budget_topk, command_lanes, route_graph)}

FILES = """d AS (SELECT *, source AS project_id, (doc_id // 20 + 1) AS u FROM documents), pj AS (SELECT DISTINCT source AS project_id, substr(source, 4)::INTEGER AS n FROM documents),
fl AS (SELECT project_id, CASE doc_id % 7 WHEN 0 THEN 'plans/' || u || '-unit-PLAN.md' WHEN 1 THEN 'drafts/body/' || u || '-unit-DRAFT.md' WHEN 2 THEN 'drafts/body/' || u || '-unit-DRAFT.md' WHEN 3 THEN 'reviews/' || u || '-unit-REVIEW.md'
   WHEN 4 THEN u || '-root-EDITOR-NOTES.md' WHEN 5 THEN 'notes/' || u || '.md' ELSE 'exports/' || u || '.epub' END AS rel_path, octet_length(encode(text))::BIGINT AS size, doc_id * 60 + 1000000 AS mtime, text || CASE WHEN doc_id % 11 = 0 THEN chr(10) || 'TODO: fix' ELSE '' END AS text, u::INTEGER AS u, (doc_id % 7)::INTEGER AS k FROM d
 UNION ALL SELECT project_id, 'STATE.md', 10, 2000000, '', 0, 10 FROM pj WHERE n % 5 <> 4
 UNION ALL SELECT project_id, 'OUTLINE.md', 10, 900000, '', 0, 11 FROM pj WHERE n % 2 = 0
 UNION ALL SELECT project_id, 'CONTEXT.md', 10, CASE WHEN n % 4 = 1 THEN 1500000 ELSE 3000000 END, '', 0, 12 FROM pj WHERE n % 3 <> 0
 UNION ALL SELECT project_id, 'HISTORY.log', 10, 2000000, CASE WHEN n % 9 = 8 THEN 'failed' ELSE 'ok' END, 0, 13 FROM pj WHERE n % 2 = 1
 UNION ALL SELECT project_id, 'STYLE-GUIDE.md', 10, 900000, CASE WHEN n % 6 = 5 THEN 'template' ELSE 'filled' END, 0, 14 FROM pj WHERE n % 7 <> 6
 UNION ALL SELECT project_id, 'config.json', 10, 900000, CASE WHEN n % 8 <> 7 THEN 'cal' ELSE '' END, 0, 15 FROM pj),
open_text AS (SELECT *, regexp_matches(upper(text), 'TODO|FIXME|UNRESOLVED|NEEDS REVISION|QUESTION: BLOCKING|VOICE DRIFT') AS is_open, regexp_matches(upper(text), 'TODO|FIXME|UNRESOLVED|QUESTION:|NOTE:') AS is_note FROM fl)"""
SIGNALS = f"""{FILES},
s AS (SELECT project_id, coalesce(list_sort(list_distinct(list(u) FILTER (WHERE k = 0))), []) AS planned, coalesce(list_sort(list_distinct(list(u) FILTER (WHERE k IN (1, 2)))), []) AS drafted, coalesce(list_sort(list_distinct(list(u) FILTER (WHERE k = 3))), []) AS reviewed,
  count(*) FILTER (WHERE k IN (1, 2)) AS drafts, count(*) FILTER (WHERE k = 3 AND (is_open OR contains(upper(text), 'CONTINUITY'))) AS review_signals, count(*) FILTER (WHERE k = 5 AND is_note) AS notes_pending,
  bool_or(k = 10) AS has_state, max(mtime) FILTER (WHERE k = 12) AS ctx, max(mtime) FILTER (WHERE k = 10) AS st, max(mtime) FILTER (WHERE k IN (1, 2)) AS dr, max(mtime) FILTER (WHERE k IN (1, 2, 10, 11, 14)) AS src, max(mtime) FILTER (WHERE k = 6) AS outp,
  max(text) FILTER (WHERE k = 14) AS style, coalesce(bool_or(k = 15 AND text = 'cal'), false) AS cal, coalesce(bool_or(k = 13), false) AS hist, coalesce(bool_or(k = 13 AND text = 'failed'), false) AS failed FROM open_text GROUP BY project_id),
g AS (SELECT *, list_sort(list_filter(planned, lambda x: NOT list_contains(drafted, x))) AS undrafted, list_sort(list_filter(drafted, lambda x: NOT list_contains(reviewed, x))) AS unreviewed FROM s),
t AS (SELECT *, CASE WHEN len(planned) = 0 THEN 'missing' WHEN len(drafted) = 0 THEN 'ready-to-draft' WHEN len(undrafted) > 0 THEN 'partially-drafted' ELSE 'covered' END AS plan_state,
  CASE WHEN drafts = 0 THEN 'none' WHEN len(unreviewed) = len(drafted) THEN 'missing' WHEN len(unreviewed) > 0 THEN 'partial' ELSE 'covered' END AS review_state,
  CASE WHEN style IS NULL THEN 'missing' WHEN style = 'template' THEN 'template' WHEN cal THEN 'calibrated' ELSE 'profiled-unverified' END AS style_state,
  CASE WHEN ctx IS NULL THEN 'missing' WHEN coalesce(ctx < st, false) OR coalesce(ctx < dr, false) THEN 'stale' ELSE 'fresh' END AS context_state, CASE WHEN ctx IS NULL THEN 'save' WHEN coalesce(ctx < st, false) THEN 'scan' ELSE 'save' END AS suggest,
  CASE WHEN outp IS NULL THEN CASE WHEN src IS NULL THEN 'none' ELSE 'missing' END WHEN src > outp THEN 'stale' ELSE 'fresh' END AS export_state,
  CASE WHEN drafts > 0 AND NOT hist THEN 'unsaved' ELSE 'clean' END AS save_state, CASE WHEN drafts > 0 THEN 'gaps' ELSE 'not-started' END AS publishing_state FROM g),
r AS (SELECT *, CASE WHEN NOT coalesce(has_state, false) THEN 2 WHEN failed THEN 3 WHEN context_state = 'stale' THEN 4 WHEN style_state IN ('missing', 'template') THEN 6 WHEN style_state = 'profiled-unverified' THEN 7 WHEN plan_state IN ('ready-to-draft', 'partially-drafted') THEN 8
  WHEN review_signals > 0 THEN 9 WHEN notes_pending > 0 THEN 10 WHEN drafts = 0 THEN 11 WHEN review_state IN ('missing', 'partial') THEN 12 WHEN publishing_state = 'gaps' AND export_state = 'missing' THEN 14 WHEN export_state IN ('stale', 'missing') THEN 17 WHEN save_state <> 'clean' THEN 18 ELSE 19 END AS rule FROM t),
c AS (SELECT *, CASE rule WHEN 2 THEN 'scan' WHEN 3 THEN 'troubleshoot' WHEN 4 THEN suggest WHEN 6 THEN 'profile-writer' WHEN 7 THEN 'voice-test' WHEN 8 THEN 'draft ' || undrafted[1] WHEN 9 THEN 'editor-review' WHEN 10 THEN 'check-notes' WHEN 11 THEN 'plan'
  WHEN 12 THEN 'editor-review ' || unreviewed[1] WHEN 14 THEN 'front-matter' WHEN 17 THEN 'export' WHEN 18 THEN 'save' ELSE 'next' END AS command FROM r),
au AS (SELECT *, list_filter([CASE WHEN string_split(command, ' ')[1] IN ('plan', 'draft', 'editor-review') THEN command END, CASE WHEN plan_state IN ('ready-to-draft', 'partially-drafted') THEN 'draft ' || undrafted[1] END, CASE WHEN review_state IN ('missing', 'partial') THEN 'editor-review ' || unreviewed[1] END], lambda x: x IS NOT NULL) AS ag,
  list_filter([CASE WHEN command IN ('save', 'scan', 'check-notes') THEN command END, CASE WHEN context_state = 'stale' THEN suggest END, CASE WHEN notes_pending > 0 THEN 'check-notes' END, CASE WHEN save_state <> 'clean' THEN 'save' END], lambda x: x IS NOT NULL) AS lo,
  list_filter([CASE WHEN command = 'export' THEN command END, CASE WHEN publishing_state = 'gaps' THEN 'publish' END], lambda x: x IS NOT NULL) AS ma FROM c)"""
_FIRST = "array_to_string(list_filter({0}, lambda x, i: list_position({0}, x) = i), ',')"

ORACLES = {
    "ledger": f"""WITH {FILES},
rv AS (SELECT project_id, u, arg_max(is_open, (k = 3, rel_path)) AS op FROM open_text WHERE k IN (3, 4) GROUP BY ALL),
un AS (SELECT project_id, u, 'planned' AS s FROM fl WHERE k = 0 UNION SELECT project_id, u, 'drafted' FROM fl WHERE k IN (1, 2) UNION SELECT project_id, u, 'reviewed' FROM rv UNION SELECT project_id, u, 'kw' FROM rv WHERE op
  UNION SELECT project_id, x, 'submitted' FROM fl, (VALUES (3)) v(x) WHERE k = 10 UNION SELECT project_id, x, 'stopen' FROM fl, (VALUES (2), (5)) v(x) WHERE k = 10),
b AS (SELECT project_id, u, bool_or(s = 'planned') AS pl, bool_or(s = 'drafted') AS dr, bool_or(s = 'reviewed') AS re, bool_or(s = 'submitted') AS su, bool_or(s IN ('kw', 'stopen')) AS op FROM un GROUP BY ALL),
c AS (SELECT *, op AND NOT su AS opn, su OR (re AND NOT (op AND NOT su)) AS dn, pl OR dr OR re OR su AS wk FROM b),
a AS (SELECT project_id, count(*) FILTER (WHERE pl) AS n_planned, count(*) FILTER (WHERE dr) AS n_drafted, count(*) FILTER (WHERE re) AS n_reviewed, count(*) FILTER (WHERE su) AS n_submitted, count(*) FILTER (WHERE dn) AS n_done, count(*) FILTER (WHERE wk AND NOT dn) AS in_progress, count(*) FILTER (WHERE wk) AS nw, coalesce(max(u) FILTER (WHERE wk), 0) AS mw,
  {", ".join(f"coalesce(string_agg(u::VARCHAR, ',' ORDER BY u) FILTER (WHERE {x}), '') AS {y}" for x, y in (("pl", "planned"), ("dr", "drafted"), ("re", "reviewed"), ("su", "submitted"), ("opn", "open"), ("dn", "done")))} FROM c GROUP BY project_id),
t AS (SELECT a.*, greatest(CASE WHEN n % 2 = 0 THEN 3 ELSE 0 END, nw, mw)::BIGINT AS total FROM a JOIN pj USING (project_id))
SELECT * EXCLUDE (nw, mw), greatest(0, total - nw)::BIGINT AS untouched, floor(n_done / total * 100 + 0.5)::BIGINT AS percent, repeat('█', least(10, floor(n_done / total * 10 + 0.5))::INTEGER) || repeat('░', 10 - least(10, floor(n_done / total * 10 + 0.5))::INTEGER) AS bar FROM t""",
    "project_signals": f"WITH {SIGNALS} SELECT project_id, plan_state, review_state, style_state, context_state, export_state, save_state, publishing_state, review_signals, notes_pending, drafts, len(undrafted)::BIGINT AS undrafted, len(unreviewed)::BIGINT AS unreviewed FROM t",
    "route_choice": f"WITH {SIGNALS} SELECT project_id, command, rule::INTEGER AS rule, CASE WHEN list_contains(ma, command) THEN 'manual-gated' WHEN len(ag) > 0 THEN 'agent-ready' WHEN len(lo) > 0 THEN 'local-helper' ELSE 'read-only' END AS mode FROM au",
    "automation_plan": f"WITH {SIGNALS} SELECT project_id, {_FIRST.format('ag')} AS agents, {_FIRST.format('lo')} AS local, {_FIRST.format('ma')} AS manual FROM au",
    "budget_topk": f"""WITH {FILES}, x AS (SELECT *, CASE WHEN k IN (10, 11, 12, 14, 15) THEN 'core' WHEN k = 0 THEN 'plan' WHEN k IN (1, 2) THEN 'draft' WHEN k = 3 THEN 'review' END AS role FROM fl),
y AS (SELECT *, row_number() OVER (PARTITION BY project_id, role ORDER BY mtime DESC, rel_path) AS rn FROM x WHERE role IS NOT NULL), z AS (SELECT * FROM y WHERE role = 'core' OR rn <= CASE role WHEN 'draft' THEN 5 ELSE 3 END),
w AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY size DESC, rel_path DESC) AS top FROM z)
SELECT project_id, count(*) AS files, sum(size)::BIGINT AS bytes, ceil(sum(size) / 4)::BIGINT AS tokens, CASE WHEN ceil(sum(size) / 4) >= 120000 THEN 'critical' WHEN ceil(sum(size) / 4) >= 80000 THEN 'tight' WHEN ceil(sum(size) / 4) >= 45000 THEN 'watch' ELSE 'ok' END AS state, string_agg(rel_path, ',' ORDER BY top) FILTER (WHERE top <= 5) AS largest FROM w GROUP BY project_id""",
    "command_lanes": f"""WITH v(k, name, category, lane, level) AS (VALUES (0, 'draft', 'core', 'agent-ready', 3), (1, 'plan', 'core', 'agent-ready', 3), (2, 'save', 'session', 'local-helper', 2), (3, 'export', 'publishing', 'manual-gated', 4), (4, 'help', 'navigation', 'read-only', 1), (5, 'polish', 'quality', 'agent-or-local', 3), (6, 'odd', 'none', 'read-only', 1), (7, 'undo', 'session', 'manual-gated', 4))
SELECT event_type, name, category, lane, level, count(*) AS uses FROM events JOIN v ON event_id % 8 = k GROUP BY ALL""",
    "route_graph": """WITH e AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
t AS (SELECT DISTINCT event_type AS name FROM events), f AS (SELECT name[1:1] AS label, min(name) AS hub FROM t GROUP BY 1),
al AS (SELECT DISTINCT 'intent' AS kind, user_id::VARCHAR AS label, src, dst FROM e WHERE dst IS NOT NULL UNION SELECT 'family', label, hub, name FROM f JOIN t ON name[1:1] = label WHERE hub <> name)
SELECT kind, src, dst, count(*) AS edges FROM al WHERE src <> 'click' AND dst <> 'click' GROUP BY ALL""",
}
