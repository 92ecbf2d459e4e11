"""Queries of the remaining rule families over the driver's tables (adapted: same computation, stand-in data), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import ranges, text as tx
from quillspark.operators import assembly, drift, registry, story, translation
from quillspark.plans import inject


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def slugify(spark, sf):
    part = _t(spark, sf, "part")
    s = tx.slug(F.col("p_name"))
    return part.select("p_partkey", s.alias("slug"), tx.is_safe_slug(s).alias("safe"))


def slug_collisions(spark, sf):
    return registry.unique_slugs(_t(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "slug", "name")


def deliverable_names(spark, sf):
    c = _t(spark, sf, "customer")
    k = F.col("c_custkey") % 3
    return c.select("c_custkey", tx.deliverable_name(F.col("c_name"), F.when(k == 0, "FR").otherwise("en"), F.when(k == 1, "KDP/print").otherwise(""), F.when(k == 2, F.concat(F.lit("v"), k.cast("string"))), F.lit("EPUB")).alias("file_name"))


def _segments(spark, sf, role):
    conv = _t(spark, sf, "conversations").filter(F.col("role") == role).withColumn("pair", F.floor(F.col("turn") / 2))
    one = conv.groupBy("conv_id", "pair").agg(F.min_by("text", "turn").alias("text"))
    return translation.segments(one, ["conv_id", "pair"], "text")


def _tm(spark, sf):
    return translation.align(_segments(spark, sf, "user"), _segments(spark, sf, "assistant"), ["conv_id", "pair"])


def tm_align(spark, sf):
    return _tm(spark, sf).select("conv_id", "pair", "para", "sent", F.md5(F.coalesce("source", F.lit(""))).alias("source_md5"), F.md5(F.coalesce("target", F.lit(""))).alias("target_md5"), "confidence")


def tm_dedupe(spark, sf):
    found = translation.dedupe(_tm(spark, sf).filter("source IS NOT NULL AND target IS NOT NULL"))
    return found.select(F.md5("source").alias("source_md5"), F.md5("target").alias("target_md5"), "confidence", "uses", "targets", "conflicting")


def tm_stats(spark, sf):
    return translation.statistics(_tm(spark, sf).withColumn("lang", (F.col("conv_id") % 4).cast("string")), "lang")


def severity_cube(spark, sf):
    ev = _t(spark, sf, "events").withColumn("severity", F.when(F.col("value") >= 100, "major").when(F.col("value") >= 50, "minor").otherwise("note"))
    return translation.severity_cube(ev, "event_type", "severity")


def fidelity_bands(spark, sf):
    marks = F.when(F.col("l_discount") < 0.02, "none").when(F.col("l_discount") < 0.06, "shift").otherwise("loss")
    return translation.fidelity(_t(spark, sf, "lineitem").select("l_returnflag", marks.alias("marker")), "l_returnflag")


def _days(spark, sf):
    return _t(spark, sf, "events").select("event_type", F.datediff(F.to_date("ts"), F.lit("2020-01-01")).alias("day"), "user_id")


def thread_gaps(spark, sf):
    return story.thread_gaps(_days(spark, sf).filter("event_type = 'purchase'"), "user_id", "day")


def thread_shape(spark, sf):
    return story.thread_shape(_days(spark, sf).withColumn("thread", F.col("user_id")), "thread", "day")


def thread_matrix(spark, sf):
    ev = _t(spark, sf, "events").withColumn("unit", F.dayofweek("ts"))
    return story.thread_matrix(ev, "event_type", "unit", [1, 2, 3, 4, 5, 6, 7])


def convergence(spark, sf):
    return story.convergence(_t(spark, sf, "events").select("event_type", F.to_date("ts").cast("string").alias("unit")), "event_type", "unit")


def pair_matrix(spark, sf):
    n = _t(spark, sf, "nation")
    edges = n.alias("x").join(n.alias("y"), F.col("x.n_regionkey") == F.col("y.n_regionkey")).filter("x.n_nationkey + 1 = y.n_nationkey OR x.n_nationkey + 2 = y.n_nationkey").select(F.col("x.n_regionkey").alias("n_regionkey"), F.col("y.n_name").alias("a"), F.col("x.n_name").alias("b"), F.when(F.col("x.n_nationkey") % 2 == 0, "none").otherwise("ally").alias("kind"))
    return story.pair_matrix(n.select("n_regionkey", "n_name"), edges, "n_regionkey", "n_name").select("n_regionkey", "a", "b", "state")


def timeline_order(spark, sf):
    o = _t(spark, sf, "orders").withColumn("date", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")))
    return story.timeline_order(o, "o_custkey", "o_orderkey", "date").select("o_custkey", "o_orderkey", F.col("story_pos").cast("long").alias("story_pos"), F.col("date_pos").cast("long").alias("date_pos"), "moved")


def chronology_conflicts(spark, sf):
    return story.chronology_conflicts(_t(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderdate").select("o_custkey", "o_orderkey")


def descendants(spark, sf):
    edges = _t(spark, sf, "nation").select(F.floor(F.col("n_nationkey") / 3).cast("long").alias("parent"), F.col("n_nationkey").cast("long").alias("child")).filter("parent <> child")
    roots = edges.select(F.col("parent").alias("node")).distinct().filter("node < 3")
    return story.descendants(edges, roots).select("root", "node", F.col("depth").cast("long").alias("depth"))


def contradictions(spark, sf):
    return story.contradictions(_t(spark, sf, "lineitem"), "l_orderkey", "l_suppkey", "l_returnflag")


def reference_density(spark, sf):
    return story.reference_density(_t(spark, sf, "lineitem").withColumn("brand", F.col("l_partkey") % 25), "brand", "l_suppkey")


def numbering_faults(spark, sf):
    li = _t(spark, sf, "lineitem").filter("l_partkey % 3 <> 0")
    return story.numbering_faults(li.withColumn("l_linenumber", F.col("l_linenumber").cast("long")), "l_orderkey", "l_linenumber")


def orphans_both_ways(spark, sf):
    docs = _t(spark, sf, "documents").filter("doc_id % 3 <> 0").select("doc_id")
    return story.orphans(docs, _t(spark, sf, "labels").select("doc_id"), "doc_id")


def citation_audit(spark, sf):
    return story.dangling_references(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), _t(spark, sf, "customer").filter("c_custkey % 7 <> 0"), "o_custkey", "c_custkey")


def recorded_vs_derived(spark, sf):
    rec = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.round("o_totalprice", 2).alias("recorded"))
    der = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.round(F.sum("l_extendedprice"), 2).alias("derived"))
    found = drift.recorded_vs_derived(rec, der, "key", 10.0)
    return found.select("key", "recorded", "derived", F.round("delta", 2).alias("delta"))


def newest_source_stale(spark, sf):
    der = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.date_add(F.to_date("o_orderdate"), 60).alias("at"))
    src = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.to_date("l_shipdate").alias("at"), F.col("l_linenumber").cast("string").alias("name"))
    return drift.stale(der, src, "key").select("key", "cause", "state")


def _log(spark, sf):
    e = F.col("event_id")
    line = F.when(e % 17 == 0, F.concat(F.lit("broken "), e.cast("string"))).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" | cmd:"), F.col("event_type"), F.lit(" | id="), e.cast("string"), F.lit(" | user="), F.col("user_id").cast("string"), F.lit(" | outcome="), F.when(F.col("value") > 50, "ok").otherwise("failed")))
    return _t(spark, sf, "events").select("event_id", "user_id", line.alias("value"))


def history_parse(spark, sf):
    p = drift.parse_log(_log(spark, sf))
    return p.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "command", F.try_element_at("fields", F.lit("user")).alias("user_field"), "outcome", "malformed")


def history_tail(spark, sf):
    p = drift.parse_log(_log(spark, sf)).filter("NOT malformed")
    return drift.last_rows(p, "user_id", ["event_id"], 5).select("user_id", "event_id", "command", "outcome")


def history_malformed(spark, sf):
    recent = drift.last_rows(_log(spark, sf), "user_id", ["event_id"], 50)
    return drift.parse_log(recent).groupBy("user_id").agg(F.count_if("malformed").alias("malformed"), F.count("*").alias("n")).filter("malformed > 0")


def sessionize(spark, sf):
    ev = _t(spark, sf, "events")
    found = drift.sessions(ev.withColumn("t", F.unix_timestamp("ts")), "user_id", ["t", "event_id"], F.col("event_type") == "purchase")
    return found.select("user_id", F.col("session").cast("long").alias("session"), "started", "ended", "actions")


def compare_units(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("source").alias("unit"), F.col("doc_id").alias("pos"), "text")
    after = docs.filter("pos % 13 <> 0").withColumn("text", F.when(F.col("pos") % 5 == 0, F.concat(F.lit("New. "), "text")).when(F.col("pos") % 5 == 1, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("\n")))).otherwise(F.col("text")))
    return drift.compare_units(docs, after, ["unit", "pos"]).select("unit", "pos", "kind", "changes")


def stage_buckets(spark, sf):
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    found = drift.stage_buckets(o.select("o_orderkey", (k % 2 == 0).alias("planned"), (k % 3 == 0).alias("drafted"), (k % 5 == 0).alias("reviewed"), (k % 7 == 0).alias("submitted")), "o_orderkey")
    return found.groupBy("next_stage", "bucket").agg(F.count("*").alias("n"))


def worst_verdicts(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 45, "critical").when(F.col("l_quantity") > 30, "major").when(F.col("l_quantity") > 10, "minor").otherwise("none").alias("severity"))
    return drift.worst_verdict(li, "l_orderkey", [("critical", "BLOCKER"), ("major", "ACTION"), ("minor", "CAUTION")]).groupBy("verdict").agg(F.count("*").alias("n"))


def unregistered_names(spark, sf):
    docs = _t(spark, sf, "documents")
    return drift.unregistered_names(docs, spark.createDataFrame([("The",), ("And",)], "name string"), "doc_id", "text", 2)


def conflict_markers(spark, sf):
    docs = _t(spark, sf, "documents").withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("<<<<<<< a\n"), "text", F.lit("\n=======\nx\n>>>>>>> b"))).otherwise(F.col("text")))
    return drift.conflict_markers(docs, "doc_id", "text").withColumn("line", F.col("line").cast("long"))


def newest_not_undone(spark, sf):
    ev = _t(spark, sf, "events").select("user_id", F.col("event_id").cast("string").alias("hash"), F.unix_timestamp("ts").alias("ts"), "event_type")
    return drift.newest_not_undone(ev.filter("event_type <> 'click'").drop("event_type"), ev.filter("hash % 3 = 0"), "user_id")


def scaffold_markers(spark, sf):
    return assembly.scaffold_markers(inject.documents(spark, sf))


def cleanup_blocks(spark, sf):
    docs = inject.documents(spark, sf)
    return docs.select("doc_id", F.sha2(assembly.cleanup(F.col("text")), 256).alias("clean_sha256"))


def assemble_text_hash(spark, sf):
    found = assembly.assemble(_t(spark, sf, "conversations"), "conv_id", ["turn"])
    return found.select("conv_id", "parts", F.sha2("text", 256).alias("text_sha256"))


def _placed(spark, sf):
    return ranges.running(_t(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"], {"pos": F.lit(1).cast("long")})


def unit_reorder(spark, sf):
    return assembly.move_unit(_placed(spark, sf), "source", "pos", 7, 3)


def unit_renumbering(spark, sf):
    """Places of each source's documents after two come in at 5, and after those from 10 to 14 go."""
    units = _placed(spark, sf)
    both = assembly.insert_units(units, "pos", 5, 2).withColumnRenamed("new_pos", "inserted").drop("changed")
    return assembly.remove_units(both, "pos", 10, 14).withColumnRenamed("new_pos", "removed")


def unit_merge(spark, sf):
    units = _placed(spark, sf).join(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return assembly.merge_units(units, "source", "pos", 3).select("source", "new_pos", F.sha2("text", 256).alias("text_sha256"), "merged")


def split_points(spark, sf):
    docs = _t(spark, sf, "documents").select("source", "doc_id", tx.words_wc(F.col("text")).cast("long").alias("words"))
    return assembly.split_point(docs, "source", "doc_id", 0.3)


def settings_validation(spark, sf):
    ev = _t(spark, sf, "events")
    k = F.col("event_id") % 6
    js = (
        F.when(k == 0, "[1]").when(k == 1, '{"version":"1","runtime":"","runtimes":["a"],"scope":"global","developer_mode":true,"data_dir":"d","install_mode":"silent","installed_at":"t"}')
        .when(k == 2, '{"version":"1","runtime":"x","runtimes":"a","scope":"nowhere","developer_mode":"yes","data_dir":"","install_mode":"silent","installed_at":"t"}').when(k == 3, '{"runtime":"x","extra":1}').when(k == 4, "null").otherwise(F.col("props"))
    )
    found = registry.validate_settings(ev.select("event_id", js.alias("js")), "js")
    return found.select("event_id", "valid", F.size("errors").cast("long").alias("n_errors"), F.when(k.isin(1, 2, 3), F.size("warnings")).otherwise(0).cast("long").alias("n_warnings"))


def json_null_on_error(spark, sf):
    ev = _t(spark, sf, "events").withColumn("js", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("{bad"), "props")).otherwise(F.col("props")))
    parsed = F.from_json("js", "map<string,string>", {"mode": "PERMISSIVE"})
    return ev.select("event_id", (parsed.isNull() | (F.size(F.coalesce(parsed, F.create_map().cast("map<string,string>"))) == 0)).alias("is_null")).groupBy("is_null").agg(F.count("*").alias("n"))


def surface_tiers(spark, sf):
    """Brands as work types of the groups that their names begin with, types as surfaces: a group's tier from its smallest part there, a brand's own where it has but one part."""
    part = _t(spark, sf, "part").withColumn("grp", F.expr("left(p_brand, length(p_brand) - 1)"))
    tier = lambda n: F.element_at(F.array(*map(F.lit, ("core", "optional", "hidden"))), (n % 3 + 1).cast("int"))
    works = part.select(F.col("p_brand").alias("work_type"), "grp").distinct()
    base = part.groupBy("grp", F.col("p_type").alias("surface")).agg(tier(F.min("p_size")).alias("tier"))
    over = part.groupBy(F.col("p_brand").alias("work_type"), F.col("p_type").alias("surface")).agg(F.count("*").alias("n")).filter("n = 1").select("work_type", "surface", F.lit("core").alias("tier"))
    names = part.select(F.col("p_type").alias("surface"), F.lit("default").alias("grp"), F.concat("p_type", F.lit(".md")).alias("name")).distinct()
    own = part.filter("p_type LIKE 'S%'").select(F.col("p_type").alias("surface"), "grp", F.concat("grp", F.lit("/"), "p_type").alias("name")).distinct()
    return registry.resolve_surfaces(works, base, over, names.unionByName(own))


def profile_commands(spark, sf):
    """Customers as profiles that include their region's, which hold its nations, a common base and, in one case, themselves."""
    nation, region = _t(spark, sf, "nation"), _t(spark, sf, "region")
    of = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    none, off = F.array().cast("array<string>"), F.lit(False)
    own = _t(spark, sf, "customer").join(of, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("profile"), F.array("r_name").alias("includes"), F.array("n_name").alias("commands"), none.alias("categories"), off.alias("all"))
    regions = region.select(F.col("r_name").alias("profile"), F.when(F.col("r_regionkey") == 0, F.array(F.lit("base"), F.col("r_name"))).otherwise(F.array(F.lit("base"))).alias("includes"), none.alias("commands"), F.array(F.col("r_regionkey").cast("string")).alias("categories"), off.alias("all"))
    fixed = spark.createDataFrame([("base", [], ["help"], [], False), ("full", [], [], [], True)], own.schema)
    commands = nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("category")).unionByName(spark.createDataFrame([("help", "none")], "name string, category string"))
    return registry.expand_profiles(own.unionByName(regions).unionByName(fixed), commands)


def runtime_availability(spark, sf):
    sup = _t(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("runtime"), (F.col("s_suppkey") % 3).cast("string").alias("name"))
    expected = spark.createDataFrame([("0",), ("1",), ("2",)], "name string")
    found = registry.availability(expected, _t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("runtime")), sup)
    return found.select("runtime", "expected", "present", F.array_join("missing", ",").alias("missing"), "status")


def keyword_routing(spark, sf):
    keys = spark.createDataFrame([(1, "ing", "draft"), (2, "the", "review"), (3, "que", "translate")], "priority int, keyword string, hub string")
    return registry.match_command(_t(spark, sf, "documents").select("doc_id", F.col("text").alias("request")), "request", keys).select("doc_id", "hub")


def preserved_copy(spark, sf):
    docs = _t(spark, sf, "documents")
    a = docs.filter("doc_id % 5 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    b = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("")), 256).alias("sha256"))
    return registry.preserved_copy(a, b).groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    slugify, slug_collisions, deliverable_names, tm_align, tm_dedupe, tm_stats, severity_cube, fidelity_bands, thread_gaps, thread_shape, thread_matrix, convergence, pair_matrix, timeline_order, chronology_conflicts, descendants,
    contradictions, reference_density, numbering_faults, orphans_both_ways, citation_audit, recorded_vs_derived, newest_source_stale, history_parse, history_tail, history_malformed, sessionize, compare_units, stage_buckets, worst_verdicts,
    unregistered_names, conflict_markers, newest_not_undone, scaffold_markers, cleanup_blocks, assemble_text_hash, unit_reorder, unit_renumbering, unit_merge, split_points, settings_validation, json_null_on_error, surface_tiers, profile_commands, runtime_availability,
    keyword_routing, preserved_copy,
)}

_SLUG = "CASE WHEN trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') = '' THEN 'untitled' ELSE trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') END"


def _seg(role, name):
    return rf"""{name}1 AS (SELECT conv_id, (turn // 2)::BIGINT AS pair, arg_min(text, turn) AS text FROM conversations WHERE role = '{role}' GROUP BY ALL),
{name}2 AS (SELECT conv_id, pair, list_filter(string_split_regex(text, '\n\s*\n'), lambda p: trim(p, ' ' || chr(10)) <> '') AS ps FROM {name}1),
{name}3 AS (SELECT conv_id, pair, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS para FROM {name}2),
{name}4 AS (SELECT conv_id, pair, para, list_filter(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10)) <> '') AS ss FROM {name}3),
{name} AS (SELECT conv_id, pair, para::INTEGER AS para, unnest(ss) AS segment, (generate_subscripts(ss, 1) - 1)::INTEGER AS sent, len(ss) AS n FROM {name}4)"""


_TM = f"""{_seg("user", "a")}, {_seg("assistant", "b")},
tm AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pair, b.pair) AS pair, coalesce(a.para, b.para) AS para, coalesce(a.sent, b.sent) AS sent, a.segment AS source, b.segment AS target,
  CASE WHEN a.segment IS NULL OR b.segment IS NULL THEN 0.3 WHEN a.n = b.n THEN 1.0 WHEN abs(a.n - b.n) = 1 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.pair = b.pair AND a.para = b.para AND a.sent = b.sent)"""
_LOG = "lg AS (SELECT event_id, user_id, ts, event_type, CASE WHEN value > 50 THEN 'ok' ELSE 'failed' END AS outcome, event_id % 17 = 0 AS malformed FROM events)"

ORACLES = {
    "slugify": f"SELECT p_partkey, {_SLUG.format('p_name')} AS slug, regexp_full_match({_SLUG.format('p_name')}, '[a-z0-9](?:[a-z0-9-]*[a-z0-9])?') AS safe FROM part",
    "slug_collisions": f"WITH s AS (SELECT p_partkey, {_SLUG.format('p_brand')} AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS n FROM s) SELECT p_partkey, slug, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS name FROM n",
    "deliverable_names": f"SELECT c_custkey, {_SLUG.format('c_name')} || CASE c_custkey % 3 WHEN 0 THEN '-fr' ELSE '-en' END || CASE c_custkey % 3 WHEN 1 THEN '-kdpprint' ELSE '' END || CASE c_custkey % 3 WHEN 2 THEN '-v2' ELSE '' END || '.epub' AS file_name FROM customer",
    "tm_align": f"WITH {_TM} SELECT conv_id, pair, para, sent, md5(coalesce(source, '')) AS source_md5, md5(coalesce(target, '')) AS target_md5, confidence FROM tm",
    "tm_dedupe": f"WITH {_TM}, best AS (SELECT source, target, max(confidence) AS confidence, count(*) AS uses FROM tm WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL), sev AS (SELECT source, count(*) AS targets FROM best GROUP BY source) SELECT md5(source) AS source_md5, md5(target) AS target_md5, confidence, uses, targets, targets > 1 AS conflicting FROM best JOIN sev USING (source)",
    "tm_stats": f"WITH {_TM} SELECT (conv_id % 4)::VARCHAR AS lang, count(*) AS segments, count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (WHERE confidence < 0.5) AS low, round(count(target) / count(*), 4) AS coverage FROM tm GROUP BY 1",
    "severity_cube": "WITH e AS (SELECT event_type, CASE WHEN value >= 100 THEN 'major' WHEN value >= 50 THEN 'minor' ELSE 'note' END AS severity FROM events) SELECT event_type, severity, count(*) AS n, grouping(event_type, severity)::BIGINT AS level FROM e GROUP BY CUBE (event_type, severity)",
    "fidelity_bands": "WITH m AS (SELECT l_returnflag, CASE WHEN l_discount < 0.02::DOUBLE THEN 'none' WHEN l_discount < 0.06::DOUBLE THEN 'shift' ELSE 'loss' END AS marker, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag) AS total, coalesce(max(CASE WHEN marker = 'none' THEN n END) OVER (PARTITION BY l_returnflag), 0) AS c FROM m) SELECT l_returnflag, marker, n, round(n * 100 / total, 2)::DOUBLE AS percent, CASE WHEN c * 100 / total >= 90 THEN 'high' WHEN c * 100 / total >= 75 THEN 'medium' ELSE 'low' END AS band FROM t",
    "thread_gaps": "WITH d AS (SELECT DISTINCT user_id, datediff('day', DATE '2020-01-01', ts::DATE)::INTEGER AS day FROM events WHERE event_type = 'purchase'), n AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next_unit FROM d) SELECT *, next_unit - day - 1 AS gap FROM n WHERE next_unit - day - 1 >= 3",
    "thread_shape": "WITH d AS (SELECT user_id AS thread, datediff('day', DATE '2020-01-01', ts::DATE)::INTEGER AS day FROM events), g AS (SELECT thread, count(DISTINCT day) AS units, min(day) AS first, max(day) AS last FROM d GROUP BY thread) SELECT *, CASE WHEN units >= 5 THEN 'dominant' WHEN units >= 2 THEN 'recurring' ELSE 'single' END AS strength, units <= 2 AS dangling, last = (SELECT max(day) FROM d) AS reaches_end FROM g",
    "thread_matrix": f"SELECT event_type, {', '.join(f'count(*) FILTER (WHERE dayofweek(ts) = {k}) AS u{k + 1}' for k in range(7))} FROM events GROUP BY event_type",
    "convergence": "SELECT ts::DATE::VARCHAR AS unit, count(DISTINCT event_type) AS threads, count(DISTINCT event_type) >= 3 AS dense FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2",
    "pair_matrix": "WITH e AS (SELECT x.n_regionkey, least(x.n_name, y.n_name) AS a, greatest(x.n_name, y.n_name) AS b, min(CASE WHEN x.n_nationkey % 2 = 0 THEN 'none' ELSE 'ally' END) AS kind FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND y.n_nationkey - x.n_nationkey IN (1, 2) GROUP BY ALL) SELECT x.n_regionkey, x.n_name AS a, y.n_name AS b, CASE WHEN kind IS NULL THEN 'undefined' WHEN kind = 'none' THEN 'none' ELSE 'described' END AS state FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_name < y.n_name LEFT JOIN e ON e.n_regionkey = x.n_regionkey AND e.a = x.n_name AND e.b = y.n_name",
    "timeline_order": "WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS d FROM orders), p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS story_pos, row_number() OVER (PARTITION BY o_custkey ORDER BY d NULLS LAST, o_orderkey) AS date_pos FROM o) SELECT *, story_pos <> date_pos AS moved FROM p",
    "chronology_conflicts": "WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) SELECT o_custkey, o_orderkey FROM p WHERE prev > o_orderdate",
    "descendants": "WITH RECURSIVE e AS (SELECT (n_nationkey // 3)::BIGINT AS parent, n_nationkey::BIGINT AS child FROM nation WHERE n_nationkey // 3 <> n_nationkey), r(root, node, depth) AS (SELECT DISTINCT parent, parent, 0::BIGINT FROM e WHERE parent < 3 UNION SELECT root, child, depth + 1 FROM r JOIN e ON parent = node) SELECT root, node, min(depth) AS depth FROM r GROUP BY ALL",
    "contradictions": "SELECT l_orderkey, l_returnflag, count(DISTINCT l_suppkey) AS parents FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1",
    "reference_density": "SELECT l_partkey % 25 AS brand, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL",
    "numbering_faults": "WITH g AS (SELECT l_orderkey, l_linenumber::BIGINT AS l, count(*) AS n FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY ALL), s AS (SELECT *, lead(l) OVER (PARTITION BY l_orderkey ORDER BY l) AS nx FROM g) SELECT l_orderkey, 'missing' AS kind, l + 1 AS first, nx - 1 AS last FROM s WHERE nx - l > 1 UNION ALL SELECT l_orderkey, 'duplicate', l, l FROM g WHERE n > 1",
    "orphans_both_ways": "SELECT DISTINCT doc_id, 'left_only' AS side FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)",
    "citation_audit": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)",
    "recorded_vs_derived": "WITH d AS (SELECT l_orderkey AS key, round(sum(l_extendedprice), 2) AS derived FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey AS key, round(o_totalprice, 2) AS recorded FROM orders) SELECT key, recorded, derived, round(derived - recorded, 2) AS delta FROM r FULL JOIN d USING (key) WHERE derived IS NULL OR recorded IS NULL OR abs(derived - recorded) > 10",
    "newest_source_stale": "WITH s AS (SELECT l_orderkey AS key, max(l_shipdate::DATE) AS at, arg_max(l_linenumber::VARCHAR, (l_shipdate::DATE, l_linenumber::VARCHAR)) AS cause FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey AS key, o_orderdate::DATE + 60 AS at FROM orders) SELECT key, cause, CASE WHEN d.at IS NULL THEN 'missing' WHEN d.at < s.at THEN 'stale' ELSE 'fresh' END AS state FROM d FULL JOIN s USING (key)",
    "history_parse": f"WITH {_LOG} SELECT event_id, CASE WHEN NOT malformed THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts, CASE WHEN NOT malformed THEN 'cmd:' || event_type END AS command, CASE WHEN NOT malformed THEN user_id::VARCHAR END AS user_field, CASE WHEN NOT malformed THEN outcome END AS outcome, malformed FROM lg",
    "history_tail": f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM lg WHERE NOT malformed) SELECT user_id, event_id, 'cmd:' || event_type AS command, outcome FROM r WHERE n <= 5",
    "history_malformed": f"WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM lg) SELECT user_id, count(*) FILTER (WHERE malformed) AS malformed, count(*) AS n FROM r WHERE n <= 50 GROUP BY user_id HAVING count(*) FILTER (WHERE malformed) > 0",
    "sessionize": "WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t, event_type FROM events), s AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS session FROM e) SELECT user_id, session, min(t) AS started, max(t) AS ended, count(*) AS actions FROM s GROUP BY ALL",
    "compare_units": "WITH k AS (SELECT source AS unit, doc_id AS pos, CASE WHEN doc_id % 13 = 0 THEN 'removed' WHEN doc_id % 5 = 0 THEN 'changed' END AS kind FROM documents), c AS (SELECT *, count(*) OVER (PARTITION BY unit) AS changes, row_number() OVER (PARTITION BY unit ORDER BY pos) AS n FROM k WHERE kind IS NOT NULL) SELECT unit, pos, kind, changes FROM c WHERE n <= 10",
    "stage_buckets": "SELECT CASE WHEN o_orderkey % 2 <> 0 THEN 'planned' WHEN o_orderkey % 3 <> 0 THEN 'drafted' WHEN o_orderkey % 5 <> 0 THEN 'reviewed' WHEN o_orderkey % 7 <> 0 THEN 'submitted' ELSE 'complete' END AS next_stage, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'done' WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN 'in_progress' ELSE 'untouched' END AS bucket, count(*) AS n FROM orders GROUP BY ALL",
    "worst_verdicts": "WITH m AS (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT CASE WHEN q > 45 THEN 'BLOCKER' WHEN q > 30 THEN 'ACTION' WHEN q > 10 THEN 'CAUTION' ELSE 'none' END AS verdict, count(*) AS n FROM m GROUP BY 1",
    "unregistered_names": r"WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w), p AS (SELECT doc_id, x, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM e) SELECT regexp_extract(x, '^(\p{Lu}\p{Ll}{2,})', 1) AS name, count(DISTINCT doc_id) AS docs FROM p WHERE regexp_matches(prev, '[\p{Ll},]$') AND regexp_matches(x, '^\p{Lu}\p{Ll}{2,}') AND regexp_extract(x, '^(\p{Lu}\p{Ll}{2,})', 1) NOT IN ('The', 'And') GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2",
    "conflict_markers": "WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 9 = 0) SELECT doc_id, 1::BIGINT AS line, '<<<<<<<' AS marker FROM l UNION ALL SELECT doc_id, n + 2, '=======' FROM l UNION ALL SELECT doc_id, n + 4, '>>>>>>>' FROM l",
    "newest_not_undone": "SELECT user_id, arg_max(event_id::VARCHAR, (floor(epoch(ts))::BIGINT, event_id::VARCHAR)) AS hash, max(floor(epoch(ts))::BIGINT) AS ts FROM events WHERE event_type <> 'click' AND event_id % 3 <> 0 GROUP BY user_id",
    "scaffold_markers": "SELECT doc_id, unnest([1, 2, 5])::BIGINT AS line, unnest(['fill_in', 'alternate', 'duplicate_heading']) AS kind FROM documents WHERE doc_id % 10 = 8",
    "cleanup_blocks": f"WITH {inject.DOCS_SQL} SELECT doc_id, sha256(CASE doc_id % 10 WHEN 8 THEN chr(10) || '# One' || substr(t, length('[Fill in: a]~Alternate 1: b~~# One~# Two') + 1) ELSE t END) AS clean_sha256 FROM inj",
    "assemble_text_hash": "SELECT conv_id, count(*) AS parts, sha256(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id",
    "unit_reorder": "WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents), n AS (SELECT *, CASE WHEN pos = 7 THEN 3 WHEN pos < 7 AND pos >= 3 THEN pos + 1 ELSE pos END::BIGINT AS new_pos FROM p) SELECT *, new_pos <> pos AS changed FROM n",
    "unit_renumbering": "WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents), n AS (SELECT *, CASE WHEN pos >= 5 THEN pos + 2 ELSE pos END AS inserted, CASE WHEN pos < 10 THEN pos WHEN pos > 14 THEN pos - 5 END AS removed FROM p) SELECT *, removed IS DISTINCT FROM pos AS changed FROM n",
    "unit_merge": "WITH p AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS nxt, lead(1) OVER (PARTITION BY source ORDER BY doc_id) AS more FROM documents) SELECT source, CASE WHEN pos > 3 THEN pos - 1 ELSE pos END AS new_pos, sha256(CASE WHEN pos = 3 AND more = 1 THEN concat_ws(chr(10) || chr(10) || '---' || chr(10) || chr(10), text, nxt) ELSE text END) AS text_sha256, pos = 3 AND coalesce(more, 0) = 1 AS merged FROM p WHERE pos <> 4",
    "split_points": r"WITH s AS (SELECT source, doc_id, len(regexp_extract_all(text, '\S+')) AS w FROM documents), c AS (SELECT *, sum(w) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY source) AS total FROM s) SELECT source, min(doc_id) AS split_at FROM c WHERE upto >= 0.3::DOUBLE * total GROUP BY source",
    "settings_validation": "SELECT event_id, event_id % 6 = 1 AS valid, CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 4 WHEN 3 THEN 7 WHEN 4 THEN 1 ELSE 8 END::BIGINT AS n_errors, CASE event_id % 6 WHEN 3 THEN 1 ELSE 0 END::BIGINT AS n_warnings FROM events",
    "json_null_on_error": "SELECT event_id % 4 = 0 AS is_null, count(*) AS n FROM events GROUP BY 1",
    "surface_tiers": """WITH p AS (SELECT *, left(p_brand, length(p_brand) - 1) AS grp FROM part), b AS (SELECT grp, p_type, ['core', 'optional', 'hidden'][min(p_size) % 3 + 1] AS tier FROM p GROUP BY ALL), o AS (SELECT p_brand, p_type FROM p GROUP BY ALL HAVING count(*) = 1),
s AS (SELECT DISTINCT p_brand, grp FROM p) SELECT s.p_brand AS work_type, b.p_type AS surface, CASE WHEN o.p_brand IS NOT NULL THEN 'core' ELSE b.tier END AS tier, CASE WHEN b.p_type LIKE 'S%' THEN grp || '/' || b.p_type ELSE b.p_type || '.md' END AS name
FROM s JOIN b USING (grp) LEFT JOIN o ON o.p_brand = s.p_brand AND o.p_type = b.p_type""",
    "profile_commands": """WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), r AS (SELECT r_name AS profile, n_name AS command FROM n UNION SELECT r_name, 'help' FROM region)
SELECT * FROM r UNION SELECT c_custkey::VARCHAR, command FROM customer JOIN n ON c_nationkey = n_nationkey JOIN r ON r.profile = r_name UNION SELECT 'base', 'help' UNION SELECT 'full', n_name FROM nation UNION SELECT 'full', 'help'""",
    "runtime_availability": "WITH h AS (SELECT DISTINCT s_nationkey AS r, s_suppkey % 3 AS k FROM supplier), g AS (SELECT n_nationkey AS r, k FROM nation, (VALUES (0), (1), (2)) v(k)) SELECT g.r::VARCHAR AS runtime, count(*) AS expected, count(h.k) AS present, coalesce(string_agg(g.k::VARCHAR, ',' ORDER BY g.k) FILTER (WHERE h.k IS NULL), '') AS missing, CASE WHEN count(h.k) = 3 THEN 'ready' WHEN count(h.k) > 0 THEN 'partial' ELSE 'missing' END AS status FROM g LEFT JOIN h ON g.r = h.r AND g.k = h.k GROUP BY g.r",
    "keyword_routing": "SELECT doc_id, CASE WHEN contains(lower(text), 'ing') THEN 'draft' WHEN contains(lower(text), 'the') THEN 'review' WHEN contains(lower(text), 'que') THEN 'translate' END AS hub FROM documents",
    "preserved_copy": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'stale' WHEN doc_id % 3 = 0 THEN 'fresh' WHEN doc_id % 2 = 0 THEN 'backed_up' ELSE 'replaced' END AS kind, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 3 <> 0 GROUP BY 1",
}
