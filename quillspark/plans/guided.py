"""Queries of the smaller rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import guidance as g


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def metadata_elements(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", F.concat(F.lit("<generator>tool x</generator><dc:author>me</dc:author><author kind='c2pa'>y</author><p data-ai-model=\"m\" id='1'>"), F.col("text")).alias("t"))
    return docs.select("doc_id", F.md5(g.clean_metadata_elements(F.col("t"))).alias("cleaned_md5"))


def artifact_plans(spark, sf):
    path = F.concat(F.lit("drafts/"), F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("Same"), (F.col("doc_id") % 5).cast("string"))).otherwise(F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, ".MD").otherwise(".md"))
    return g.artifact_plans(_t(spark, sf, "documents").select("doc_id", path.alias("rel_path"))).drop("rel_path")


def safe_apply(spark, sf):
    e = F.col("event_id")
    lane = F.element_at(F.array(*map(F.lit, ["manual-gated", "agent-ready", "read-only", "local-helper"])), (e % 4 + 1).cast("int"))
    return g.safe_apply(_t(spark, sf, "events").select(lane.alias("lane"), (e % 3 == 0).alias("requested"), (e % 5 != 0).alias("found"))).groupBy("lane", "kind").agg(F.count("*").alias("n"))


def style_records(spark, sf):
    e = F.col("event_id")
    r = F.struct(F.when(e % 5 == 0, "insufficient_length").when(e % 5 == 1, "odd").otherwise("ok").alias("status"), (e % 9 - 1).alias("word_count"), (e % 4).alias("sentence_count"), F.lit(0.5).alias("burstiness_cv"), ((e % 11) / 8).alias("lexical_diversity"), F.lit(0.0).alias("ai_ngram_density"), ((e % 6) / 5).alias("score"), F.when(e % 3 == 0, "NONE").otherwise("LOW").alias("band"))
    return _t(spark, sf, "events").select("event_id", r.alias("r")).select("event_id", F.array_join(g.style_record_errors(F.col("r")), ",").alias("errors"), g.suspicious(F.col("event_id") % 2, F.col("r.score")).alias("suspicious"))


def health_lights(spark, sf):
    s = _t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("langs"))
    checks = {"size": (F.col("chars") > 150_000, F.col("chars") > 100_000), "spread": (F.col("langs") < 2, F.col("langs") < 4)}
    return g.health_lights(s, checks).select("source", "size", "spread", "worst")


def severity_tally(spark, sf):
    return g.severity_tally(_t(spark, sf, "lineitem").select("l_shipdate", F.date_format("l_shipdate", "yyyy").alias("year"), F.when(F.col("l_tax") > 0.06, "drift").when(F.col("l_tax") > 0.03, "WARNING").otherwise("Info").alias("severity")), "year")


def save_messages(spark, sf):
    e = F.col("event_id")
    command = F.element_at(F.array(*map(F.lit, ["draft", "plan", "editor-review", "translate", "export", "scan", None])), (e % 7 + 1).cast("int"))
    return _t(spark, sf, "events").select("event_id", g.save_message(command, F.when(e % 2 == 0, e % 10)).alias("message"))


def context_snapshot(spark, sf):
    log = _t(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("command"), F.when(F.col("value") > 50, "ok").otherwise("failed").alias("outcome"))
    return g.snapshot(log, "user_id", "event_id")


def book_identity(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("t1"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("t2"))
    return g.identity(c, ["t1", "t2"], ["t2"], ["t2"]).select("c_custkey", "title", "author", "language", "slug")


def work_types(spark, sf):
    k = F.col("doc_id") % 5
    text = F.concat(F.when(k == 0, "INT. HOUSE\n").when(k == 1, "1:1 a\n1:2 b\n1:3 c\n").when(k == 2, "## Chapter 1\n").when(k == 3, "```\nx\n```\n").otherwise(""), "text")
    return _t(spark, sf, "documents").select("doc_id", g.guess_work_type(text).alias("kind"))


def arc_types(spark, sf):
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    marks = F.array_compact(F.array(F.when(k % 11 == 0, "cycle"), F.when(k % 3 == 0, "journey"), F.when(k % 4 == 0, "mystery")))
    return o.select(g.arc_type(k % 15, marks).alias("arc")).groupBy("arc").agg(F.count("*").alias("n"))


def term_snippets(spark, sf):
    return g.snippets(_t(spark, sf, "documents"), "license", "doc_id", "text")


def proposal_tally(spark, sf):
    o = _t(spark, sf, "orders")
    d = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("passage"), F.when(F.col("o_orderkey") % 2 == 0, "accept").otherwise("reject").alias("decision"))
    r = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("passage"), F.when(F.col("o_orderkey") % 7 == 0, "agree").otherwise("query").alias("response"))
    return g.proposal_tally(d, r)


def reference_rewrite(spark, sf):
    t = F.concat(F.lit("see /cmd:sacred:genealogy and /cmd:save, "), F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", g.rewrite_refs(t, {"flat": r"\$cmd-$1"}).alias("text"))


QUERIES = {f.__name__: f for f in (metadata_elements, artifact_plans, safe_apply, style_records, health_lights, severity_tally, save_messages, context_snapshot, book_identity, work_types, arc_types, term_snippets, proposal_tally, reference_rewrite)}

_SLUG = "coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[\\s_]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-'), ''), 'untitled')"
ORACLES = {
    "metadata_elements": "SELECT doc_id, md5('<generator></generator><dc:author>me</dc:author><author kind=''c2pa''></author><p id=''1''>' || text) AS cleaned_md5 FROM documents",
    "artifact_plans": "WITH p AS (SELECT doc_id, 'cleaned/drafts/' || CASE WHEN doc_id % 9 = 0 THEN 'Same' || doc_id % 5 ELSE doc_id::VARCHAR END || '-cleaned.md' AS output FROM documents) SELECT doc_id, output, count(*) OVER (PARTITION BY lower(output)) > 1 AS conflict FROM p",
    "safe_apply": "SELECT ['manual-gated', 'agent-ready', 'read-only', 'local-helper'][event_id % 4 + 1] AS lane, CASE event_id % 4 WHEN 0 THEN 'manual_gate' WHEN 1 THEN 'agent_candidate' WHEN 2 THEN 'suggested' ELSE CASE WHEN event_id % 5 = 0 THEN 'skipped' WHEN event_id % 3 = 0 THEN 'ran' ELSE 'ready' END END AS kind, count(*) AS n FROM events GROUP BY ALL",
    "style_records": "SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'status' WHEN event_id % 5 = 0 THEN CASE WHEN event_id % 9 = 0 THEN 'word_count' ELSE '' END ELSE array_to_string(list_filter([CASE WHEN event_id % 9 = 0 THEN 'word_count' END, CASE WHEN event_id % 11 > 8 THEN 'lexical_diversity' END, CASE WHEN event_id % 3 = 0 THEN 'band' END], lambda x: x IS NOT NULL), ',') END AS errors, event_id % 2 > 0 OR event_id % 6 >= 4 AS suspicious FROM events",
    "health_lights": "WITH s AS (SELECT source, sum(n_chars) AS c, count(DISTINCT lang) AS l FROM documents GROUP BY source), x AS (SELECT source, CASE WHEN c > 150000 THEN 'red' WHEN c > 100000 THEN 'yellow' ELSE 'green' END AS size, CASE WHEN l < 2 THEN 'red' WHEN l < 4 THEN 'yellow' ELSE 'green' END AS spread FROM s) SELECT *, CASE WHEN 'red' IN (size, spread) THEN 'red' WHEN 'yellow' IN (size, spread) THEN 'yellow' ELSE 'green' END AS worst FROM x",
    "severity_tally": "SELECT strftime(l_shipdate, '%Y') AS year, count(*) FILTER (WHERE l_tax > 0.06::DOUBLE) AS drift, count(*) FILTER (WHERE l_tax > 0.03::DOUBLE AND l_tax <= 0.06::DOUBLE) AS warning, count(*) FILTER (WHERE l_tax <= 0.03::DOUBLE) AS info FROM lineitem GROUP BY 1",
    "save_messages": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Draft' WHEN 1 THEN 'Plan' WHEN 2 THEN 'Review' WHEN 3 THEN 'Translate' WHEN 4 THEN 'Export' WHEN 5 THEN 'Work: scan' ELSE 'Checkpoint' END || CASE WHEN event_id % 7 < 4 AND event_id % 2 = 0 THEN ' unit ' || event_id % 10 ELSE '' END AS message FROM events",
    "context_snapshot": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, string_agg(event_type, ' < ' ORDER BY n) AS recent, count(*) FILTER (WHERE NOT value > 50) AS failed, arg_min(event_type, n) AS last_command FROM r WHERE n <= 5 GROUP BY user_id",
    "book_identity": f"WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS t1, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS t2 FROM customer) SELECT c_custkey, coalesce(t1, t2, 'Untitled') AS title, coalesce(t2, 'Unknown') AS author, lower(coalesce(t2, 'en')) AS language, {_SLUG.format('coalesce(t1, t2, ' + chr(39) + 'Untitled' + chr(39) + ')')} AS slug FROM c",
    "work_types": "SELECT doc_id, ['screenplay', 'scripture', 'novel', 'technical', 'prose'][doc_id % 5 + 1] AS kind FROM documents",
    "arc_types": "SELECT CASE WHEN o_orderkey % 15 <= 1 THEN 'single' WHEN o_orderkey % 11 = 0 THEN 'cyclical' WHEN o_orderkey % 3 = 0 AND o_orderkey % 15 >= 12 THEN 'journey' WHEN o_orderkey % 4 = 0 THEN 'mystery' WHEN o_orderkey % 15 >= 9 THEN 'five_act' ELSE 'three_act' END AS arc, count(*) AS n FROM orders GROUP BY 1",
    "term_snippets": "WITH a AS (SELECT doc_id, text, instr(lower(text), 'license') AS p FROM documents) SELECT doc_id, (p - 1)::BIGINT AS at, substr(text, greatest(1, p - 20), p - greatest(1, p - 20) + 27) AS snippet FROM a WHERE p > 0",
    "proposal_tally": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'open' WHEN o_orderkey % 2 = 0 THEN 'accept' ELSE 'reject' END AS decision, CASE WHEN o_orderkey % 5 = 0 THEN 'open' WHEN o_orderkey % 7 = 0 THEN 'agree' ELSE 'query' END AS response, count(*) AS n FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 = 0) GROUP BY ALL",
    "reference_rewrite": "SELECT doc_id, 'see $cmd-sacred-genealogy and $cmd-save, ' || text AS text FROM documents",
}
