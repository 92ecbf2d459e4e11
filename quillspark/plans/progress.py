"""Queries of the progress and review tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import progress as p
from quillspark.plans import manuscript


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pipeline_position(spark, sf):
    """A stage of a customer is done once they have placed so many orders."""
    placed = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return p.pipeline_position(_t(spark, sf, "customer").join(placed, "c_custkey", "left"), "c_custkey", {s: F.col("n") >= 3 * k for k, s in enumerate(p.STAGES, 1)})


def ledger_rollup(spark, sf):
    bucket = F.when(F.col("n_chars") > 2000, "done").when(F.col("n_chars") > 500, "in progress").otherwise("untouched")
    return p.ledger_rollup(_t(spark, sf, "documents").withColumn("bucket", bucket), ["lang", "source"], "bucket", "n_chars")


_MESSAGES = ["Saved after drafting chapter ", "Saved after editor review of chapter ", "Saved after revising chapter ", "Saved work in progress on chapter ", "Saved: note ", "Initial save of book ", "Merge track ", "Saved somehow "]


def save_history(spark, sf):
    ev = _t(spark, sf, "events")
    message = F.concat(F.element_at(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 8 + 1).cast("int")), F.col("event_id").cast("string"))
    return p.save_history(ev.withColumn("message", message), "user_id", ["ts", "event_id"], "message", 5)


def _themes(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("source").alias("part"), F.col("doc_id").alias("unit"), "text")
    listed = spark.createDataFrame([(t,) for t in ("copyright", "license", "und", "water", "qqq")], "theme string")
    themes = docs.select("part").distinct().select("part", F.explode(F.array(*(F.lit(r[0]) for r in listed.collect()))).alias("theme"))
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    mentions = docs.select("part", "unit", F.explode(F.filter(words, lambda w: w.isin("copyright", "license", "und", "water", "qqq", "the"))).alias("theme"))
    return p.theme_strength(themes, docs, mentions, "part")


def theme_strength(spark, sf):
    return _themes(spark, sf)[0]


def units_without_themes(spark, sf):
    return _themes(spark, sf)[1]


def annotation_counts(spark, sf):
    return p.annotation_counts(_t(spark, sf, "events"), "event_type", "user_id")


def age_conflicts(spark, sf):
    """Customers' ages as some orders state them, two of three wrong by a year or none."""
    born = F.date_add(F.lit("1950-01-01").cast("date"), (F.col("c_custkey") * 37 % 9000).cast("int"))
    people = _t(spark, sf, "customer").select(F.col("c_custkey").alias("person"), born.alias("born"))
    told = _t(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("person"), F.col("o_orderdate").cast("date").alias("at"))
    stated = told.join(people, "person").withColumn("age", F.year("at") - F.year("born") - F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).drop("born")
    return p.age_conflicts(stated, people, "person", "at", "age", "born").select("o_orderkey", F.col("age").cast("long").alias("age"), "expected")


def conflicting_terms(spark, sf):
    part = _t(spark, sf, "part").select(F.split("p_name", " ")[0].alias("term"), F.when(F.col("p_partkey") % 3 == 0, F.split("p_type", " ")[0]).otherwise("").alias("translation"))
    return p.conflicting_terms(part, "term", "translation").withColumn("translations", F.array_join("translations", "|"))


def severity_report(spark, sf):
    severity = F.when(F.col("value") > 40, "High").when(F.col("value") > 10, "medium").otherwise("low")
    return p.severity_report(_t(spark, sf, "events").withColumn("severity", severity).withColumn("user", F.col("user_id") % 50), "user", "event_type", "severity", "medium", 2)


def migrated_settings(spark, sf):
    ev, k = _t(spark, sf, "events"), F.col("event_id") % 5
    js = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit('{"runtime":"r'), F.col("user_id").cast("string"), F.lit('","scope":"project"}'))).when(k == 2, '{"runtime":"","runtimes":["a"],"profile":null}').when(k == 3, "[1]").otherwise('{"runtime":7}')
    return ev.select("event_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(p.migrate_settings(js))))).alias("settings"))


def command_inventory(spark, sf):
    """Pages' paths as commands, with hosts' categories from those of even numbers."""
    pages = _t(spark, sf, "pages").select("page_id", F.concat(F.lit("/cmd:"), F.regexp_replace(F.regexp_replace("url", r"^\w+://[^/]+/|[?#].*$", ""), "/", ":")).alias("ref"))
    commands = pages.groupBy("ref").agg(F.min("page_id").alias("n")).select("ref", F.when(F.col("n") % 3 == 0, F.concat(F.lit("page "), "n")).alias("description"), F.lit(None).cast("string").alias("hint"))
    registry = commands.select(F.replace(F.regexp_replace("ref", "^/cmd:", ""), F.lit(":"), F.lit("-")).alias("key")).distinct().filter(F.length("key") % 2 == 0).select("key", F.lit("even").alias("category"), F.lit("known").alias("description"))
    return p.inventory(commands, registry)[0].drop("hint")


def voice_harness(spark, sf):
    expected = _t(spark, sf, "documents").select("doc_id", F.explode(F.array(F.lit("guided"), F.lit("foreign"))).alias("fixture_id"), "lang").select("doc_id", "fixture_id", F.when(F.col("fixture_id") == "guided", F.col("lang") == "en").otherwise(F.col("lang") != "en").alias("expected_pass"))
    return p.voice_harness(manuscript.QUERIES["voice_marker_score"](spark, sf), expected, ["doc_id", "fixture_id"])


QUERIES = {f.__name__: f for f in (pipeline_position, ledger_rollup, save_history, theme_strength, units_without_themes, annotation_counts, age_conflicts, conflicting_terms, severity_report, migrated_settings, command_inventory, voice_harness)}

_LISTED = "('copyright'), ('license'), ('und'), ('water'), ('qqq')"
_MENTIONS = f"""d AS (SELECT source AS part, doc_id AS unit, list_distinct(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS w FROM documents), th(theme) AS (VALUES {_LISTED}), m AS (SELECT DISTINCT part, unit, theme FROM d JOIN th ON list_contains(w, theme))"""
ORACLES = {
    "pipeline_position": f"""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT {p.STAGES} AS s), i AS (SELECT c_custkey, CASE WHEN coalesce(n, 0) < 30 THEN coalesce(n, 0) // 3 + 1 END AS i FROM customer LEFT JOIN n ON o_custkey = c_custkey)
SELECT c_custkey, i::INTEGER AS index, s[i] AS stage, array_to_string(list_transform(range(1, 11), lambda k: CASE WHEN k = i THEN '[' || s[k] || ']' ELSE s[k] END), ' > ') AS track FROM i, s""",
    "ledger_rollup": """WITH g AS (SELECT lang, source, count(*) AS units, count(*) FILTER (WHERE n_chars > 2000) AS done, count(*) FILTER (WHERE n_chars > 500 AND n_chars <= 2000) AS in_progress, coalesce(sum(n_chars), 0)::BIGINT AS words, (CASE GROUPING(lang, source) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END)::BIGINT AS level FROM documents GROUP BY ROLLUP (lang, source))
SELECT *, '(' || done || '/' || units || ' done' || CASE WHEN in_progress > 0 THEN ', ' || in_progress || ' in progress' ELSE '' END || ')' AS heading FROM g""",
    "save_history": """WITH m AS (SELECT user_id, ts, event_id, event_id % 8 AS k FROM events WHERE event_id % 8 <> 6), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INTEGER AS n FROM m)
SELECT user_id, n, ts, event_id, ['Drafted chapter ', 'Reviewed chapter ', 'Revised chapter ', 'Work in progress on chapter ', 'note ', 'Started book ', '', 'Saved somehow '][k + 1] || event_id AS action FROM n WHERE n <= 5""",
    "theme_strength": f"WITH {_MENTIONS}, e AS (SELECT part, theme, count(unit) AS units FROM (SELECT DISTINCT part FROM d) CROSS JOIN th LEFT JOIN m USING (part, theme) GROUP BY ALL) SELECT part, theme, units, CASE WHEN units >= 5 THEN 'strong' WHEN units >= 2 THEN 'moderate' WHEN units = 1 THEN 'emerging' ELSE 'dormant' END AS strength FROM e",
    "units_without_themes": f"WITH {_MENTIONS} SELECT part, unit FROM d ANTI JOIN m USING (part, unit)",
    "annotation_counts": "SELECT event_type, count(DISTINCT user_id) AS passages, count(*) AS annotations FROM events GROUP BY event_type",
    "age_conflicts": """WITH c AS (SELECT c_custkey, DATE '1950-01-01' + (c_custkey * 37 % 9000)::INTEGER AS born FROM customer),
o AS (SELECT o_orderkey, o_orderdate::DATE AS told, born, (year(o_orderdate) - year(born) - CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS age FROM orders JOIN c ON o_custkey = c_custkey),
x AS (SELECT o_orderkey, age, (year(told) - year(born) - CASE WHEN month(told) * 100 + day(told) < month(born) * 100 + day(born) AND NOT (month(told) = month(born) AND told = last_day(told) AND born = last_day(born)) THEN 1 ELSE 0 END)::BIGINT AS expected, told < born AS early FROM o)
SELECT o_orderkey, age, expected FROM x WHERE age <> expected OR early""",
    "conflicting_terms": """WITH t AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS term, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_type, ' ')[1] END AS x FROM part), g AS (SELECT term, count(x) AS n, coalesce(string_agg(x, '|' ORDER BY x), '') AS translations FROM t GROUP BY term)
SELECT term, translations, CASE n WHEN 0 THEN 'untranslated' ELSE 'several' END AS kind FROM g WHERE n <> 1""",
    "severity_report": """WITH f AS (SELECT user_id % 50 AS "user", event_type, count(*) AS n, count(*) FILTER (WHERE value > 40) AS high, count(*) FILTER (WHERE value <= 40) AS medium FROM events WHERE value > 10 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, event_type) AS r FROM f)
SELECT "user", sum(n)::BIGINT AS flags, sum(high)::BIGINT AS high, sum(medium)::BIGINT AS medium, 0::BIGINT AS low, string_agg(event_type, ', ' ORDER BY r) FILTER (WHERE r <= 2) AS top FROM r GROUP BY "user\"""",
    "migrated_settings": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"install_mode":"\\"interactive\\"","k":"' || regexp_extract(props, '(\\d+)', 1) || '","profile":"\\"full\\"","runtimes":"[]","scope":"\\"global\\""}'
  WHEN 1 THEN '{"install_mode":"\\"interactive\\"","profile":"\\"full\\"","runtime":"\\"r' || user_id || '\\"","runtimes":"[\\"r' || user_id || '\\"]","scope":"\\"project\\""}'
  WHEN 2 THEN '{"install_mode":"\\"interactive\\"","profile":"null","runtime":"\\"\\"","runtimes":"[\\"a\\"]","scope":"\\"global\\""}' WHEN 4 THEN '{"install_mode":"\\"interactive\\"","profile":"\\"full\\"","runtime":"7","runtimes":"[]","scope":"\\"global\\""}' END AS settings FROM events""",
    "command_inventory": """WITH r AS (SELECT replace(regexp_replace(url, '^\\w+://[^/]+/|[?#].*$', '', 'g'), '/', ':') AS k, min(page_id) AS n FROM pages GROUP BY 1)
SELECT '/cmd:' || k AS ref, replace(k, ':', '-') AS skill, CASE WHEN length(k) % 2 = 0 THEN 'even' ELSE 'uncategorized' END AS category, CASE WHEN n % 3 = 0 THEN 'page ' || n WHEN length(k) % 2 = 0 THEN 'known' ELSE regexp_replace(k, '[:-]', ' ', 'g') END AS description FROM r""",
    "voice_harness": f"""WITH v AS ({manuscript.ORACLES["voice_marker_score"]}), j AS (SELECT fixture_id, passed = CASE fixture_id WHEN 'guided' THEN lang = 'en' ELSE lang <> 'en' END AS same FROM v JOIN documents USING (doc_id))
SELECT fixture_id, count(*) AS samples, count(*) FILTER (WHERE same) AS agreeing, bool_and(same) AS ok FROM j GROUP BY fixture_id""",
}
