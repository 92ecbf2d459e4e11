"""Queries of the audit, clean and compare family over marked texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.text import pictographic_ranges, utf16_length
from quillspark.operators import hidden, metadata
from quillspark.plans import inject


def _sql_class(ranges):
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


EMOJI = _sql_class(pictographic_ranges())
JOINING = "[" + "".join(f"\\p{{{s}}}" for s in rules.JOINING_SCRIPTS) + "]"


def _sql_in(ranges):
    return "(" + " OR ".join(f"cp BETWEEN {a} AND {b}" for a, b in ranges) + ")"


#: Every character with its neighbours, and the targeted ones that no context protects.
CHARS = rf"""{inject.DOCS_SQL},
ch AS (SELECT doc_id, lang, unnest(regexp_extract_all(t, '(?s).')) AS c, generate_subscripts(regexp_extract_all(t, '(?s).'), 1) - 1 AS pos FROM inj),
nb AS (SELECT *, unicode(c) AS cp, lag(c) OVER w AS prev, lead(c) OVER w AS nxt,
  max(CASE WHEN regexp_matches(c, '{EMOJI}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS near8,
  sum(CASE WHEN unicode(c) > 65535 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto
  FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cl AS (SELECT *, CASE {" ".join(f"WHEN {_sql_in(r)} THEN '{n}'" for n, _, r in rules.UNICODE_CLASSES)} END AS rule_id FROM nb),
hit AS (SELECT * FROM cl WHERE rule_id IS NOT NULL AND NOT (cp = 65279 AND pos = 0)
  AND NOT (cp IN (8204, 8205) AND coalesce(regexp_matches(prev, '{JOINING}'), false) AND coalesce(regexp_matches(nxt, '{JOINING}'), false))
  AND NOT ((cp = 8205 OR cp BETWEEN 65024 AND 65039) AND (coalesce(regexp_matches(prev, '{EMOJI}'), false) OR coalesce(regexp_matches(nxt, '{EMOJI}'), false)))
  AND NOT (cp BETWEEN 917504 AND 917631 AND coalesce(near8, 0) = 1))"""
FINDINGS = f"""{CHARS},
fd AS (SELECT doc_id, any_value(lang) AS lang, rule_id, CASE WHEN rule_id IN ('unicode.exotic_space', 'unicode.variation_selector') THEN 'probable' ELSE 'confirmed' END AS confidence,
  'U+' || lpad(printf('%X', cp), greatest(4, length(printf('%X', cp)))::INTEGER, '0') AS code_point, count(*)::BIGINT AS n, min(pos) AS first, min(upto - CASE WHEN cp > 65535 THEN 2 ELSE 1 END)::BIGINT AS off
  FROM hit GROUP BY doc_id, rule_id, cp)"""


def _findings(spark, sf):
    return hidden.scan(inject.documents(spark, sf))


def unicode_scan(spark, sf):
    return _findings(spark, sf).withColumnRenamed("count", "n").withColumnRenamed("offset", "utf16_offset")


def unicode_totals_by_lang(spark, sf):
    docs = inject.documents(spark, sf)
    return hidden.scan(docs, keep=("lang",)).groupBy("lang", "rule_id", "confidence").agg(F.count_distinct("doc_id").alias("docs"), F.sum("count").alias("n"))


def clean_text_hash(spark, sf):
    return inject.documents(spark, sf).select("doc_id", F.sha2(hidden.clean(F.col("text")), 256).alias("clean_sha256"))


def clean_counts(spark, sf):
    return hidden.removed_counts(inject.documents(spark, sf))


def finding_diff(spark, sf):
    docs = inject.documents(spark, sf)
    # what is compared with is the cleaned text, in which one document of three was not cleaned
    after = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(hidden.clean(F.col("text"))))
    channel = F.lit("unicode")
    found = hidden.compare_findings(hidden.scan(docs).withColumn("channel", channel), hidden.scan(after).withColumn("channel", channel))
    return found.drop("member", "channel")


def _targets(docs):
    return docs.select(F.col("source").alias("run_id"), "doc_id", F.when(F.length("text") > 12000, "degraded").otherwise("complete").alias("status"))


def audit_status(spark, sf):
    docs = inject.documents(spark, sf)
    findings = hidden.scan(docs, keep=("source",)).select(F.col("source").alias("run_id"))
    errors = docs.filter("doc_id % 97 = 0").select(F.col("source").alias("run_id"), F.when(F.col("doc_id") % 2 == 0, "remote_unsupported").otherwise("unsafe_path").alias("code"))
    return metadata.fold_status(findings, errors, _targets(docs))


def metadata_lines(spark, sf):
    return metadata.front_matter_findings(inject.documents(spark, sf))


def html_meta_tags(spark, sf):
    return metadata.html_meta_tags(inject.pages(spark, sf))


def html_data_attrs(spark, sf):
    return metadata.html_ai_attributes(inject.pages(spark, sf))


def data_uri_inventory(spark, sf):
    return metadata.data_uris(inject.pages(spark, sf)).select("page_id", "target", "declared", "bytes", "actual", "error")


def text_format_class(spark, sf):
    docs = inject.documents(spark, sf).select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "a.MD").otherwise("a.txt").alias("name"), "text")
    pages = inject.pages(spark, sf).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.lit("misleading.bin").alias("name"), F.col("html").alias("text"))
    return docs.unionByName(pages).select("kind", "id", metadata.text_format(F.col("name"), F.col("text")).alias("format"))


def front_matter_values(spark, sf):
    return metadata.front_matter_values(inject.documents(spark, sf), "doc_id")


def front_matter_clean(spark, sf):
    docs = inject.documents(spark, sf)
    cleaned = hidden.clean_front_matter(F.col("text"))
    return docs.select("doc_id", F.sha2(cleaned, 256).alias("clean_sha256"), F.sha2(metadata.strip_front_matter(F.col("text")), 256).alias("body_sha256"))


def writing_policy(spark, sf):
    docs = inject.documents(spark, sf)
    marked = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("a — b\nc – d –\n"), "text")).otherwise(F.col("text")))
    return hidden.writing_policy(marked).withColumnRenamed("count", "n").withColumn("line", F.col("line").cast("long"))


def content_digests(spark, sf):
    docs = inject.documents(spark, sf)
    return docs.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"), utf16_length(F.col("text")).cast("long").alias("utf16_units"))


def sarif_results(spark, sf):
    found = _findings(spark, sf)
    return found.groupBy("rule_id", metadata.sarif_level(F.col("confidence")).alias("level")).agg(F.count("*").alias("results"), F.sum("count").alias("occurrences"))


def clean_outcomes(spark, sf):
    """Per document that had removals: not removed, removed but other findings remain, removed and verified."""
    docs = inject.documents(spark, sf)
    after = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(hidden.clean(F.col("text"))))
    left = hidden.scan(after).groupBy("doc_id").agg(F.sum(F.when(F.col("confidence") == "confirmed", F.col("count")).otherwise(0)).alias("confirmed"), F.count("*").alias("left"))
    acted = hidden.removed_counts(docs).groupBy("doc_id").agg(F.sum("removed").alias("removed"))
    told = F.when(F.coalesce("confirmed", F.lit(0)) > 0, "not_removed").when(F.coalesce("left", F.lit(0)) > 0, "removed_degraded").otherwise("removed_verified")
    return acted.join(left, "doc_id", "left").select("doc_id", "removed", told.alias("outcome"))


QUERIES = {f.__name__: f for f in (
    unicode_scan, unicode_totals_by_lang, clean_text_hash, clean_counts, finding_diff, audit_status, metadata_lines, html_meta_tags, html_data_attrs, data_uri_inventory,
    text_format_class, front_matter_values, front_matter_clean, writing_policy, content_digests, sarif_results, clean_outcomes,
)}

_REMOVABLE = _sql_in(rules.REMOVABLE)
_CLEANED = f"""{CHARS},
gone AS (SELECT doc_id, pos FROM hit WHERE {_REMOVABLE}),
cleaned AS (SELECT doc_id, coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE g.pos IS NULL), '') AS t FROM ch LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id)"""
ORACLES = {
    "unicode_scan": f"WITH {FINDINGS} SELECT doc_id, rule_id, confidence, code_point, n, off AS utf16_offset, len(string_split(left(t, first), chr(10)))::BIGINT AS line, (length(string_split(left(t, first), chr(10))[-1]) + length(regexp_replace(string_split(left(t, first), chr(10))[-1], '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) + 1)::BIGINT AS \"column\" FROM fd JOIN inj USING (doc_id)",
    "unicode_totals_by_lang": f"WITH {FINDINGS} SELECT lang, rule_id, confidence, count(DISTINCT doc_id) AS docs, sum(n)::BIGINT AS n FROM fd GROUP BY ALL",
    "clean_text_hash": f"WITH {_CLEANED} SELECT doc_id, sha256(t) AS clean_sha256 FROM cleaned",
    "clean_counts": f"WITH {FINDINGS} SELECT doc_id, code_point, n AS removed, 0::BIGINT AS replaced FROM fd WHERE confidence = 'confirmed'",
    "finding_diff": f"WITH {FINDINGS} SELECT doc_id, rule_id, confidence, code_point, n AS before, CASE WHEN doc_id % 3 = 0 OR confidence = 'probable' THEN n ELSE 0 END AS after, CASE WHEN doc_id % 3 = 0 OR confidence = 'probable' THEN n ELSE 0 END AS remaining, CASE WHEN doc_id % 3 = 0 OR confidence = 'probable' THEN 0 ELSE n END AS removed, 0::BIGINT AS added FROM fd",
    "audit_status": f"""WITH {FINDINGS},
r AS (SELECT source AS run_id, max(CASE WHEN length(t) > 12000 THEN 2 ELSE 0 END) AS r FROM inj GROUP BY 1
 UNION ALL SELECT source, 1 FROM fd JOIN inj USING (doc_id)
 UNION ALL SELECT source, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 3 END FROM inj WHERE doc_id % 97 = 0)
SELECT run_id, ['clear', 'findings', 'degraded', 'unsafe', 'error'][max(r) + 1] AS status, [0, 1, 2, 64, 70][max(r) + 1]::INTEGER AS exit_code FROM r GROUP BY run_id""",
    "metadata_lines": f"""WITH {inject.DOCS_SQL}, b AS (SELECT doc_id, regexp_extract(t, '^---\\n(.|\\n)*?\\n---\\n') AS fm FROM inj WHERE t LIKE '---%'),
l AS (SELECT doc_id, unnest(string_split(fm, chr(10))) AS s, generate_subscripts(string_split(fm, chr(10)), 1) AS line FROM b)
SELECT doc_id, line::BIGINT AS line, 'metadata.generator' AS rule_id, 'informational' AS confidence, trim(s)[1:240] AS evidence FROM l WHERE regexp_matches(lower(s), '{rules.FIELD}')""",
    "html_meta_tags": f"""WITH {inject.PAGES_SQL}, m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<meta\\b[^>]*(?:name|property)=["''](?:generator|author|provenance|ai[^"'']*)["''][^>]*>')) AS tag FROM pg)
SELECT page_id, 1::BIGINT AS line, CASE WHEN regexp_matches(tag, '(?i){rules.PROVENANCE}') THEN 'metadata.provenance' ELSE 'metadata.generator' END AS rule_id, CASE WHEN regexp_matches(tag, '(?i){rules.PROVENANCE}') THEN 'probable' ELSE 'informational' END AS confidence, tag[1:240] AS evidence FROM m WHERE regexp_matches(tag, '(?i){rules.FIELD}')""",
    "html_data_attrs": f"""WITH {inject.PAGES_SQL} SELECT page_id, 'metadata.provenance' AS rule_id, 'confirmed' AS confidence, unnest(regexp_extract_all(html, '(?i)\\bdata-ai[^=\\s>]*=(?:"[^"]*"|''[^'']*'')'))[1:240] AS evidence FROM pg""",
    "data_uri_inventory": f"""WITH {inject.PAGES_SQL}, u AS (SELECT page_id, regexp_extract_all(html, '(?i)data:image/(png|jpe?g|webp|gif|bmp|tiff|avif|heic);base64,([a-z0-9+/=]+)', 1) AS k, regexp_extract_all(html, '(?i)data:image/(png|jpe?g|webp|gif|bmp|tiff|avif|heic);base64,([a-z0-9+/=]+)', 2) AS c FROM pg),
e AS (SELECT page_id, unnest(k) AS declared, unnest(c) AS code, generate_subscripts(k, 1) AS n FROM u)
SELECT page_id, page_id || '#data-uri-' || n AS target, lower(declared) AS declared, octet_length(from_base64(code))::BIGINT AS bytes, CASE WHEN hex(from_base64(code))[1:16] = '89504E470D0A1A0A' THEN 'png' END AS actual, CASE WHEN hex(from_base64(code))[1:16] <> '89504E470D0A1A0A' THEN 'data_uri_mismatch' END AS error FROM e""",
    "text_format_class": f"""WITH {inject.DOCS_SQL}, {inject.PAGES_SQL} SELECT 'doc' AS kind, doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'markdown' WHEN lower(ltrim(t)) LIKE '<svg%' THEN 'svg' WHEN lower(ltrim(t)) LIKE '<html%' OR lower(ltrim(t)) LIKE '<!doctype html%' THEN 'html' ELSE 'text' END AS format FROM inj
UNION ALL SELECT 'page', page_id, CASE WHEN lower(ltrim(html)) LIKE '<svg%' THEN 'svg' WHEN lower(ltrim(html)) LIKE '<html%' OR lower(ltrim(html)) LIKE '<!doctype html%' THEN 'html' ELSE 'text' END FROM pg""",
    "front_matter_values": f"""WITH {inject.DOCS_SQL}, l AS (SELECT doc_id, unnest(string_split(regexp_extract(t, '^---\\n((.|\\n)*?)\\n---\\n', 1), chr(10))) AS s, generate_subscripts(string_split(regexp_extract(t, '^---\\n((.|\\n)*?)\\n---\\n', 1), chr(10)), 1) AS n FROM inj WHERE t LIKE '---%')
SELECT doc_id, trim(string_split(s, ':')[1]) AS key, arg_min(trim(regexp_replace(s, '^[^:]*:', '')), n) AS value FROM l WHERE s LIKE '%:%' GROUP BY ALL""",
    "front_matter_clean": f"WITH {inject.DOCS_SQL} SELECT inj.doc_id, sha256(CASE inj.doc_id % 10 WHEN 7 THEN '---' || chr(10) || 'title: y' || chr(10) || '---' || chr(10) || text ELSE t END) AS clean_sha256, sha256(CASE inj.doc_id % 10 WHEN 7 THEN text ELSE t END) AS body_sha256 FROM inj JOIN documents USING (doc_id)",
    "writing_policy": f"""WITH {inject.DOCS_SQL}, m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'a ' || chr(8212) || ' b' || chr(10) || 'c ' || chr(8211) || ' d ' || chr(8211) || chr(10) || t ELSE t END AS t FROM inj),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM m),
c AS (SELECT doc_id, line, unnest(regexp_extract_all(s, '[\\x{{2013}}\\x{{2014}}]|{EMOJI}')) AS c FROM l)
SELECT doc_id, line::BIGINT AS line, 'U+' || lpad(printf('%X', unicode(c)), greatest(4, length(printf('%X', unicode(c))))::INTEGER, '0') AS code_point, count(*) AS n FROM c GROUP BY ALL""",
    "content_digests": f"WITH {inject.DOCS_SQL} SELECT doc_id, sha256(t) AS sha256, octet_length(encode(t))::BIGINT AS bytes, (length(t) + length(regexp_replace(t, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))::BIGINT AS utf16_units FROM inj",
    "sarif_results": f"WITH {FINDINGS} SELECT rule_id, CASE confidence WHEN 'confirmed' THEN 'error' ELSE 'warning' END AS level, count(*) AS results, sum(n)::BIGINT AS occurrences FROM fd GROUP BY ALL",
    "clean_outcomes": f"WITH {FINDINGS}, a AS (SELECT doc_id, sum(n) FILTER (WHERE confidence = 'confirmed') AS removed, count(*) FILTER (WHERE confidence <> 'confirmed') AS other FROM fd GROUP BY doc_id) SELECT doc_id, removed::BIGINT AS removed, CASE WHEN doc_id % 4 = 0 THEN 'not_removed' WHEN other > 0 THEN 'removed_degraded' ELSE 'removed_verified' END AS outcome FROM a WHERE removed > 0",
}
