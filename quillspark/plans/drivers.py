"""Queries of the drivers and look-ups: audit, cleaning, collection, translation memory, addresses, remote records, manifests, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.operators import audit, cleaning, hidden, intervals, manifest, network, records, reports, translation
from quillspark.plans import inject
from quillspark.plans.audit import FINDINGS
from quillspark.sources import collect


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tm_lookup(spark, sf):
    """Sentences of the benchmark as a memory, looked up in all documents."""
    items = translation.segments(_t(spark, sf, "benchmark"), ["item_id"], "text")
    memory = items.select(F.col("segment").alias("source"), F.concat(F.lit("item "), "item_id", F.lit("/"), "para", F.lit("/"), "sent").alias("target"), F.lit(1.0).alias("confidence"))
    found = translation.lookup(_t(spark, sf, "documents").select("doc_id", "text"), memory, "doc_id", "text")
    return found.select("doc_id", F.md5("source").alias("source_md5"), "target", "confidence")


def _targets(spark, sf):
    """Documents and pages as targets, in one table."""
    docs = inject.documents(spark, sf).select(F.concat(F.lit("doc-"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".txt")).alias("name"), "text")
    pages = inject.pages(spark, sf).select(F.concat(F.lit("page-"), "page_id", F.lit(".html")).alias("name"), F.col("html").alias("text"))
    return docs.unionByName(pages).withColumn("path", F.col("name"))


def audit_report(spark, sf):
    return audit.audit(_targets(spark, sf), "path", "name", "text", strict=True).drop("container", "message")


def audit_status_by_kind(spark, sf):
    report = audit.audit(_targets(spark, sf), "path", "name", "text")
    return audit.status_of(report.withColumn("run_id", F.concat(F.substring_index("target", "-", 1), F.lit("-"), F.substring(F.regexp_extract("target", r"-(\d+)", 1), -1, 1))), ["run_id"])


def clean_totals(spark, sf):
    docs = inject.documents(spark, sf).withColumn("name", F.when(F.col("doc_id") % 3 == 0, "a.md").otherwise("a.txt"))
    done = cleaning.clean_targets(docs, "doc_id", "name", "text")
    return done.select(F.col("target").alias("doc_id"), "format", "sha256", "clean_sha256", *(f"{k}_count" for k in cleaning.TOTALS), "status", "outcome")


#: Caps of the walk that the query takes: they are what it reports on.
CAPS = {"files": 1 << 40, "bytes": 1_500_000, "depth": 8, "directories": 64}


def collect_walk(spark, sf):
    """Documents as the files of four languages' trees, walked until their bytes pass the cap."""
    docs = _t(spark, sf, "documents").withColumn("rel_path", F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.when(F.col("doc_id") % 50 == 7, "/.cache/x").otherwise("")))
    entries = None
    for k, lang in enumerate(("fr", "en", "de", "es")):
        one = collect.listing(docs.filter(F.col("lang") == lang).select("rel_path", F.col("n_chars").alias("length")), lang, k)
        entries = entries.unionByName(one) if entries else one
    files, errors, totals = collect.collect(entries, CAPS)
    none = F.lit(None).cast("string")
    return (
        files.select(F.lit("file").alias("kind"), F.col("path").alias("what"), none.alias("at"), F.col("length").alias("n"))
        .unionByName(errors.select(F.lit("error").alias("kind"), F.col("code").alias("what"), "at", F.lit(None).cast("long").alias("n")))
        .unionByName(totals.select(F.lit("total").alias("kind"), F.lit("files").alias("what"), none.alias("at"), F.col("files").alias("n")))
        .unionByName(totals.select(F.lit("total").alias("kind"), F.lit("bytes").alias("what"), none.alias("at"), F.col("bytes").alias("n")))
    )


def _addresses(spark, sf):
    """An address of one of eight spellings for each event."""
    ev = _t(spark, sf, "events")
    h = lambda c: F.lower(F.hex(c.cast("long")))
    a, b, k = F.col("event_id") % 40, F.col("user_id") % 65536, F.col("event_id") % 8
    dotted = lambda first: F.concat_ws(".", F.lit(first), *((F.col("event_id") / d).cast("long").alias("x") % 256 for d in (3, 7)), F.lit("9"))
    text = (
        F.when(k == 0, F.concat(F.lit("2001:db8:"), h(a), F.lit("::"), h(b))).when(k == 1, F.concat(F.lit("2A00:1450:"), F.upper(h(a)), F.lit(":"), F.upper(h(b)), F.lit(":0:00:000:1")))
        .when(k == 2, F.concat(F.lit("::ffff:"), dotted("10"))).when(k == 3, F.concat(F.lit("2002:"), h(b), F.lit("::1"))).when(k == 4, F.concat(F.lit("fe80::"), h(b)))
        .when(k == 5, dotted("8")).when(k == 6, F.concat(F.lit("1:2:3:"), h(b))).otherwise(F.concat(F.lit("2a03:2880::"), h(a), F.lit(":0:"), h(b)))
    )
    return ev.select("event_id", text.alias("address"))


def ip_networks(spark, sf):
    """The longest known network of each event's address, and whether the address is global unicast."""
    nations = _t(spark, sf, "nation")
    own = nations.select(F.concat(F.lit("2001:db8:"), F.lower(F.hex(F.col("n_nationkey").cast("long"))), F.lit("::")).alias("network"), F.lit(48).alias("bits"), F.col("n_name").alias("label"))
    fixed = [(n, b, "special") for n, b in (*network.SPECIAL_IPV4, *network.SPECIAL_IPV6, ("fe80::", 10), ("::ffff:0:0", 96))] + [("2000::", 3, "global"), ("2a03:2880::", 29, "wide"), ("8.0.0.0", 9, "half")]
    table = own.unionByName(spark.createDataFrame(fixed, "network string, bits int, label string"))
    read = _addresses(spark, sf).select("*", F.explode(F.array(network.address_hex(F.col("address")))).alias("digits"))  # worked out once a row
    found = network.longest_prefix(read, "address", table, "digits")
    return found.select("event_id", "digits", network.is_global(F.col("address"), F.col("digits")).alias("global"), "network", "bits", "label")


def provider_findings(spark, sf):
    """Inspection records of ten shapes made from events, eight of them with a fault or more."""
    ev = _t(spark, sf, "events").withColumn("k", F.col("event_id") % 10)
    q, k = lambda s: F.lit(s), F.col("k")
    count = F.when(k == 3, "0").when(k == 8, '"3"').otherwise((F.col("user_id") % 5 + 1).cast("string"))
    kind = F.when(k == 4, "unknown").otherwise("zwj_family")
    at = F.when(k == 5, (F.col("event_id") % 100 + 20).cast("string")).otherwise((F.col("event_id") % 20).cast("string"))
    hit = F.concat(q('{"codepoint":"U+200B","label":"zero width","count":'), count, q(',"kind":"'), kind, q('","confidence":"probable","sample_offsets":['), at, F.when(k == 1, "]").when(k == 2, '],"more":1').otherwise("]"), q("}"))
    hit = F.when(k == 1, F.regexp_replace(hit, '"label":"zero width",', "")).otherwise(hit)
    two = q(',{"codepoint":"u+00a0","label":"space","count":2,"kind":"space","confidence":"informational","sample_offsets":[]}')
    record = F.concat(q('{"has_c2pa":'), F.when(F.col("value") > 20, "true").otherwise("false"), q(',"hits":['), hit, F.when(k == 6, two).otherwise(""), q("]"), F.when(k == 9, ',"findings":["free text"],"stylometry":{}').otherwise(""), F.when(k == 7, "").otherwise("}"))
    df = ev.select("event_id", F.try_parse_json(record).alias("record"), F.lit(20).cast("long").alias("length"))
    return records.provider_findings(df, "event_id", "record", "length").withColumnRenamed("offset", "at")


def json_depth(spark, sf):
    """Depth and nodes of events' JSON: as it is, wrapped, cut off, a lone text with brackets in it, nested by key, missing."""
    ev, k = _t(spark, sf, "events"), F.col("event_id") % 6
    deep = (F.col("event_id") % 40).cast("int")
    js = (
        F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), "props", F.lit(', [], ["]", '), "props", F.lit("]]"))).when(k == 2, F.expr("substring(props, 1, length(props) - 1)"))
        .when(k == 3, '"a [ b \\" { c"').when(k == 4, F.concat(F.repeat(F.lit("["), deep), "props", F.repeat(F.lit("]"), deep)))
    )
    return records.json_complexity(ev.select("event_id", js.alias("js")), "event_id", "js")


def manifest_digest(spark, sf):
    return manifest.multiset_digest(_t(spark, sf, "documents").select("source", "doc_id", "lang", "text", "n_chars"), ["source"])


def interval_overlaps(spark, sf):
    """Stretches of each user's events (ten seconds for each unit of value), and whether they overlap another one."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    ev = _t(spark, sf, "events").select("user_id", "event_id", start.alias("start"), (start + F.round(F.col("value") * 10_000_000).cast("long")).alias("end"))
    return intervals.overlapping(ev, ["user_id"], "start", "end").select("user_id", "event_id", "overlaps")


def report_lines(spark, sf):
    found = hidden.scan(inject.documents(spark, sf), keep=("source",)).withColumnRenamed("doc_id", "target")
    return reports.markdown_lines(found, "source").select(F.col("source").alias("run_id"), "line", "text")


QUERIES = {f.__name__: f for f in (tm_lookup, audit_report, audit_status_by_kind, clean_totals, collect_walk, ip_networks, provider_findings, json_depth, manifest_digest, interval_overlaps, report_lines)}

#: FINDINGS over documents and pages together, by name.
_BOTH = f"""{inject.DOCS_SQL}, {inject.PAGES_SQL},
inj AS (SELECT 'doc-' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END AS doc_id, doc_id AS id, lang, t FROM injd UNION ALL SELECT 'page-' || page_id || '.html', page_id, '', html FROM pg)""".replace("inj AS (SELECT doc_id, lang, source", "injd AS (SELECT doc_id, lang, source", 1)
_ALL = FINDINGS.replace(inject.DOCS_SQL, _BOTH, 1)
_REPORT = f"""WITH {_ALL},
form AS (SELECT doc_id, id, t, CASE WHEN doc_id LIKE '%.md' THEN 'markdown' WHEN lower(ltrim(t)) LIKE '<svg%' THEN 'svg' WHEN doc_id LIKE '%.html' OR lower(ltrim(t)) LIKE '<html%' OR lower(ltrim(t)) LIKE '<!doctype html%' THEN 'html' ELSE 'text' END AS format FROM inj),
uri AS (SELECT doc_id, regexp_extract_all(t, '(?i)data:image/(png|jpe?g|webp|gif|bmp|tiff|avif|heic);base64,([a-z0-9+/=]+)', 2) AS c FROM form),
img AS (SELECT doc_id || '#data-uri-' || n AS target, c[n] AS code FROM uri, unnest(range(1, len(c) + 1)) t(n)),
tag AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?i)<meta\\b[^>]*(?:name|property)=["''](?:generator|author|provenance|ai[^"'']*)["''][^>]*>')) AS tag FROM form WHERE format IN ('html', 'svg')),
r AS (SELECT 'target' AS kind, doc_id AS target, format, octet_length(encode(t))::BIGINT AS bytes, sha256(t) AS sha256, 'text-unicode' AS lane, 'complete' AS status, false AS embedded,
    NULL AS rule_id, NULL AS confidence, NULL AS channel, NULL AS code_point, NULL::BIGINT AS "count", NULL::BIGINT AS line, NULL::BIGINT AS "offset", NULL AS member, NULL AS evidence, NULL AS code FROM form
  UNION ALL SELECT 'target', target, 'png', octet_length(from_base64(code)), sha256(from_base64(code)), 'embedded-raster', 'complete', true, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM img
  UNION ALL SELECT 'finding', doc_id, NULL, NULL, NULL, NULL, NULL, NULL, rule_id, confidence, 'unicode', code_point, n, len(string_split(left(t, first), chr(10))), off, NULL, NULL, NULL FROM fd JOIN inj USING (doc_id)
  UNION ALL SELECT 'finding', doc_id, NULL, NULL, NULL, NULL, NULL, NULL, 'metadata.generator', 'informational', 'metadata', NULL, NULL, 2, NULL, NULL, 'generator: x', NULL FROM form WHERE format = 'markdown' AND id % 10 = 7
  UNION ALL SELECT 'finding', doc_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN regexp_matches(tag, '(?i){rules.PROVENANCE}') THEN 'metadata.provenance' ELSE 'metadata.generator' END, CASE WHEN regexp_matches(tag, '(?i){rules.PROVENANCE}') THEN 'probable' ELSE 'informational' END, 'metadata', NULL, NULL, 1, NULL, NULL, tag[1:240], NULL FROM tag WHERE regexp_matches(tag, '(?i){rules.FIELD}')
  UNION ALL SELECT 'finding', doc_id, NULL, NULL, NULL, NULL, NULL, NULL, 'metadata.provenance', 'confirmed', 'metadata', NULL, NULL, NULL, NULL, NULL, unnest(regexp_extract_all(t, '(?i)\\bdata-ai[^=\\s>]*=(?:"[^"]*"|''[^'']*'')'))[1:240], NULL FROM form WHERE format IN ('html', 'svg'))"""


def _hex_group(x):
    return f"lpad(lower(to_hex(({x})::BIGINT)), 4, '0')"


def _dotted_digits(first):
    two = lambda x: f"lpad(lower(to_hex(({x})::BIGINT)), 2, '0')"
    return f"'00000000000000000000ffff' || {two(first)} || {two('event_id // 3 % 256')} || {two('event_id // 7 % 256')} || '09'"


_A, _B = _hex_group("event_id % 40"), _hex_group("user_id % 65536")
_Z = "'0000'"
_DIGITS = f"""CASE event_id % 8 WHEN 0 THEN '20010db8' || {_A} || {" || ".join([_Z] * 4)} || {_B} WHEN 1 THEN '2a001450' || {_A} || {_B} || '0000000000000001'
  WHEN 2 THEN {_dotted_digits(10)} WHEN 3 THEN '2002' || {_B} || '000000000000000000000001' WHEN 4 THEN 'fe80' || {" || ".join([_Z] * 6)} || {_B}
  WHEN 5 THEN {_dotted_digits(8)} WHEN 6 THEN NULL ELSE '2a032880' || {" || ".join([_Z] * 3)} || {_A} || {_Z} || {_B} END"""


def _bits(x):
    return f"array_to_string(list_transform(range(1, 33), lambda i: list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'], position(substr({x}, i, 1) IN '0123456789abcdef'))), '')"


def _digits_of(text):
    import ipaddress

    n = int(ipaddress.ip_address(text)) + (0 if ":" in text else 0xFFFF << 32)
    return f"{n:032x}"


_FIXED = ", ".join(f"('{n}', {b}, '{label}', '{_digits_of(n)}')" for n, b, label in [(n, b, "special") for n, b in (*network.SPECIAL_IPV4, *network.SPECIAL_IPV6, ("fe80::", 10), ("::ffff:0:0", 96))] + [("2000::", 3, "global"), ("2a03:2880::", 29, "wide"), ("8.0.0.0", 9, "half")])
_SPECIAL_BITS = " OR ".join(f"starts_with(b, '{int(_digits_of(n), 16):0128b}'[1:{bits + (0 if ':' in n else 96)}])" for n, bits in (*network.SPECIAL_IPV4, *network.SPECIAL_IPV6))

ORACLES = {
    "tm_lookup": r"""WITH p AS (SELECT item_id, list_filter(string_split_regex(text, '\n\s*\n'), lambda x: trim(x, ' ' || chr(10)) <> '') AS ps FROM benchmark),
q AS (SELECT item_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS para FROM p),
s AS (SELECT item_id, para, list_filter(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10)) <> '') AS ss FROM q),
m AS (SELECT 'item ' || item_id || '/' || para || '/' || (generate_subscripts(ss, 1) - 1) AS target, unnest(ss) AS source FROM s)
SELECT doc_id, md5(m.source) AS source_md5, target, 1.0::DOUBLE AS confidence FROM documents JOIN m ON contains(text, trim(m.source, ' ' || chr(9) || chr(10) || chr(13)))""",
    "audit_report": f"{_REPORT} SELECT * FROM r",
    "audit_status_by_kind": f"""{_REPORT}, g AS (SELECT string_split(target, '-')[1] || '-' || right(regexp_extract(target, '-(\\d+)', 1), 1) AS run_id, max(CASE WHEN kind = 'finding' THEN 1 ELSE 0 END) AS w FROM r GROUP BY 1)
SELECT run_id, CASE w WHEN 1 THEN 'findings' ELSE 'clear' END AS status, w::INTEGER AS exit_code FROM g""",
    "clean_totals": f"""WITH {FINDINGS}, n AS (SELECT doc_id, sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (WHERE confidence = 'confirmed'), 0)::BIGINT AS gone FROM fd GROUP BY doc_id),
h AS (SELECT doc_id, pos FROM hit WHERE rule_id NOT IN ('unicode.exotic_space', 'unicode.variation_selector')),
c AS (SELECT doc_id, string_agg(c, '' ORDER BY pos) FILTER (WHERE h.pos IS NULL) AS x FROM ch LEFT JOIN h USING (doc_id, pos) GROUP BY doc_id),
a AS (SELECT inj.doc_id, t, inj.doc_id % 3 = 0 AS md, inj.doc_id % 3 = 0 AND inj.doc_id % 10 = 7 AS fm, coalesce(n.n, 0) AS n, coalesce(gone, 0) AS gone, coalesce(x, '') AS x FROM inj LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)),
o AS (SELECT *, CASE WHEN fm THEN replace(x, 'generator: x' || chr(10), '') ELSE x END AS y, CASE WHEN md THEN 'markdown' WHEN lower(ltrim(t)) LIKE '<svg%' THEN 'svg' WHEN lower(ltrim(t)) LIKE '<html%' OR lower(ltrim(t)) LIKE '<!doctype html%' THEN 'html' ELSE 'text' END AS format FROM a)
SELECT doc_id, format, sha256(t) AS sha256, sha256(y) AS clean_sha256, n + fm::BIGINT AS before_count, n - gone AS after_count, gone + fm::BIGINT AS removed_count, n - gone AS remaining_count, 0::BIGINT AS added_count, 'complete' AS status, CASE WHEN t = y THEN 'no_safe_change' ELSE 'removed_verified' END AS outcome FROM o""",
    "collect_walk": f"""WITH f AS (SELECT list_position(['fr', 'en', 'de', 'es'], lang) AS k, lang || '/' || source || '/' || lpad(doc_id::VARCHAR, 12, '0') || CASE WHEN doc_id % 50 = 7 THEN '/.cache/x' ELSE '' END AS path, n_chars AS length FROM documents WHERE lang IN ('fr', 'en', 'de', 'es') AND source IS NOT NULL),
e AS (SELECT k, path, 'file' AS kind, length FROM f UNION SELECT k, array_to_string(string_split(path, '/')[1:d], '/'), 'dir', 0 FROM f, unnest(range(1, len(string_split(path, '/')))) t(d)),
w AS (SELECT *, string_split(path, '/') AS names FROM e WHERE NOT contains('/' || path || '/', '/.cache/')),
c AS (SELECT *, sum(CASE WHEN kind = 'file' THEN length ELSE 0 END) OVER o AS bytes, sum(CASE WHEN kind = 'dir' THEN 1 ELSE 0 END) OVER o AS dirs, row_number() OVER o AS place FROM w WINDOW o AS (ORDER BY k, names, CASE WHEN kind = 'dir' THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, CASE WHEN kind = 'dir' AND dirs > {CAPS["directories"]} THEN 'directory_count_limit' WHEN kind = 'file' AND bytes > {CAPS["bytes"]} THEN 'input_bytes_limit' END AS code FROM c),
s AS (SELECT min(place) AS stop FROM x WHERE code IS NOT NULL),
g AS (SELECT x.* FROM x, s WHERE stop IS NULL OR place <= stop)
SELECT 'file' AS kind, path AS what, NULL AS at, length AS n FROM g WHERE kind = 'file' UNION ALL SELECT 'error', code, path, NULL FROM x, s WHERE place = stop
UNION ALL SELECT 'total', 'files', NULL, count(*) FROM g WHERE kind = 'file' UNION ALL SELECT 'total', 'bytes', NULL, coalesce(sum(length), 0)::BIGINT FROM g WHERE kind = 'file'""",
    "ip_networks": f"""WITH a AS (SELECT event_id, {_DIGITS} AS digits FROM events), n AS (SELECT '2001:db8:' || lower(to_hex(n_nationkey::BIGINT)) || '::' AS network, 48 AS bits, n_name AS label, '20010db8' || {_hex_group("n_nationkey")} || repeat('0000', 5) AS d FROM nation UNION ALL SELECT * FROM (VALUES {_FIXED}) v(network, bits, label, d)),
m AS (SELECT *, left({_bits("d")}, bits + CASE WHEN contains(network, ':') THEN 0 ELSE 96 END) AS p FROM n), b AS (SELECT *, {_bits("digits")} AS b FROM a),
j AS (SELECT event_id, arg_max(struct_pack(network := network, bits := bits, label := label), length(p)) AS x FROM b JOIN m ON starts_with(b, p) GROUP BY event_id)
SELECT event_id, digits, coalesce(CASE WHEN event_id % 8 = 5 THEN NOT ({_SPECIAL_BITS}) ELSE starts_with(b, '001') AND NOT ({_SPECIAL_BITS}) END, false) AS global, x.network AS network, x.bits::INTEGER AS bits, x.label AS label FROM b LEFT JOIN j USING (event_id)""",
    "provider_findings": """WITH e AS (SELECT event_id, event_id % 10 AS k, user_id, value,
    CASE event_id % 10 WHEN 1 THEN 'keys' WHEN 2 THEN 'keys' WHEN 3 THEN 'count' WHEN 4 THEN 'kind' WHEN 5 THEN 'offsets' WHEN 7 THEN 'record' WHEN 8 THEN 'count' END AS error, CASE event_id % 10 WHEN 9 THEN 'provider-freeform,stylometry' ELSE '' END AS ignored FROM events)
SELECT event_id, error, ignored, NULL AS rule_id, NULL AS confidence, NULL AS channel, NULL AS code_point, NULL::BIGINT AS "count", NULL::BIGINT AS at FROM e WHERE error IS NOT NULL
UNION ALL SELECT event_id, NULL, ignored, 'provider.c2pa.present', 'confirmed', 'c2pa', NULL, NULL, NULL FROM e WHERE error IS NULL AND value > 20
UNION ALL SELECT event_id, NULL, ignored, 'provider.unicode.zwj_family', 'probable', 'unicode', 'U+200B', user_id % 5 + 1, event_id % 20 FROM e WHERE error IS NULL
UNION ALL SELECT event_id, NULL, ignored, 'provider.unicode.space', 'informational', 'unicode', 'u+00a0', 2, NULL FROM e WHERE k = 6""",
    "json_depth": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 3 THEN 1 WHEN 4 THEN event_id % 40 + 2 END::BIGINT AS depth, CASE event_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 8 WHEN 3 THEN 1 WHEN 4 THEN event_id % 40 + 2 END::BIGINT AS nodes,
  CASE WHEN event_id % 6 IN (2, 5) THEN 'malformed' WHEN event_id % 6 = 4 AND event_id % 40 > 30 THEN 'too_deep' END AS error FROM events""",
    "manifest_digest": """WITH r AS (SELECT source, ('0x' || substr(md5(concat_ws('|', coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(length(lang) || ':' || lang, '-'), coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-'), coalesce(length(text) || ':' || text, '-'))), 1, 15))::BIGINT AS n FROM documents)
SELECT source, count(*) AS rows, sum(n)::DECIMAL(38, 0) AS row_sum, bit_xor(n) AS row_xor FROM r GROUP BY source""",
    "interval_overlaps": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + round(value * 10000000)::BIGINT AS f FROM events),
o AS (SELECT DISTINCT a.event_id FROM e a JOIN e b ON a.user_id IS NOT DISTINCT FROM b.user_id AND a.event_id <> b.event_id AND a.s < a.f AND b.s < b.f AND a.s < b.f AND b.s < a.f)
SELECT user_id, event_id, event_id IN (SELECT event_id FROM o) AS overlaps FROM e""",
    "report_lines": f"""WITH {FINDINGS}, l AS (SELECT source AS run_id, row_number() OVER (PARTITION BY source ORDER BY fd.doc_id, rule_id, code_point) + 2 AS line, '- ' || fd.doc_id || ' ' || rule_id || ' (' || confidence || ') ' || code_point || ' x' || n AS text FROM fd JOIN documents USING (doc_id)),
s AS (SELECT run_id, count(*) AS n FROM l GROUP BY run_id)
SELECT run_id, line, text FROM l UNION ALL SELECT run_id, 1, '# Findings' FROM s UNION ALL SELECT run_id, 2, '' FROM s UNION ALL SELECT run_id, n + 3, '' FROM s UNION ALL SELECT run_id, n + 4, '{reports.CAVEAT}' FROM s""",
}
