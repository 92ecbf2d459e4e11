"""Queries of report formatting, address checks and payload checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions import text as tx
from quillspark.operators import hidden, reports
from quillspark.plans import inject
from quillspark.plans.audit import FINDINGS, _sql_in


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ip():
    e = F.col("event_id")
    return F.when(e % 11 == 0, "999.1.1.1").otherwise(F.concat_ws(".", (e % 256).cast("string"), (F.floor(e / 7) % 256).cast("string"), (F.floor(e / 3) % 256).cast("string"), (e * 13 % 256).cast("string")))


def ip_classes(spark, sf):
    ip = _t(spark, sf, "events").select("event_id", _ip().alias("ip"))
    return ip.select("event_id", reports.ipv4_number(F.col("ip")).alias("number"), reports.is_global_ipv4(F.col("ip")).alias("global"))


def service_urls(spark, sf):
    return _t(spark, sf, "pages").select("page_id", reports.service_url_error(F.col("url")).alias("error"))


def markdown_cells(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.sha2(tx.markdown_escape(F.col("text")), 256).alias("escaped_sha256"))


def report_markdown(spark, sf):
    docs = inject.documents(spark, sf)
    found = hidden.scan(docs, keep=("source",)).withColumnRenamed("source", "run_id").withColumn("target", F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")))
    return reports.markdown(found).select("run_id", F.size(F.split("report", "\n")).cast("long").alias("lines"))


def progress_bars(spark, sf):
    k = F.col("o_orderkey")
    return _t(spark, sf, "orders").select("o_orderkey", tx.progress_bar(k % 13, k % 17).alias("bar"), tx.percent(k % 13, k % 17).alias("percent"))


def code_point_labels(spark, sf):
    n = F.col("o_orderkey") * 37 % 1_114_112
    return _t(spark, sf, "orders").select("o_orderkey", tx.code_point_label(n).alias("label"), tx.unicode_class(n).alias("rule_id"))


def remote_hits(spark, sf):
    e = F.col("event_id")
    hit = F.struct(F.when(e % 5 == 0, "other").otherwise("zero_width").alias("kind"), (e % 4).alias("count"), F.array_repeat(e % 50, (e % 3).cast("int")).alias("offsets"))
    return _t(spark, sf, "events").withColumn("h", hit).select("event_id", reports.hit_errors(F.col("h.kind"), F.col("h.count"), F.col("h.offsets"), F.lit(40), ["zero_width", "bidi"]).alias("error"))


QUERIES = {f.__name__: f for f in (ip_classes, service_urls, markdown_cells, report_markdown, progress_bars, code_point_labels, remote_hits)}


def _range(network, bits):
    a, b, c, d = map(int, network.split("."))
    low = ((a << 24) | (b << 16) | (c << 8) | d) >> (32 - bits) << (32 - bits)
    return f"number BETWEEN {low} AND {low + (1 << (32 - bits)) - 1}"


ORACLES = {
    "ip_classes": f"WITH n AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN (event_id % 256) * 16777216 + (event_id // 7 % 256) * 65536 + (event_id // 3 % 256) * 256 + event_id * 13 % 256 END AS number FROM events) SELECT event_id, number, coalesce(NOT ({' OR '.join(_range(*r) for r in reports.SPECIAL_RANGES)}), false) AS global FROM n",
    "service_urls": "SELECT page_id, CASE WHEN contains(url, '?') OR contains(url, '#') THEN 'query_or_fragment' WHEN url LIKE 'http://%' THEN 'plain_http' END AS error FROM pages",
    "markdown_cells": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\r?\n|\r', ' ', 'g'), '([\\`*\[\]{}#|<>])', '\\\1', 'g')) AS escaped_sha256 FROM documents",
    "report_markdown": f"WITH {FINDINGS} SELECT source AS run_id, count(*)::BIGINT + 5 AS lines FROM fd JOIN documents USING (doc_id) GROUP BY source",
    "progress_bars": "WITH o AS (SELECT o_orderkey, o_orderkey % 13 AS d, o_orderkey % 17 AS t FROM orders), k AS (SELECT *, CASE WHEN t > 0 THEN greatest(0, least(10, floor(d / t * 10 + 0.5)))::INTEGER ELSE 0 END AS k FROM o) SELECT o_orderkey, repeat('█', k) || repeat('░', 10 - k) AS bar, CASE WHEN t > 0 THEN floor(d / t * 100 + 0.5)::BIGINT ELSE 0 END AS percent FROM k",
    "code_point_labels": f"WITH c AS (SELECT o_orderkey, o_orderkey * 37 % 1114112 AS cp FROM orders) SELECT o_orderkey, 'U+' || lpad(printf('%X', cp), greatest(4, length(printf('%X', cp)))::INTEGER, '0') AS label, CASE {' '.join(f'WHEN {_sql_in(r)} THEN {n!r}' for n, _, r in rules.UNICODE_CLASSES)} END AS rule_id FROM c",
    "remote_hits": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'kind' WHEN event_id % 4 <> event_id % 3 THEN 'count' WHEN event_id % 3 > 0 AND event_id % 50 >= 40 THEN 'offsets' END AS error FROM events",
}
