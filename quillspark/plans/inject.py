"""Deterministic test marks: the driver's texts hold no hidden characters, so queries put some in by key, alike in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRONT = "---\ngenerator: x\ntitle: y\n---\n"
SCAFFOLD = "[Fill in: a]\nAlternate 1: b\n\n# One\n# Two\n"


def marked(text: Column, key: Column) -> Column:
    cut = lambda *at: F.concat(*at)
    sub = lambda a, n=1 << 30: F.substring(text, a, n)
    k = key % 10
    return (
        F.when(k == 0, cut(sub(1, 3), F.lit("​"), sub(4, 2), F.lit("​"), sub(6)))
        .when(k == 1, cut(sub(1, 2), F.lit("‮"), sub(3)))
        .when(k == 2, cut(sub(1, 4), F.lit("\U000e0041"), sub(5)))
        .when(k == 3, cut(sub(1, 1), F.lit(" "), sub(2)))
        .when(k == 4, cut(F.lit("﻿"), sub(1, 6), F.lit("﻿"), sub(7)))
        .when(k == 5, cut(F.lit("क‌ष"), text))
        .when(k == 6, cut(F.lit("\U0001f469‍\U0001f4bb​"), text))
        .when(k == 7, cut(F.lit(FRONT), text))
        .when(k == 8, cut(F.lit(SCAFFOLD), text))
        .otherwise(text)
    )


MARKED = """CASE doc_id % 10
  WHEN 0 THEN substr(text, 1, 3) || chr(8203) || substr(text, 4, 2) || chr(8203) || substr(text, 6)
  WHEN 1 THEN substr(text, 1, 2) || chr(8238) || substr(text, 3)
  WHEN 2 THEN substr(text, 1, 4) || chr(917569) || substr(text, 5)
  WHEN 3 THEN substr(text, 1, 1) || chr(160) || substr(text, 2)
  WHEN 4 THEN chr(65279) || substr(text, 1, 6) || chr(65279) || substr(text, 7)
  WHEN 5 THEN chr(2325) || chr(8204) || chr(2359) || text
  WHEN 6 THEN chr(128105) || chr(8205) || chr(128187) || chr(8203) || text
  WHEN 7 THEN '---' || chr(10) || 'generator: x' || chr(10) || 'title: y' || chr(10) || '---' || chr(10) || text
  WHEN 8 THEN '[Fill in: a]' || chr(10) || 'Alternate 1: b' || chr(10) || chr(10) || '# One' || chr(10) || '# Two' || chr(10) || text
  ELSE text END"""
DOCS_SQL = f"inj AS (SELECT doc_id, lang, source, {MARKED} AS t FROM documents)"


def documents(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", "lang", "source", marked(F.col("text"), F.col("doc_id")).alias("text"))


PNG = "iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg=="
TAG, ATTR, URI = '<meta name="generator" content="ai-tool">', '<p data-ai-source="x">', f'<img src="data:image/png;base64,{PNG}">'


def pages(spark, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    mark = F.when(k == 0, TAG).when(k == 1, ATTR).when(k == 2, URI).otherwise("")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.concat("html", mark).alias("html"))


PAGES_SQL = f"pg AS (SELECT page_id, url, html || CASE page_id % 4 WHEN 0 THEN '{TAG}' WHEN 1 THEN '{ATTR}' WHEN 2 THEN '{URI}' ELSE '' END AS html FROM pages)"
