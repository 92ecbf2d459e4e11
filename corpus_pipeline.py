"""The corpus pipeline: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run() writes
each stage's result to the shared folder and gives it, read again, to the next.

- quality classifier: documents that score under the threshold of operator 4 go.
- SimHash near-dedup: of each group of near copies the document with the smallest doc_id stays.
- benchmark decontamination: documents that hold an item of the benchmark go.
- mixing: each document stays once for each time that the mix takes it, rounded to whole documents (the mix of operator 8
  takes whole passes of a source and one last part of a pass, whose border cuts at most one document per source), so texts
  stay whole; a document that the mix doesn't reach goes.
- token-ID output: the documents as token-ID shards, read back: one row per document written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.decontamination import decontaminate
from quillspark.llm.mixing import mix
from quillspark.llm.near_dedup import near_dedup
from quillspark.llm.quality_crf import fit, keep_good
from quillspark.llm.shared import carry_modules, cut, free_name
from quillspark.llm.token_output import read_digests, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one doc_id stay as often as the one of them that the mix takes most."""
    key, times, each = (free_name(n, docs.columns) for n in ("_id", "_times", "_pass"))
    taken = mix(docs).groupBy(F.col("doc_id").alias(key)).agg(F.max(F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0)).cast("int").alias(times))
    joined = docs.join(taken.filter(F.col(times) > 0), docs["doc_id"].eqNullSafe(F.col(key)))
    return joined.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(docs[c] for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return read_digests(write_tokens(docs))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", contamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    carry_modules(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # a trained classifier, SimHash and a tokenizer have no SQL; tests compare the stages with brute force
