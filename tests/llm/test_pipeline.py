"""The pipeline's stages on the smallest tables: columns, decisions, and what follows from them."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from quillspark.llm import decontamination, near_dedup, quality_crf, queries
from quillspark.llm.shared import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in pipeline.STAGES:
        out.append(cut(f(spark, out[-1], SF), "test"))
    return out


def test_stages_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_keeps_the_labelled_good(spark, stages):
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = np.mean([(d in kept) == bool(q) for d, q in labels.items()])
    assert right > 0.95


def test_no_near_copies_stay(stages):
    shingled = {}
    for r in stages[2].collect():
        words = (r.text or "").lower().split()
        shingled[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    ids = sorted(shingled)
    close = [(a, b) for a in ids for b in ids if a < b and len(shingled[a] & shingled[b]) >= 0.8 * len(shingled[a] | shingled[b])]
    before = {r.doc_id for r in stages[1].select("doc_id").collect()}
    assert len(ids) < len(before) and not close
    assert near_dedup.near_dedup(stages[2]).count() == len(ids)


def test_no_item_stays(spark, stages):
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [r.doc_id for r in stages[3].collect() if any(i in " ".join((r.text or "").lower().split()) for i in items)]
    assert decontamination.leaks(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def test_mixture_repeats_whole_documents(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = stages[4].collect()
    assert all(before[r.doc_id] == r.text for r in after) and max(np.unique([r.doc_id for r in after], return_counts=True)[1]) <= 2


def test_every_row_is_written(stages):
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    upto = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == upto
        upto += r.n_tokens


ODD = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, _score double, _quality string, _times int, _pass int, root string, digest string, _gone int"


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (1, "", None, "a", 0), (None, "two words", "en", None, 9), (4, "word " * 3000, "en", "a", None), (4, "other words that stay in this row", "en", "b", 3)]])
def test_stages_take_nulls_empty_tables_and_clashing_columns(spark, rows):
    docs = spark.createDataFrame([(*r, 7, "x", 0.5, "q", 1, 2, "r", "d", 3) for r in rows], ODD)
    model = pipeline.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = pipeline.keep_good(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    for f in (pipeline.near_duplicates, pipeline.contamination, pipeline.mixture):
        found = f(spark, docs, SF)
        assert found.columns == docs.columns and (found.count() > 0) == bool(rows)
    assert pipeline.tokens(spark, docs, SF).count() == len(rows)


def test_all_operators_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_python_workers_get_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["rows", "bytes"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('word ', 1000) AS text")
    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    seen = cut(texts.mapInArrow(sizes, "rows long, bytes long"), "test").collect()
    assert sum(r.rows for r in seen) == 3000 and max(r.bytes for r in seen) < 2.2 * 2**20
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == before


def test_quality_writes_whole_rows_in_small_batches(spark, stages):
    kept = quality_crf.keep_good(stages[0], quality_crf.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet")))
    assert kept.inputFiles() and all("quality-kept" in f for f in kept.inputFiles())
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in stages[1].collect())
