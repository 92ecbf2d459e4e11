"""Every registered query against its SQL twin on the smallest tables; none of them may be empty."""

import glob
import math
import os

import duckdb
import pytest

from quillspark.plans import registry

SF = "/root/testdata/sf0.001"
#: Empty at this size, checked for rows at the next one by hand: thresholds that need more data.
MAY_BE_EMPTY = {"whiplash", "chunk_profile", "unregistered_names", "tempo_runs"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET threads = 2")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, int) and not isinstance(x, bool):
        return round(float(x), 6)
    return x


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


def test_each_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(registry.ORACLES[name])
    want, names = cur.fetchall(), [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert table(df.columns, got) == table(names, want)
    assert got or name in MAY_BE_EMPTY


def test_sentence_runs_of_odd_texts(spark, tmp_path):
    """No row for a text without a sentence, and the white space of the SQL: without the vertical tab, and with its mark U+0001."""
    odd = ["", None, " ", "\n \n", "\t", "\r", "\x0b", "\x01", " \x01\n", ".", "a.\x0b b. c.", "a\x0bb c. d\x0be f. g h.", "a b.\x01 c d. \x01e f.\tg h", "\n\na. b. c.\n", "a.\r\nb!\r\nc?", "a. b. c. d", "a b. c"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = c.execute(registry.ORACLES["sentence_runs"])
    want, names = cur.fetchall(), [d[0] for d in cur.description]
    df = registry.QUERIES["sentence_runs"](spark, str(tmp_path))
    assert table(df.columns, df.collect()) == table(names, want)
    assert {0, 1, 2, 3, 7, 8} == set(range(len(odd))) - {r[0] for r in want}


def test_style_measures_leave_out_texts_of_spaces_and_line_feeds(spark, tmp_path):
    """Such a text has no sentence; counted as one of no words, its mean would divide by zero."""
    spark.createDataFrame([(1, "\n \n"), (2, " "), (3, "\na b. c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.sentences) for r in registry.QUERIES["style_measures"](spark, str(tmp_path)).collect()] == [(3, 2)]
