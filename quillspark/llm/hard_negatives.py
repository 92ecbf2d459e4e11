"""Operator 11, hard-negative mining over product codes with stored residual norms.

Index. A codebook for each of PARTS parts of the vectors is fitted on at most SAMPLE rows (those with the least hash); it
decides how tight bounds are, never what is found. Every row is coded, and the norm of what its code leaves is stored.

Search. An anchor's product with a row is the sum of PARTS entries of the anchor's lookup tables, give or take the anchor's
norm times the row's residual norm. Rows are dealt to blocks of at most ROWS, the anchors are streamed past each block, and
of a block only rows whose bound reaches the best found so far are multiplied exactly, in integers. The bests of the blocks
(a few rows for each anchor and block) are merged by a window.
1. Positives: of the rows of the anchor's label the TOP best.
2. Negatives: for each positive, of the rows of other labels with a product between LOW and HIGH per cent of the
   positive's, the first NEGATIVES. A row is a candidate if its bounds meet that range and its upper bound reaches the
   range's third best so far.
No row is left out by anything but a bound, so the result is that of all products.

Defined results: rows with a null id or label, a null vector or null or non-finite components take no part; shorter vectors are
filled up with zeros; anchors equal in id, label and vector are one, rows with an anchor's id are not its partners; repeated
rows each take a rank; a component of 65,536 or more is an error; empty tables give an empty result; further columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import cut
from quillspark.llm.vectors import integer_vectors, matrix, squares

TOP, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
PARTS, ENTRIES, SAMPLE, FITS = 16, 64, 4096, 6
#: Rows and bytes of a block at most; anchors and rows that are looked up at once; pairs that are multiplied at once.
ROWS, BYTES, ANCHORS, CHUNK, PAIRS = 1 << 16, 32 << 20, 256, 4096, 1 << 15


def fit(sample: np.ndarray, parts: int = PARTS, entries: int = ENTRIES, times: int = FITS) -> list[np.ndarray]:
    """A codebook for each part of these vectors, by a few of Lloyd's rounds."""
    books = []
    for part in np.array_split(sample, min(parts, sample.shape[1]), 1):
        book = np.unique(part, axis=0)
        book = book[np.linspace(0, len(book) - 1, min(entries, len(book))).astype(int)]
        for _ in range(times):
            code = squares(part, book).argmin(1)
            count = np.bincount(code, minlength=len(book))
            sums = np.zeros(book.shape, np.int64)
            np.add.at(sums, code, part)
            book = np.where(count[:, None] > 0, sums // np.maximum(count, 1)[:, None], book)
        books.append(book)
    return books


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and the norms of what they leave, rounded up."""
    codes, rest = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x))
    for m, (part, book) in enumerate(zip(np.array_split(x, len(books), 1), books)):
        far = squares(part, book)
        codes[:, m] = far.argmin(1)
        rest += far.min(1)
    return codes, np.sqrt(rest) * (1 + 1e-9) + 1e-9


def _coded(width: int, books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (vec_id, label, v) with code and rest."""
        for batch in batches:
            codes, rest = encode(matrix(batch.column(2), width), books)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest)], ["vec_id", "label", "v", "code", "rest"])

    return run


def indexed(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, sample: int = SAMPLE) -> tuple[DataFrame, int, list[np.ndarray]]:
    """The written index (vec_id, label, v, code, rest) of rows (vec_id, label, v), the vectors' width and the codebooks."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    some = [r[0] + [0] * (width - len(r[0])) for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).select("v").collect()]
    books = fit(np.array(some, np.int64).reshape(len(some), width), parts, entries) if some and width else []
    return cut(rows.mapInArrow(_coded(width, books), "vec_id long, label int, v array<int>, code binary, rest double"), "negative-index"), width, books


class Rows:
    """A block of the index."""

    def __init__(self, batches: list[pa.RecordBatch], width: int) -> None:
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: table[name].combine_chunks() if table[name].num_chunks != 1 else table[name].chunk(0)
        self.ids, self.labels, self.rest = (column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "rest"))
        self.v = matrix(column("v"), width).astype(np.int32)
        self.codes = np.frombuffer(b"".join(column("code").to_pylist()), np.uint8).reshape(len(self.ids), -1)


def tables(a: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    """For each part the products of these anchors with its entries."""
    return [part.astype(np.float64) @ book.T.astype(np.float64) for part, book in zip(np.array_split(a, max(1, len(books)), 1), books)]


def bounds(looked: list[np.ndarray], norms: np.ndarray, codes: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all products of anchors and rows."""
    about = np.zeros((len(norms), len(rest)))
    for m, table in enumerate(looked):
        about += table[:, codes[:, m]]
    off = np.outer(norms, rest)
    off += 1e-6 + 1e-9 * np.abs(about)
    return about - off, about + off


def _products(a: np.ndarray, x: np.ndarray, ai: np.ndarray, xi: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(np.einsum("ij,ij->i", a[ai[k : k + PAIRS]], x[xi[k : k + PAIRS]].astype(np.int64)) for k in range(0, len(ai), PAIRS))])


class Best:
    """The first n of each group so far, by falling score, then by id."""

    def __init__(self, groups: int, n: int) -> None:
        self.groups, self.n = groups, n
        self.group, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.last = np.full(groups, -np.inf)  # the n-th score, once there are as many

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group, score, ids = np.concatenate([self.group, group]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        kept = place < self.n
        full = place == self.n - 1
        self.last[group[full]] = score[full]
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]


def _at_least(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th greatest value of each row, or minus infinity."""
    return np.partition(values, -n, 1)[:, -n] if values.shape[1] >= n else np.full(len(values), -np.inf)


def positives(a: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: Rows, books: list[np.ndarray], top: int) -> Best:
    """Of a block, the top rows of each anchor's label."""
    best, norms = Best(len(a), top), np.sqrt((a.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
    for label in np.intersect1d(labels, rows.labels):
        mine, there = np.flatnonzero(labels == label), np.flatnonzero(rows.labels == label)
        looked = tables(a[mine], books)
        for some in np.split(there, range(CHUNK, len(there), CHUNK)):
            low, high = bounds(looked, norms[mine], rows.codes[some], rows.rest[some])
            other = rows.ids[some][None, :] != ids[mine][:, None]
            low[~other] = -np.inf
            least = np.maximum(best.last[mine], _at_least(low, top))
            ai, xi = np.nonzero(other & (high >= least[:, None]))
            ai, xi = mine[ai], some[xi]
            best.add(ai, _products(a, rows.v, ai, xi), rows.ids[xi])
    return best


def negatives(a: np.ndarray, labels: np.ndarray, scores: list[list[int]], rows: Rows, books: list[np.ndarray], n: int, low: int, high: int) -> Best:
    """Of a block, the n first rows of other labels in the range of each positive's score; group: anchor times width plus the positive's place."""
    wide = max(map(len, scores))
    ps = np.array([s + [-1] * (wide - len(s)) for s in scores], np.int64)  # below zero the range is empty
    best = Best(ps.size, n)
    if not wide:
        return best
    floor, most = -((-low * ps) // 100), (high * ps) // 100
    norms, looked = np.sqrt((a.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9), tables(a, books)
    for k in range(0, len(rows.ids), CHUNK):
        some = slice(k, k + CHUNK)
        under, over = bounds(looked, norms, rows.codes[some], rows.rest[some])
        other = rows.labels[some][None, :] != labels[:, None]
        least = np.maximum(best.last.reshape(ps.shape), floor)
        if not k:  # nothing is known yet: what lies in the range for sure sets a first bar
            for j in range(wide):
                sure = other & (under >= floor[:, j : j + 1]) & (over <= most[:, j : j + 1])
                least[:, j] = np.maximum(least[:, j], _at_least(np.where(sure, under, -np.inf), n))
        met = np.zeros(other.shape, bool)
        for j in range(wide):
            met |= (over >= least[:, j : j + 1]) & (under <= most[:, j : j + 1]) & (floor[:, j : j + 1] <= most[:, j : j + 1])
        ai, xi = np.nonzero(met & other)
        score = _products(a, rows.v[some], ai, xi)
        for j in range(wide):
            hit = (score >= np.maximum(floor[ai, j], least[ai, j])) & (score <= most[ai, j])
            best.add(ai[hit] * wide + j, score[hit], rows.ids[some][xi[hit]])
    return best


def _streamed(search, width: int):
    """Rows (block, kind, ...) sorted by block and kind: the block's rows are held, its anchors are streamed past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows = None, [], None
        for batch in batches:
            block, kind = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(block)]):
                if s == e:
                    continue
                if block[s] != now:
                    now, held, rows = block[s], [], None
                if not kind[s]:
                    held.append(batch.slice(s, e - s))
                elif held:
                    rows = rows or Rows(held, width)
                    for k in range(s, e, ANCHORS):
                        yield search(batch.slice(k, min(ANCHORS, e - k)), rows)

    return run


def _dealt(index: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """The index's rows dealt to blocks in turn, and the anchors to every block."""
    own = index.withColumns({"block": F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"), "kind": F.lit(0), "own": F.lit(0).cast("long"), "ids": F.array().cast("array<long>"), "scores": F.array().cast("array<long>")})
    past = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "kind": F.lit(1), "code": F.lit(None).cast("binary"), "rest": F.lit(None).cast("double")})
    names = ["block", "kind", "vec_id", "label", "v", "code", "rest", "own", "ids", "scores"]
    return own.select(names).unionByName(past.select(names)).repartition(blocks, "block").sortWithinPartitions("block", "kind")


def mine(df: DataFrame, anchors: DataFrame, top: int = TOP, n: int = NEGATIVES, low: int = LOW, high: int = HIGH, rows_in_block: int = ROWS, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, place (of the positive, from 0).

    df, anchors: vec_id, label, v (array of int); the anchors are looked for among all rows of df. low, high: per cent, over 0.
    """
    index, width, books = indexed(df, sample=sample)
    asked = cut(anchors.dropDuplicates(["vec_id", "label", "v"]).withColumn("own", F.xxhash64("label", "v")), "negative-anchors")
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, -(-index.count() // max(1, min(rows_in_block, BYTES // (4 * max(1, width))))))

    def first(batch: pa.RecordBatch, rows: Rows) -> pa.RecordBatch:
        a, ids, own = matrix(batch.column(4), width), batch.column(2).to_numpy(), batch.column(7).to_numpy()
        best = positives(a, ids, batch.column(3).to_numpy(), rows, books, top)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[best.group], own[best.group], best.score, best.id)], ["vec_id", "own", "score", "id"])

    def then(batch: pa.RecordBatch, rows: Rows) -> pa.RecordBatch:
        a, scores = matrix(batch.column(4), width), batch.column(9).to_pylist()
        best, wide = negatives(a, batch.column(3).to_numpy(), scores, rows, books, n, low, high), max(map(len, scores))
        k, j = best.group // max(1, wide), best.group % max(1, wide)
        ids = batch.column(8).to_pylist()
        cols = (batch.column(2).to_numpy()[k], batch.column(7).to_numpy()[k], j.astype(np.int32), np.array([ids[x][y] for x, y in zip(k, j)], np.int64), np.array([scores[x][y] for x, y in zip(k, j)], np.int64), best.score, best.id)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["anchor_id", "own", "place", "positive_id", "positive_score", "negative_score", "negative_id"])

    plain = asked.withColumns({"ids": F.array().cast("array<long>"), "scores": F.array().cast("array<long>")})
    found = _dealt(index, plain, blocks).mapInArrow(_streamed(first, width), "vec_id long, own long, score long, id long")
    order = Window.partitionBy("vec_id", "own").orderBy(F.desc("score"), "id")  # top rows of each block at most
    ranked = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    lists = ranked.groupBy("vec_id", "own").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("p"))
    paired = cut(asked.join(lists, ["vec_id", "own"]).select("vec_id", "label", "v", "own", F.col("p.id").alias("ids"), F.col("p.score").alias("scores")), "negative-positives")
    met = _dealt(index, paired, blocks).mapInArrow(_streamed(then, width), "anchor_id long, own long, place int, positive_id long, positive_score long, negative_score long, negative_id long")
    order = Window.partitionBy("anchor_id", "own", "place").orderBy(F.desc("negative_score"), "negative_id")  # n rows of each block at most
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "place")


def query(spark, sf_dir: str) -> DataFrame:
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label").filter("vec_id IS NOT NULL AND label IS NOT NULL")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int"))
    return mine(rows, rows.filter("vec_id % 50 = 0")).drop("place")


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
