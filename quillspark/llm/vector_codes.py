"""Operator 12, vector code compression: product codes whose codebooks are learned by Heap Lloyd.

Vectors of integers are cut into equal parts; each part position has a codebook, and a vector's code is the index of the
nearest entry of each. Lloyd's rounds run over blocks of vectors that never move: a block holds, for each part position and
entry, a heap of the parts assigned to it, keyed by slack: the lower bound of the distance to every other entry minus the
distance to its own, plus the drift that its entry's heap had gathered when the key was made. When entries move, an entry's
drift grows by its own way and the longest way of another. A part whose key is over the drift is still nearest to its entry,
untouched; only parts at the heap's top whose keys the drift has passed are popped, compared with all entries exactly, and
pushed again. Keys are rounded down, so a bound that rounding could blur is a pop, and ties go to the lower index as in a
full comparison.

A round is one job: it reads the blocks, and writes them with their codes and heaps and, after the first round, only the
sums of parts that changed their entry. Those sums are added up by Spark, and just entries x components of them come to the
driver, where a codebook is made anew as floor(sum / count). Each round's blocks are a table in the shared folder.

Defined results: rows whose vector is null or holds null or non-finite components take no part; null ids come last in the
order of ids, repeated ids are ordered by their vectors, and every row gets its code; null labels are one label; a length
that PARTS doesn't divide, and shorter vectors, are filled up with zeros; fewer rows than entries make fewer entries; a component
of 65,536 or more is an error; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import cut
from quillspark.llm.vectors import integer_vectors, matrix, packed, squares, unpacked

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of a block; its heaps hold a pair for each part.
BLOCK = 4096
#: Labels whose sums are broadcast (12 bytes a row), counted before; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
BLOCKS = "ids array<long>, labels array<int>, v binary, code binary, slack binary, row binary, moved binary"


def _slack(lower: np.ndarray, upper: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Keys of the heaps, rounded down."""
    key = lower - upper + drift
    return np.nextafter((key - 1e-6 - 1e-9 * (np.where(np.isinf(lower), 0, lower) + upper + drift)).astype(np.float32), np.float32(-np.inf))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower one of equal ones), its distance and the next one's."""
    far = squares(x, book)
    code, rows = far.argmin(1), np.arange(len(x))
    upper = np.sqrt(far[rows, code].astype(np.float64))
    if len(book) == 1:
        return code, upper, np.full(len(x), np.inf)
    rest = far.astype(np.float64)
    rest[rows, code] = np.inf
    return code, upper, np.sqrt(rest.min(1))


class Block:
    """The vectors of a block, their codes, and a heap of (slack, row) for each part position and entry."""

    def __init__(self, x: np.ndarray, books: np.ndarray) -> None:
        parts, entries, wide = books.shape
        self.x, self.entries = x.reshape(len(x), parts, wide), entries
        self.code = np.zeros((len(x), parts), np.uint8)
        self.heaps: list[list[list[tuple[float, int]]]] = [[[] for _ in range(entries)] for _ in range(parts)]
        self.moved = np.zeros((parts, entries, wide + 1), np.int64)

    def first(self, books: np.ndarray) -> None:
        for m, book in enumerate(books):
            code, upper, lower = nearest(self.x[:, m], book)
            self.code[:, m] = code
            self._count(m, code, self.x[:, m], 1)
            key = _slack(lower, upper, np.zeros(len(code)))
            order = np.lexsort((key, code))
            for j, part in enumerate(np.split(order, np.cumsum(np.bincount(code, minlength=self.entries))[:-1])):
                self.heaps[m][j] = list(zip(key[part].tolist(), part.tolist()))  # in order of keys, so a heap

    def again(self, books: np.ndarray, drift: np.ndarray) -> int:
        """Pop what the drift has passed, compare it with all entries, push it again. Returns how many were."""
        popped = 0
        for m, book in enumerate(books):
            rows = []
            for heap, most in zip(self.heaps[m], drift[m].tolist()):
                while heap and heap[0][0] <= most:
                    rows.append(heapq.heappop(heap)[1])
            if not rows:
                continue
            popped += len(rows)
            at = np.array(rows)
            was, part = self.code[at, m].astype(np.int64), self.x[at, m]
            code, upper, lower = nearest(part, book)
            other = code != was
            self._count(m, was[other], part[other], -1)
            self._count(m, code[other], part[other], 1)
            self.code[at, m] = code
            for key, j, row in zip(_slack(lower, upper, drift[m][code]).tolist(), code.tolist(), rows):
                heapq.heappush(self.heaps[m][j], (key, row))
        return popped

    def errors(self, books: np.ndarray) -> np.ndarray:
        own = books[np.arange(books.shape[0]), self.code]
        return ((self.x - own) ** 2).sum((1, 2))

    def _count(self, m: int, code: np.ndarray, part: np.ndarray, sign: int) -> None:
        np.add.at(self.moved[m, :, :-1], code, sign * part)
        np.add.at(self.moved[m, :, -1], code, sign)

    def state(self) -> list[bytes]:
        flat = [x for heaps in self.heaps for heap in heaps for x in heap]
        return [self.code.tobytes(), np.array([x[0] for x in flat], "<f4").tobytes(), np.array([x[1] for x in flat], "<u2").tobytes(), self.moved.tobytes()]

    @classmethod
    def read(cls, v: bytes, code: bytes, slack: bytes, row: bytes, books: np.ndarray) -> Block:
        parts, entries, wide = books.shape
        n = len(code) // parts
        own = cls(unpacked(v, parts * wide, n), books)
        own.code = np.frombuffer(code, np.uint8).reshape(n, parts).copy()
        keys, rows, at = np.frombuffer(slack, "<f4").tolist(), np.frombuffer(row, "<u2").tolist(), 0
        for m in range(parts):
            for j, size in enumerate(np.bincount(own.code[:, m], minlength=entries).tolist()):
                own.heaps[m][j] = list(zip(keys[at : at + size], rows[at : at + size]))
                at += size
        return own


def _begun(books: np.ndarray, size: int):
    parts, _, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (vec_id, label, v) to blocks with their first codes."""
        for batch in batches:
            for part in (batch.slice(k, size) for k in range(0, batch.num_rows, size)):
                x = matrix(part.column(2), parts * wide)
                block = Block(x, books)
                block.first(books)
                yield _row(part.column(0).to_pylist(), part.column(1).to_pylist(), packed(x), block)

    return run


def _row(ids, labels, v, block: Block) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 5]
    names = ["ids", "labels", "v", "code", "slack", "row", "moved"]
    return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((ids, labels, v, *block.state()), kinds)], names)


def _goes_on(books: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block.read(r["v"], r["code"], r["slack"], r["row"], books)
                block.again(books, drift)
                yield _row(r["ids"], r["labels"], r["v"], block)

    return run


def _ended(books: np.ndarray, drift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block.read(r["v"], r["code"], r["slack"], r["row"], books)
                block.again(books, drift)
                cols = (pa.array(r["ids"], pa.int64()), pa.array(r["labels"], pa.int32()), pa.array([c.tobytes() for c in block.code], pa.binary()), pa.array(block.errors(books)))
                yield pa.RecordBatch.from_arrays(list(cols), ["vec_id", "label", "code", "error"])

    return run


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's blocks, as slots and values."""
    total = None
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            own = np.frombuffer(raw, np.int64)
            total = own.copy() if total is None else total + own
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "value"])


def _moved(blocks: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The sums of all blocks: one number for each entry's component, and its count."""
    out = np.zeros(shape[0] * shape[1] * (shape[2] + 1), np.int64)
    for slot, value in blocks.select("moved").mapInArrow(_partial, "slot int, value long").groupBy("slot").agg(F.sum("value")).collect():
        out[slot] = value
    return out.reshape(shape[0], shape[1], shape[2] + 1)


def _drifted(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each entry its own way and the longest way of another entry of its codebook."""
    way = np.sqrt(((new - old).astype(np.float64) ** 2).sum(2))
    if way.shape[1] == 1:
        return way
    order = np.sort(way, 1)
    return way + np.where(way == order[:, -1:], np.where(order[:, -2:-1] == order[:, -1:], order[:, -1:], order[:, -2:-1]), order[:, -1:])


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code: a byte for each part, error), and the codebooks (part, entry, component). entries: 256 at most."""
    if not 0 < entries <= 256 or not 0 < block <= 1 << 16:
        raise ValueError("codes are bytes and rows of a block two bytes")
    kept = integer_vectors(df, id_col, vec_col, label_col)
    starts = [r[0] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not starts:
        return df.sparkSession.createDataFrame([], "vec_id long, label int, code binary, error long"), np.zeros((parts, 0, 0), np.int64)
    wide = -(-kept.agg(F.max(F.size("v"))).first()[0] // parts)
    books = np.array([v + [0] * (parts * wide - len(v)) for v in starts], np.int64).reshape(len(starts), parts, wide).transpose(1, 0, 2)
    now = cut(kept.mapInArrow(_begun(books, block), BLOCKS), "code-blocks")
    sums, drift = np.zeros((*books.shape[:2], wide + 1), np.int64), np.zeros(books.shape[:2])
    for k in range(rounds):
        sums += _moved(now, books.shape)
        count = sums[:, :, -1:]
        made = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), books)
        drift, books = drift + _drifted(books, made), made
        if k + 1 < rounds:
            now = cut(now.mapInArrow(_goes_on(books, drift), BLOCKS), "code-blocks")
    return now.mapInArrow(_ended(books, drift), "vec_id long, label int, code binary, error long"), books


def decode(code: bytes, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return books[np.arange(len(code)), np.frombuffer(code, np.uint8)].reshape(-1)


def query(spark, sf_dir: str) -> DataFrame:
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = cut(found, "codes")
    sums = cut(codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "code-labels")
    both = codes.join(F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums, F.col("label").eqNullSafe(F.col("_label")))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(k: int) -> str:
    way = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT"
    return f"""
a{k} AS MATERIALIZED (SELECT r, m, any_value(x) AS x, min(struct_pack(d := d, j := j)) AS best FROM (SELECT r, p.m, x, j, {way} AS d FROM p JOIN c{k} USING (m)) GROUP BY r, m)"""


def _moved_sql(k: int) -> str:
    return f"""
s{k} AS (SELECT m, best.j AS j, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS y FROM a{k}, unnest(range(1, len(x) + 1)) t(i) GROUP BY ALL),
n{k} AS (SELECT m, j, list(y ORDER BY i) AS c FROM s{k} GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT m, j, coalesce(n{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN n{k} USING (m, j))"""


ORACLE = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM v),
p AS MATERIALIZED (SELECT r, m, v[m * (len(v) // 16) + 1 : (m + 1) * (len(v) // 16)] AS x FROM k, unnest(range(16)) t(m)),
c0 AS MATERIALIZED (SELECT m, r - 1 AS j, x AS c FROM p WHERE r <= 64),{_assigned(0)},{_moved_sql(0)},{_assigned(1)},{_moved_sql(1)},{_assigned(2)},
e AS (SELECT r, string_agg(lpad(lower(to_hex(best.j)), 2, '0'), '' ORDER BY m) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY r),
b AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY m, j, i)) AS codebooks_sha256 FROM (SELECT m, j, i, c[i] AS y FROM c2, unnest(range(1, len(c) + 1)) t(i)))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN e USING (r), b
"""
