"""Operator 2, reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

State (LineStore): written postings, one row per distinct key and document, and the exact table of reference counts (key,
number of documents, largest doc_id). insert() adds the postings of new documents, delete() takes documents' postings away;
either changes the exact table by the changed keys alone and gives a new store, so that a delete undoes an insert. Keys are
dealt to shards by hash; each shard has a cuckoo filter of its keys at or over the threshold: it is kept by insertions and
deletions of fingerprints, and tells for most lines, without the exact table, that they are no repeat. What passes a filter
is checked against the exact table, so false positives cost time but no line.

A key is carried as its 128-bit BLAKE2b digest. The number of shards follows the number of postings. Filters meet lines in
one pass over the shard (the filter's row sorts first), never as a broadcast. A shard with many postings, such as one with a
line that most documents hold, is dealt over salts by their number, each of which gets a copy of its filter; joins on hot
keys stream them past one row of the exact table, and adaptive execution splits them.

Defined results: a null or empty text is one empty line; rows of one doc_id count as one document for the keys and
each row loses the lines; a null doc_id comes before all others (it never is the largest unless alone); an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import ASCII_SPACE, cut

MIN_POINTS, MIN_DOCS = 20, 3
#: At least so many shards; postings of a shard when a store is made; postings of a shard that meet its filter in one task.
SHARDS, SHARD_ROWS, SALT_ROWS = 64, 200_000, 25_000


class CuckooFilter:
    """Buckets of four 32-bit fingerprints; both buckets of an item follow from its fingerprint alone.

    So an item is either in its two buckets or nowhere: deleting it can't hit another key's only copy (keys of one fingerprint
    each have a copy), and when an item finds no place, a table of twice the size is filled from the fingerprints themselves.
    """

    KICKS, FIRST = 200, 64

    def __init__(self, table: bytes | None = None) -> None:
        self.table = np.frombuffer(table, np.uint32).reshape(-1, 4).copy() if table else np.zeros((self.FIRST, 4), np.uint32)

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[8:12], "little") or 1

    def _first(self, f):
        return (f * 0x9E3779B1 >> 7) & (len(self.table) - 1)

    def _other(self, at, f):
        return at ^ ((f * 0x85EBCA77 >> 5 | 1) & (len(self.table) - 1))

    def _put(self, f: int) -> bool:
        at = self._first(f)
        moves = []
        for k in range(-1, self.KICKS):
            for place in (at, self._other(at, f)) if k < 0 else (at,):
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = f
                    return True
            moves.append((at, k % 4, int(self.table[at, k % 4])))
            self.table[at, k % 4], f = f, moves[-1][2]
            at = self._other(at, f)
        for at, k, old in reversed(moves):
            self.table[at, k] = old
        return False

    def insert(self, digest: bytes) -> None:
        """Each key once."""
        f = self._print(digest)
        if self._put(f):
            return
        held = [*self.table[self.table != 0].tolist(), f]
        if held.count(f) > 8:
            raise ValueError("a key was inserted again and again")
        size = len(self.table)
        while True:
            size *= 2
            self.table = np.zeros((size, 4), np.uint32)
            if all(map(self._put, held)):
                return

    def delete(self, digest: bytes) -> bool:
        """Only of items that were inserted; one copy of their fingerprint goes."""
        f = self._print(digest)
        for at in (self._first(f), self._other(self._first(f), f)):
            if len(found := np.flatnonzero(self.table[at] == f)):
                self.table[at, found[0]] = 0
                return True
        return False

    def holds(self, digests: list[bytes]) -> np.ndarray:
        f = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)[:, 8:12].copy().view("<u4").ravel()
        f = np.maximum(f, 1).astype(np.uint64)
        mask = np.uint64(len(self.table) - 1)
        a = (f * np.uint64(0x9E3779B1) >> np.uint64(7)) & mask
        b = a ^ ((f * np.uint64(0x85EBCA77) >> np.uint64(5) | np.uint64(1)) & mask)
        f = f.astype(np.uint32)[:, None]
        return (self.table[a.astype(np.int64)] == f).any(1) | (self.table[b.astype(np.int64)] == f).any(1)

    def dump(self) -> bytes:
        return self.table.tobytes()


def line_keys(text: bytes, min_points: int = MIN_POINTS) -> Iterator[tuple[bytes, bytes | None]]:
    """(line, digest of its key or None where the key is too short) of each line of a text in UTF-8."""
    for line in text.split(b"\n"):
        key = line.strip(ASCII_SPACE).lower()  # bytes.lower() changes A-Z only
        long = len(key) >= min_points and (len(key) >= 4 * min_points or len(key.decode("utf-8", "replace")) >= min_points)
        yield line, hashlib.blake2b(key, digest_size=16).digest() if long else None


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        raw = x.as_buffer()
        yield raw.to_pybytes() if raw else b""


def _postings(min_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                own = {d for _, d in line_keys(text, min_points) if d}
                keys += own
                ids += [doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    return run


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's filter after its changes; rows (shard, filter, key, added), the old filter's row before its changes."""

    def give(shard, sieve):
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([sieve.dump()], pa.binary())], ["shard", "filter"])

    now, sieve = None, None
    for batch in batches:
        for shard, old, key, added in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if shard != now:
                if sieve:
                    yield give(now, sieve)
                now, sieve = shard, CuckooFilter(old)
            if key is not None:
                (sieve.insert if added else sieve.delete)(key)
    if sieve:
        yield give(now, sieve)


def _sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings that their shard's filter holds; rows (shard, salt, filter, key, doc_id), a filter's row before its postings."""
    now, sieve = None, None
    for batch in batches:
        shards, salts, filters, keys, ids = (batch.column(k) for k in range(5))
        both = shards.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | salts.to_numpy(zero_copy_only=False)
        for at in np.split(np.arange(len(both)), np.flatnonzero(np.diff(both)) + 1) if len(both) else []:
            if both[at[0]] != now:
                now, sieve = both[at[0]], None
            if filters[int(at[0])].is_valid:
                sieve, at = CuckooFilter(filters[int(at[0])].as_py()), at[1:]
            if sieve is None or not len(at):
                continue
            own, docs = keys.slice(int(at[0]), len(at)), ids.slice(int(at[0]), len(at))
            hit = pa.array(sieve.holds(own.to_pylist()))
            yield pa.RecordBatch.from_arrays([own.filter(hit), docs.filter(hit)], ["key", "doc_id"])


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest"))


class LineStore:
    """postings (key, doc_id) of the documents inserted so far, each once; counts (key, n_docs, largest): the exact table; filters
    (shard, filter) of the keys at or over the threshold. Each change gives a new store and touches no old one."""

    def __init__(self, postings: DataFrame, counts: DataFrame, filters: DataFrame | None, gained: DataFrame, lost: DataFrame | None, shards: int, min_points: int, min_docs: int) -> None:
        self.postings, self.counts, self.shards, self.min_points, self.min_docs = postings, counts, shards, min_points, min_docs
        change = gained.select(self._shard(), F.lit(None).cast("binary").alias("filter"), "key", F.lit(True).alias("added"))
        if lost is not None:
            change = change.unionByName(lost.select(self._shard(), F.lit(None).cast("binary").alias("filter"), "key", F.lit(False).alias("added")))
        if filters is not None:
            change = change.unionByName(filters.select("shard", "filter", F.lit(None).cast("binary").alias("key"), F.lit(True).alias("added")))
        ordered = change.repartition("shard").sortWithinPartitions("shard", F.col("filter").isNull(), "added")
        self.filters = cut(ordered.mapInArrow(_changed, "shard int, filter binary"), "line-filters")

    def _shard(self) -> F.Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")

    @staticmethod
    def read(docs: DataFrame, min_points: int = MIN_POINTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(key, doc_id), each once: rows of one doc_id are one document."""
        found = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_postings(min_points), "key binary, doc_id long")
        return cut(found.distinct(), "line-postings")

    @classmethod
    def of(cls, docs: DataFrame, min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> LineStore:
        postings = cls.read(docs, min_points)
        shards = max(SHARDS, -(-postings.count() // SHARD_ROWS))
        counts = cut(_counted(postings), "line-counts")
        return cls(postings, counts, None, counts.filter(F.col("n_docs") >= min_docs), None, shards, min_points, min_docs)

    def insert(self, docs: DataFrame) -> LineStore:
        read = self.read(docs, self.min_points)
        new = read.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"))
        again = self.postings.join(new, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"))
        fresh = cut(read.join(again, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti"), "line-fresh")
        delta = cut(_counted(fresh).withColumnsRenamed({"n_docs": "_n", "largest": "_l"}), "line-delta")
        was = self.counts.join(delta, "key").select("key", "n_docs", (F.col("n_docs") + F.col("_n")).alias("now"), F.greatest("largest", "_l").alias("largest"))
        was = cut(was.unionByName(delta.join(self.counts, "key", "left_anti").select("key", F.lit(0).cast("long").alias("n_docs"), F.col("_n").alias("now"), F.col("_l").alias("largest"))), "line-touched")
        return self._next(self.postings.unionByName(fresh), was)

    def delete(self, ids: DataFrame) -> LineStore:
        """ids: the doc_id of each document to take away."""
        gone = ids.select(F.col(ids.columns[0]).cast("long").alias("_gone")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("_gone"))
        left = cut(self.postings.join(gone, same, "left_anti"), "line-postings")
        delta = cut(self.postings.join(gone, same, "left_semi").groupBy("key").agg(F.count("*").alias("_n")), "line-delta")
        largest = left.join(delta.select("key"), "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("_l"))  # of the changed keys alone
        was = cut(self.counts.join(delta, "key").join(largest, "key", "left").select("key", "n_docs", (F.col("n_docs") - F.col("_n")).alias("now"), F.col("_l").alias("largest")), "line-touched")
        return self._next(left, was)

    def _next(self, postings: DataFrame, touched: DataFrame) -> LineStore:
        """touched: key, n_docs before, now, largest, of the keys whose counts change."""
        stay = self.counts.join(touched.select("key"), "key", "left_anti")
        counts = cut(stay.unionByName(touched.filter("now > 0").select("key", F.col("now").alias("n_docs"), "largest")), "line-counts")
        up, down = touched.filter((F.col("n_docs") < self.min_docs) & (F.col("now") >= self.min_docs)), touched.filter((F.col("n_docs") >= self.min_docs) & (F.col("now") < self.min_docs))
        return LineStore(postings, counts, self.filters, up.select("key"), down.select("key"), self.shards, self.min_points, self.min_docs)

    def drops(self) -> DataFrame:
        """doc_id, keys: digests of the lines that each document loses."""
        salts = F.greatest(F.lit(1), F.ceil(F.sum("n_docs") / SALT_ROWS)).cast("int")
        sizes = F.broadcast(cut(self.counts.groupBy(self._shard()).agg(salts.alias("salts")), "line-sizes"))  # a row for each shard
        no_key, no_id, no_filter = F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("filter")
        filters = self.filters.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "filter", no_key, no_id)
        salted = self.postings.withColumn("shard", self._shard()).join(sizes, "shard").select("shard", F.pmod(F.hash("doc_id"), F.col("salts")).alias("salt"), no_filter, "key", "doc_id")
        met = filters.unionByName(salted).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        likely = met.mapInArrow(_sieve, "key binary, doc_id long")
        repeats = self.counts.filter(F.col("n_docs") >= self.min_docs)
        lost = likely.join(repeats.select("key", "largest"), "key").filter(~F.col("doc_id").eqNullSafe(F.col("largest")))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # no more than the document has lines

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_lines, n_dropped, kept (the text of the lines that stay)."""
        drops = self.drops().select(F.col("doc_id").alias("_d"), "keys")
        joined = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(drops, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
        return joined.select("doc_id", "text", "keys").mapInArrow(_rewrite(self.min_points), "doc_id long, n_lines long, n_dropped long, kept string")


def _rewrite(min_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, dropped, kept = [], [], []
            for text, keys in zip(_texts(batch.column(1)), batch.column(2).to_pylist()):
                n = text.count(b"\n") + 1
                if keys:
                    gone = set(keys)
                    stay = [line for line, d in line_keys(text, min_points) if d not in gone]
                    text = b"\n".join(stay)
                    dropped.append(n - len(stay))
                else:
                    dropped.append(0)
                lines.append(n)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return LineStore.of(docs).apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND doc_id <> largest AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
