"""Operator 9, exact dedup by Grace hashing: partition, spill, partition again, and compare complete contents in a table.

Pass 1 (map side) keeps an open-addressing table of the contents that a task has seen; a repeat points to the task's
first row of that content, so a content goes on once per task however many copies there are. Its rows are written once.
Pass 2 deals the first rows out by content hash (the exchange's files are the first spill) and each bucket is loaded
into an open-addressing table of complete contents; a bucket over the memory bound is dealt to spill files by further
bits of the hash, and each of them is handled likewise, until it fits. Contents of one hash can't be dealt apart; they
are streamed against the table, which holds each content once.
Rows then get their group through the pointer to their task's first row.

Defined results: a null text counts as empty; of equal texts the smallest doc_id stays, null ids last; of rows that
repeat the smallest id one stays; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import tempfile
from collections.abc import Iterator
from itertools import chain, islice, repeat

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import ASCII_SPACE, cut

#: Bytes of content that a table holds at most before it is emptied (pass 1) or dealt to spill files (pass 2).
TABLE_BYTES = 128 << 20
#: Spill files that a bucket is dealt to, by FANOUT_BITS more bits of the hash each time; past the last bit none.
FANOUT_BITS = 4
HASH_BITS = 64


class ContentTable:
    """Open addressing with linear probing; keys are compared as complete contents, the hash only finds the place."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots, self.contents, self.hashes, self.held = [-1] * 1024, [], [], 0

    def find(self, content: bytes, h: int) -> tuple[int, bool]:
        """The entry's number, and whether it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            at = (at + 1) & mask
        self.slots[at] = len(self.contents)
        self.contents.append(content)
        self.hashes.append(h)
        self.held += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self.grow()
        return len(self.contents) - 1, True

    def grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def squeeze(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space."""
    if not text:
        return text
    inner = b" ".join(text.split())
    if not inner:
        return b" "
    return (b" " if text[:1] in ASCII_SPACE else b"") + inner + (b" " if text[-1:] in ASCII_SPACE else b"")


LOCAL = "doc_id long, ptr string, rep string, h long, sha256 string, content binary"


def _local(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = f"{TaskContext.get().partitionId():x}"
        table, reps, n, out, held = ContentTable(), [], 0, [[] for _ in range(6)], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()))], ["doc_id", "ptr", "rep", "h", "sha256", "content"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                raw = text.as_buffer()
                content = squeeze(raw.to_pybytes() if raw else b"")
                h = xxhash.xxh3_64_intdigest(content)
                ptr = f"{task}-{n:x}"
                n += 1
                e, new = table.find(content, h)
                if new:
                    reps.append((ptr, hashlib.sha256(content).hexdigest()))
                rep, sha = reps[e]
                for c, v in zip(out, (doc_id, ptr, rep, h - (1 << 63), sha, content if new else None)):
                    c.append(v)
                held += 100 + len(content) * new
                if table.held > table_bytes:
                    table.clear()
                    reps.clear()
                if held > 8 << 20:
                    yield flush()
                    out, held = [[] for _ in range(6)], 0
        yield flush()

    return run


def _spilled(path: str) -> Iterator[tuple[int, bool, str, bytes]]:
    with open(path, "rb") as f:
        while head := f.read(17):
            h, given, n, m = struct.unpack("<Q?II", head)
            yield h, given, f.read(n).decode(), f.read(m)


def _bucket(rows: Iterator[tuple[int, bool, str, bytes]], level: int, table_bytes: int, folder: str) -> Iterator[tuple[str, str]]:
    """(pointer, pointer of its group's first entry) of rows (h, whether it was given out already, pointer, content)."""
    table, first, rows = ContentTable(), [], iter(rows)
    for h, given, ptr, content in rows:
        e, new = table.find(content, h)
        if new:
            first.append(ptr)
        if not given:
            yield ptr, first[e]
        if table.held > table_bytes and level * FANOUT_BITS < HASH_BITS:
            break
    else:
        return
    sub = tempfile.mkdtemp(dir=folder)
    names = [f"{sub}/{k}" for k in range(1 << FANOUT_BITS)]
    files = [open(x, "wb") for x in names]  # noqa: SIM115
    # What the table holds goes first and is given out already, so each group keeps its first entry.
    for h, given, ptr, content in chain(zip(table.hashes, repeat(True), first, table.contents), rows):
        p = ptr.encode()
        files[h >> (HASH_BITS - FANOUT_BITS * (level + 1)) & ((1 << FANOUT_BITS) - 1)].write(struct.pack("<Q?II", h, given, len(p), len(content)) + p + content)
    for f in files:
        f.close()
    table.clear()
    for name in names:
        yield from _bucket(_spilled(name), level + 1, table_bytes, sub)
        os.unlink(name)


def _grace(table_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp()  # scratch of this task alone, gone with it
        try:
            rows = ((h + (1 << 63), False, ptr, content) for b in batches for ptr, h, content in zip(*(b.column(k).to_pylist() for k in range(3))))
            pairs = _bucket(rows, 0, table_bytes, folder)
            while some := list(islice(pairs, 50_000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], ["rep", "grp"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    local = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_local(table_bytes), LOCAL)
    rows = cut(local, "exact-dedup")
    found = rows.filter("content IS NOT NULL").select("rep", "h", "content").repartition("h").mapInArrow(_grace(table_bytes), "rep string, grp string")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "ptr"))
    per_rep = rows.groupBy("rep").agg(best.alias("b"), F.count("*").alias("n"))
    grouped = found.join(per_rep, "rep")
    groups = grouped.groupBy("grp").agg(F.min("b").alias("g_b"), F.sum("n").alias("group_size"))
    by_rep = grouped.select("rep", "grp").join(groups, "grp").select("rep", "g_b", "group_size")
    return rows.drop("content", "h").join(by_rep, "rep").select("doc_id", F.col("g_b.doc_id").alias("keep_id"), "group_size", (F.col("ptr") == F.col("g_b.ptr")).alias("kept"), F.col("sha256").alias("text_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
