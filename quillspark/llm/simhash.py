"""Operator 3, SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints have 64 bits. For a radius r each bit position gets a random vector of r + 1 bits, and for each of the
2^(r+1) - 1 nonzero vectors v one table keeps the positions whose vector has an odd product with v. Any r differing
positions leave some v orthogonal to all of their vectors, so each pair within the radius agrees on all bits that some
table keeps: no pair is missed, whatever the random choice.

Rows are reduced to distinct fingerprints first, so copies cost one row. In a table's bucket not all pairs are emitted
but links that span its groups of fingerprints within the radius: a bucket of up to BUCKET fingerprints is compared in
one block of one pass over all buckets; the fingerprints of larger ones are linked over hubs, exactly: x and y are within r if and only if a point
lies within ceil(r/2) of one and floor(r/2) of the other, so each fingerprint is dealt to the points around it and each
point links what meets there. Components come from alternating stars over the written links.

Defined results: a null or empty text has fingerprint zero and is linked like any other; null ids are least last (a
component of null ids alone has id null); rows that repeat each get a row; an empty table gives an empty result; further
columns are not read.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.shared import cut

RADIUS, SEED = 3, 42
#: Fingerprints of a bucket that are compared in one block (BUCKET^2 comparisons of 8 bytes); larger ones go over hubs.
BUCKET = 2048
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of size words, joined by a space, repeats included; of all words if there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    return np.array([h(whole[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    at = hashes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
    counts = np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((2 * counts.ravel() > len(hashes)).astype(np.uint8), bitorder="little").tobytes(), "little")


def shingled(text: bytes, size: int = 3) -> np.ndarray:
    """The features of the contract: word shingles with repeats, A-Z lower-cased."""
    return shingle_hashes(text.lower().split(), size)


def distinct_words(text: bytes) -> np.ndarray:
    """Features for near copies with changed words: the distinct words."""
    h = xxhash.xxh64_intdigest
    return np.array([h(w, SEED) for w in set(text.lower().split())], np.uint64)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def texts_of(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        raw = x.as_buffer()
        yield raw.to_pybytes() if raw else b""


def _prints(features: Callable[[bytes], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(features(t))) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, features: Callable[[bytes], np.ndarray] = shingled, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_prints(features), "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """The kept bits of each of the 2^(radius+1) - 1 tables."""
    dice = random.Random(seed)
    vectors = [dice.randrange(1, 1 << (radius + 1)) for _ in range(64)]
    return [sum(1 << k for k, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _keys(masks: list[int]):
    kept = np.array(masks, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(part, 4096).to_numpy(zero_copy_only=False).astype(np.int64)
                key = (fp.view(np.uint64)[:, None] & kept).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(masks), dtype=np.int32), len(fp))), pa.array(key.ravel()), pa.array(np.repeat(fp, len(masks)))], ["tab", "key", "fp"])

    return run


def spanning_links(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that span each group of these distinct fingerprints whose links are all pairs within the radius."""
    left = np.sort(fps).view(np.uint64)
    while len(left):
        seen, front, left = left[:1], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for f in front:
                hit = ~near & (np.bitwise_count(left ^ f) <= radius)
                near |= hit
                yield from ((int(seen[0]), int(x)) for x in left[hit])
            front, left = left[near], left[~near]


def _bucket_links(radius: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tab, key, fp) sorted by bucket to links (a, b); of a bucket over most, whose fingerprints are not held, one row without a link."""
        now, held, n, found = None, [], 0, []

        def ended():
            if n > most:
                found.append((*now, None, None))
            elif n > 1:
                found.extend((*now, _signed(x), _signed(y)) for x, y in spanning_links(np.concatenate(held), radius))

        def give():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["tab", "key", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            tab, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            first = np.concatenate([[0], np.flatnonzero((np.diff(tab) != 0) | (np.diff(key) != 0)) + 1])
            last = np.append(first[1:], len(tab))
            many = last - first > 1
            many[[0, -1]] = True  # a bucket may go on in the next batch
            for s, e in zip(first[many].tolist(), last[many].tolist()):
                if (at := (int(tab[s]), int(key[s]))) != now:
                    ended()
                    now, held, n = at, [], 0
                n += e - s
                held = [*held, fp[s:e]] if n <= most else []
            yield give()
            found.clear()
        ended()
        yield give()

    return run


def _hubs(masks: list[int], radius: int):
    """The points within ceil(radius / 2) of each fingerprint that agree with it on its table's bits, and whether they are within floor(radius / 2)."""
    near, far = radius // 2, (radius + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {}
        for batch in batches:
            for tab, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if tab not in flips:
                    free = [1 << k for k in range(64) if not masks[tab] >> k & 1]
                    flips[tab] = [(np.array([sum(c) for c in itertools.combinations(free, n)], np.uint64), n <= near) for n in range(far + 1)]
                for some, close in flips[tab]:
                    n = len(some)
                    points = (some ^ np.array(fp, np.int64).view(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(points), pa.array([fp] * n, pa.int64()), pa.array([close] * n)], ["hub", "fp", "close"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints (column fp) within the radius."""
    masks = covering_masks(radius, seed)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: few bytes come in, many rows go out
    keyed = distinct.select("fp").repartition(parts, "fp").mapInArrow(_keys(masks), "tab int, key long, fp long")
    dealt = keyed.repartition("tab", "key").sortWithinPartitions("tab", "key")  # distinct fingerprints: a few bytes a row, and only BUCKET of them are held
    found = cut(dealt.mapInArrow(_bucket_links(radius, bucket), "tab int, key long, a long, b long"), "simhash-buckets")
    large, found = found.filter("a IS NULL").select("tab", "key"), found.filter("a IS NOT NULL").select("a", "b")
    if large.isEmpty():
        return found
    hot = keyed.join(large, ["tab", "key"]).select("tab", "fp").repartition("fp", "tab")
    hubs = cut(hot.mapInArrow(_hubs(masks, radius), "hub long, fp long, close boolean").distinct(), "simhash-hubs")
    anchors = hubs.filter("close").groupBy("hub").agg(F.min("fp").alias("a"))  # all that meet at a hub are within the radius of a close one
    return found.unionByName(hubs.join(anchors, "hub").select("a", F.col("fp").alias("b")).filter("a <> b").distinct())


def simhash_components(docs: DataFrame, features: Callable[[bytes], np.ndarray] = shingled, radius: int = RADIUS, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, root (the least fingerprint of its component), component_id (its smallest doc_id)."""
    prints = cut(fingerprints(docs, features, id_col, text_col), "simhash-prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, radius, bucket), "simhash-links")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root")
    return prints.join(classes, "fp").select("doc_id", "fp", "root", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

