"""Operator 13, n-gram Jaccard join over signature trees.

Sets. A text's set is its distinct word shingles, as 64-bit hashes; texts of equal sets are one from there on. Each set has a
bitmap of its shingles (at least two bits a shingle, a power of two in all, so a longer bitmap folds to a shorter one).

Forest. Two sets at the threshold share one of the first n - ceil(threshold n) + 1 shingles of each, in one order for all
texts (rare before common, see common_shingles; any order is right). So there is a tree for each such shingle that several
sets hold; shingles held by the very same sets have one tree. Sets of a shingle beyond BLOCK are dealt to several trees, and
each two of them meet in a task.

Trees. A leaf is a set; FAN neighbours make a node, which holds the OR of their bitmaps, the range of their sizes and the
most shingles that one of them loses to shared bits. Two trees (or a tree and itself) are descended together: a pair of nodes
is pruned if no two sizes of their ranges fit, if the common bits and lost shingles can't make the overlap that the threshold needs, or
if all their sets are in one class already. What is left at the leaves are candidates; a pair that several trees hold counts in the
first of them.

Classes. Of a tree's candidates only a spanning forest is given out, the nearest first, never all pairs; it is compared exactly, by
the shingles of both texts. Links that hold unite classes, pairs that don't are handed to their tree to be passed over, and
trees that gave candidates are descended again. The first descent takes the largest tree of each set alone, which unites most.
After FORESTS descents all candidates left are given out, so the end doesn't depend on how many it takes. Nothing that could be
a link is left out.

Defined results: a null or empty text has an empty set, linked with nothing, its component is its own id; fewer words than a shingle are
one shingle; null ids are least last (a component of null ids alone has id null); repeated rows each get a row; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.shared import cut
from quillspark.llm.simhash import SEED, _signed, fingerprint, links, texts_of

SHINGLE, PERCENT = 4, 85
#: Sets of a tree; children of a node; descents that give a spanning forest; bits of the shortest bitmap; bytes compared at once.
BLOCK, FAN, FORESTS, BITS, AT_ONCE = 1024, 8, 4, 512, 2 << 20
#: Rows or pairs that are Python objects at once.
PART = 1024
#: For the order of shingles alone: one in SAMPLE texts is looked at, shingles of LEAST of them are common, MOST are told apart.
SAMPLE, LEAST, MOST = 16, 4, 100_000
#: Ids that are broadcast to fetch texts, counted before (8 bytes each and a digest); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: An odd number that spreads the hash of a run of words over all bits.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Tasks over which the partners of one set are dealt, when they are compared with it.
SALT = 16


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words, itertools.repeat(SEED)), np.uint64, len(words))


def mixed(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes, sorted, of the runs of size words, from the words' hashes; of all words if there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    run = words[:n]
    for k in range(1, size):
        run = (run ^ (run >> np.uint64(29))) * MIX + words[k : n + k]
    run = (run ^ (run >> np.uint64(32))) * MIX
    return np.unique(run ^ (run >> np.uint64(29)))


def needed(n: int, percent: int = PERCENT) -> int:
    """The shingles that a set of n shares at least with each set that reaches the threshold."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Jaccard of sorted distinct arrays, none empty, at least the threshold."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def bitmap(own: np.ndarray) -> bytes:
    bits = max(BITS, 1 << (2 * len(own) - 1).bit_length()) if len(own) else BITS
    out = np.zeros(bits, np.uint8)
    out[(own & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def digest_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _shingles(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mixed(word_hashes(t), size) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["shingle"])

    return run


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles common in a sample of the distinct texts, sorted, and their counts; at most MOST. They only say which shingles come last in the order."""
    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).distinct().mapInArrow(_shingles(size), "shingle long")
    rows = some.groupBy("shingle").count().filter(F.col("count") >= LEAST).orderBy(F.desc("count"), "shingle").limit(MOST).collect()
    shingle, count = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(shingle)
    return shingle[order], count[order]


def prefix(own: np.ndarray, percent: int, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first of these sorted distinct shingles in the order of all texts; one of them is shared with each set at the threshold."""
    if not len(own):
        return own
    rank = np.zeros(len(own), np.int64)
    if len(shingle):
        at = np.minimum(np.searchsorted(shingle, own), len(shingle) - 1)
        rank = np.where(shingle[at] == own, count[at], 0)
    return own[np.argsort(rank, kind="stable")][: len(own) - needed(len(own), percent) + 1]


def _sets(size: int, percent: int, shingle: np.ndarray, count: np.ndarray, prints: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text) to (doc_id, digest, n, mark: the least hash, bits, fp: SimHash of the distinct words, prefix)."""
        for batch in batches:
            rows, heads = [], [np.empty(0, np.uint64)]
            for t in texts_of(batch.column(1)):
                words = word_hashes(t)
                own = mixed(words, size)
                heads.append(prefix(own, percent, shingle, count))
                rows.append((digest_of(own), len(own), int(own[:1].view(np.int64).sum()), bitmap(own), _signed(fingerprint(np.unique(words))) if prints else None))
            cols = list(zip(*rows)) or [()] * 5
            ends = pa.array(np.cumsum([0, *map(len, heads[1:])]), pa.int32())
            prefixes = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(heads).view(np.int64)))
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds)), prefixes], ["doc_id", "digest", "n", "mark", "bits", "fp", "prefix"])

    return run


class Tree:
    """Signature tree: levels of (OR of bitmaps, least and greatest size, most lost shingles, least and greatest class), the leaves first."""

    def __init__(self, words: np.ndarray, size: np.ndarray, root: np.ndarray) -> None:
        lost = size - np.bitwise_count(words).sum(1, dtype=np.int64)
        self.levels = [(words, size, size, lost, root, root)]
        while len(self.levels[-1][0]) > 1:
            self.grow()

    def grow(self) -> None:
        words, least, most, lost, low, high = self.levels[-1]
        at = np.arange(0, len(words), FAN)
        self.levels.append((np.bitwise_or.reduceat(words, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.maximum.reduceat(lost, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))


def _fits(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether nodes i of level a and j of level b can hold a link between classes, and the most shingles that two of their sets can share."""
    (wa, la, ha, ca, ra, qa), (wb, lb, hb, cb, rb, qb) = a, b
    ok = (100 * ha[i] >= percent * lb[j]) & (100 * hb[j] >= percent * la[i]) & ~((ra[i] == qa[i]) & (rb[j] == qb[j]) & (ra[i] == rb[j]))
    most = np.zeros(len(i), np.int64)
    at, step = np.flatnonzero(ok), max(1, AT_ONCE // max(1, 8 * wa.shape[1]))
    for k in range(0, len(at), step):
        x, y = i[at[k : k + step]], j[at[k : k + step]]
        common = np.bitwise_count(wa[x] & wb[y]).sum(1, dtype=np.int64) + np.minimum(ca[x], cb[y])
        most[at[k : k + step]] = np.minimum(common, np.minimum(ha[x], hb[y]))
    return ok & ((100 + percent) * most >= percent * (la[i] + lb[j])), most


def descend(a: Tree, b: Tree, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves i of a and j of b (of one tree: i < j) that can be links, and the most shingles that they can share."""
    while len(a.levels) < len(b.levels):
        a.grow()
    while len(b.levels) < len(a.levels):
        b.grow()
    i = j = np.zeros(1, np.int64)
    for k in range(len(a.levels) - 1, -1, -1):
        if a is b:
            ahead = i < j if not k else i <= j
            i, j = i[ahead], j[ahead]
        ok, most = _fits(a.levels[k], b.levels[k], i, j, percent)
        i, j, most = i[ok], j[ok], most[ok]
        if k:
            down = np.arange(FAN)
            x, y = np.broadcast_arrays((i[:, None] * FAN + down)[:, :, None], (j[:, None] * FAN + down)[:, None, :])
            inside = (x < len(a.levels[k - 1][0])) & (y < len(b.levels[k - 1][0]))
            i, j = x[inside], y[inside]
    return i, j, most


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    while words.shape[1] > width:
        words = words[:, : words.shape[1] // 2] | words[:, words.shape[1] // 2 :]
    return words


class Group:
    """The sets of one or two trees of a shingle: (id, class, block, size, mark, bitmap, shingles of all its trees), at most two blocks."""

    def __init__(self, rows: list[tuple], crossed: bool, token: int | None = None) -> None:
        self.rows = sorted(rows, key=lambda r: (r[2], len(r[5]), r[1], r[4], r[0]))
        self.root = np.array([r[1] for r in self.rows], np.int64)
        self.crossed, self.token = crossed, token
        self.earlier = None if token is None else self._earlier(token)

    def _earlier(self, token: int) -> np.ndarray:
        """A row of bits for each set: the trees before this one that it shares with another set of this one."""
        seen = Counter(t for r in self.rows for t in r[6] if t < token)
        places = {t: p for p, t in enumerate(t for t, n in seen.items() if n > 1)}
        out = np.zeros((len(self.rows), -(-len(places) // 64)), np.uint64)
        for k, r in enumerate(self.rows):
            at = np.array([places[t] for t in r[6] if t in places], np.int64)
            np.bitwise_or.at(out[k], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        return out

    def _first_here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether no tree before this one holds both sets."""
        if self.earlier is None or not self.earlier.shape[1]:
            return np.ones(len(i), bool)
        step = max(1, AT_ONCE // (8 * self.earlier.shape[1]))
        return np.concatenate([np.empty(0, bool), *(~(self.earlier[i[k : k + step]] & self.earlier[j[k : k + step]]).any(1) for k in range(0, len(i), step))])

    def candidates(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places i and j in rows of the pairs that count here, and the greatest similarity they can have."""
        size = np.array([r[3] for r in self.rows], np.int64)
        parts = {}
        for k, r in enumerate(self.rows):
            parts.setdefault((r[2], len(r[5])), []).append(k)
        held = {at: (np.array(ks), np.frombuffer(b"".join(self.rows[k][5] for k in ks), "<u8").reshape(len(ks), -1)) for at, ks in parts.items()}
        for x, y in ((x, y) for x in held for y in held):
            if (x[0] == y[0]) == self.crossed or x[1] > y[1] or x[1] == y[1] and x > y:
                continue  # each two trees once, the longer bitmaps folded
            (ka, wa), (kb, wb) = held[x], held[y]
            a = Tree(wa, size[ka], self.root[ka])
            b = a if x == y else Tree(_folded(wb, wa.shape[1]), size[kb], self.root[kb])
            i, j, most = descend(a, b, percent)
            i, j = ka[i], kb[j]
            apart = np.flatnonzero(self.root[i] != self.root[j])
            apart = apart[self._first_here(i[apart], j[apart])]
            yield i[apart], j[apart], most[apart] / (size[i[apart]] + size[j[apart]] - most[apart])

    def chosen(self, percent: int, refuted: set, whole: bool) -> list[tuple[int, int]]:
        """Candidates that are not refuted: all of them, or of the nearest ones a spanning forest between classes."""
        found = [(x.astype(np.int32), y.astype(np.int32), z.astype(np.float32)) for x, y, z in self.candidates(percent)]
        if not found:
            return []
        i, j, score = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(-score, kind="stable").astype(np.int32)
        top, out = {}, []

        def find(x):
            while (up := top.get(x, x)) != x:
                top[x] = x = top.get(up, up)
            return x

        pairs = (p for k in range(0, len(order), PART) for p in zip(i[order[k : k + PART]].tolist(), j[order[k : k + PART]].tolist()))
        for x, y in pairs:
            a, b = find(int(self.root[x])), find(int(self.root[y]))
            if a == b or tuple(sorted((self.rows[x][0], self.rows[y][0]))) in refuted:
                continue
            out.append((x, y))
            if not whole:
                top[a] = b
        return out


def _searched(percent: int, whole: bool, single: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (token, lo, hi, other, id, root, block, n, mark, bits, tokens), sorted by (token, lo, hi); other: a refuted partner of id, else null. single: each set has one tree."""
        now, rows, refuted = None, [], set()

        def give():
            if len(rows) < 2 or len({r[1] for r in rows}) < 2:
                return None
            group = Group(rows, now[1] != now[2], None if single else now[0])
            pairs = [sorted(group.rows[x][:2] for x in xy) for xy in group.chosen(percent, refuted, whole)]
            cols = [[now[k]] * len(pairs) for k in range(3)] + [[p[k][w] for p in pairs] for k in (0, 1) for w in (0, 1)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["token", "lo", "hi", "a", "ra", "b", "rb"])

        for batch in (b.slice(k, PART) for b in batches for k in range(0, b.num_rows, PART)):
            for token, lo, hi, other, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (token, lo, hi) != now:
                    if now and (out := give()):
                        yield out
                    now, rows, refuted = (token, lo, hi), [], set()
                if other is None:
                    rows.append(tuple(row))
                else:
                    refuted.add((min(row[0], other), max(row[0], other)))
        if now and (out := give()):
            yield out

    return run


def _compared(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, salt, b, digest, text) sorted by (a, salt, b): text a (null b) first, then its partners, to (a, b, links)."""
        now, held = None, None
        for batch in batches:
            found = []
            for a, salt, b, d, t in zip(*(batch.column(k).to_pylist() for k in range(4)), texts_of(batch.column(4))):
                if (a, salt) != now:
                    now, held = (a, salt), None
                own = mixed(word_hashes(t), size)
                if digest_of(own) != d:  # another row of that doc_id
                    continue
                if b is None:
                    held = own
                else:
                    found.append((a, b, linked(held, own, percent)))
            cols = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "links"])

    return run


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, links) of distinct pairs (a, b) of ids, by the shingles of both texts; a text travels once for each partner, or for SALT of them."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
    places = dealt.select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("id")).distinct().unionByName(dealt.select("a", "salt", "b", F.col("b").alias("id")))
    asked = cut(places.join(reps.select("id", "digest", F.col("doc_id").alias("_id")), "id").drop("id"), "join-asked")
    rows = docs.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, F.col("doc_id").eqNullSafe(F.col("_id"))).select("a", "salt", "b", "digest", "text")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(_compared(size, percent), "a long, b long, links boolean").distinct()


def _dealt(members: DataFrame, block: int) -> DataFrame:
    """members (token, count, id, ...) with lo, hi, block: a row for each two trees of the shingle in which the set takes part."""
    blocks = F.ceil(F.col("count") / block).cast("int")
    own = members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    past = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return past.withColumns({"lo": F.least("block", "_o"), "hi": F.greatest("block", "_o")}).drop("_o", "blocks")


def _forest(reps: DataFrame) -> DataFrame:
    """(token, id): the sets of each tree. Of shingles held by the same sets one stays: their sets have one least id and one hash (64 bits)."""
    postings = reps.select("id", F.explode("prefix").alias("token"))
    held = postings.groupBy("token").agg(F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("all"))
    shared = held.filter(F.col("all") != F.xxhash64("least"))  # the hash of one set is that of its id
    kept = shared.groupBy("least", "all").agg(F.min("token").alias("token")).select("token")
    return cut(postings.join(kept, "token"), "join-trees")


def _searching(dealt: DataFrame, refuted: DataFrame | None, percent: int, whole: bool, single: bool) -> DataFrame:
    kinds = {"root": "long", "block": "int", "n": "int", "mark": "long", "bits": "binary", "tokens": "array<long>"}
    names = ["token", "lo", "hi", "other", "id", *kinds]
    rows = dealt.withColumn("other", F.lit(None).cast("long")).select(names)
    if refuted is not None:
        rows = rows.unionByName(refuted.select("token", "lo", "hi", F.col("b").alias("other"), F.col("a").alias("id"), *(F.lit(None).cast(t).alias(c) for c, t in kinds.items())))
    ordered = rows.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    return ordered.mapInArrow(_searched(percent, whole, single), "token long, lo int, hi int, a long, ra long, b long, rb long")


def _merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """roots (id, root) after the classes a and b of each edge became one."""
    moved = components(edges, "join-classes").withColumnRenamed("root", "_root")
    return cut(roots.join(moved, F.col("root") == F.col("node"), "left").select("id", F.coalesce("_root", "root").alias("root")), "join-roots")


def _seeded(reps: DataFrame, radius: int, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, root) after each set was compared with the first of its component of operator 3."""
    near = components(links(reps.select("fp").distinct(), radius), "join-prints")
    of = reps.join(near, F.col("fp") == F.col("node")).select("id", F.col("root").alias("_of"))
    firsts = of.groupBy("_of").agg(F.min("id").alias("a"))
    pairs = cut(of.join(firsts, "_of").filter("id <> a").select("a", F.col("id").alias("b")), "join-seeds")
    alike = reps.join(near, F.col("fp") == F.col("node"), "left_anti").groupBy("fp").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1")  # one print, without a link to another
    pairs = pairs.unionByName(reps.join(alike.select("fp", "a"), "fp").filter("id <> a").select("a", F.col("id").alias("b")))
    return _merged(reps.select("id", F.col("id").alias("root")), _verified(pairs, docs, reps, size, percent).filter("links").select("a", "b"))


def jaccard_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, forests: int = FORESTS, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest of its set, n), and (digest, root, doc_id: its smallest): roots are equal for sets joined by links.

    radius: components of operator 3 over distinct words are compared first, each set with the first of its component; this
    only spares the trees work.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = cut(plain.mapInArrow(_sets(size, percent, *common_shingles(plain, size), radius is not None), "doc_id long, digest binary, n int, mark long, bits binary, fp long, prefix array<long>"), "join-sets")
    firsts = sets.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "mark", "bits", "fp", "prefix")))
    reps = cut(firsts.withColumn("id", F.monotonically_increasing_id()), "join-texts")  # written, so ids stay as they are
    trees = _forest(reps)
    sizes = trees.groupBy("token").agg(F.count("*").alias("count"))
    largest = trees.join(sizes, "token").groupBy("id").agg(F.max(F.struct("count", "token")).alias("m"), F.sort_array(F.collect_list("token")).alias("tokens"))  # a prefix at most
    own = cut(largest.select("id", F.col("m.token").alias("largest"), "tokens").join(reps.select("id", "n", "mark", "bits"), "id"), "join-own")
    roots, refuted, asked = reps.select("id", F.col("id").alias("root")) if radius is None else _seeded(reps, radius, plain, size, percent), None, None
    for k in range(forests + 2):
        of = own.select(F.col("largest").alias("token"), "id") if not k else trees
        if k > 1:  # a tree without candidates has none later
            of = of.join(asked.select("token").distinct(), "token", "left_semi")
        rooted = of.join(roots, "id")
        live = rooted.groupBy("token").agg(F.count("*").alias("count"), F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a <> _b").select("token", "count")
        members = rooted.join(live, "token").join(own.select("id", "n", "mark", "bits", "tokens"), "id")
        asked = cut(_searching(_dealt(members, block), refuted, percent, k > forests, not k), "join-candidates")
        if asked.isEmpty():
            if not k:  # the largest trees have none, others may
                continue
            break
        found = cut(_verified(asked.select("a", "b").distinct(), plain, reps, size, percent), "join-compared")
        told = asked.join(found, ["a", "b"])
        roots = _merged(roots, told.filter("links").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        if k:
            known = told.filter("NOT links").select("token", "lo", "hi", "a", "b")
            refuted = cut(known if refuted is None else refuted.unionByName(known), "join-refuted")
    return sets.select("doc_id", "digest", "n"), roots.join(reps.select("id", "digest", "doc_id"), "id").drop("id")


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    sets, roots = jaccard_sets(docs, **options)
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = roots.select("digest", "root").join(least, "root").select("digest", "component_id")
    alone = sets.filter("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return sets.filter("n > 0").join(of, "digest").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(alone)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
t AS MATERIALIZED (SELECT s, row_number() OVER () AS k, len(s) AS n FROM (SELECT DISTINCT list_sort(s) AS s FROM s WHERE len(s) > 0)),
m AS MATERIALIZED (SELECT r, doc_id, len(s.s) AS n, coalesce(t.k, -r) AS k FROM s LEFT JOIN t ON list_sort(s.s) = t.s),
g AS MATERIALIZED (SELECT k, n, unnest(s) AS g FROM t),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.g = b.g AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
x(a, b) AS (SELECT k, k FROM m UNION SELECT x.a, l.b FROM x JOIN l ON x.b = l.a),
c AS (SELECT x.a AS k, min(m.doc_id) AS component_id FROM x JOIN m ON m.k = x.b GROUP BY x.a)
SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM m JOIN c USING (k)
"""
