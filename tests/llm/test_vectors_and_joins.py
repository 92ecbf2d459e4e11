"""Operators 11 to 13 against brute force: nulls, ties, repeats, empty tables, odd lengths, clashing columns, hot groups."""

import random

import numpy as np
import pytest

from quillspark.llm import hard_negatives, signature_join, vector_codes
from quillspark.llm.signature_join import mixed, word_hashes
from quillspark.llm.vectors import integer_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, block string, code int"
NAN, INF = float("nan"), float("inf")


def vectors(n=300, wide=32, seed=3):
    dice = np.random.default_rng(seed)
    centers = dice.normal(size=(12, wide))
    rows = [(k, [float(x) for x in np.float32((centers[k % 12] + 0.3 * dice.normal(size=wide)) / 4)], k % 4 if k % 11 else None, "b", 1) for k in range(n)]
    rows += [(n, None, 1, "b", 1), (n + 1, [1.0] * (wide - 1) + [None], 1, "b", 1), (n + 2, [NAN] * wide, 2, None, None), (n + 3, [INF] * wide, 2, None, None), (n + 4, [-INF] * wide, 2, None, None)]
    rows += [(350 + k, rows[50][1], 1, "b", 1) for k in range(40)]  # copies: ties
    rows += [(None, rows[3][1], 2, "b", 1), (7, rows[9][1], 3, "b", 1)]
    return rows


def floors(v):
    return [int(np.floor(256 * float(x))) for x in v]


def usable(rows):
    return [(i, floors(v), y) for i, v, y, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]


def lloyd_by_force(rows, parts, entries, rounds):
    kept = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = -(-max(len(v) for _, v, _ in kept) // parts)
    x = np.array([v + [0] * (parts * wide - len(v)) for _, v, _ in kept], np.int64).reshape(len(kept), parts, wide)
    books = [x[:entries, m].copy() for m in range(parts)]

    def assign():
        far = np.stack([((x[:, m, None, :] - books[m][None]) ** 2).sum(2) for m in range(parts)], 1)
        return far.argmin(2), far.min(2).sum(1)

    for _ in range(rounds):
        code, _ = assign()
        for m in range(parts):
            for j in range(len(books[m])):
                if (mine := x[code[:, m] == j, m]).size:
                    books[m][j] = mine.sum(0) // len(mine)
    code, error = assign()
    return sorted((str(i), bytes(c.astype(np.uint8)), int(e)) for (i, *_), c, e in zip(kept, code, error)), np.stack(books)


@pytest.mark.parametrize("wide, block, rounds", [(32, 4096, 2), (32, 16, 5), (30, 50, 3)])
def test_heap_lloyd_is_lloyd(spark, wide, block, rounds):
    rows = vectors(wide=wide)
    got, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), entries=16, rounds=rounds, block=block)
    want, want_books = lloyd_by_force(rows, 16, 16, rounds)
    assert sorted((str(r.vec_id), bytes(r.code), r.error) for r in got.collect()) == want
    assert (books == want_books).all()
    code = bytes(got.filter("vec_id = 5").first().code)
    assert (vector_codes.decode(code, books).reshape(16, -1) == want_books[np.arange(16), list(code)]).all()


def test_heaps_spare_parts_that_no_bound_lets_move():
    dice = np.random.default_rng(1)
    x = np.concatenate([dice.integers(-3, 4, (400, 16)) + 300 * k for k in range(4)])
    books = np.stack([np.array([[300 * k] for k in range(4)])] * 16)
    block = vector_codes.Block(x, books)
    block.first(books)
    moved = books.copy()
    moved[:, 0] += 2
    drift = vector_codes._drifted(books, moved)
    assert block.again(moved, drift) == 0 and (block.code == np.repeat(np.arange(4), 400)[:, None]).all()
    moved[:, 0] += 398
    assert 0 < block.again(moved, drift + 398) and (block.code == np.stack([((x[:, m, None] - moved[m].T) ** 2).argmin(1) for m in range(16)], 1)).all()


def test_codes_of_few_and_no_rows(spark):
    few = spark.createDataFrame(vectors()[:3], SCHEMA)
    got, books = vector_codes.compress(few)
    assert books.shape[:2] == (16, 3) and sorted(bytes(r.code) for r in got.collect()) == [bytes([k] * 16) for k in range(3)]
    none, _ = vector_codes.compress(few.limit(0))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error"]
    empty, _ = vector_codes.compress(spark.createDataFrame([(1, [], 0, "", 0), (2, [], 0, "", 0)], SCHEMA))
    assert [(bytes(r.code), r.error) for r in empty.collect()] == [(bytes(16), 0)] * 2


def test_large_components_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        integer_vectors(spark.createDataFrame([(1, [1e9], 0, "", 0)], SCHEMA), "vec_id", "embedding", "label").collect()


def negatives_by_force(rows, step, top=5, n=3, low=50, high=95):
    kept = [(i, np.array(v, np.int64), y) for i, v, y in usable(rows) if i is not None and y is not None]
    anchors = {(i, tuple(v), y) for i, v, y in kept if i % step == 0}
    out = []
    for i, v, y in anchors:
        scored = sorted(((-int(np.dot(v, w)), j, z) for j, w, z in kept if j != i))
        for s, j, _ in [x for x in scored if x[2] == y][:top]:
            fits = [(t, k) for t, k, z in scored if z != y and low * -s <= 100 * -t <= high * -s][:n]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("rows_in_block, sample", [(1 << 16, 4096), (40, 20)])
def test_hard_negatives(spark, rows_in_block, sample):
    rows = vectors()
    kept = integer_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), "vec_id", "embedding", "label").filter("vec_id IS NOT NULL AND label IS NOT NULL")
    got = hard_negatives.mine(kept, kept.filter("vec_id % 7 = 0"), rows_in_block=rows_in_block, sample=sample)
    want = negatives_by_force(rows, 7)
    assert sorted(tuple(r)[:6] for r in got.collect()) == want and len(want) > 150


def test_hard_negatives_of_nothing(spark):
    kept = integer_vectors(spark.createDataFrame(vectors()[:30], SCHEMA), "vec_id", "embedding", "label").filter("label IS NOT NULL")
    assert hard_negatives.mine(kept.limit(0), kept.limit(0)).count() == 0
    assert hard_negatives.mine(kept, kept.limit(0)).count() == 0
    lone = kept.filter("vec_id = 1")
    assert hard_negatives.mine(lone, lone).count() == 0


def test_bounds_hold():
    dice = np.random.default_rng(2)
    x = dice.integers(-200, 200, (500, 24))
    books = hard_negatives.fit(x[:60], entries=8)
    codes, rest = hard_negatives.encode(x, books)
    low, high = hard_negatives.bounds(hard_negatives.tables(x[:50], books), np.sqrt((x[:50] ** 2).sum(1)) * (1 + 1e-9), codes, rest)
    exact = x[:50] @ x.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).mean() < 2 * np.abs(exact).max()


def texts(seed=4, n=160):
    dice = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        words = [dice.choice(vocabulary) for _ in range(dice.randrange(1, 120))]
        if k % 3 and rows:  # copies, near copies and chains of near copies
            words = dice.choice(rows)[1].split()
            for _ in range(dice.randrange(0, 4)):
                words[dice.randrange(len(words))] = dice.choice(vocabulary)
        if k % 10 == 0:
            words = [f"common{j}" for j in range(40)] + words[: k % 7]
        rows.append((k, " ".join(words) if k % 2 else "  ".join(words).upper(), "x", 1))
    return [*rows, (n, None, "x", 1), (n + 1, "", "x", 1), (n + 2, " \n\t", "x", 1), (n + 3, "two words", "x", 1), (n + 4, "TWO words", "x", 1), (n + 5, "word " * 20000, "x", 1), (None, rows[5][1], "x", 1), (3, rows[8][1], "x", 1)]


def components_by_force(rows, size=4, percent=85):
    sets = []
    for _, t, *_ in rows:
        words = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset())
    top = list(range(len(rows)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    links = 0
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                top[find(a)] = find(b)
    least = {}
    for k, (d, *_) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted((str(d), len(sets[k]), str(d if not sets[k] else least.get(find(k)))) for k, (d, *_) in enumerate(rows)), links


@pytest.mark.parametrize("block, forests, percent", [(1024, 4, 85), (4, 0, 85), (7, 2, 60)])
def test_signature_join(spark, block, forests, percent):
    rows = texts()
    got = signature_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, root string, token int").repartition(4), block=block, forests=forests, percent=percent).collect()
    want, links = components_by_force(rows, percent=percent)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want and links > 50


def test_signature_join_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert signature_join.jaccard_components(none).count() == 0
    blank = signature_join.jaccard_components(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert sorted(map(tuple, blank.collect())) == [(1, 0, 1), (2, 0, 2)]


def test_descent_loses_no_pair_and_prunes():
    dice = random.Random(9)
    sets = []
    for k in range(120):
        words = [f"v{dice.randrange(5000)}" for _ in range(dice.randrange(5, 300))] if k % 3 == 0 else sets[-1][0][: max(5, len(sets[-1][0]) - dice.randrange(0, 9))]
        sets.append((words, mixed(word_hashes(" ".join(words).encode()), 4)))
    rows = [(1000 + k, k, 0, len(own), int(own[0] >> np.uint64(1)), signature_join.bitmap(own), [5, 9] if k % 2 else [5, 7, 9]) for k, (_, own) in enumerate(sets)]
    group = signature_join.Group(rows, False)
    found = {tuple(sorted((group.rows[a][1], group.rows[b][1]))) for i, j, _ in group.candidates(85) for a, b in zip(i.tolist(), j.tolist())}
    true = {(a, b) for a in range(120) for b in range(a + 1, 120) if signature_join.linked(sets[a][1], sets[b][1], 85)}
    assert true <= found and len(found) < 2 * len(true) + 50 < 120 * 119 / 4
    forest = group.chosen(85, set(), False)
    assert len(forest) < len(rows) and len(group.chosen(85, set(), True)) == len(found)
    assert len(signature_join.Group(rows, False, 5).chosen(85, set(), True)) == len(found) and not signature_join.Group(rows, False, 9).chosen(85, set(), True)


def test_prefixes_of_linked_sets_meet():
    dice = np.random.default_rng(5)
    base = np.unique(dice.integers(0, 1 << 60, 400).astype(np.uint64))
    common = np.sort(base[::3])
    for drop in range(0, 40, 4):
        other = np.unique(np.concatenate([base[drop:], dice.integers(0, 1 << 60, drop).astype(np.uint64)]))
        if signature_join.linked(base, other):
            a, b = (signature_join.prefix(s, 85, common, np.arange(len(common))) for s in (base, other))
            assert len(np.intersect1d(a, b))


def test_queries_have_the_columns_of_their_contracts(spark):
    from quillspark.llm import queries

    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES["op12_vector_codes"](spark, sf).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert set(queries.QUERIES["op11_hard_negatives"](spark, sf).columns) == {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"}
    kinds = {f.name: f.dataType.simpleString() for f in queries.QUERIES["op13_signature_join"](spark, sf).schema}
    assert kinds == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
