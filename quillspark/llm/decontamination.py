"""Operator 6, benchmark decontamination, in DataFrame functions only.

1. Windows. Texts are lower-cased and split at ASCII white space; the windows of an item are all runs of its size. Of a
   window's shingles (five words; an item of fewer words is one shingle) only those that the item holds count for it and the
   others against it, so windows are laid only where the weights of common shingles in reach suffice for THRESHOLD. Of
   neighbouring windows the best and first one begins where a common shingle comes in at its end, or, cut short by the text's
   end, at a common shingle: those starts are laid, whatever lies between. Nothing that could pass is left out.
2. SimHash. Windows and items get 64-bit fingerprints over their shingles, each counting with the root of its weight: the
   angle between two is then that of their weighted similarity, also where items share most of their words.
3. Multi-index Hamming blocks. Fingerprints are cut into RADIUS + 1 blocks; two within RADIUS bits agree on one block at
   least, so equal (size, block, value) finds every item of the window's size within the radius, whichever item anchored it.
4. Verification. Candidates are kept at a weighted-shingle similarity of at least THRESHOLD: the sum of weight times the
   lesser count over the sum of weight times the greater count of all shingles (with repeats, compared as words); a shingle
   weighs 1 over the number of items that hold it, and 1 if the item does not hold it.

The items' shingles and the windows' places are broadcast only up to BROADCAST_ROWS rows, the items' prints up to PRINT_BYTES, counted before;
beyond that Spark shuffles. Else texts are not shuffled: all are read for shingles, then those with a window are read again.
Radius: a window at the threshold has 9.7 of its item's 64 bits changed on average (an angle of 27 degrees), with a deviation of 2.9, so
one of some 10,000 such windows has more than RADIUS; tests compare with brute force over all windows.

Defined results: null and empty texts on either side match nothing; rows of one doc_id (null included) are one document;
a window at a text's end is cut short; repeated items each match; empty tables give an empty result; further columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import cut, free_name

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 20
#: Rows of small tables (a few dozen bytes each) and bytes of the items' prints that are broadcast, counted before.
BROADCAST_ROWS, PRINT_BYTES = 1_000_000, 64 << 20


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _runs(of: Column, size: Column | int, value) -> Column:
    """value(place from 0, words) of each run of size words."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(F.size(of) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(of) - size + 1)), lambda i: value(i - 1, F.slice(of, i, size)))).otherwise(F.array())


def _shingles(of: Column) -> Column:
    """The shingles as text; a sequence of fewer words is one."""
    return F.when(F.size(of) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(of) - (SHINGLE - 1))), lambda i: F.array_join(F.slice(of, i, SHINGLE), " "))).otherwise(F.array(F.array_join(of, " ")))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column that is worked out once per row: the optimizer copies plain columns into the lambdas that use them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def weighted_prints(df: DataFrame, keys: list[str], of: str, weights: DataFrame) -> DataFrame:
    """keys, fp: 64-bit SimHash of the shingles of the words in column of, a row of df for each keys.

    A shingle counts with the root of its weight (weights: hash, weight; 1 if it isn't there), each repeat as a feature of
    its own: two sequences' angle is then that of their weighted similarity, whatever words they hold. Bit k is 1 if the
    roots of features that set it add up to more than those that don't.
    """
    each = df.select(*keys, F.explode(_runs(F.col(of), F.least(F.size(of), F.lit(SHINGLE)), lambda _, run: F.xxhash64(run))).alias("hash"))
    counted = each.groupBy(*keys, "hash").agg(F.count("*").cast("int").alias("_c")).join(weights, "hash", "left")
    feature = F.struct("hash", F.col("_c").alias("c"), F.sqrt(F.coalesce("weight", F.lit(1.0))).alias("w"))
    held = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(feature)).alias("_f"))  # the shingles of one window or item
    every = F.flatten(F.transform("_f", lambda x: F.transform(F.sequence(F.lit(1), x["c"]), lambda i: F.struct(F.xxhash64(x["hash"], i).alias("h"), x["w"].alias("w")))))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    side = lambda k: F.aggregate("_h", F.lit(0.0), lambda n, x: n + F.when(F.call_function("shiftright", x["h"], k).bitwiseAND(one) == one, x["w"]).otherwise(-x["w"]))
    whole = F.aggregate(F.sequence(F.lit(0), F.lit(63)), none, lambda n, k: n.bitwiseOR(F.when(side(k) > 1e-9, F.call_function("shiftleft", one, k)).otherwise(none)))
    return _once(held, "_h", every).select(*keys, whole.alias("fp"))


def _blocks(df: DataFrame, radius: int) -> DataFrame:
    """One row per block: _block, _value."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    values = [F.struct(F.lit(k).alias("k"), F.shiftright("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v")) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return df.withColumn("_b", F.explode(F.array(*values))).withColumns({"_block": F.col("_b.k"), "_value": F.col("_b.v")}).drop("_b")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start (of the best window, in words from 0), similarity: one row per document and item that it holds."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bench = items.select("item_id", words(F.col("text")).alias("i_words")).filter(F.size("i_words") > 0).withColumns({"n": F.size("i_words"), "_size": F.least(F.size("i_words"), F.lit(SHINGLE))})
    sizes = [r[0] for r in bench.select("_size").distinct().orderBy("_size").collect()]  # of 1 to 5
    if not sizes:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start int, similarity double")
    df = bench.select("item_id", F.explode(F.array_distinct(_shingles(F.col("i_words")))).alias("s"))
    weights = df.groupBy("s").agg((1.0 / F.count("*")).alias("weight"))
    known = bench.select("n", "_size", "i_words", F.xxhash64("i_words").alias("_item")).dropDuplicates(["_item"])
    spots = known.select("_item", "n", "_size", F.explode(_runs(F.col("i_words"), F.col("_size"), lambda _, run: F.struct(F.array_join(run, " ").alias("s"), F.xxhash64(run).alias("hash")))).alias("x")).select("_item", "n", "_size", "x.*").join(weights, "s")
    totals = spots.groupBy("_item").agg(F.sum("weight").alias("total"))
    anchors = cut(spots.select("_item", "n", "_size", "hash", "weight").distinct().join(totals, "_item"), "leak-shingles")
    small = anchors.count() <= broadcast_rows
    split = texts.select("doc_id", words(F.col("text")).alias("w"))
    runs = F.flatten(F.array(*(_runs(F.col("w"), size, lambda at, run: F.struct(at.alias("d_at"), F.xxhash64(run).alias("hash"))) for size in sizes)))
    hits = split.select("doc_id", F.size("w").alias("len"), F.explode(runs).alias("x")).select("doc_id", "len", "x.*").join(F.broadcast(anchors) if small else anchors, "hash")
    least = threshold - 1e-5
    enough = hits.withColumn("all", F.expr("sum(weight) OVER (PARTITION BY doc_id, _item)")).filter(F.col("all") >= least * F.col("total"))
    span = F.col("n") - F.col("_size")
    spread = enough.withColumns({"span": span, "behind": F.col("len") - F.col("_size") - F.col("d_at"), "at": F.col("d_at") / F.greatest(span, F.lit(0.5))})
    over = lambda what, frame: F.expr(f"{what} OVER (PARTITION BY doc_id, _item ORDER BY at RANGE BETWEEN {frame})")
    back, on = "1.000000001D PRECEDING AND CURRENT ROW", "CURRENT ROW AND 1.000000001D FOLLOWING"
    laid = spread.withColumns({"w_back": over("sum(weight)", back), "n_back": over("count(*)", back), "w_on": over("sum(weight)", on), "n_on": over("count(*)", on)})
    fits = lambda side, room: F.col(f"w_{side}") >= least * (F.col("total") + F.greatest(F.lit(0), F.least(F.col("span"), room) + 1 - F.col(f"n_{side}")))
    starts = F.array(F.when(fits("back", F.col("d_at")), F.col("d_at") - F.col("span")), F.when((F.col("behind") < F.col("span")) & fits("on", F.col("behind")), F.col("d_at")))
    places = cut(laid.select(F.col("doc_id").alias("_d"), "n", F.explode(starts).alias("start")).filter("start IS NOT NULL").distinct(), "leak-places")
    dealt = places.groupBy("_d").agg(F.collect_list(F.struct("start", "n")).alias("_at"))  # at most two for each shared shingle of one text
    held = texts.join(F.broadcast(dealt) if places.count() <= broadcast_rows else dealt, F.col("doc_id").eqNullSafe(F.col("_d")))
    cut_out = _once(held.select("doc_id", "text", "_at"), "w", words(F.col("text"))).select("doc_id", F.explode(F.transform("_at", lambda p: F.struct(p["start"].alias("start"), p["n"].alias("n"), F.slice("w", F.greatest(F.lit(1), p["start"] + 1), F.greatest(F.lit(0), p["n"] + F.least(F.lit(0), p["start"]))).alias("w")))).alias("x")).select("doc_id", "x.*")
    by_hash = cut(anchors.select("hash", "weight").distinct(), "leak-weights")
    by_hash = F.broadcast(by_hash) if by_hash.count() <= broadcast_rows else by_hash
    placed = cut(cut_out.filter(F.size("w") > 0).withColumn("_w", F.xxhash64("w")).dropDuplicates(["doc_id", "start", "n", "_w"]), "leak-windows")
    seen = weighted_prints(placed, ["doc_id", "start", "n", "_w"], "w", by_hash).select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("n").alias("_n"), F.col("_w").alias("_x"), "fp")
    found = placed.join(seen, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("start") == F.col("_s")) & (F.col("n") == F.col("_n")) & (F.col("_w") == F.col("_x")))
    windows = _blocks(found.select("doc_id", "start", "n", "w", "fp"), radius)
    counted = bench.dropDuplicates(["item_id", "i_words"]).select("item_id", "i_words", F.explode(_shingles(F.col("i_words"))).alias("s")).groupBy("item_id", "i_words", "s").agg(F.count("*").alias("n_item"))
    weighed = counted.join(weights, "s").groupBy("item_id", "i_words").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("weight", "n_item")))).alias("shingles"), F.sum(F.col("weight") * F.col("n_item")).alias("total"))
    own = weighted_prints(known.select("_item", "i_words"), ["_item"], "i_words", by_hash)
    prints = cut(_blocks(weighed.withColumns({"n": F.size("i_words"), "_item": F.xxhash64("i_words")}).join(own, "_item"), radius).withColumnRenamed("fp", "i_fp").drop("i_words", "_item"), "leak-prints")
    few = prints.agg(F.coalesce(F.sum(F.lit(64) + F.size("shingles") * 96), F.lit(0))).first()[0] <= PRINT_BYTES  # about what they take
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("i_fp"))) <= radius
    candidates = windows.join(F.broadcast(prints) if few else prints, ["n", "_block", "_value"]).filter(near)
    first = F.expr(f"_block = aggregate(sequence(0, {radius}), {radius + 1}, (m, k) -> least(m, if(((fp ^ i_fp) & element_at(_masks, k + 1)) = 0, k, {radius + 1})))")
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    masks = F.array(*(F.lit(((1 << b) - (1 << a)) - ((1 << 64) if b == 64 else 0)).cast("long") for a, b in zip(cuts, cuts[1:])))
    once = candidates.withColumn("_masks", masks).filter(first)  # a pair that agrees on several blocks counts at the first
    listed = _once(once, "_w", _shingles(F.col("w")))
    a, own = F.col("_w"), F.array_distinct("_w")
    times = lambda s: F.when(F.size(own) == F.size(a), F.lit(1)).otherwise(F.size(F.filter(a, lambda y: y == s)))
    met = _once(listed, "_met", F.transform(own, lambda s: F.struct(F.try_element_at("shingles", s).alias("item"), times(s).alias("c"))))
    both = F.aggregate("_met", F.lit(0.0), lambda n, x: n + F.when(x["item"].isNull(), 0.0).otherwise(x["item"]["weight"] * F.least(x["c"], x["item"]["n_item"])))
    more = F.aggregate("_met", F.lit(0.0), lambda n, x: n + F.when(x["item"].isNull(), x["c"].cast("double")).otherwise(x["item"]["weight"] * F.greatest(F.lit(0), x["c"] - x["item"]["n_item"])))
    scored = met.withColumn("similarity", F.round(both / (F.col("total") + more), 6)).filter(F.col("similarity") >= threshold)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("m"))
    return best.select("doc_id", "item_id", F.greatest(F.lit(0), -F.col("m.s")).cast("int").alias("start"), F.col("m.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no item."""
    own = free_name("_bad", docs.columns)
    bad = leaks(docs, items, **options).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(bad, docs[options.get("id_col", "doc_id")].eqNullSafe(F.col(own)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))

