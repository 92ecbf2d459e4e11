"""Translation memory: segments, alignment, confidence, dedupe, statistics, lookup, export; glossary and fidelity tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules


def segments(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """para, sent and segment: paragraphs at blank lines, sentences after . ! ? and white space."""
    paras = df.select(*keys, F.posexplode(F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p) != "")).alias("para", "_p"))
    return paras.select(*keys, "para", F.posexplode(F.filter(F.split("_p", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")).alias("sent", "segment"))


def align(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Segments paired by place; confidence from the counts: 1.0 if paragraph and sentence counts agree, 0.8 if sentences of the paragraph differ by one, 0.5 if by more, 0.3 unpaired."""
    at = [*keys, "para"]
    counted = lambda df, n: df.withColumn(n, F.count("*").over(Window.partitionBy(*at)))
    a = counted(source, "_a").withColumnRenamed("segment", "source")
    b = counted(target, "_b").withColumnRenamed("segment", "target")
    j = a.join(b, [*at, "sent"], "full_outer")
    gap = F.abs(F.col("_a") - F.col("_b"))
    conf = F.when(F.col("source").isNull() | F.col("target").isNull(), 0.3).when(gap == 0, 1.0).when(gap == 1, 0.8).otherwise(0.5)
    return j.select(*at, "sent", "source", "target", conf.alias("confidence"))


def dedupe(tm: DataFrame) -> DataFrame:
    """One row per source and target, at the highest confidence; sources with several targets are flagged."""
    best = tm.groupBy("source", "target").agg(F.max("confidence").alias("confidence"), F.count("*").alias("uses"))
    several = best.groupBy("source").agg(F.count("*").alias("targets"))
    return best.join(several, "source").withColumn("conflicting", F.col("targets") > 1)


def band(confidence: Column) -> Column:
    out = F.when(confidence >= rules.TM_CONFIDENCE[0][1], rules.TM_CONFIDENCE[0][0])
    return out.when(confidence >= rules.TM_CONFIDENCE[1][1], rules.TM_CONFIDENCE[1][0]).otherwise("low")


def statistics(tm: DataFrame, by: str) -> DataFrame:
    b = band(F.col("confidence"))
    return tm.groupBy(by).agg(F.count("*").alias("segments"), *(F.count_if(b == k).alias(k) for k in ("high", "medium", "low")), F.round(F.count("target") / F.count("*"), 4).alias("coverage"))


#: Runs of all segments up to which anchors are broadcast; beyond, units and segments meet by a shuffle.
SMALL = 200_000
#: Places that hold an anchor beyond which its places and segments are dealt over SALT parts of that shuffle.
HOT, SALT = 10_000, 16
#: Characters by which a word of a short segment is looked for in the units' words, and how long those are before they are cut.
SHORT, PIECE = 3, 256


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _side_by_side(items: Column, n: int) -> Column:
    """Each item with the n - 1 after it, as structs of fields 0 to n - 1; null past the end."""
    return F.arrays_zip(*(F.slice(items, k + 1, F.size(items)) for k in range(n)))


def _inner_runs(source: Column) -> Column:
    """Keys of the words between the first and last one of a segment, two at a time, which a unit that holds it must hold whole."""
    words = _words(source)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 3)), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))
    return F.when(F.size(words) >= 4, F.array_distinct(pairs)).when(F.size(words) == 3, F.array(F.xxhash64(F.get(words, F.lit(1)))))


def _places(texts: DataFrame, pairs: bool, singles: bool) -> DataFrame:
    """_id and the key _g of each pair of neighbouring words and of each word of the texts (_id, _t).

    Keys are digests: equal ones of different words only bring a pair that contains() refuses. Generators are outer ones, since
    Spark would work out the array of an inner one twice.
    """
    words = texts.select("_id", F.split("_t", r"\s+").alias("_w"))
    if not pairs:
        return words.select("_id", F.explode_outer("_w").alias("_a")).select("_id", F.xxhash64("_a").alias("_g"))
    each = words.select("_id", F.explode_outer(_side_by_side(F.col("_w"), 2)).alias("_x"))
    two, one = F.xxhash64(F.col("_x")["0"], F.col("_x")["1"]), F.xxhash64(F.col("_x")["0"])
    return each.select("_id", F.explode_outer(F.array(two, one)).alias("_g") if singles else two.alias("_g"))


def _meet(places: DataFrame, anchors: DataFrame, few: bool, hot: int) -> DataFrame:
    """Places and anchors of equal _g: by a broadcast, or by a shuffle in which hot ones are dealt over parts."""
    if few:
        return places.join(F.broadcast(anchors), "_g")
    own = anchors.select("_g").distinct()
    held = places.groupBy("_g").agg(F.count("*").alias("_n"))
    parts = own.join(held, "_g").select("_g", F.when(F.col("_n") > hot, SALT).otherwise(1).alias("_parts"))
    dealt = places.join(parts, "_g").withColumn("_part", F.pmod(F.xxhash64(*places.columns), F.col("_parts")).cast("int")).drop("_parts")
    copies = anchors.join(parts, "_g").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copies, ["_g", "_part"]).drop("_part")


def _words_with(texts: DataFrame, parts: DataFrame, longest: int, few: bool, hot: int) -> DataFrame:
    """The key _g of each distinct word of the texts that holds a part (_p), by the part's first characters: _g, _s."""
    words = texts.select(F.explode_outer(F.split("_t", r"\s+")).alias("_a")).distinct()
    cut = F.when(F.length("_a") <= PIECE + longest, F.array(F.col("_a"))).otherwise(F.transform(F.sequence(F.lit(0), F.floor(F.length("_a") / PIECE).cast("int")), lambda k: F.substring(F.col("_a"), k * PIECE + 1, F.lit(PIECE + longest))))
    pieces = words.select(F.xxhash64("_a").alias("_word"), F.explode_outer(cut).alias("_a"))
    placed = pieces.select("_word", "_a", F.explode_outer(_side_by_side(F.split("_a", ""), SHORT)).alias("_x"))
    runs = [F.xxhash64(*(F.col("_x")[str(k)] for k in range(n))) for n in range(1, SHORT + 1)]
    keyed = placed.select("_word", "_a", F.explode_outer(F.array(*runs)).alias("_g"))
    first = F.split(F.substring("_p", 1, SHORT), "")
    anchors = parts.withColumn("_g", F.when(F.size(first) == 1, F.xxhash64(first[0])).when(F.size(first) == 2, F.xxhash64(first[0], F.get(first, F.lit(1)))).otherwise(F.xxhash64(first[0], F.get(first, F.lit(1)), F.get(first, F.lit(2)))))
    return _meet(keyed, anchors, few, hot).filter(F.contains("_a", "_p")).select(F.col("_word").alias("_g"), "_s").distinct()


def lookup(units: DataFrame, tm: DataFrame, id_col: str, text: str, hot: int = HOT, small: int = SMALL) -> DataFrame:
    """Segments of the memory (source, target, confidence) whose source, outer white space aside, occurs anywhere in a unit's text.

    Each distinct source is anchored at the run of its inner words that occurs least in the units, one of one or two words at
    all words of the units that hold its longest word; units meet segments by equal anchors, and only those pairs are looked
    at with contains(). A segment of which one run is in no unit meets none. Characters are looked at once a distinct word,
    not once a place. Anchors of a memory of up to small runs are broadcast, so of the units only what meets one moves; of a
    larger one, places of an anchor beyond hot are dealt over SALT parts, and its segments go to each. Texts move once, to
    the pairs of their unit. Null or blank sources and null texts match nothing.
    """
    trimmed = F.trim(F.regexp_replace("source", r"^\s+|\s+$", "")).alias("_s")
    sources = tm.select(trimmed).filter("_s <> ''").distinct().withColumn("_w", _words(F.col("_s")))
    own = sources.filter(F.size("_w") > 2).select("_s", F.explode(_inner_runs(F.col("_s"))).alias("_g"))
    longest = F.array_max(F.transform("_w", lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    parts = sources.filter(F.size("_w") <= 2).select("_s", longest.alias("_p"))
    pairs, singles = (bool(x) for x in sources.agg(F.max(F.size("_w") > 3), F.max(F.size("_w") <= 3)).first())
    if not pairs and not singles:
        return units.select(id_col, *(F.lit(None).cast(tm.schema[c].dataType).alias(c) for c in ("source", "target", "confidence"))).limit(0)
    runs = own.count()
    shorts, length = parts.agg(F.count("*"), F.max(F.length("_p"))).first()
    texts = units.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    places, few = _places(texts, pairs, singles), runs + shorts <= small
    anchors = None
    if runs:
        seen = places.join(F.broadcast(own.select("_g").distinct()), "_g", "left_semi") if few else places
        held = seen.groupBy("_g").agg(F.count("*").alias("n"))
        least = own.join(held, "_g", "left").groupBy("_s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_g")).alias("a"))
        anchors = least.filter("a.n > 0").select("a._g", "_s")
    if shorts:
        holding = _words_with(texts, parts, length, few, hot)
        anchors = anchors.unionByName(holding) if anchors else holding
    anchors = anchors.localCheckpoint() if few else anchors
    met = _meet(places, anchors, few and anchors.count() <= small, hot).select("_id", "_s").distinct()
    found = units.select(id_col, F.col(text).alias("_t")).join(met, F.col(id_col).eqNullSafe(F.col("_id"))).filter(F.contains("_t", "_s")).select(id_col, "_s")
    return found.join(tm.select(trimmed, "source", "target", "confidence"), "_s").drop("_s")


def tmx(tm: DataFrame, by: str) -> DataFrame:
    """One exchange document per group, of its paired segments in order of source."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    unit = F.concat(F.lit("<tu><tuv><seg>"), esc(F.col("source")), F.lit("</seg></tuv><tuv><seg>"), esc(F.col("target")), F.lit("</seg></tuv></tu>"))
    return tm.filter("source IS NOT NULL AND target IS NOT NULL").groupBy(by).agg(F.concat(F.lit("<tmx><body>"), F.array_join(F.array_sort(F.collect_list(unit)), ""), F.lit("</body></tmx>")).alias("tmx"))


def glossary_gaps(counts: DataFrame, glossary: DataFrame) -> DataFrame:
    """Counted terms (term, n) that the glossary (term) lacks."""
    return counts.join(glossary.select("term").distinct(), "term", "left_anti")


def fidelity(markers: DataFrame, by: str) -> DataFrame:
    """Share of each drift marker (column marker) and the band of the unmarked share."""
    n = markers.groupBy(by, "marker").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(by))
    clean = F.max(F.when(F.col("marker") == "none", F.col("n"))).over(Window.partitionBy(by))
    score = F.coalesce(clean, F.lit(0)) * 100 / total
    return n.select(by, "marker", "n", F.round(F.col("n") * 100 / total, 2).alias("percent"), F.when(score >= 90, "high").when(score >= 75, "medium").otherwise("low").alias("band"))


def severity_cube(df: DataFrame, category: str, severity: str) -> DataFrame:
    """Counts by category and severity with totals of both."""
    return df.cube(category, severity).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
