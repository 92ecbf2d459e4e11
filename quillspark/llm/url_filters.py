"""Operator 7, URL filters: host and path rules first, then gradient-boosted trees on lexical features.

Rules (host, path, verdict) fit a host and its subdomains where the path begins with the rule's; the longest wins. Urls
that no rule fits are judged by boosted trees, trained on labelled urls (without others given: those that the rules
decide), a bounded sample of SAMPLE rows by the md5 of their id. Features: length, host labels, path depth, digit ratio,
character entropy, parameters, hyphens, and of the host's last label the smoothed share of blocked urls among all labelled
ones and the frequency among all pages; only the fitting uses the sample, which is written once. All of it is DataFrame functions and Spark's own tree learner; no Python runs on executors.

Defined results: a null url, and one without ://, has an empty host and path, no rule, and features of an empty text;
without labels of both kinds the trees' verdict is the only label, or allow; rows that repeat are judged alike; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import cut

SAMPLE, BROADCAST_ROWS = 20_000, 100_000
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
FEATURES = ["f_length", "f_labels", "f_depth", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_suffix_rate", "f_suffix_share"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, or null."""
    def fits(h: str, p: str) -> Column:
        return ((host == h) | host.endswith(f".{h}")) & path.startswith(p)

    found = [F.when(fits(h, p), F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.greatest(*found, *([found[0]] if len(found) == 1 else []))


def _lexical(df: DataFrame) -> DataFrame:
    """The features that need the url alone, and _suffix, the host's last label."""
    text = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return df.withColumns({
        "f_length": n.cast("double"), "f_labels": F.size(F.split("host", r"\.")).cast("double"),
        "f_depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
        "f_digits": F.coalesce(F.try_divide(F.length(F.regexp_replace(text, "[^0-9]", "")), n), F.lit(0.0)),
        "f_entropy": F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda e, c: e + F.when(c == "", F.lit(0.0)).otherwise(-share(c) * F.log2(share(c))))).otherwise(F.lit(0.0)),
        "f_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "f_hyphens": (n - F.length(F.replace(text, F.lit("-"), F.lit("")))).cast("double"),
        "_suffix": F.substring_index("host", ".", -1),
    })


def _suffixes(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, float]:
    """_suffix, f_suffix_rate of all labelled urls, f_suffix_share of all pages; and the share of blocked urls."""
    n = rows.count()
    prior = known.agg(F.avg("label")).first()[0]
    rates = known.groupBy("_suffix").agg(((F.sum("label") + prior * 10) / (F.count("*") + 10)).alias("f_suffix_rate"))
    shares = rows.groupBy("_suffix").agg((F.count("*") / max(n, 1)).alias("f_suffix_share"))
    return shares.join(rates, "_suffix", "full"), prior


def _with_suffixes(df: DataFrame, suffixes: DataFrame, few: bool, prior: float) -> DataFrame:
    """A few suffixes are broadcast, so that a hot one moves no rows; else the larger side streams past them."""
    joined = df.join(F.broadcast(suffixes) if few else suffixes.hint("merge"), "_suffix", "left")
    return joined.withColumns({"f_suffix_rate": F.coalesce("f_suffix_rate", F.lit(prior)), "f_suffix_share": F.coalesce("f_suffix_share", F.lit(0.0))})


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (the trees' probability; null where a rule decides).

    labelled: url, blocked (0 or 1); else the urls that the rules decide.
    """
    def prepared(df: DataFrame) -> DataFrame:
        host, path = host_and_path(F.col("url"))
        return df.withColumns({"host": host, "path": path})

    rows = prepared(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    ruled = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = ruled.filter("_rule IS NOT NULL").select("url", "host", "path", (F.col("_rule.verdict") == "block").cast("double").alias("label"))
    else:
        known = prepared(labelled.select("url", F.col("blocked").cast("double").alias("label"))).filter(F.col("label").isin(0.0, 1.0))
    taken = _lexical(known.orderBy(F.md5(F.coalesce("url", F.lit(""))), "label").limit(sample))
    taken = cut(taken, "url-sample")
    seen = {r["label"]: r["count"] for r in taken.groupBy("label").count().collect()}  # two rows at most
    if len(seen) < 2:
        other = "block" if seen.get(1.0) else "allow"
        judged = ruled.withColumn("p_block", F.lit(1.0 if other == "block" else 0.0))
    else:
        suffixes, prior = _suffixes(_lexical(rows), _lexical(known))
        suffixes = cut(suffixes, "url-suffixes")
        few = suffixes.count() <= BROADCAST_ROWS
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="_x", handleInvalid="keep")
        model = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=20, maxDepth=4, seed=7).fit(assembler.transform(_with_suffixes(taken, suffixes, few, prior)).select("_x", "label"))
        rest = _with_suffixes(_lexical(ruled), suffixes, few, prior)
        judged = model.transform(assembler.transform(rest)).withColumn("p_block", F.element_at(vector_to_array("probability"), 2))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("_rule").isNull(), F.col("p_block")).alias("p_block"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")

