"""Reports at the sink: Markdown lines, SARIF documents, comparison sections, and checks of remote payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.ranges import running
from quillspark.functions.text import markdown_escape
from quillspark.operators import network
from quillspark.operators.metadata import sarif_level

CAVEAT = "A clear report does not prove authorship and does not lift duties of disclosure."


def location_text(loc: Column) -> Column:
    """Readable place of a finding: struct (line, column, offset, member, segment, tool), nulls left out."""
    part = lambda name: F.when(loc[name].isNotNull(), F.concat(F.lit(f"{name} "), loc[name].cast("string")))
    return F.concat_ws(", ", part("member"), part("segment"), part("tool"), part("line"), part("column"), part("offset"))


def markdown(findings: DataFrame, run: str = "run_id") -> DataFrame:
    """One Markdown report per run: findings (target, rule_id, confidence, code_point, count) in order, and the caveat."""
    line = F.concat_ws(" ", F.lit("-"), markdown_escape(F.col("target")), F.col("rule_id"), F.concat(F.lit("("), "confidence", F.lit(")")), "code_point", F.concat(F.lit("x"), F.coalesce("count", F.lit(1)).cast("string")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("target", "rule_id", F.coalesce("code_point", F.lit("")).alias("cp"), line.alias("l")))), lambda x: x["l"]), "\n")
    return findings.groupBy(run).agg(F.concat(F.lit("# Findings\n\n"), body, F.lit(f"\n\n{CAVEAT}\n")).alias("report"))


def sarif(findings: DataFrame, run: str = "run_id") -> DataFrame:
    """One SARIF 2.1.0 document per run: rules are the sorted distinct rule ids."""
    result = F.struct(F.col("rule_id").alias("ruleId"), sarif_level(F.col("confidence")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("target").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"))
    g = findings.groupBy(run).agg(F.transform(F.array_sort(F.collect_set("rule_id")), lambda r: F.struct(r.alias("id"))).alias("rules"), F.array_sort(F.collect_list(result)).alias("results"))
    driver = F.struct(F.struct(F.lit("quillspark").alias("name"), F.col("rules")).alias("driver"))
    return g.select(run, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), "results")).alias("runs"))).alias("sarif"))


def compared_lines(diff: DataFrame, target: str) -> DataFrame:
    """Sections of removed, remaining and added findings per target."""
    long = diff.select(target, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("removed", "remaining", "added")))).alias("x"), "rule_id", "confidence", "code_point").filter("x.n > 0")
    line = F.concat_ws(" ", F.col("x.kind"), "rule_id", "confidence", "code_point", F.concat(F.lit("x"), F.col("x.n").cast("string")))
    return long.groupBy(target).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("section"))


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    parts = F.split(text, r"\.")
    valid = text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    part = lambda k: F.get(parts, F.lit(k)).try_cast("long")
    return F.when(valid, part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3))


SPECIAL_RANGES = network.SPECIAL_IPV4


def in_network(number: Column, base: str, bits: int) -> Column:
    a, b, c, d = map(int, base.split("."))
    low = ((a << 24) | (b << 16) | (c << 8) | d) >> (32 - bits) << (32 - bits)
    return number.between(low, low + (1 << (32 - bits)) - 1)


def is_global_ipv4(text: Column) -> Column:
    n = ipv4_number(text)
    special = F.lit(False)
    for base, bits in SPECIAL_RANGES:
        special = special | in_network(n, base, bits)
    return F.coalesce(~special, F.lit(False))


def service_url_error(url: Column) -> Column:
    """Why a service address is refused, or null: https only (http for loopback), no credentials, query or fragment."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    loop = part("HOST").isin("127.0.0.1", "localhost", "[::1]")
    return (
        F.when(part("PROTOCOL").isNull(), "not_a_url").when(~part("PROTOCOL").isin("http", "https"), "scheme").when(part("USERINFO").isNotNull(), "credentials")
        .when(url.contains("?") | url.contains("#"), "query_or_fragment").when((part("PROTOCOL") == "http") & ~F.coalesce(loop, F.lit(False)), "plain_http")
    )


def hit_errors(kind: Column, count: Column, offsets: Column, length: Column, kinds: list[str]) -> Column:
    """Whether a remote hit is well formed: a known kind, a count that matches, offsets inside the text."""
    inside = F.forall(offsets, lambda o: (o >= 0) & (o < length))
    return F.when(~F.coalesce(kind.isin(kinds), F.lit(False)), "kind").when(F.coalesce(count != F.size(offsets), F.lit(True)), "count").when(~F.coalesce(inside, F.lit(False)), "offsets")


def capped(requested: Column, ceiling: int) -> Column:
    return F.least(F.coalesce(requested, F.lit(ceiling)), F.lit(ceiling))


def markdown_lines(findings: DataFrame, run: str = "run_id") -> DataFrame:
    """The Markdown report of each run as rows run, line (from 1), text, for reports of any size: title, findings in order of target, rule and code point, caveat.

    Line numbers are running counts over ranges of the order, so no report has to fit one row or one task; written ordered
    by run and line, the rows are the file. A run's findings must differ in target, rule or code point.
    """
    bullet = F.concat_ws(" ", F.lit("-"), markdown_escape(F.col("target").cast("string")), F.col("rule_id"), F.concat(F.lit("("), "confidence", F.lit(")")), "code_point", F.concat(F.lit("x"), F.coalesce("count", F.lit(1)).cast("string")))
    plain = findings.select(F.col(run).alias("_run"), "target", "rule_id", F.coalesce("code_point", F.lit("")).alias("_cp"), bullet.alias("text")).localCheckpoint()  # what finds them runs once, not once for cuts, range totals, rows and sizes
    body = running(plain, ["_run"], ["target", "rule_id", "_cp"], {"_at": F.lit(1).cast("long")}).select("_run", (F.col("_at") + 2).alias("line"), "text")
    frame = plain.groupBy("_run").agg(F.count("*").alias("n"))
    around = frame.select("_run", F.explode(F.array(*(F.struct(at.cast("long").alias("line"), F.lit(t).alias("text")) for at, t in ((F.lit(1), "# Findings"), (F.lit(2), ""), (F.col("n") + 3, ""), (F.col("n") + 4, CAVEAT))))).alias("x")).select("_run", "x.*")
    return body.unionByName(around).withColumnRenamed("_run", run)
