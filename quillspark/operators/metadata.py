"""Metadata scans: fields in front matter, markup and segments; embedded images; front-matter values; formats of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.text import js_trim, lines

CI = "(?i)"


def field_lines(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """One finding per line that names a metadata field: line, rule_id, confidence, evidence (240 characters)."""
    each = df.select(id_col, F.posexplode(lines(text)).alias("n", "s")).filter(F.col("s").rlike(CI + rules.FIELD))
    told = F.col("s").rlike(CI + rules.PROVENANCE)
    return each.select(
        id_col, (F.col("n") + 1).cast("long").alias("line"), F.when(told, "metadata.provenance").otherwise("metadata.generator").alias("rule_id"),
        F.when(told, "probable").otherwise("informational").alias("confidence"), F.substring(js_trim(F.col("s")), 1, 240).alias("evidence"),
    )


def front_matter(text: Column) -> Column:
    return F.regexp_extract(text, rules.FRONT_MATTER, 0)


def front_matter_findings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    held = df.filter(F.col(text_col).rlike(rules.FRONT_MATTER))
    return field_lines(held, id_col, front_matter(F.col(text_col)))


def html_meta_tags(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    tags = df.select(id_col, F.explode(F.regexp_extract_all(html_col, F.lit(f"{CI}({rules.META_TAG})"), F.lit(1))).alias("tag"))
    return field_lines(tags, id_col, F.col("tag"))


def html_ai_attributes(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    found = df.select(id_col, F.explode(F.regexp_extract_all(html_col, F.lit(f"{CI}({rules.DATA_AI})"), F.lit(1))).alias("a"))
    return found.select(id_col, F.lit("metadata.provenance").alias("rule_id"), F.lit("confirmed").alias("confidence"), F.substring("a", 1, 240).alias("evidence"))


def svg_metadata(df: DataFrame, id_col: str = "page_id", svg_col: str = "svg") -> DataFrame:
    return field_lines(df.select(id_col, F.explode(F.regexp_extract_all(svg_col, F.lit(f"{CI}({rules.SVG_METADATA})"), F.lit(1))).alias("m")), id_col, F.col("m"))


def image_format(content: Column) -> Column:
    """Format of media bytes by their signature, or null."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    box = F.hex(F.substring(content, 5, 4)) == "66747970"
    brands = F.hex(F.substring(content, 9, 56))
    brand = lambda *names: F.coalesce(F.exists(F.array(*(F.lit(n.encode().hex().upper()) for n in names)), lambda b: F.exists(F.sequence(F.lit(0), F.lit(13)), lambda k: F.substring(brands, k * 8 + 1, F.lit(8)) == b)), F.lit(False))
    return (
        F.when(head(8) == "89504E470D0A1A0A", "png").when(head(3) == "FFD8FF", "jpeg")
        .when((head(4) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp")
        .when(box & brand("avif", "avis"), "avif").when(box & brand("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1"), "heic")
        .when(head(2) == "424D", "bmp").when(head(6).isin("474946383761", "474946383961"), "gif")
        .when(head(4).isin("49492A00", "4D4D002A"), "tiff").when(head(4).isin("49492B00", "4D4D002B"), "bigtiff").when(head(5) == "255044462D", "pdf")
    )


def data_uris(df: DataFrame, id_col: str = "page_id", text_col: str = "html", limits: dict = rules.LIMITS) -> DataFrame:
    """Embedded images: target (<id>#data-uri-<n>), declared, bytes, actual format, error (per-item and running-total limits, mismatch).

    One row with data_uri_count_limit stands for all behind the count limit.
    """
    pattern = f"{CI}{rules.DATA_URI}"
    each = df.filter(F.col(text_col).rlike("(?i)data:image/")).select(id_col, F.posexplode(F.arrays_zip(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all(text_col, F.lit(pattern), F.lit(2)).alias("code"))).alias("n", "u"))
    estimate = F.floor(F.length("u.code") * 3 / 4)
    sized = each.filter(F.col("n") <= limits["data_uris"]).select(id_col, (F.col("n") + 1).alias("n"), F.lower("u.kind").alias("declared"), F.when((estimate <= limits["data_uri_bytes"]) & (F.col("n") < limits["data_uris"]), F.try_to_binary("u.code", F.lit("base64"))).alias("content"), estimate.alias("estimate"))
    running = F.sum(F.coalesce(F.octet_length("content"), F.lit(0))).over(Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    actual = image_format(F.col("content"))
    wanted = F.when(F.col("declared") == "jpg", "jpeg").otherwise(F.col("declared"))
    error = F.when(F.col("n") > limits["data_uris"], "data_uri_count_limit").when(F.col("estimate") > limits["data_uri_bytes"], "data_uri_limit").when(F.col("total") > limits["data_uri_total"], "data_uri_total_limit").when(F.col("content").isNull() | F.coalesce(actual != wanted, F.lit(True)), "data_uri_mismatch")
    return sized.withColumn("total", running).select(id_col, F.concat(F.col(id_col).cast("string"), F.lit("#data-uri-"), F.col("n").cast("string")).alias("target"), "declared", F.octet_length("content").cast("long").alias("bytes"), actual.alias("actual"), error.alias("error"))


def text_format(name: Column, text: Column) -> Column:
    """markdown by extension; svg and html by extension or the first 4,096 characters; else text."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^./]*)$", 1))
    head = F.lower(F.regexp_replace(F.substring(F.coalesce(text, F.lit("")), 1, 4096), r"^[\s\x{FEFF}\x{A0}]+", ""))
    return (
        F.when(ext.isin(".md", ".markdown"), "markdown").when((ext == ".svg") | head.startswith("<svg") | head.rlike(r"^<\?xml[^>]*>\s*<svg"), "svg")
        .when(ext.isin(".html", ".htm") | head.startswith("<!doctype html") | head.startswith("<html"), "html").otherwise("text")
    )


def is_text(content: Column) -> Column:
    """Valid UTF-8 without NUL."""
    return F.is_valid_utf8(content.cast("string")) & ~F.contains(content, F.lit(b"\0"))


def strip_quotes(v: Column) -> Column:
    return F.regexp_replace(v, r"""^(["'])(.*)\1$""", "$2")


def front_matter_values(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """key, value of the front matter: first occurrence wins; comments go; block scalars are empty; wrapping quotes go."""
    inner = F.regexp_extract(F.col(text_col), r"^\x{FEFF}?---\r?\n([\s\S]*?)\r?\n(?:---|\.\.\.)(?:\r?\n|$)", 1)
    each = df.select(id_col, F.posexplode(F.split(inner, "\r?\n")).alias("n", "s")).filter(F.col("s").rlike(r"^[^\s#:][^:]*:"))
    raw = F.trim(F.regexp_replace("s", "^[^:]*:", ""))
    bare = F.when(raw.rlike("""^["']"""), raw).otherwise(F.trim(F.regexp_replace(raw, r"(?:^|[ \t])#.*$", "")))
    value = F.when(bare.rlike(r"^[|>][+-]?\d*$"), "").otherwise(strip_quotes(bare))
    return each.select(id_col, F.trim(F.substring_index("s", ":", 1)).alias("key"), "n", value.alias("value")).groupBy(id_col, "key").agg(F.min_by("value", "n").alias("value"))


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"^\x{FEFF}?---\r?\n[\s\S]*?\r?\n(?:---|\.\.\.)(?:\r?\n|$)", "")


def fold_status(findings: DataFrame, errors: DataFrame, targets: DataFrame, run: str = "run_id") -> DataFrame:
    """One status per run: error, unsafe, degraded, findings or clear, and its exit code."""
    rank = {"clear": 0, "findings": 1, "degraded": 2, "unsafe": 3, "error": 4}
    worst = (
        targets.select(run, F.when(F.col("status").isin("degraded", "unsupported"), 2).otherwise(0).alias("r"))
        .unionByName(findings.select(run, F.lit(1).alias("r")))
        .unionByName(errors.select(run, F.when(F.col("code") == "internal", 4).when(F.col("code").isin(rules.DEGRADED_CODES), 2).otherwise(3).alias("r")))
        .groupBy(run).agg(F.max("r").alias("r"))
    )
    name = F.element_at(F.array(*(F.lit(k) for k in rank)), F.col("r") + 1)
    code = F.element_at(F.create_map(*(F.lit(x) for kv in rules.EXIT_CODES.items() for x in kv)), name)
    return worst.select(run, name.alias("status"), code.alias("exit_code"))


def sarif_level(confidence: Column) -> Column:
    return F.when(confidence == "confirmed", "error").when(confidence == "probable", "warning").otherwise("note")
