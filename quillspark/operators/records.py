"""Checks of remote JSON records with Spark's variant type: exact keys, kinds, counts, depth; and their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import let

# Fixed values of the records.
HIT_KEYS = ["codepoint", "confidence", "count", "kind", "label", "sample_offsets"]
HIT_KINDS = ["strip", "bidi", "tag_chars", "variation_selector", "zwj_family", "private_use", "space", "confusable", "other_cf"]
CAPABILITIES = {"tools": ["c2patool", "exiftool", "qpdf"], "pixel_backends": ["ctrlregen", "diffusion"], "scorers": ["synthid", "stylometry"], "harnesses": ["markllm"]}
OPERATIONS = ["inspect", "clean"]
FORMATS = ["markdown", "text", "html", "svg", "png", "jpeg", "pdf", "docx", "odt", "epub", "webp", "avif", "heic", "bmp", "gif", "tiff", "bigtiff", "xlsx", "pptx"]
VERSION = "0.5.0"
DEPTH, NODES = 32, 50_000


def fields(v: Column) -> Column:
    """An object's fields as a map of variants; null for anything else."""
    return F.when(kind(v) == "object", F.try_variant_get(v, "$", "map<string,variant>"))


def items(v: Column) -> Column:
    """An array's items as variants; null for anything else."""
    return F.when(kind(v) == "array", F.try_variant_get(v, "$", "array<variant>"))


def kind(v: Column) -> Column:
    """object, array, string, number, boolean or null; null where there is no value."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")
    )


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def text(v: Column) -> Column:
    """A string; null for anything else."""
    return F.when(kind(v) == "string", F.try_variant_get(v, "$", "string"))


def whole(v: Column) -> Column:
    """A whole number; null for anything else, numbers with a fraction among them."""
    n = F.try_variant_get(v, "$", "double")
    return F.when((kind(v) == "number") & (n == F.floor(n)), n.cast("long"))


def has_only_keys(v: Column, allowed: list[str]) -> Column:
    return F.coalesce(F.forall(F.map_keys(fields(v)), lambda k: k.isin(allowed)), F.lit(False))


def has_exact_keys(v: Column, expected: list[str]) -> Column:
    return F.coalesce(F.array_sort(F.map_keys(fields(v))) == F.array(*map(F.lit, sorted(expected))), F.lit(False))


def is_count_record(v: Column) -> Column:
    """Whether it is an object of counts: names that aren't empty, whole numbers that aren't negative."""
    m = fields(v)
    return F.coalesce(F.forall(F.map_entries(m), lambda e: (F.length(e["key"]) > 0) & F.coalesce(whole(e["value"]) >= 0, F.lit(False))), F.lit(False))


def sum_counts(v: Column) -> Column:
    """The sum of an object of counts; null if it isn't one."""
    return F.when(is_count_record(v), F.aggregate(F.map_values(fields(v)), F.lit(0).cast("long"), lambda n, x: n + whole(x)))


def is_string_array(v: Column, among: list[str] | None = None, empty: bool = False) -> Column:
    def good(x: Column) -> Column:
        s = text(x)
        ok = s.isNotNull() if empty else F.length(s) > 0
        return F.coalesce(ok & (s.isin(among) if among else F.lit(True)), F.lit(False))

    return F.coalesce(F.forall(items(v), good), F.lit(False))


def hit_error(hit: Column, length: Column) -> Column:
    """The first fault of a hit, or null: record, keys, codepoint, label, count, kind, confidence, offsets."""
    offsets = items(field(hit, "sample_offsets"))
    inside = F.forall(offsets, lambda o: F.coalesce((whole(o) >= 0) & (length.isNull() | (whole(o) < length)), F.lit(False)))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(kind(hit) == "object"), "record").when(~has_exact_keys(hit, HIT_KEYS), "keys").when(no(text(field(hit, "codepoint")).rlike("(?i)^U\\+[0-9A-F]{4,6}$")), "codepoint")
        .when(no(F.length(text(field(hit, "label"))) > 0), "label").when(no(whole(field(hit, "count")) > 0), "count").when(no(text(field(hit, "kind")).isin(HIT_KINDS)), "kind")
        .when(no(text(field(hit, "confidence")).isin("probable", "informational")), "confidence").when(no(inside), "offsets")
    )


def capability_error(health: Column, capabilities: Column, version: str = VERSION) -> Column:
    """Why a service's two records are refused, or null."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    truth = lambda v: F.when(kind(v) == "boolean", F.try_variant_get(v, "$", "boolean"))
    told = text(field(health, "version"))
    flags = F.lit(True)
    for group, names in CAPABILITIES.items():
        for name in names:
            flags = flags & (kind(field(field(capabilities, group), name)) == "boolean")
    limits = field(capabilities, "limits")
    over = F.lit(True)
    for name in ("max_concurrency", "max_input_bytes"):
        v = field(limits, name)
        over = over & (v.isNull() | (kind(v) == "null") | F.coalesce(whole(v) > 0, F.lit(False)))
    listed = lambda name, among: field(capabilities, name).isNull() | is_string_array(field(capabilities, name), among)
    return (
        F.when(no(truth(field(health, "ok"))) | no(F.trim(told) != ""), "provider_health_invalid")
        .when(no(F.regexp_replace(told, "^v", "") == version) | no(truth(field(capabilities, "ok"))) | no(text(field(capabilities, "version")) == told) | no(flags), "provider_capabilities_invalid")
        .when(~listed("operations", OPERATIONS) | ~listed("formats", FORMATS), "provider_capabilities_invalid")
        .when(limits.isNotNull() & (no(kind(limits) == "object") | no(over)), "provider_capabilities_invalid")
    )


def not_offered(capabilities: Column, operation: Column, form: Column) -> Column:
    """provider_operation_unsupported or provider_format_unsupported, or null; what a service doesn't list it offers in full."""
    names = lambda name, other: F.coalesce(F.transform(items(field(capabilities, name)), text), F.array(*map(F.lit, other)))
    return F.when(~F.array_contains(names("operations", OPERATIONS), operation), "provider_operation_unsupported").when(~F.array_contains(names("formats", FORMATS), form), "provider_format_unsupported")


def provider_findings(df: DataFrame, id_col: str, record: str, length: str) -> DataFrame:
    """Findings of inspection records (variant): id, rule_id, confidence, channel, code_point, count, offset; a malformed record gives the one row with error.

    Hits that aren't well formed refuse their whole record; findings in free text are dropped and named in ignored.
    """
    v = F.col(record)
    said = lambda name: F.coalesce(F.when(kind(field(v, name)) == "boolean", F.try_variant_get(field(v, name), "$", "boolean")), F.lit(False))
    hits = F.concat(*(F.coalesce(items(field(v, name)), F.array().cast("array<variant>")) for name in ("hits", "layer_a_hits")))
    ignored = F.array_compact(F.array(F.when(F.size(items(field(v, "findings"))) > 0, "provider-freeform"), F.when(kind(field(v, "stylometry")) == "object", "stylometry")))
    none = lambda t: F.lit(None).cast(t)
    row = lambda rule, confidence, channel, cp, n, at: F.struct(rule.alias("rule_id"), confidence.alias("confidence"), F.lit(channel).alias("channel"), cp.alias("code_point"), n.alias("count"), at.alias("offset"))
    flags = F.array_compact(F.array(
        F.when(said("has_c2pa"), row(F.lit("provider.c2pa.present"), F.lit("confirmed"), "c2pa", none("string"), none("long"), none("long"))),
        F.when(said("has_ai_metadata"), row(F.lit("provider.metadata.ai_present"), F.lit("confirmed"), "metadata", none("string"), none("long"), none("long"))),
    ))

    def found(h: Column) -> Column:
        rule = F.concat(F.lit("provider.unicode."), F.lower(F.regexp_replace(text(field(h, "kind")), "(?i)[^a-z0-9_.-]", "_")))
        return row(rule, text(field(h, "confidence")), "unicode", text(field(h, "codepoint")), whole(field(h, "count")), whole(F.get(items(field(h, "sample_offsets")), F.lit(0))))

    bad = F.when(F.coalesce(kind(v) != "object", F.lit(True)), "record").otherwise(F.get(F.array_compact(F.transform(hits, lambda h: hit_error(h, F.col(length)))), F.lit(0)))
    told = df.select(id_col, bad.alias("error"), F.array_join(ignored, ",").alias("ignored"), F.concat(flags, F.transform(hits, found)).alias("_f"))
    rows = told.withColumn("_f", F.when(F.col("error").isNull(), F.col("_f"))).select(id_col, "error", "ignored", F.explode_outer("_f").alias("f")).select(id_col, "error", "ignored", "f.*")
    return rows.filter("rule_id IS NOT NULL OR error IS NOT NULL")


def complexity(json: Column, depth: int = DEPTH, nodes: int = NODES) -> Column:
    """Struct (depth, nodes, error: malformed, too_deep, too_many) of a JSON text; a value alone has depth 1, each value is a node.

    The text is parsed once for whether it is JSON; depth and nodes come from its brackets and values with strings taken
    out, in one pass over what is left, which also sees what follows the one value. A key that an object holds twice is malformed.
    """
    bare = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', "s"), r"([{,]\s*)s\s*:", "$1")
    values = F.regexp_replace(bare, r"[^\s,\[\]{}:]+", "s")
    marks = F.regexp_replace(values, r"\s", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"), F.lit(0).alias("top"))

    def step(a: Column, c: Column) -> Column:
        after = a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        outer = F.when((a["now"] <= 0) & (c != ""), 1).otherwise(0)  # the value, or what should not follow it
        return F.struct(after.alias("now"), F.greatest(a["most"], F.when(c == "s", a["now"] + 1).otherwise(after)).alias("most"), (a["top"] + outer).alias("top"))

    walked = F.aggregate(F.split(marks, ""), start, step)
    found = F.when(F.try_parse_json(json).isNotNull() & ~values.contains(":"), F.struct(walked.alias("w"), F.length(F.regexp_replace(marks, r"[\]},]", "")).cast("long").alias("nodes")))

    def told(x: Column) -> Column:
        good = F.coalesce(x["w"]["top"] == 1, F.lit(False))
        depth_, nodes_ = F.when(good, x["w"]["most"].cast("long")), F.when(good, x["nodes"])
        return F.struct(depth_.alias("depth"), nodes_.alias("nodes"), F.when(~good, "malformed").when(depth_ > depth, "too_deep").when(nodes_ > nodes, "too_many").alias("error"))

    return let(found, told)


def json_complexity(df: DataFrame, id_col: str, json: str, depth: int = DEPTH, nodes: int = NODES) -> DataFrame:
    """id, depth, nodes, error of each row's JSON text; null is malformed."""
    return df.select(id_col, complexity(F.col(json), depth, nodes).alias("c")).select(id_col, "c.*")
