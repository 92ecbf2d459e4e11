"""The cleaning run: findings before and after from one pass over each row, their difference inside the row, and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.text import let
from quillspark.operators import guidance, hidden
from quillspark.operators.audit import field_findings, markup_findings, no_findings, unicode_findings
from quillspark.operators.manifest import publish
from quillspark.operators.metadata import text_format

IDENTITY = ["rule_id", "confidence", "channel", "code_point", "member"]
TOTALS = ["before", "after", "removed", "remaining", "added"]


def findings_of(text: Column, form: Column) -> Column:
    """All findings of a text of this format, as the audit has them."""
    return F.concat(
        unicode_findings(text),
        F.when(form == "markdown", field_findings(F.regexp_extract(text, rules.FRONT_MATTER, 0))).otherwise(no_findings()),
        F.when(form.isin("html", "svg"), markup_findings(text, form == "svg")).otherwise(no_findings()),
    )


def cleaned_text(text: Column, form: Column) -> Column:
    """The text without what may go: of markdown also fields of its front matter, of markup its tool elements and data-ai attributes, and there only text nodes lose characters."""
    return F.when(form == "markdown", hidden.clean(hidden.clean_front_matter(text))).when(form.isin("html", "svg"), hidden.clean_markup(guidance.clean_metadata_elements(text))).otherwise(hidden.clean(text))


def difference(before: Column, after: Column) -> Column:
    """Multiset difference of two arrays of findings: identity, before, after, removed, remaining, added. Places don't count; a null count is one."""
    identity = lambda f: F.struct(*(f[c].alias(c) for c in IDENTITY))
    grouped = F.array_distinct(F.transform(F.concat(before, after), identity))
    total = lambda found, k: F.aggregate(F.filter(found, lambda f: identity(f).eqNullSafe(k)), F.lit(0).cast("long"), lambda n, f: n + F.coalesce(f["count"], F.lit(1)))

    def told(k: Column) -> Column:
        return let(F.struct(total(before, k).alias("b"), total(after, k).alias("a")), lambda t: F.struct(
            *(k[c].alias(c) for c in IDENTITY), t["b"].alias("before"), t["a"].alias("after"), (t["b"] - F.least(t["b"], t["a"])).alias("removed"),
            F.least(t["b"], t["a"]).alias("remaining"), (t["a"] - F.least(t["b"], t["a"])).alias("added"),
        ))

    return F.transform(grouped, told)


def clean_targets(df: DataFrame, target: str, name: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per text that isn't null: target, format, bytes, sha256, cleaned, clean_sha256, findings before and after, their difference, its five totals, status and outcome.

    status: complete, or failed where the cleaned text has another format than the text had; such a text stays as it was.
    outcome: no_safe_change (the text stays as it is), not_removed (a confirmed hidden character is left) or removed_verified.
    Each row is read once, cleaned once and scanned twice inside one projection; nothing is joined or shuffled.
    """
    form = text_format(F.col(name), F.col(text))
    own = df.filter(F.col(text).isNotNull()).select(*keep, F.col(target).alias("target"), F.col(name).alias("_name"), F.col(text).alias("_text"), form.alias("format"))
    out = own.select("*", F.explode(F.array(cleaned_text(F.col("_text"), F.col("format")))).alias("_out"))
    same = text_format(F.col("_name"), F.col("_out")) == F.col("format")
    safe = out.select(*keep, "target", "format", "_text", F.when(same, F.col("_out")).otherwise(F.col("_text")).alias("cleaned"), F.when(same, "complete").otherwise("failed").alias("status"))
    both = F.struct(findings_of(F.col("_text"), F.col("format")).alias("before"), F.when(F.col("cleaned") == F.col("_text"), None).otherwise(findings_of(F.col("cleaned"), F.col("format"))).alias("after"))
    scanned = safe.select("*", F.explode(F.array(both)).alias("_f")).withColumns({"findings_before": F.col("_f.before"), "findings_after": F.coalesce("_f.after", "_f.before")})
    compared = scanned.select("*", F.explode(F.array(difference(F.col("findings_before"), F.col("findings_after")))).alias("changes"))
    totals = {f"{k}_count": F.aggregate("changes", F.lit(0).cast("long"), lambda n, x: n + x[k]) for k in TOTALS}
    left = F.exists("findings_after", lambda f: (f["channel"] == "unicode") & (f["confidence"] == "confirmed"))
    outcome = F.when(F.col("cleaned") == F.col("_text"), "no_safe_change").when(left, "not_removed").otherwise("removed_verified")
    raw = F.col("_text")
    return compared.select(*keep, "target", "format", F.octet_length(raw).cast("long").alias("bytes"), F.sha2(raw, 256).alias("sha256"), "cleaned", F.sha2("cleaned", 256).alias("clean_sha256"), "findings_before", "findings_after", "changes", *(c.alias(n) for n, c in totals.items()), "status", outcome.alias("outcome"))


def clean_run(df: DataFrame, target: str, name: str, text: str, path: str, run: str) -> DataFrame:
    """Clean all texts and publish the outcome below path in two phases (see manifest.publish): all of it or, if any target failed, nothing.

    The published rows hold target, format, cleaned, sha256, clean_sha256 and outcome. Returns the run's rows without their texts.
    """
    done = clean_targets(df, target, name, text)
    if not done.filter("status = 'failed'").isEmpty():
        return done.drop("cleaned").withColumn("outcome", F.lit("not_removed"))
    publish(done.select("target", "format", "cleaned", "sha256", "clean_sha256", "outcome"), path, run)
    return done.drop("cleaned")


def retarget(report: DataFrame, old: str, new: str, cols: tuple[str, ...] = ("target",)) -> DataFrame:
    """A report about a staged copy as one about its place: the prefix old of these columns becomes new."""
    return report.withColumns({c: F.when(F.col(c).startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 30))).otherwise(F.col(c)) for c in cols})
