"""Hidden-character scan, context-safe removal, and the before and after comparison of findings.

All of it is per-row expressions: one pattern decides first whether a text holds any character of interest, so clean rows
are never taken apart, and nothing is shuffled but the few findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.text import EMOJI, HIDDEN, JOINING, char_class, code_point_label, in_ranges, let, loose, pictographic_ranges, unicode_class, utf16_length


def _matches(char: Column, pattern: str) -> Column:
    return F.coalesce(char.rlike(pattern), F.lit(False))


def _kept_in_context(chars: Column, at: Column, cp: Column) -> Column:
    """Joiners between letters of joining scripts, joiners and selectors at an emoji, tags within eight characters of one."""
    before, after = F.get(chars, at - 1), F.get(chars, at + 1)
    letters = cp.isin(0x200C, 0x200D) & _matches(before, JOINING) & _matches(after, JOINING)
    emoji = ((cp == 0x200D) | ((cp >= 0xFE00) & (cp <= 0xFE0F))) & (_matches(before, EMOJI) | _matches(after, EMOJI))
    tags = (cp >= 0xE0000) & (cp <= 0xE007F) & F.exists(F.slice(chars, F.greatest(F.lit(1), at - 7), F.least(F.lit(8), at)), lambda c: _matches(c, EMOJI))
    return letters | emoji | tags


#: Hits of a text up to which their places come from the lengths between them; beyond, from its characters one by one.
FEW = 64


def hits(text: Column, ranges: list[tuple[int, int]] | None = None, few: int = FEW) -> Column:
    """Array of (at, cp) of the targeted characters of a text that no context protects; at counts code points from 0.

    One pattern finds them with their contexts, so a text of few is not taken apart into its characters.
    """
    wanted = [r for _, _, rs in rules.UNICODE_CLASSES for r in rs] if ranges is None else ranges
    pattern = loose(wanted)
    hit = lambda at, cp: F.struct(at.cast("int").alias("at"), cp.alias("cp"))

    def between(found: Column) -> Column:
        before = lambda parts, i: F.aggregate(F.slice(parts, 1, i + 1), i, lambda n, part: n + F.length(part))
        return let(F.split(text, pattern, -1), lambda parts: F.transform(found, lambda c, i: hit(before(parts, i), F.ascii(c))))

    def each(chars: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: in_ranges(F.ascii(F.get(chars, i)), wanted))
        found = F.transform(places, lambda i: hit(i, F.ascii(F.get(chars, i))))
        return F.filter(found, lambda h: ~((h["cp"] == 0xFEFF) & (h["at"] == 0)) & ~_kept_in_context(chars, h["at"], h["cp"]))

    none = F.expr("array()").cast("array<struct<at:int,cp:int>>")
    told = lambda found: F.when(F.size(found) == 0, none).when(F.size(found) <= few, between(found)).otherwise(let(F.split(text, ""), each))
    return F.when(text.rlike(char_class(wanted)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), told)).otherwise(none)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One finding per row, rule and code point: rule_id, confidence, code_point, count, and where first (offset, line, column in UTF-16 units).

    Places are worked out before anything is grouped, so no text is shuffled; keep: columns of the row that findings carry.
    """
    text, own = F.col(text_col), [id_col, *keep]

    def by_code_point(found: Column) -> Column:
        def first(cp: Column) -> Column:
            same = F.filter(found, lambda h: h["cp"] == cp)
            return F.struct(cp.alias("cp"), F.size(same).alias("n"), F.array_min(F.transform(same, lambda h: h["at"])).alias("at"))

        return F.transform(F.array_distinct(F.transform(found, lambda h: h["cp"])), first)

    found = df.filter(text.rlike(HIDDEN)).select(*own, text.alias("_text"), F.explode(let(hits(text), by_code_point)).alias("h"))
    before = F.substring("_text", 1, F.col("h.at"))
    lines = F.split(before, "\n", -1)
    place = F.struct(F.col("h.at").alias("at"), utf16_length(before).cast("long").alias("offset"), F.size(lines).cast("long").alias("line"), (utf16_length(F.element_at(lines, -1)) + 1).cast("long").alias("column"))
    placed = found.select(*own, F.col("h.cp").alias("cp"), F.col("h.n").alias("n"), place.alias("place"))
    first = placed.groupBy(*own, "cp").agg(F.sum("n").alias("count"), F.min("place").alias("f"))
    rule = unicode_class(F.col("cp"))
    confidence = F.when(rule.isin(rules.PROBABLE_CLASSES), "probable").otherwise("confirmed")
    return first.select(*own, rule.alias("rule_id"), confidence.alias("confidence"), code_point_label(F.col("cp")).alias("code_point"), "count", "f.offset", "f.line", "f.column")


def clean(text: Column) -> Column:
    """The text without confirmed hidden characters that no context protects; spaces and selectors stay.

    Contexts are those of the uncleaned text. Each removed character is one that the scan counts, so the budget of the
    evidence (as many removals per code point as were found) is met exactly.
    """
    return F.regexp_replace(text, loose(rules.REMOVABLE), "")


def removed_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row and code point: removed, replaced (always 0 by default, since exotic spaces are never confirmed)."""
    found = df.select(id_col, F.explode(hits(F.col(text_col), rules.REMOVABLE)).alias("h"))
    return found.groupBy(id_col, code_point_label(F.col("h.cp")).alias("code_point")).agg(F.count("*").alias("removed")).withColumn("replaced", F.lit(0).cast("long"))


def clean_markup(text: Column) -> Column:
    """Clean text nodes of markup; script and style blocks and tags stay as they are."""
    shielded = F.regexp_extract_all(text, F.lit(r"(?is)(<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>)"), F.lit(1))
    open_text = F.split(text, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>", -1)
    return F.aggregate(F.zip_with(open_text, shielded, lambda t, s: F.struct(t.alias("t"), s.alias("s"))), F.lit(""), lambda out, x: F.concat(out, F.coalesce(clean(x["t"]), F.lit("")), F.coalesce(x["s"], F.lit(""))))


def clean_front_matter(text: Column) -> Column:
    """Markdown front matter without lines of tool fields, or of metadata fields with a provenance value."""
    block = F.regexp_extract(text, rules.FRONT_MATTER, 0)
    inner = F.regexp_extract(block, r"^\x{FEFF}?---[ \t]*\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)", 1)

    def stays(line: Column) -> Column:
        key, value = F.substring_index(line, ":", 1), F.expr("''")
        value = F.regexp_replace(line, "^[^:]*:", "")
        drop = key.rlike(f"(?i){rules.ORDINARY_TOOL}") | (key.rlike(f"(?i){rules.FIELD}") & value.rlike(f"(?i){rules.PROVENANCE}"))
        return ~line.contains(":") | ~drop

    cleaned = F.array_join(F.filter(F.split(inner, "\r?\n", -1), stays), "\n")
    head = F.regexp_extract(block, r"^\x{FEFF}?---[ \t]*\r?\n", 0)
    tail = F.regexp_extract(block, r"\r?\n---(?:\r?\n|$)$", 0)
    return F.when(block == "", text).otherwise(F.concat(head, cleaned, tail, F.substring(text, F.length(block) + 1, F.length(text))))


def writing_policy(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Dashes U+2013 and U+2014 and emoji, one row per line and code point."""
    wanted = char_class([(0x2013, 0x2014), *pictographic_ranges()])  # one class: an alternative is tried anew at each character
    each = df.filter(F.col(text_col).rlike(wanted)).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line_text")).filter(F.col("line_text").rlike(wanted))
    chars = each.select(id_col, (F.col("n") + 1).alias("line"), F.explode(F.regexp_extract_all("line_text", F.lit(f"({wanted})"), F.lit(1))).alias("c"))
    return chars.groupBy(id_col, "line", code_point_label(F.ascii("c")).alias("code_point")).agg(F.count("*").alias("count"))


IDENTITY = ["rule_id", "confidence", "channel", "code_point", "member"]


def compare_findings(before: DataFrame, after: DataFrame, target: str = "doc_id") -> DataFrame:
    """Multiset difference of findings, places ignored: before, after, remaining, removed, added per target and identity. A null count is one."""
    keys = [target, *IDENTITY]

    def summed(df, name):
        cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in keys]
        return df.select(*cols, F.coalesce(F.col("count"), F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias(name))

    a, b = summed(before, "before"), summed(after, "after")
    right = b.select(*(F.col(c).alias(f"_{c}") for c in keys), "after")
    joined = a.join(right, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "full_outer")
    n, m = F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0))
    return joined.select(*(F.coalesce(c, f"_{c}").alias(c) for c in keys), n.alias("before"), m.alias("after"), F.least(n, m).alias("remaining"), (n - F.least(n, m)).alias("removed"), (m - F.least(n, m)).alias("added"))
