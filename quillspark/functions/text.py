"""Text functions as Spark expressions: code points, white space, slugs, names, counts, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import rules

#: The white space of the rules' trims: ASCII white space, no-break space, byte order mark, and all space separators.
SPACE = r"[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def let(value: Column, use) -> Column:
    """use(value), with value worked out once; written out in a lambda it would be worked out again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def char_class(ranges: list[tuple[int, int]]) -> str:
    """A pattern of one character of the ranges. Most are above U+2000, so one comparison decides for letters below."""
    listed = lambda some: "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in some)
    low, high = listed([r for r in ranges if r[0] < 0x2000]), listed([r for r in ranges if r[0] >= 0x2000])
    return f"[{low}" + (f"[\\x{{2000}}-\\x{{10FFFF}}&&[{high}]]]" if high else "]")


def pictographic_ranges() -> list[tuple[int, int]]:
    parts = (x.partition("-") for x in rules.PICTOGRAPHIC.split())
    return [(int(a, 16), int(b or a, 16)) for a, _, b in parts]


HIDDEN = char_class([r for _, _, ranges in rules.UNICODE_CLASSES for r in ranges])
EMOJI = char_class(pictographic_ranges())
JOINING = "[" + "".join(f"\\p{{Is{s}}}" for s in rules.JOINING_SCRIPTS) + "]"


def loose(ranges: list[tuple[int, int]]) -> str:
    """A pattern of one character of the ranges that no context protects.

    Kept: a mark at the start, joiners between letters of joining scripts, joiners and selectors at an emoji, tags within eight
    characters of one. Emoji stand as themselves in what looks back, since only then are characters counted there, not UTF-16 units.
    """
    seen = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in pictographic_ranges()) + "]"
    joiner, at_emoji, tag = r"[\x{200C}\x{200D}]", r"[\x{200D}\x{FE00}-\x{FE0F}]", r"[\x{E0000}-\x{E007F}]"
    return (
        rf"(?={char_class(ranges)})(?!\A\x{{FEFF}})(?!(?<={JOINING}){joiner}{JOINING})(?!(?<={seen}){at_emoji})(?!{at_emoji}{seen})"
        rf"(?!{tag}(?<={seen}[\s\S]{{0,7}}{tag}))[\s\S]"
    )


def in_ranges(cp: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a code point is in one of the ranges; one comparison decides for most letters."""
    found = F.lit(False)
    for a, b in ranges:
        found = found | ((cp >= a) & (cp <= b))
    return (cp >= min(a for a, _ in ranges)) & found


def unicode_class(cp: Column) -> Column:
    """Rule id of a code point, or null."""
    first, *rest = rules.UNICODE_CLASSES
    out = F.when(in_ranges(cp, first[2]), first[0])
    for rule, _, ranges in rest:
        out = out.when(in_ranges(cp, ranges), rule)
    return out


def code_point_label(cp: Column) -> Column:
    digits = F.hex(cp.cast("long"))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points, and those above U+FFFF once more."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]+", ""))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.upper(text).contains(w.upper())
    return F.coalesce(out, F.lit(False))


def slug(label: Column) -> Column:
    low = F.lower(F.coalesce(label, F.lit("")))
    kept = F.regexp_replace(F.regexp_replace(low, rf"(?:{SPACE}|_)+", "-"), "[^a-z0-9-]", "")
    trimmed = F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")
    return F.when(trimmed == "", "untitled").otherwise(trimmed)


def is_safe_slug(text: Column) -> Column:
    return F.coalesce(text.rlike("^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$"), F.lit(False))


def deliverable_name(label: Column, lang: Column, platform: Column, version: Column, ext: Column) -> Column:
    """{slug}[-lang][-platform][-vN].ext; empty parts are left out."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]", "")
    number = F.regexp_replace(F.coalesce(version.cast("string"), F.lit("")), "(?i)^v", "")
    part = lambda c, lead="": F.when(c != "", F.concat(F.lit(lead), c))
    stem = F.concat_ws("-", slug(label), part(plain(lang)), part(plain(platform)), part(F.regexp_replace(number, "[^0-9A-Za-z]", ""), "v"))
    return F.concat(stem, F.lit("."), plain(ext))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def words_wc(text: Column) -> Column:
    """Words as the drift check counts them: all runs of non-space."""
    return F.size(word_list(text))


def words_prose(text: Column) -> Column:
    """Words as the statistics count them: without rule lines, bare header marks and empty lines."""
    kept = F.filter(lines(text), lambda ln: ~F.trim(ln).rlike(r"^(?:---+|#+|)$"))
    return F.aggregate(kept, F.lit(0), lambda n, ln: n + F.size(F.filter(F.split(F.trim(ln), r"\s+"), lambda w: w != "")))


def words_print(text: Column) -> Column:
    """Words as the print estimate counts them: the assembled text split on white space."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0).otherwise(F.size(F.split(js_trim(text), rf"{SPACE}+")))


def js_round(x: Column) -> Column:
    """Half up toward positive infinity."""
    return F.floor(x + 0.5)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, js_round(part / whole * 100)).otherwise(0).cast("long")


def progress_bar(done: Column, total: Column, cells: int = 10) -> Column:
    k = F.when(total > 0, F.least(F.lit(cells), F.greatest(F.lit(0), js_round(done / total * cells)))).otherwise(0).cast("int")
    return F.concat(F.repeat(F.lit("█"), k), F.repeat(F.lit("░"), F.lit(cells) - k))


def reading_time(minutes: Column) -> Column:
    return F.concat((minutes / 60).cast("int").cast("string"), F.lit("h "), (minutes % 60).cast("int").cast("string"), F.lit("m"))


def unit_number(name: Column, suffix: str) -> Column:
    """The number a file name begins with, if the name ends in suffix."""
    return F.regexp_extract(name, rf"(?i)^(\d+)\D.*{suffix}$", 1).try_cast("int")


def markdown_escape(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    for code in [*range(0, 9), 11, 12, *range(14, 32), 127]:
        text = F.replace(text, F.lit(chr(code)), F.lit(f"\\u{code:04X}"))
    flat = F.regexp_replace(text, "\r?\n|\r", " ")
    return F.replace(F.regexp_replace(flat, r"([\\`*\[\]{}#|<>])", r"\\$1"), F.lit(r"\[REDACTED\]"), F.lit("[REDACTED]"))


def redact(text: Column, secret: str) -> Column:
    return F.replace(text, F.lit(secret), F.lit("[REDACTED]")) if secret else text
