"""The audit of targets: one scan deals each row to its lane, and all lanes meet in one table of targets, findings and errors.

Everything about a row is worked out inside it, so a table of targets is read once and nothing is shuffled but the order at
the sink. Lanes: text-unicode (texts, markup), media-container (by signature), zip-container (office and book archives) and unsupported.
Archives and media are opened beside that scan, by the Arrow readers of sources.containers, and only their rows go there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.text import HIDDEN, code_point_label, js_trim, let, lines, unicode_class, utf16_length
from quillspark.operators import hidden
from quillspark.operators.metadata import CI, image_format, is_text, text_format
from quillspark.sources import containers

FINDING = "struct<rule_id:string,confidence:string,channel:string,code_point:string,count:bigint,line:bigint,offset:bigint,member:string,evidence:string>"
ERROR = "struct<code:string,target:string,message:string>"
TARGET = "struct<path:string,format:string,container:string,bytes:bigint,sha256:string,lane:string,status:string,embedded:boolean>"
CONFIDENCE = ["confirmed", "probable", "informational", "likely_false_positive"]

# Which formats are texts and archives, names of texts, what members of archives hold metadata and visible text.
TEXT_FORMATS = ["markdown", "text", "html", "svg"]
ZIP_FORMATS = ["docx", "odt", "epub", "xlsx", "pptx"]
TEXT_EXTENSIONS = [".md", ".markdown", ".txt", ".text", ".html", ".htm", ".svg", ".xml", ".json", ".yaml", ".yml", ".csv"]
METADATA_MEMBERS = {"docx": "^(?:docProps|customXml)/", "xlsx": "^(?:docProps|customXml)/", "pptx": "^(?:docProps|customXml)/", "odt": r"^(?:meta\.xml|META-INF/manifest\.xml)$", "epub": r"(?i:\.opf$)|^META-INF/"}
VISIBLE_MEMBERS = {"docx": r"^word/(?:document|header\d*|footer\d*|footnotes|endnotes)\.xml$", "xlsx": r"^xl/(?:sharedStrings|worksheets/[^/]+)\.xml$", "pptx": r"^ppt/(?:slides|notesSlides)/[^/]+\.xml$", "odt": r"^content\.xml$", "epub": r"(?i)\.(?:xhtml|html|htm)$"}


def finding(rule_id, confidence, channel: str, code_point=None, count=None, line=None, offset=None, member=None, evidence=None) -> Column:
    """A finding as FINDING; a confidence given by name must be a known one."""
    if isinstance(confidence, str) and confidence not in CONFIDENCE:
        raise ValueError(f"no confidence {confidence}")
    value = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    kinds = ["string"] * 4 + ["long"] * 3 + ["string"] * 2
    names = ["rule_id", "confidence", "channel", "code_point", "count", "line", "offset", "member", "evidence"]
    return F.struct(*(value(v, t).alias(n) for n, t, v in zip(names, kinds, (rule_id, confidence, channel, code_point, count, line, offset, member, evidence))))


def no_findings() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def unicode_findings(text: Column, channel: str = "unicode", member: Column | None = None) -> Column:
    """Findings of hidden characters, one for each code point, with the place of the first; counts and places as hidden.scan has them."""
    def each(found: Column) -> Column:
        def of(cp: Column) -> Column:
            same = F.filter(found, lambda h: h["cp"] == cp)
            before = F.substring(text, F.lit(1), F.array_min(F.transform(same, lambda h: h["at"])))
            rule = unicode_class(cp)
            confidence = F.when(rule.isin(rules.PROBABLE_CLASSES), "probable").otherwise("confirmed")
            return finding(rule, confidence, channel, code_point_label(cp), F.size(same), F.size(F.split(before, "\n", -1)), utf16_length(before), member)

        return F.transform(F.array_distinct(F.transform(found, lambda h: h["cp"])), of)

    return F.coalesce(F.when(text.rlike(HIDDEN), let(hidden.hits(text), each)), no_findings())


def field_findings(text: Column, member: Column | None = None) -> Column:
    """Findings of the lines that name a metadata field."""
    def told(s: Column, n: Column) -> Column:
        sure = s.rlike(CI + rules.PROVENANCE)
        return F.when(s.rlike(CI + rules.FIELD), finding(F.when(sure, "metadata.provenance").otherwise("metadata.generator"), F.when(sure, "probable").otherwise("informational"), "metadata", line=n + 1, member=member, evidence=F.substring(js_trim(s), 1, 240)))

    return F.coalesce(F.when(text.rlike(CI + rules.FIELD), F.array_compact(F.transform(lines(text), told))), no_findings())


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{CI}({pattern})"), F.lit(1))


def markup_findings(text: Column, svg: Column) -> Column:
    """Findings of meta tags and data-ai attributes, and in SVG of metadata elements."""
    tags = F.flatten(F.transform(_all(text, rules.META_TAG), lambda t: field_findings(t)))
    marked = F.transform(_all(text, rules.DATA_AI), lambda a: finding("metadata.provenance", "confirmed", "metadata", evidence=F.substring(a, 1, 240)))
    held = F.when(svg, F.flatten(F.transform(_all(text, rules.SVG_METADATA), lambda t: field_findings(t)))).otherwise(no_findings())
    return F.concat(tags, marked, held)


def embedded_images(path: Column, text: Column, limits: dict = rules.LIMITS) -> Column:
    """Array of (n, declared, actual, bytes, sha256, raw: a marker in its bytes, code: the error, stop) of a text's data URIs.

    An item over its limit is passed over; the item that breaks the running total ends the list, and so does the count limit.
    """
    pattern = f"{CI}{rules.DATA_URI}"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("code"))

    def sized(u: Column, i: Column) -> Column:
        estimate = F.floor(F.length(u["code"]) * 3 / 4)
        content = F.when((i < limits["data_uris"]) & (estimate <= limits["data_uri_bytes"]), F.try_to_binary(F.rpad(F.regexp_replace(u["code"], "=+$", ""), F.ceil(F.length(F.regexp_replace(u["code"], "=+$", "")) / 4).cast("int") * 4, F.lit("=")), F.lit("base64")))
        wanted = F.when(F.lower(u["kind"]) == "jpg", "jpeg").otherwise(F.lower(u["kind"]))
        return F.struct((i + 1).alias("n"), wanted.alias("declared"), (estimate > limits["data_uri_bytes"]).alias("over"), content.alias("content"))

    def told(u: Column, i: Column, all_: Column) -> Column:
        total = F.aggregate(F.slice(all_, F.lit(1), i + 1), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x["content"]), F.lit(0)))
        actual = F.coalesce(image_format(u["content"]), F.lit("unsupported"))
        code = (
            F.when(u["n"] > limits["data_uris"], "data_uri_count_limit").when(u["over"], "data_uri_limit").when(total > limits["data_uri_total"], "data_uri_total_limit")
            .when(u["content"].isNull(), "data_uri_malformed").when(actual != u["declared"], "data_uri_signature_mismatch")
        )
        stop = F.coalesce(code.isin("data_uri_count_limit", "data_uri_total_limit"), F.lit(False))
        raw = F.coalesce(F.decode(u["content"], "ISO-8859-1").rlike(CI + rules.RAW_MARKER), F.lit(False))
        return F.struct(u["n"].alias("n"), F.concat(path, F.lit("#data-uri-"), u["n"].cast("string")).alias("target"), u["declared"].alias("declared"), actual.alias("actual"), F.octet_length(u["content"]).cast("long").alias("bytes"), F.sha2(u["content"], 256).alias("sha256"), raw.alias("raw"), code.alias("code"), stop.alias("stop"))

    whole = let(F.transform(F.slice(pairs, 1, limits["data_uris"] + 1), sized), lambda a: F.transform(a, lambda u, i: told(u, i, a)))
    first = lambda a: F.array_min(F.transform(F.filter(a, lambda x: x["stop"]), lambda x: x["n"]))
    kept = let(whole, lambda a: F.filter(a, lambda x: first(a).isNull() | (x["n"] <= first(a))))
    return F.when(text.rlike("(?i)data:image/"), kept)


def classified(content: Column, name: Column) -> Column:
    """Format by the bytes, of texts also by the name: an image format, zip, a text format or unsupported. Archives are told apart when they are opened."""
    zipped = F.hex(F.substring(content, 1, 4)).isin("504B0304", "504B0506", "504B0708")
    return F.coalesce(image_format(content), F.when(zipped, "zip"), F.when(is_text(content), text_format(name, content.cast("string"))), F.lit("unsupported"))


def inspected(df: DataFrame, target: str, name: str, content: str, limits: dict = rules.LIMITS, strict: bool = False) -> DataFrame:
    """_path, _format and _report (array of kind, target, finding, error) of each row; a text column is taken for its UTF-8 bytes."""
    is_string = df.schema[content].dataType.simpleString() == "string"
    raw = F.col(content).cast("binary") if is_string else F.col(content)
    form = text_format(F.col(name), F.col(content)) if is_string else classified(raw, F.col(name))
    base = df.filter(F.col(content).isNotNull()).select(F.col(target).cast("string").alias("_path"), F.col(name).alias("_name"), raw.alias("_raw"), form.alias("_format"))
    text, path = F.col("_raw").cast("string"), F.col("_path")
    is_form = lambda *names: F.col("_format").isin(*names)
    textual = is_form(*TEXT_FORMATS)
    found = F.when(textual, F.concat(
        unicode_findings(text),
        F.when(is_form("markdown"), field_findings(F.regexp_extract(text, rules.FRONT_MATTER, 0))).otherwise(no_findings()),
        F.when(is_form("html", "svg"), markup_findings(text, is_form("svg"))).otherwise(no_findings()),
    )).otherwise(no_findings())
    images = F.coalesce(F.when(textual, embedded_images(path, text, limits)), F.array().cast("array<struct<n:int,target:string,declared:string,actual:string,bytes:bigint,sha256:string,raw:boolean,code:string,stop:boolean>>"))
    step = base.select("_path", "_name", "_raw", "_format", F.explode(F.array(F.struct(found.alias("found"), images.alias("images")))).alias("_x"))
    images, found = F.col("_x.images"), F.col("_x.found")
    routed = F.lower(F.regexp_extract("_name", r"(\.[^./]*)$", 1)).isin(TEXT_EXTENSIONS) & ~textual
    unsafe = F.exists(images, lambda x: x["code"].isNotNull())
    lane = F.when(textual, "text-unicode").when(is_form("zip"), "zip-container").when(is_form("unsupported"), "unsupported").otherwise("media-container")
    status = F.when(unsafe, "unsafe").when(is_form("unsupported"), "unsupported").otherwise("complete")
    kind = f"struct<kind:string,target:string,t:{TARGET},f:{FINDING},e:{ERROR}>"
    row = lambda k, at, **parts: F.struct(F.lit(k).alias("kind"), at.alias("target"), *(parts.get(p, F.lit(None)).cast(t).alias(p) for p, t in (("t", TARGET), ("f", FINDING), ("e", ERROR)))).cast(kind)
    item = lambda at, f, b, sha, ln, st, inner: F.struct(at.alias("path"), f.alias("format"), f.alias("container"), b.alias("bytes"), sha.alias("sha256"), ln.alias("lane"), st.alias("status"), F.lit(inner).alias("embedded"))
    own = F.array(row("target", path, t=item(path, F.col("_format"), F.octet_length("_raw").cast("long"), F.sha2("_raw", 256), lane, status, False)))
    strictly = F.when(status.isin("degraded", "unsupported"), F.array(row("finding", path, f=finding("coverage.unresolved", "informational", "residual", evidence=F.concat_ws(" ", "_format", lane))))) if strict else F.lit(None)
    none = F.array().cast(f"array<{kind}>")
    good = F.filter(images, lambda x: x["code"].isNull())
    bad = F.filter(images, lambda x: x["code"].isNotNull())
    at = lambda x: F.when(x["code"] == "data_uri_signature_mismatch", x["target"]).otherwise(path)
    report = F.concat(
        own, F.transform(found, lambda f: row("finding", path, f=f)), F.coalesce(strictly, none),
        F.transform(good, lambda x: row("target", x["target"], t=item(x["target"], x["actual"], x["bytes"], x["sha256"], F.lit("embedded-raster"), F.lit("complete"), True))),
        F.transform(F.filter(good, lambda x: x["raw"]), lambda x: row("finding", x["target"], f=finding("binary.raw_marker", "likely_false_positive", "residual"))),
        F.transform(bad, lambda x: row("error", at(x), e=F.struct(x["code"].alias("code"), at(x).alias("target"), F.concat(F.lit("Embedded data URI "), x["n"].cast("string"), F.lit(" was refused.")).alias("message")))),
    )
    refused = F.array(row("error", path, e=F.struct(F.lit("unsafe_input").alias("code"), path.alias("target"), F.concat(F.lit("Binary "), F.col("_format"), F.lit(" input was routed through a text path.")).alias("message"))))
    return step.select("_path", "_format", F.when(routed, refused).otherwise(report).alias("_report"))


def audit(df: DataFrame, target: str, name: str, content: str, limits: dict = rules.LIMITS, strict: bool = False) -> DataFrame:
    """Report rows: kind (target, finding, error), target, and the fields of targets, findings and errors, nulls where a kind has none.

    Null contents aren't targets. If content is binary, archives and media are opened too; a text column has neither.
    """
    rows = inspected(df, target, name, content, limits, strict).select(F.explode("_report").alias("r")).select("r.*")
    if df.schema[content].dataType.simpleString() == "binary":
        rows = rows.unionByName(opened(df, target, name, content))
    return rows.select("kind", "target", "t.format", "t.container", "t.bytes", "t.sha256", "t.lane", "t.status", "t.embedded", "f.rule_id", "f.confidence", "f.channel", "f.code_point", "f.count", "f.line", "f.offset", "f.member", "f.evidence", "e.code", "e.message")


def _rows(df: DataFrame, findings: Column) -> DataFrame:
    out = df.select(F.col("path").alias("target"), F.explode(findings).alias("f"))
    return out.select(F.lit("finding").alias("kind"), "target", F.lit(None).cast(TARGET).alias("t"), "f", F.lit(None).cast(ERROR).alias("e"))


def binary_findings(files: DataFrame) -> DataFrame:
    """Report rows of the metadata of media files (path, content): manifests in a segment, fields in other segments, and, where nothing was found, a marker among the bytes."""
    text = F.col("data").cast("string")
    told = F.when(F.concat(F.col("segment"), F.lit(" "), text).rlike(CI + rules.SEGMENT_MANIFEST), F.array(finding("c2pa.embedded_manifest", "confirmed", "c2pa", member=F.col("segment"), evidence=F.concat("segment", F.lit(": "), F.substring(text, 1, 200)))))
    parts = containers.read_segments(files)
    found = _rows(parts.filter("segment IS NOT NULL"), told.otherwise(field_findings(text, F.col("segment"))))
    marked = files.filter(F.decode("content", "ISO-8859-1").rlike(CI + rules.RAW_MARKER))
    raw = marked.join(found.select(F.col("target").alias("path")).distinct(), "path", "left_anti")
    return found.unionByName(_rows(raw, F.array(finding("binary.raw_marker", "likely_false_positive", "residual"))))


def archive_findings(files: DataFrame) -> DataFrame:
    """Report rows of archives (path, content): fields in metadata members, hidden characters in visible members, errors of refused archives and of members that can't be opened."""
    members = containers.read_members(files)
    names = F.array_sort(F.collect_set("member"))
    kinds = members.filter("member IS NOT NULL").filter(F.col("member").isin("xl/workbook.xml", "ppt/presentation.xml", "word/document.xml", "mimetype", "META-INF/container.xml", "content.xml", "meta.xml"))
    kinds = kinds.groupBy("path").agg(names.alias("_names"), F.max(F.when(F.col("member") == "mimetype", F.trim(F.col("data").cast("string")))).alias("_mime"))  # seven names at most
    has = lambda n: F.array_contains("_names", n)
    told = (
        F.when(has("xl/workbook.xml"), "xlsx").when(has("ppt/presentation.xml"), "pptx").when(has("word/document.xml"), "docx")
        .when((F.col("_mime") == "application/epub+zip") | has("META-INF/container.xml"), "epub").when((F.col("_mime") == "application/vnd.oasis.opendocument.text") | has("content.xml") & has("meta.xml"), "odt").otherwise("zip")
    )
    of = members.join(kinds.select("path", told.alias("format")), "path", "left")
    fits = lambda table: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, p in table.items() for x in (k, p))), F.col("format")), F.lit("^$"))
    text = F.col("data").cast("string")
    where = lambda table: F.expr("false") if not table else F.call_function("regexp", F.col("member"), fits(table))
    held = of.filter("data IS NOT NULL")
    fields = _rows(held.filter(where(METADATA_MEMBERS)), field_findings(text, F.col("member")))
    seen = _rows(held.filter(where(VISIBLE_MEMBERS)), unicode_findings(text, "visible-content", F.col("member")))
    refused = of.filter("error IS NOT NULL").select("path", F.col("error").alias("code")).distinct()
    errors = refused.select(F.lit("error").alias("kind"), F.col("path").alias("target"), F.lit(None).cast(TARGET).alias("t"), F.lit(None).cast(FINDING).alias("f"), F.struct("code", F.col("path").alias("target"), F.lit("The archive or a member of it was refused.").alias("message")).alias("e"))
    return fields.unionByName(seen).unionByName(errors)


def opened(df: DataFrame, target: str, name: str, content: str) -> DataFrame:
    """Report rows of what archives and media among binary rows hold."""
    files = df.filter(F.col(content).isNotNull()).select(F.col(target).cast("string").alias("path"), F.col(content).alias("content"), classified(F.col(content), F.col(name)).alias("_f"), F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1)).isin(TEXT_EXTENSIONS).alias("_routed"))
    own = files.filter(~F.col("_routed"))
    media = own.filter(~F.col("_f").isin("zip", "unsupported", *TEXT_FORMATS)).select("path", "content")
    return binary_findings(media).unionByName(archive_findings(own.filter("_f = 'zip'").select("path", "content")))


def ordered(report: DataFrame) -> DataFrame:
    """The report in its order at the sink: targets by path, findings by target, rule and place, errors by target and code."""
    return report.orderBy(F.when(F.col("kind") == "target", 0).when(F.col("kind") == "finding", 1).otherwise(2), "target", "rule_id", "member", "line", "offset", "code_point", "code")


def status_of(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """status and exit_code (per group of by), from the worst row: error, unsafe, degraded, findings or clear; an empty report is clear."""
    worst = (
        F.when(F.col("code") == "internal", 4).when(F.col("code").isNotNull() & ~F.col("code").isin(rules.DEGRADED_CODES), 3)
        .when(F.col("code").isNotNull() | F.col("status").isin("degraded", "unsupported"), 2).when(F.col("kind") == "finding", 1).otherwise(0)
    )
    found = report.groupBy(*(by or [])).agg(F.coalesce(F.max(worst), F.lit(0)).alias("_r"))
    names = ["clear", "findings", "degraded", "unsafe", "error"]
    return found.select(*(by or []), F.element_at(F.array(*map(F.lit, names)), F.col("_r") + 1).alias("status"), F.element_at(F.array(*(F.lit(rules.EXIT_CODES[n]) for n in names)), F.col("_r") + 1).alias("exit_code"))


def audit_one(spark: SparkSession, path: str, content: bytes, limits: dict = rules.LIMITS) -> DataFrame:
    """The report of one buffer in memory."""
    return audit(spark.createDataFrame([(path, path, bytearray(content))], "path string, name string, content binary"), "path", "name", "content", limits)
