"""Rules on small cases: hidden characters, metadata, cleaning, comparison, status, names, ledgers, routing, settings, containers, logs."""

import io
import json
import random
import re
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions import text as tx
from quillspark.operators import assembly, drift, hidden, manuscript, metadata, projects, registry, reports, story, translation
from quillspark.sources import containers, files


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def scanned(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return {r.code_point: r for r in hidden.scan(df).collect()}


@pytest.mark.parametrize("text, found", [
    ("safe joiner: ل‍ا\ncarrier: A​B", {"U+200B": 1}), ("\U0001f469‍\U0001f4bb", {}), ("A​B​C​D​E", {"U+200B": 4}), ("a b", {"U+00A0": 1}), ("﻿a﻿b", {"U+FEFF": 1}),
    ("क‌ष x‌y", {"U+200C": 1}), ("\U0001f3f4\U000e0067\U000e007f", {}), ("flag far away from \U0001f3f4 123456789\U000e0067", {"U+E0067": 1}), ("‪x⁩", {"U+202A": 1, "U+2069": 1}), ("‎­؜⁡", {}), ("", {}), ("©️ x️", {"U+FE0F": 1}),
])
def test_hidden_characters(spark, text, found):
    assert {k: r["count"] for k, r in scanned(spark, text).items()} == found


def test_offsets_count_utf16(spark):
    r = scanned(spark, "\U0001f600\nab\U0001f600c​")["U+200B"]
    assert (r.offset, r.line, r.column, r.confidence) == (8, 2, 6, "confirmed")


@pytest.mark.parametrize("text, cleaned", [("邊\U000e0100ᠠ᠎ᠡA​B", "邊\U000e0100ᠠ᠎ᠡAB"), ("﻿a﻿", "﻿a"), ("a b", "a b"), ("\U0001f469‍\U0001f4bb​", "\U0001f469‍\U0001f4bb"), ("plain", "plain")])
def test_clean(spark, text, cleaned):
    assert one(spark, text, hidden.clean) == cleaned


def test_clean_is_idempotent_and_counts_agree(spark):
    dice = random.Random(3)
    marks = "​‌‍⁠﻿‪⁦\U000e0041 ️"
    texts = [(k, "".join(dice.choice("ab क\U0001f469é\n" + marks) for _ in range(40))) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    once = df.withColumn("text", hidden.clean(F.col("text")))
    left = {(r.doc_id, r.code_point): r["count"] for r in hidden.scan(df).filter("confidence = 'confirmed'").collect()}
    removed = {(r.doc_id, r.code_point): r.removed for r in hidden.removed_counts(df).collect()}
    assert left == removed and len(removed) > 100
    before, after = hidden.scan(df).withColumn("channel", F.lit("u")), hidden.scan(once).withColumn("channel", F.lit("u"))
    for r in hidden.compare_findings(before, after).collect():
        assert r.before == r.removed + r.remaining and r.after == r.remaining + r.added


@pytest.mark.parametrize("few", [0, 64])
def test_places_between_hits_and_by_character(spark, few):
    """Every context of a hidden character, by pattern and by character, against a plain reading of the rules; whole texts are not taken apart for a few."""
    dice = random.Random(11)
    some = "a​‌‍⁠﻿‮⁦\U000e0041\U000e007f️︀\U000e0100   　\n" + "कषبa©\U0001f469\U0001f4bb☀é‼"
    texts = ["".join(dice.choice(some) for _ in range(dice.randrange(0, 25))) for _ in range(1500)] + ["\U0001f469" + "b" * k + "\U000e0041" for k in range(5, 11)] + ["\U0001f469" + "\U0001f600" * 7 + "x" * k + "\U000e0041" for k in range(5, 11)] + [None, "", "﻿", "​" * 200]
    emoji, joining = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in tx.pictographic_ranges()) + "]"), "कषب"

    def plain(t, ranges):
        out = []
        for i, c in enumerate(t or ""):
            cp, prev, after = ord(c), t[i - 1] if i else "", t[i + 1 : i + 2]
            kept = (cp == 0xFEFF and i == 0) or (cp in (0x200C, 0x200D) and prev and prev in joining and after and after in joining) or ((cp == 0x200D or 0xFE00 <= cp <= 0xFE0F) and (emoji.match(prev) or emoji.match(after))) or (0xE0000 <= cp <= 0xE007F and emoji.search(t[max(0, i - 8) : i]))
            if any(a <= cp <= b for a, b in ranges) and not kept:
                out.append((i, cp))
        return out

    every = [r for _, _, rs in rules.UNICODE_CLASSES for r in rs]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = df.select("t", hidden.hits(F.col("t"), few=few).alias("a"), hidden.hits(F.col("t"), rules.REMOVABLE, few=few).alias("b"), hidden.clean(F.col("t")).alias("c")).collect()
    for r in got:
        assert [tuple(x) for x in r.a] == plain(r.t, every) and [tuple(x) for x in r.b] == plain(r.t, rules.REMOVABLE), repr(r.t)
        gone = {i for i, _ in plain(r.t, rules.REMOVABLE)}
        assert r.c == (None if r.t is None else "".join(c for i, c in enumerate(r.t) if i not in gone)), repr(r.t)
    plan = df.select(hidden.clean(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan


def test_compare_pairs_nulls_and_missing_counts(spark):
    schema = "doc_id long, rule_id string, confidence string, channel string, code_point string, member string, count int"
    before = spark.createDataFrame([(1, "r", "c", "u", None, None, 4), (1, "r", "c", "u", "U+200B", "m", None)], schema)
    after = spark.createDataFrame([(1, "r", "c", "u", None, None, 3), (1, "n", "c", "u", None, None, 2)], schema)
    got = {(r.rule_id, r.code_point): (r.before, r.after, r.remaining, r.removed, r.added) for r in hidden.compare_findings(before, after).collect()}
    assert got == {("r", None): (4, 3, 3, 1, 0), ("r", "U+200B"): (1, 0, 0, 1, 0), ("n", None): (0, 2, 0, 0, 2)}


def test_markup_cleaning_leaves_scripts(spark):
    html = "<p>a​b</p><script>c​d</script><STYLE>e​f</STYLE><i title='​'>g​h</i>"
    assert one(spark, html, hidden.clean_markup) == html.replace("a​b", "ab").replace("g​h", "gh")


def test_front_matter(spark):
    text = "---\ngenerator: x\ntitle: y # note\nauthor: watermark\ntitle: z\nquoted: 'a # b'\nblock: |\n---\nbody\n---\ngenerator: later\n---\n"
    df = spark.createDataFrame([(1, text), (2, "no\n---\ngenerator: x\n---\n"), (3, None)], "doc_id long, text string")
    assert sorted((r.line, r.rule_id) for r in metadata.front_matter_findings(df).collect()) == [(2, "metadata.generator"), (4, "metadata.provenance")]
    assert {r.key: r.value for r in metadata.front_matter_values(df, "doc_id").collect()} == {"generator": "x", "title": "y", "author": "watermark", "quoted": "a # b", "block": ""}
    assert one(spark, text, hidden.clean_front_matter) == text.replace("generator: x\n", "", 1).replace("author: watermark\n", "")
    assert one(spark, text, metadata.strip_front_matter).startswith("body")


@pytest.mark.parametrize("findings, errors, targets, status, code", [
    ([], [], ["complete"], "clear", 0), ([1], [], ["complete"], "findings", 1), ([1], [], ["degraded"], "degraded", 2), ([], ["remote_unsupported"], ["complete"], "degraded", 2), ([], ["provider_fallback", "remote_unsupported"], ["complete"], "unsafe", 64), ([], ["internal", "x"], ["complete"], "error", 70),
])
def test_status(spark, findings, errors, targets, status, code):
    frame = lambda rows, col: spark.createDataFrame([("r", x) for x in rows], f"run_id string, {col}")
    got = metadata.fold_status(frame(findings, "f int"), frame(errors, "code string"), frame(targets, "status string")).first()
    assert (got.status, got.exit_code) == (status, code)


SIGNATURES = [("89504E470D0A1A0A00", "png"), ("FFD8FFE000", "jpeg"), ("524946460400000057454250", "webp"), ("0000001C6674797061766966", "avif"), ("0000001C6674797068656963", "heic"), ("424D3600", "bmp"), ("474946383961", "gif"), ("49492A00", "tiff"), ("4D4D002B", "bigtiff"), ("255044462D312E37", "pdf"), ("00", None)]


def test_signatures(spark):
    df = spark.createDataFrame([(bytearray.fromhex(h),) for h, _ in SIGNATURES], "c binary")
    assert [r.f for r in df.select(metadata.image_format(F.col("c")).alias("f")).collect()] == [f for _, f in SIGNATURES]


@pytest.mark.parametrize("label, slug", [("The Long War", "the-long-war"), ("The Watchmaker's Daughter", "the-watchmakers-daughter"), ("Book 2: The Reckoning", "book-2-the-reckoning"), ("A  B", "a-b"), ("a_b", "a-b"), ("", "untitled"), ("***", "untitled"), (None, "untitled"), ("日本", "untitled"), ("a b", "a-b")])
def test_slug(spark, label, slug):
    assert one(spark, label, tx.slug) == slug


@pytest.mark.parametrize("parts, name", [(("the-long-war", "fr", "kdp", "2", "epub"), "the-long-war-fr-kdp-v2.epub"), (("x", "", "", "v3", "pdf"), "x-v3.pdf"), (("x", None, None, "", "pdf"), "x.pdf"), (("The Long War", "FR", "KDP/print", None, "EPUB"), "the-long-war-fr-kdpprint.epub")])
def test_deliverable_names(spark, parts, name):
    df = spark.createDataFrame([parts], "a string, b string, c string, d string, e string")
    assert df.select(tx.deliverable_name(*(F.col(c) for c in "abcde"))).first()[0] == name


def test_unique_slugs(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a"), (3, "B"), (4, "A!")], "id int, label string")
    taken = spark.createDataFrame([("b",), ("b-2",)], "name string")
    assert [r.name for r in registry.unique_slugs(df, "label", "id").orderBy("id").collect()] == ["a", "a-2", "b", "a-3"]
    assert [r.name for r in registry.unique_slugs(df, "label", "id", taken).orderBy("id").collect()] == ["a", "a-2", "b-3", "a-3"]


def project(spark, rows):
    return spark.createDataFrame([("p", path, len(text), at, text) for path, text, at in rows], "project_id string, rel_path string, size long, mtime long, text string")


GUIDE = "\n".join(f"rule {k}" for k in range(9))


def routed(spark, rows):
    return projects.automation(projects.route(projects.signals(project(spark, rows)))).first()


def test_routes(spark):
    base = [("STATE.md", "ok", 10), ("CONTEXT.md", "c", 100), ("STYLE-GUIDE.md", GUIDE, 1), ("config.json", '{"voice":{"calibrated":true}}', 1), ("HISTORY.log", "a\nsaved\n", 1)]
    draft, plan, review = ("drafts/body/1-a-DRAFT.md", "x", 5), ("plans/1-a-PLAN.md", "x", 5), ("reviews/1-a-REVIEW.md", "fine", 5)
    got = routed(spark, [*base, plan])
    assert (got.command, got.mode, got.plan_state) == ("draft 1", "agent-ready", "ready-to-draft")
    got = routed(spark, [*base, draft])
    assert (got.command, got.review_state, got.mode) == ("editor-review 1", "missing", "agent-ready")
    pub = [("front-matter/a.md", "", 1), ("back-matter/a.md", "", 1), ("marketing/BLURB.md", "", 1), ("build/ebook-cover.jpg", "", 20)]
    got = routed(spark, [*base, draft, review, *pub])
    assert (got.command, got.mode, got.publishing_state) == ("prepublish-review", "manual-gated", "editorial-review-needed")
    assert routed(spark, base[1:]).command == "scan" and routed(spark, [*base[:-1], ("HISTORY.log", "ok\nsave failed\n\n", 1)]).command == "troubleshoot"
    assert routed(spark, [base[0], ("CONTEXT.md", "c", 5), *base[2:]]).command == "scan"
    assert routed(spark, [*base[:2], ("STYLE-GUIDE.md", "TBD\n" + GUIDE, 1), *base[3:]]).command == "profile-writer"
    assert routed(spark, [*base[:3], ("config.json", "{broken", 1), base[4]]).command == "voice-test"
    assert routed(spark, [*base, ("proposals/a.md", "", 1)]).command == "editor-review --proposal" and routed(spark, [*base, ("NOTES.md", "todo", 1)]).command == "check-notes" and routed(spark, base).command == "plan"
    assert routed(spark, [*base, draft, ("reviews/1-a-REVIEW.md", "continuity", 5)]).command == "editor-review"
    odd = routed(spark, [*base, ("drafts/odd.md", "x", 5)])
    assert (odd.review_state, odd.command) == ("missing", "editor-review")


def test_ledger(spark):
    rows = [("OUTLINE.md", "| 1 | a |\n| 2 | b |\n| 3 | c |", 1), *((f"drafts/body/{k}-x-DRAFT.md", "", 1) for k in (1, 2, 3)), ("reviews/1-a-REVIEW.md", "clean", 1), ("reviews/2-a-REVIEW.md", "TODO", 1), ("reviews/3-a-REVIEW.md", "TODO", 1), ("STATE.md", "submit | Scene 3 | Submitted", 1)]
    r = projects.ledger(project(spark, rows)).first()
    assert (r.total, r.n_reviewed, r.n_submitted, r.done, r.open, r.in_progress, r.percent, r.bar) == (3, 3, 1, [1, 3], [2], 1, 67, "███████░░░")
    empty = projects.ledger(project(spark, [("a.txt", "", 1)])).first()
    assert (empty.total, empty.percent, empty.bar, empty.done) == (0, 0, "░" * 10, [])


def test_context_budget(spark):
    rows = [("STATE.md", "x" * 10, 1)] + [(f"drafts/{k}.md", "x" * k, k) for k in range(10)] + [(f"plans/{k}.md", "y" * 100, k) for k in range(5)]
    r = projects.context_budget(project(spark, rows)).first()
    assert (r.files, r.bytes, r.tokens, r.state) == (9, 10 + 9 + 8 + 7 + 6 + 5 + 300, 87, "ok")


def test_settings(spark):
    good = {"version": "1", "runtime": "", "runtimes": ["a"], "scope": "global", "developer_mode": True, "data_dir": "d", "install_mode": "silent", "installed_at": "t"}
    cases = [(good, [], 0), ({**good, "extra": 1}, [], 1), ({k: v for k, v in good.items() if k != "version"}, ["version is missing"], 0), ({**good, "scope": "moon"}, ["scope is not one of its values"], 0), ({**good, "runtimes": "a"}, ["runtimes is not array"], 0), ({**good, "data_dir": ""}, ["data_dir is empty"], 0), ([1], ["not an object"], 0), (None, ["not an object"], 0)]
    df = spark.createDataFrame([(k, json.dumps(c[0])) for k, c in enumerate(cases)], "k int, js string")
    for r in registry.validate_settings(df, "js").collect():
        assert (r.errors, len(r.warnings), r.valid) == (cases[r.k][1], cases[r.k][2], not cases[r.k][1])


def archive(entries, **options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **options) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def test_containers(spark):
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"tEXt", b"Software\0ai-tool") + chunk(b"tEXt", b"Author\0me") + chunk(b"caBX", b"c2pa") + chunk(b"IDAT", b"pixels") + chunk(b"IEND", b"")
    jpeg = b"\xff\xd8" + b"\xff\xeb\x00\x08jumb--" + b"\xff\xe1\x00\x06Exif" + b"\xff\xda\x00\x02data"
    webp = b"RIFF\0\0\0\0WEBP" + b"XMP \x02\0\0\0ab" + b"C2PA\x03\0\0\0abc\0"
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"!\xfe\x05hello\x00;"
    rows = [("png", png), ("jpeg", jpeg), ("webp", webp), ("gif", gif), ("docx", archive([("word/document.xml", "<a/>"), ("docProps/core.xml", "x")])), ("slip", archive([("../a", "x")])), ("abs", archive([("/a", "x")])), ("bomb", archive([("a", "0" * 3_000_000)], compression=zipfile.ZIP_DEFLATED)), ("bad", b"PK\x03\x04zzz"), ("torn", png[:40]), ("none", None), ("dup", archive([("a", "x"), ("A", "y")]))]
    df = spark.createDataFrame(rows, "path string, content binary")
    segments = {(r.path, r.segment) for r in containers.read_segments(df).filter("segment IS NOT NULL").collect()}
    assert segments == {("png", "tEXt"), ("png", "caBX"), ("jpeg", "APP11"), ("jpeg", "APP1"), ("webp", "XMP"), ("webp", "C2PA"), ("gif", "comment")}
    assert {r.path: r.error for r in containers.read_segments(df).filter("error IS NOT NULL").collect()} == {"torn": "png_malformed"}
    members = containers.read_members(df.filter("path IN ('docx', 'slip', 'abs', 'bomb', 'bad', 'dup')")).collect()
    assert {r.path: r.error for r in members if r.error} == {"slip": "archive_unsafe_name", "abs": "archive_unsafe_name", "bomb": "archive_ratio_limit", "bad": "archive_malformed", "dup": "archive_duplicate_name"}
    assert containers.zip_kind({r.member: bytes(r.data) for r in members if r.path == "docx"}) == "docx" and containers.metadata_member("docx", "docProps/core.xml")
    done = {r.path: r for r in containers.cleaned(df).collect()}
    assert done["png"].removed == 2 and b"pixels" in done["png"].content and b"Author" in done["png"].content and b"ai-tool" not in done["png"].content
    assert done["jpeg"].removed == 1 and b"Exif" in done["jpeg"].content and done["webp"].removed == 1 and len(done["webp"].content) - 8 == struct.unpack("<I", done["webp"].content[4:8])[0]
    assert (done["gif"].removed, done["torn"].error, bytes(done["torn"].content)) == (0, "png_malformed", png[:40])


def test_reports(spark):
    rows = [("r", "b", "x.y", "probable", "U+200B", 2, "m"), ("r", "a|b", "x.y", "confirmed", None, None, "m")]
    df = spark.createDataFrame(rows, "run_id string, target string, rule_id string, confidence string, code_point string, count int, message string")
    report = reports.markdown(df).first().report
    assert report.index("a\\|b") < report.index("- b") and "x2" in report and reports.CAVEAT in report
    sarif = json.loads(reports.sarif(df).first().sarif)
    assert sarif["version"] == "2.1.0" and sorted(x["level"] for x in sarif["runs"][0]["results"]) == ["error", "warning"] and sarif["runs"][0]["tool"]["driver"]["rules"] == [{"id": "x.y"}]
    assert one(spark, "a\x01[b]\r\nc", tx.markdown_escape) == "a\\\\u0001\\[b\\] c"


def test_addresses(spark):
    cases = {"8.8.8.8": True, "10.1.2.3": False, "172.31.0.1": False, "172.32.0.1": True, "256.1.1.1": False, "1.2.3": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    assert [r.g for r in df.select(reports.is_global_ipv4(F.col("ip")).alias("g")).collect()] == list(cases.values())
    urls = {"https://x.org/a": None, "http://x.org": "plain_http", "http://127.0.0.1:9": None, "https://u:p@x.org": "credentials", "https://x.org?q=1": "query_or_fragment", "ftp://x.org": "scheme"}
    df = spark.createDataFrame([(k,) for k in urls], "u string")
    assert [r.e for r in df.select(reports.service_url_error(F.col("u")).alias("e")).collect()] == list(urls.values())


def test_cleanup_and_word_counts(spark):
    text = "# One\n[Fill in: a]\nAlternate 1: b\nstill b\n\nkeep {{VAR}}\n# Two\nAlternate 2: c\n## Sub\nend"
    assert one(spark, text, assembly.cleanup) == "# One\n\nkeep {{VAR}}\n## Sub\nend"
    prose = "# Title here\n#\n---\n\ntwo words\n"
    assert (one(spark, prose, tx.words_prose), one(spark, prose, tx.words_wc), one(spark, " ", tx.words_print), one(spark, None, tx.words_wc)) == (5, 7, 0, 0)


def test_screenplay(spark):
    lines = ["INT. HOUSE - DAY", "", "JOHN", "(quietly)", "Hello.", "", "He leaves.", "CUT TO:"]
    df = spark.createDataFrame([(k, s, lines[k - 1] if k else None) for k, s in enumerate(lines)], "k int, s string, b string")
    got = [r.x for r in df.orderBy("k").select(assembly.screenplay_kind(F.col("s"), F.col("b")).alias("x")).collect()]
    assert got == ["scene_heading", "blank", "character", "parenthetical", "dialogue", "blank", "action", "transition"]


def test_assembly_order(spark):
    fs = spark.createDataFrame([("p", "front", "2-b.md", None), ("p", "front", "1-a.md", None), ("p", "body", "1-x.md", 1), ("p", "body", "3-x.md", 3), ("p", "back", "z.md", None), ("p", "back", "a.md", None)], "project_id string, section string, name string, unit int")
    outline = spark.createDataFrame([("p", 3, 1), ("p", 1, 2), ("p", 2, 3)], "project_id string, unit int, pos int")
    got = assembly.assembly_order(fs, outline).orderBy("pos").collect()
    assert [r.name for r in got] == ["1-a.md", "2-b.md", "3-x.md", "1-x.md", None, "a.md", "z.md"] and [r.missing for r in got].index(True) == 4


def test_log_and_stream(spark, tmp_path):
    from quillspark.streaming import history

    lines = ["2024-01-01T00:00:00 | cmd:save | a=1 | outcome=ok", "broken", "2024-01-01T00:10:00 | cmd:save | a=2 | outcome=failed", "2024-01-01T05:00:00 | cmd:scan | a=3 | outcome=ok", "2024-01-01T05:00:00 | cmd:scan | a=3 | outcome=ok"]
    df = spark.createDataFrame([(s,) for s in lines], "value string")
    assert [r.malformed for r in drift.parse_log(df).collect()] == [False, True, False, False, False]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.txt").write_text("\n".join(lines))
    (tmp_path / "in" / "later.txt").write_text("2024-01-02T05:00:00 | cmd:scan | a=4 | outcome=ok")
    q = history.outcome_counts(history.read_log_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.start.hour + 24 * (r.start.day - 1), r.command, r.outcome): r.n for r in spark.table("counts").collect()}
    assert got == {(0, "cmd:save", "ok"): 1, (0, "cmd:save", "failed"): 1, (5, "cmd:scan", "ok"): 1, (29, "cmd:scan", "ok"): 1}


def test_files(spark, tmp_path):
    for name, text in (("drafts/a.md", "x"), ("drafts/.git/c", "x"), ("node_modules/b.md", "x"), ("build/o.bin", "\0")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = files.texts(files.read_tree(spark, str(tmp_path)))
    assert {(r.rel_path, r.text) for r in tree.collect()} == {("drafts/a.md", "x"), ("build/o.bin", None)}
    assert [r.rel_path for r in files.in_scope(tree, "source").collect()] == ["drafts/a.md"] and files.over_limits(tree).count() == 0 and files.over_limits(tree, {"bytes": 0, "depth": 9}).count() == 2
    assert files.run_totals(tree).first().within
    assert one(spark, "HTTP://x", files.target_kind) == "remote_unsupported"


def test_voice_fixtures(spark):
    docs = spark.createDataFrame([(1, "The Grey sea, the grey sky."), (2, None)], "doc_id long, text string")
    fx = spark.createDataFrame([("g", ["grey", "sea", "grey"], ["delve"], 3, 0)], "fixture_id string, required array<string>, forbidden array<string>, min_markers int, max_forbidden int")
    assert {r.doc_id: (r.hits, r.passed) for r in manuscript.voice_markers(docs, fx).collect()} == {1: (3, True), 2: (0, False)}


def test_translation_lookup_and_export(spark):
    tm = spark.createDataFrame([("fr", "One.", "Un & deux.", 1.0), ("fr", "Two.", None, 0.3)], "lang string, source string, target string, confidence double")
    units = spark.createDataFrame([(1, "One. Three.\n\nTwo."), (2, "Four.")], "unit int, text string")
    assert sorted((r.unit, r.source) for r in translation.lookup(units, tm, "unit", "text").collect()) == [(1, "One."), (1, "Two.")]
    assert translation.tmx(tm, "lang").first().tmx == "<tmx><body><tu><tuv><seg>One.</seg></tuv><tuv><seg>Un &amp; deux.</seg></tuv></tu></body></tmx>"


def test_cycles_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent long, child long")
    got = story.descendants(edges, spark.createDataFrame([(1,)], "node long"))
    assert sorted((r.node, r.depth) for r in got.collect()) == [(1, 0), (2, 1), (3, 2)]


def test_slugs_pass_over_names_that_other_rows_hold(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a 2"), (4, "a"), (5, "a 2")], "id int, label string")
    names = [r.name for r in registry.unique_slugs(df, "label", "id").orderBy("id").collect()]
    assert names == ["a", "a-3", "a-2", "a-4", "a-2-2"]


def test_text_has_no_nul(spark):
    df = spark.createDataFrame([(1, bytearray(b"plain \xc3\xa9")), (2, bytearray(b"a\0b")), (3, bytearray(b"\xff\xfe"))], "id int, content binary")
    assert [r.x for r in df.orderBy("id").select(metadata.is_text(F.col("content")).alias("x")).collect()] == [True, False, False]


def test_data_uris_past_the_count_limit_are_told(spark):
    df = spark.createDataFrame([(1, f'<img src="data:image/png;base64,{"iVBORw0KGgo="}">' * 5)], "page_id int, html string")
    got = metadata.data_uris(df, limits={**rules.LIMITS, "data_uris": 3}).orderBy("target").collect()
    assert [r.error for r in got] == [None, None, None, "data_uri_count_limit"]


def test_findings_carry_kept_columns_and_first_places(spark):
    df = spark.createDataFrame([(1, "ab\nc​d​ ", "s")], "doc_id int, text string, source string")
    got = {r.code_point: (r["count"], r.offset, r.line, r.column, r.source) for r in hidden.scan(df, keep=("source",)).collect()}
    assert got["U+200B"][:4] == (2, 4, 2, 2) and {g[4] for g in got.values()} == {"s"}
