"""Drivers and look-ups on small cases: against sequential loops, brute force and the standard library."""

import io
import ipaddress
import json
import os
import random
import re
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quillspark.functions import ranges
from quillspark.operators import audit, cleaning, hidden, manifest, manuscript, network, records, reports, translation
from quillspark.sources import collect

ZWSP, PNG = "​", "iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg=="


# Translation memory.


@pytest.mark.parametrize("hot", [10_000, 1])
def test_lookup_finds_what_occurs(spark, hot):
    dice = random.Random(6)
    words = ["the", "cat", "sat", "on", "a", "mat", "naïve", "größe", "x", "\U0001f600", "end.", "Thank", "you."]
    units = [(k, " ".join(dice.choice(words) for _ in range(dice.randrange(0, 60)))) for k in range(60)] + [(60, None), (61, ""), (62, "the\ncat  sat"), (None, "the cat sat on a mat"), (5, "you.")]
    sources = {" ".join(dice.choice(words) for _ in range(dice.randrange(1, 6))) for _ in range(120)} | {"e", "at", "he cat", "he cat sat o", "at sat on a ma", "nothing like it at all", "the\ncat", " the cat sat ", "\t", "", "ï", "größ", "\U0001f600 x"}
    tm = [(s, f"t{k}", 0.5) for k, s in enumerate(sorted(sources))] + [("cat", "zwei", 1.0), (None, "n", 1.0)]
    got = translation.lookup(spark.createDataFrame(units, "unit long, text string"), spark.createDataFrame(tm, "source string, target string, confidence double"), "unit", "text", hot=hot)
    want = sorted((str(u), s, t) for u, x in units if x is not None for s, t, _ in tm if s and s.strip() and s.strip() in x)
    assert sorted((str(r.unit), r.source, r.target) for r in got.collect()) == want and len(want) > 500


@pytest.mark.parametrize("small", [200_000, 0])
def test_lookup_of_short_segments_in_long_words(spark, small):
    """Words longer than a piece, segments at their cuts, at both ends, of one to three characters and longer than a piece; the same by broadcast and by shuffle."""
    dice = random.Random(7)
    long = ["".join(dice.choice("abcdé\U0001f600") for _ in range(n)) for n in (700, 255, 256, 257, 1500)]
    units = [(k, x) for k, x in enumerate(long)] + [(9, " \n".join(long)), (10, "a b"), (11, "ab cd ef gh")]
    cuts = {x[a : a + n] for x in long for a in (0, 250, 255, 256, 510, len(x) - 4) for n in (1, 2, 3, 8, 20, 300)} - {""}
    tm = [(s, s, 1.0) for s in cuts | {"b cd", "b cd e", "b cd ef g", "a", long[3][-5:] + " \n" + long[4][:5], "zz"}]
    got = translation.lookup(spark.createDataFrame(units, "unit long, text string"), spark.createDataFrame(tm, "source string, target string, confidence double"), "unit", "text", hot=5, small=small).collect()
    assert sorted((r.unit, r.source) for r in got) == sorted((u, s) for u, x in units for s, _, _ in tm if s in x)


def test_lookup_moves_what_meets_an_anchor(spark):
    """Only distinct words, never whole texts, are taken apart into characters, and a small memory's anchors are broadcast."""
    units, tm = spark.createDataFrame([(1, "the cat sat on a mat, today")], "unit long, text string"), spark.createDataFrame([("cat sat on a", "t", 1.0), ("mat,", "u", 1.0)], "source string, target string, confidence double")
    plan = translation.lookup(units, tm, "unit", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"split\(text#\d+, , -1\)", plan) and "strategy=broadcast" in plan


def test_lookup_of_nothing(spark):
    units, tm = spark.createDataFrame([(1, "a")], "unit long, text string"), spark.createDataFrame([], "source string, target string, confidence double")
    assert translation.lookup(units, tm, "unit", "text").count() == 0
    assert translation.lookup(units.limit(0), spark.createDataFrame([("a", "b", 1.0)], tm.schema), "unit", "text").count() == 0


# Order over ranges.


def test_running_neighbours_percentiles(spark):
    dice = random.Random(2)
    rows = [(dice.choice(["hot", "hot", "hot", "cold", None]), k, dice.choice([None, *range(12)])) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    got = {r.k: r for r in ranges.running(df, ["g"], ["k"], {"n": F.lit(1), "s": F.col("v")}, ranges=9).collect()}
    near = {r.k: r for r in ranges.neighbours(df, ["g"], ["k"], ["k", "v"], ranges=9).collect()}
    for g in ("hot", "cold", None):
        own = [r for r in rows if r[0] == g]
        upto = 0
        for i, (_, k, v) in enumerate(own):
            upto += v or 0
            assert (got[k].n, got[k].s) == (i + 1, upto)
            assert (near[k].prev and tuple(near[k].prev)) == (own[i - 1][1:] if i else None)
            assert (near[k].next and tuple(near[k].next)) == (own[i + 1][1:] if i + 1 < len(own) else None)
    shares = {"a": 0.1, "b": 0.5, "c": 0.77}
    want = {r.g: r for r in df.groupBy("g").agg(*(F.percentile("v", s).alias(n) for n, s in shares.items())).collect()}
    for r in ranges.percentiles(df, ["g"], "v", shares).collect():
        assert [round(r[n], 9) for n in shares] == [round(want[r.g][n], 9) for n in shares]
    assert ranges.running(df.limit(0), ["g"], ["k"], {"n": F.lit(1)}).count() == 0


# Collection.


def walk_by_hand(entries, caps):
    files, errors, n, size, dirs = [], [], 0, 0, 0
    for no, path, kind, length, depth in sorted(entries, key=lambda e: (e[0], e[1].split("/"), e[2] != "dir")):
        if any(x in path.split("/") for x in (".git", "node_modules", ".cache")):
            continue
        if kind == "remote":
            errors.append(("remote_unsupported", path))
            continue
        stop = None
        if kind == "dir":
            dirs += 1
            stop = "directory_depth_limit" if depth > caps["depth"] else "directory_count_limit" if dirs > caps["directories"] else None
        elif kind == "file":
            n, size = n + 1, size + length
            files.append(path)
            stop = "file_count_limit" if n > caps["files"] else "input_bytes_limit" if size > caps["bytes"] else None
        else:
            stop = {"link": "unsafe_input", "escape": "unsafe_input", "scheme": "unsupported_scheme", "missing": "missing_target"}[kind]
        if stop:
            errors.append((stop, path))
            break
    return sorted(set(files)), sorted(errors), (n, size)


@pytest.mark.parametrize("seed, caps", [(1, {}), (2, {"files": 40}), (3, {"bytes": 2000}), (4, {"depth": 2}), (5, {"directories": 6}), (6, {"link": 0.02}), (7, {"files": 1}), (8, {"bytes": 0})])
def test_collection_is_the_sequential_walk(spark, seed, caps):
    dice, entries = random.Random(seed), []
    for no in range(3):
        names = {"/".join(["root", *(dice.choice("abc") for _ in range(dice.randrange(0, 4))), f"f{dice.randrange(40)}{dice.choice(['', '.cache', '.md'])}"]) for _ in range(60)} | {"root/.cache/x", "root/a/.git/y"}
        folders = {p.rsplit("/", k)[0] for p in names for k in range(1, p.count("/") + 1)}
        kind = lambda: "link" if dice.random() < caps.get("link", 0) else "file"  # noqa: E731, B023
        entries += [(no, p, kind(), dice.randrange(100), p.count("/")) for p in sorted(names)] + [(no, p, "dir", 0, p.count("/")) for p in sorted(folders)]
    entries += [(3, "https://x/y", "remote", None, 0), (4, "root/a", "missing", None, 0), (5, "https://late/", "remote", None, 0)]
    limits = {"files": 10_000, "bytes": 1 << 40, "depth": 64, "directories": 10_000} | {k: v for k, v in caps.items() if k != "link"}
    df = spark.createDataFrame(entries, "target_no int, path string, kind string, length long, depth int").repartition(5)
    files, errors, totals = collect.collect(df, limits, ranges=7)
    want = walk_by_hand(entries, limits)
    assert (sorted(r.path for r in files.collect()), sorted((r.code, r["at"]) for r in errors.collect()), tuple(totals.first())) == want


def test_collection_of_nothing(spark):
    files, errors, totals = collect.collect(spark.createDataFrame([], "target_no int, path string, kind string, length long, depth int"))
    assert (files.count(), errors.count(), tuple(totals.first())) == (0, 0, (0, 0))


# Audit and cleaning.


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def png(*chunks):
    body = b"\x89PNG\r\n\x1a\n"
    for kind, data in (*chunks, (b"IEND", b"")):
        body += struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return body


def test_audit_of_all_lanes(spark):
    rows = [
        ("a.md", f"safe joiner: ل‍ا\ncarrier: A{ZWSP}B <img src='data:image/png;base64,{PNG}'> data:image/jpeg;base64,{PNG}".encode()),
        ("b.html", b"<meta name='generator' content='x'><p data-ai-model='m'>"), ("c.svg", b"<svg><metadata>\ncreator: ai-generated\n</metadata></svg>"), ("d.txt", b"plain"),
        ("e.png", png((b"caBX", b"jumb box"), (b"tEXt", b"Software\0tool"))), ("f.png", png((b"zzZZ", b"made of c2pa"))),
        ("g.docx", zipped(word__document_xml=f"<w:t>a{ZWSP}b</w:t>", docProps__core_xml="<dc:creator>x</dc:creator>")), ("h.txt", b"\x89PNG\r\n\x1a\n"), ("i.bin", b"\0\1\2"), ("j.md", None),
        ("k.md", b"---\nauthor: me\n---\nbody"), ("l.md", b"text\n---\nauthor: me\n---\n"),
    ]
    df = spark.createDataFrame([(n, n, c and bytearray(c)) for n, c in rows], "path string, name string, content binary")
    report = audit.audit(df, "path", "name", "content", strict=True)
    got = report.collect()
    lanes = {r.target: (r.format, r.lane, r.status) for r in got if r.kind == "target"}
    assert lanes == {
        "a.md": ("markdown", "text-unicode", "unsafe"), "a.md#data-uri-1": ("png", "embedded-raster", "complete"), "b.html": ("html", "text-unicode", "complete"), "c.svg": ("svg", "text-unicode", "complete"), "d.txt": ("text", "text-unicode", "complete"),
        "e.png": ("png", "media-container", "complete"), "f.png": ("png", "media-container", "complete"), "g.docx": ("zip", "zip-container", "complete"), "i.bin": ("unsupported", "unsupported", "unsupported"), "k.md": ("markdown", "text-unicode", "complete"), "l.md": ("markdown", "text-unicode", "complete"),
    }
    found = sorted((r.target, r.rule_id, r.confidence, r.member or "", r.line or 0) for r in got if r.kind == "finding")
    assert found == [
        ("a.md", "unicode.zero_width", "confirmed", "", 2), ("b.html", "metadata.generator", "informational", "", 1), ("b.html", "metadata.provenance", "confirmed", "", 0), ("c.svg", "metadata.provenance", "probable", "", 2),
        ("e.png", "c2pa.embedded_manifest", "confirmed", "caBX", 0), ("e.png", "metadata.generator", "informational", "tEXt", 1), ("f.png", "binary.raw_marker", "likely_false_positive", "", 0),
        ("g.docx", "metadata.generator", "informational", "docProps/core.xml", 1), ("g.docx", "unicode.zero_width", "confirmed", "word/document.xml", 1), ("i.bin", "coverage.unresolved", "informational", "", 0), ("k.md", "metadata.generator", "informational", "", 2),
    ]
    assert sorted((r.target, r.code) for r in got if r.kind == "error") == [("a.md#data-uri-2", "data_uri_signature_mismatch"), ("h.txt", "unsafe_input")]
    assert tuple(audit.status_of(report).first()) == ("unsafe", 64)
    assert [r.kind for r in audit.ordered(report).collect()] == sorted((r.kind for r in got), key=["target", "finding", "error"].index)
    assert tuple(audit.status_of(audit.audit_one(spark, "x.txt", b"plain")).first()) == ("clear", 0)
    assert tuple(audit.status_of(report.limit(0)).first()) == ("clear", 0)


def test_confidence_is_checked():
    with pytest.raises(ValueError, match="confidence"):
        audit.finding("x", "certain", "unicode")


def test_limits_of_embedded_images(spark):
    uri = f"data:image/png;base64,{PNG} "
    df = spark.createDataFrame([("a.html", uri * 5)], "path string, text string")
    codes = lambda **limits: sorted((r.code, r.target) for r in audit.audit(df, "path", "path", "text", limits={"data_uris": 1000, "data_uri_bytes": 1 << 20, "data_uri_total": 1 << 20, **limits}).filter("kind = 'error'").collect())
    assert codes() == [] and codes(data_uris=3) == [("data_uri_count_limit", "a.html")]
    assert codes(data_uri_bytes=10) == [("data_uri_limit", "a.html")] * 5 and codes(data_uri_total=150) == [("data_uri_total_limit", "a.html")]


def test_text_audit_reads_its_table_once(spark, tmp_path):
    spark.createDataFrame([("a.md", "x")], "path string, text string").write.parquet(f"{tmp_path}/t")
    plan = audit.audit(spark.read.parquet(f"{tmp_path}/t"), "path", "path", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Arrow" not in plan


def test_difference_counts(spark):
    one = lambda n: audit.finding("unicode.zero_width", "confirmed", "unicode", "U+200B", n)
    other = audit.finding("metadata.generator", "informational", "metadata", line=3)
    df = spark.range(1).select(F.array(one(4), other, other).alias("a"), F.array(one(3), other, audit.finding("x", "probable", "unicode")).alias("b"))
    got = {r.rule_id: tuple(r)[5:] for r in df.select(F.explode(cleaning.difference(F.col("a"), F.col("b"))).alias("d")).select("d.*").collect()}
    assert got == {"unicode.zero_width": (4, 3, 1, 3, 0), "metadata.generator": (2, 1, 1, 1, 0), "x": (0, 1, 0, 0, 1)}


CASES = [("a.txt", f"A{ZWSP}B{ZWSP}C"), ("b.md", f"---\ngenerator: x\ntitle: y\n---\nb{ZWSP}"), ("c.html", f"<html><p data-ai-x='1'>a{ZWSP}b</p><script>c{ZWSP}d</script>"), ("d.txt", "nothing"), ("e.txt", "a b"), ("f.txt", None)]


def test_clean_targets(spark):
    got = {r.target: r for r in cleaning.clean_targets(spark.createDataFrame(CASES, "path string, text string"), "path", "path", "text").collect()}
    assert {k: r.cleaned for k, r in got.items()} == {"a.txt": "ABC", "b.md": "---\ntitle: y\n---\nb", "c.html": f"<html><p>ab</p><script>c{ZWSP}d</script>", "d.txt": "nothing", "e.txt": "a b"}
    assert {k: (r.before_count, r.after_count, r.removed_count, r.remaining_count, r.added_count, r.outcome) for k, r in got.items()} == {
        "a.txt": (2, 0, 2, 0, 0, "removed_verified"), "b.md": (2, 0, 2, 0, 0, "removed_verified"), "c.html": (3, 1, 2, 1, 0, "not_removed"), "d.txt": (0, 0, 0, 0, 0, "no_safe_change"), "e.txt": (1, 1, 0, 1, 0, "no_safe_change"),
    }


def test_clean_run_publishes_all_or_nothing(spark, tmp_path):
    df, path = spark.createDataFrame(CASES, "path string, text string"), str(tmp_path / "out")
    assert manifest.published(spark, path) is None
    cleaning.clean_run(df, "path", "path", "text", path, "r1")
    first = sorted(manifest.published(spark, path).collect())
    cleaning.clean_run(df, "path", "path", "text", path, "r1")  # the same run again
    assert sorted(manifest.published(spark, path).collect()) == first and len(first) == 5
    df.limit(2).write.parquet(f"{path}/runs/r2")  # a try that was lost before its manifest
    assert sorted(manifest.published(spark, path).collect()) == first
    cleaning.clean_run(df.limit(2), "path", "path", "text", path, "r2")
    assert manifest.published(spark, path).count() == 2
    unsteady = df.withColumn("text", F.udf(lambda: os.urandom(8).hex())())
    with pytest.raises(manifest.NotPublished):
        manifest.publish(unsteady, path, "r3")
    assert manifest.published(spark, path).count() == 2


def test_retarget(spark):
    report = spark.createDataFrame([("tmp/a.md",), ("tmp/a.md#data-uri-1",), ("x/tmp/a.md",), (None,)], "target string")
    assert [r.target for r in cleaning.retarget(report, "tmp/a.md", "out/a-cleaned.md").collect()] == ["out/a-cleaned.md", "out/a-cleaned.md#data-uri-1", "x/tmp/a.md", None]


# Manifests and reports.


def test_digest_is_that_of_the_multiset(spark):
    rows = [(k % 3, k, f"t{k % 5}" if k % 7 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "g int, k long, t string")
    digest = lambda d: tuple(manifest.multiset_digest(d).first())
    assert digest(df) == digest(df.repartition(9).orderBy(F.desc("k")))
    for other in (rows[1:], [*rows, rows[0]], [*rows, rows[0], rows[0]], [(0, 0, "x"), *rows[1:]], [(0, 0, ""), *rows[1:]]):
        assert digest(spark.createDataFrame(other, df.schema)) != digest(df)
    parts = manifest.multiset_digest(df, ["g"], ["g", "k", "t"])
    assert tuple(manifest.merged(parts).first()) == tuple(manifest.multiset_digest(df, cols=["g", "k", "t"]).first())
    changed = df.withColumn("t", F.when(F.col("k") == 4, "new").otherwise(F.col("t"))).filter("g <> 2").unionByName(spark.createDataFrame([(9, 1, "a")], df.schema))
    diff = manifest.same_rows(parts, manifest.multiset_digest(changed, ["g"], ["g", "k", "t"]), ["g"])
    assert sorted(map(tuple, diff.collect())) == [(1, "changed"), (2, "only_first"), (9, "only_second")]
    assert tuple(manifest.multiset_digest(df.limit(0)).first()) == (0, 0, 0)


def test_report_lines_find_once(spark):
    """The findings behind a report are worked out once: the rows' plan holds none of it."""
    found = spark.range(5).select(F.lit("r").alias("run_id"), F.regexp_replace(F.col("id").cast("string"), "1", "x").alias("target"), F.lit("x").alias("rule_id"), F.lit("probable").alias("confidence"), F.lit(None).cast("string").alias("code_point"), F.lit(1).cast("long").alias("count"))
    lines = reports.markdown_lines(found)
    assert "regexp_replace(cast(id" not in lines._jdf.queryExecution().optimizedPlan().toString() and lines.count() == 9


def test_report_lines(spark):
    rows = [("r1", "b|c", "x", "probable", None, None), ("r1", "a", "y", "confirmed", "U+200B", 3), ("r2", "a", "z", "informational", None, 1)]
    df = spark.createDataFrame(rows, "run_id string, target string, rule_id string, confidence string, code_point string, count long")
    whole = {r.run_id: r.report for r in reports.markdown(df).collect()}
    got = {}
    for r in sorted(reports.markdown_lines(df).collect(), key=lambda r: (r.run_id, r.line)):
        got.setdefault(r.run_id, []).append(r.text)
    assert {k: "\n".join(v) + "\n" for k, v in got.items()} == whole


# Addresses.

SPELLINGS = ["::ffff:171.205.10.255", "250.171.0.9", "::", "::1", "1::", "2001:DB8::A", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8::", "12345::", "g::", "::ffff:1.2.3.4", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::ffff:1.2.3.256", "::ffff:01.2.3.4", "1.2.3.4", "1.2.3", "01.2.3.4", "1.2.3.4.5", "", " ::1", "[::1]", "2000::", "3fff:ffff::", "4000::", "2001:1ff::", "2001:200::", "2002::1", "3ffe::1", "2001:db8::1", "2001:db9::1", "64:ff9b::1", ":::", ":", "::ffff:0:0", "0:0:0:0:0:ffff:a00:1"]


def number(text):
    try:
        n = ipaddress.ip_address(text)
    except ValueError:
        return None
    return None if "%" in text else int(n) + (0 if n.version == 6 else 0xFFFF << 32)


def test_addresses_are_read_as_by_the_standard_library(spark):
    dice = random.Random(8)
    some = [str(ipaddress.IPv6Address(dice.getrandbits(128) & ~(((1 << 16 * dice.randrange(0, 7)) - 1) << 16 * dice.randrange(0, 4)))) for _ in range(200)]
    some += [x.upper() for x in some[:50]] + [ipaddress.IPv6Address(x).exploded for x in some[:50]] + SPELLINGS
    rows = spark.createDataFrame([(x,) for x in some], "a string").select("a", network.address_hex(F.col("a")).alias("d"), network.canonical(network.address_hex(F.col("a"))).alias("c"), network.is_loopback(F.col("a")).alias("l")).collect()
    for r in rows:
        n = number(r.a)
        assert r.d == (None if n is None else f"{n:032x}"), r.a
        if n is not None:
            mapped = n >> 32 == 0xFFFF
            assert r.c == str(ipaddress.IPv4Address(n & 0xFFFFFFFF) if mapped else ipaddress.IPv6Address(n)), r.a
        assert r.l == (r.a in ("::1",) or n == 1)


def test_global_unicast(spark):
    nets4, nets6 = [ipaddress.ip_network(f"{n}/{b}") for n, b in network.SPECIAL_IPV4], [ipaddress.ip_network(f"{n}/{b}") for n, b in network.SPECIAL_IPV6]
    dice = random.Random(3)
    some = SPELLINGS + [str(n.network_address + d) for n in nets4 for d in (0, n.num_addresses - 1)] + [str(n.network_address + d) for n in nets6 for d in (0, n.num_addresses - 1)] + [str(ipaddress.IPv4Address(dice.getrandbits(32))) for _ in range(100)] + ["8.8.8.8", "2a00:1450::1", "192.31.197.0", "1fff:ffff::", "3fff::"]
    for r in spark.createDataFrame([(x,) for x in some], "a string").select("a", network.is_global(F.col("a")).alias("g")).collect():
        n = number(r.a)
        if n is None:
            want = False
        elif ":" in r.a:
            a = ipaddress.IPv6Address(n)
            want = a in ipaddress.ip_network("2000::/3") and not any(a in x for x in nets6)
        else:
            want = not any(ipaddress.ip_address(r.a) in x for x in nets4)
        assert r.g == want, r.a


def test_longest_prefix(spark):
    dice = random.Random(4)
    nets = {(str(ipaddress.ip_network((dice.getrandbits(32) >> 28 << 28, b), strict=False).network_address), b) for b in (0, 1, 2, 3, 4, 8) for _ in range(4)}
    nets |= {(str(ipaddress.ip_network((dice.getrandbits(3) << 125 | dice.getrandbits(2) << 62, b), strict=False).network_address), b) for b in (0, 3, 64, 65, 66, 127, 128) for _ in range(4)} | {("::", 0), ("0.0.0.0", 0)}
    table = [(n, b, f"{n}/{b}") for n, b in sorted(nets)] + [("broken", 3, "x"), ("::", 129, "y"), (None, 3, "z")]
    some = [str(ipaddress.IPv4Address(dice.getrandbits(32))) for _ in range(60)] + [str(ipaddress.IPv6Address(dice.getrandbits(3) << 125 | dice.getrandbits(2) << 62 | dice.getrandbits(1))) for _ in range(60)] + ["none", None]
    got = network.longest_prefix(spark.createDataFrame([(k, a) for k, a in enumerate(some)], "k int, a string"), "a", spark.createDataFrame(table, "network string, bits int, label string")).collect()
    spaces = [(n, b, (number(n) >> (128 - (b if ":" in n else 96 + b))), b if ":" in n else 96 + b) for n, b in nets]
    assert len(got) == len(some)
    for r in got:
        n = number(r.a) if r.a else None
        fits = [(total, f"{net}/{b}") for net, b, first, total in spaces if n is not None and n >> (128 - total) == first]
        longest = max((t for t, _ in fits), default=None)
        assert r.label == min((label for t, label in fits if t == longest), default=None), r.a


# Remote records.


def walked(text):
    def no_twins(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    try:
        stack = [(json.loads(text, object_pairs_hook=no_twins), 1)]
    except (ValueError, TypeError):
        return None, None
    most = n = 0
    while stack:
        v, d = stack.pop()
        most, n = max(most, d), n + 1
        stack += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
    return most, n


def test_json_complexity(spark):
    dice = random.Random(5)

    def made(d):
        k = dice.randrange(7 if d < 6 else 5)
        if k < 5:
            return [1, -2.5e3, "a [ \" \\ { : , s", None, True][k]
        return [made(d + 1) for _ in range(dice.randrange(4))] if k == 5 else {f'k"{j}[': made(d + 1) for j in range(dice.randrange(4))}

    some = [json.dumps(made(0), indent=dice.choice([None, 1])) for _ in range(150)]
    some += [None, "", "{", "[1,]", '"a', "[" * 40 + "]" * 40, '{"a":1,"a":2}', "nul", '"s":1', "[]", "{}", "{} {}", "1,", "1]", "{}:1", "[1]]", " 7 ", '{"s":"s"}', "[" + "1," * 60 + "1]"]
    df = spark.createDataFrame(list(enumerate(some)), "k int, js string")
    for r in records.json_complexity(df, "k", "js", depth=8, nodes=50).collect():
        depth, nodes = walked(some[r.k])
        error = "malformed" if depth is None else "too_deep" if depth > 8 else "too_many" if nodes > 50 else None
        assert (r.depth, r.nodes, r.error) == (depth, nodes, error), some[r.k]


HIT = {"codepoint": "U+200B", "label": "z", "count": 1, "kind": "strip", "confidence": "probable", "sample_offsets": [0, 4]}


@pytest.mark.parametrize("change, error", [
    ({}, None), ({"count": 2.0}, None), ({"sample_offsets": []}, None), ({"codepoint": "u+1F600"}, None), ({"extra": 1}, "keys"), ({"label": ...}, "keys"), ({"codepoint": "200B"}, "codepoint"), ({"codepoint": 5}, "codepoint"), ({"label": ""}, "label"), ({"label": None}, "label"),
    ({"count": 0}, "count"), ({"count": 1.5}, "count"), ({"count": "1"}, "count"), ({"count": None}, "count"), ({"kind": "other"}, "kind"), ({"confidence": "confirmed"}, "confidence"), ({"sample_offsets": [5]}, "offsets"), ({"sample_offsets": [-1]}, "offsets"), ({"sample_offsets": {"0": 1}}, "offsets"), ({"sample_offsets": ["1"]}, "offsets"),
])
def test_hits(spark, change, error):
    hit = {k: v for k, v in {**HIT, **change}.items() if v is not ...}
    got = spark.createDataFrame([(json.dumps(hit),)], "h string").select(records.hit_error(F.parse_json("h"), F.lit(5)).alias("e")).first().e
    assert got == error


def test_records_are_normalised(spark):
    rows = [
        (1, json.dumps({"has_c2pa": True, "has_ai_metadata": True, "hits": [HIT], "layer_a_hits": [{**HIT, "kind": "zwj_family", "sample_offsets": []}], "findings": ["free"], "stylometry": {}})), (2, json.dumps({"has_c2pa": "yes", "hits": [HIT, {**HIT, "count": 0}]})),
        (3, "[]"), (4, "{"), (5, None), (6, "{}"),
    ]
    df = spark.createDataFrame(rows, "id long, js string").select("id", F.try_parse_json("js").alias("r"), F.lit(9).alias("n"))
    got = sorted((r.id, r.error or "", r.rule_id or "", r.code_point or "", -1 if r.offset is None else r.offset, r.ignored) for r in records.provider_findings(df, "id", "r", "n").collect())
    told = "provider-freeform,stylometry"
    assert got == [(1, "", "provider.c2pa.present", "", -1, told), (1, "", "provider.metadata.ai_present", "", -1, told), (1, "", "provider.unicode.strip", "U+200B", 0, told), (1, "", "provider.unicode.zwj_family", "U+200B", -1, told), (2, "count", "", "", -1, ""), (3, "record", "", "", -1, ""), (4, "record", "", "", -1, ""), (5, "record", "", "", -1, "")]


def test_counts_of_records(spark):
    one = lambda js, f: spark.createDataFrame([(js,)], "js string").select(f(F.parse_json("js")).alias("x")).first().x
    assert [one(js, records.sum_counts) for js in ('{"a":1,"b":2}', "{}", '{"a":-1}', '{"a":1.5}', '{"a":"1"}', "[1]", '{"":1}')] == [3, 0, None, None, None, None, None]
    assert [one(js, lambda v: records.has_only_keys(v, ["a", "b"])) for js in ('{"a":1}', '{"a":1,"c":2}', "{}", "[]")] == [True, False, True, False]
    assert [one(js, records.is_string_array) for js in ('["a"]', '["a",""]', '["a",1]', "{}", "[]")] == [True, False, False, False, True]


def capabilities(**change):
    return {"ok": True, "version": "v0.5.0", "tools": {"c2patool": True, "exiftool": False, "qpdf": True}, "pixel_backends": {"ctrlregen": False, "diffusion": False}, "scorers": {"synthid": False, "stylometry": True}, "harnesses": {"markllm": False}, **change}


@pytest.mark.parametrize("health, change, error", [
    ({}, {}, None), ({"ok": False}, {}, "provider_health_invalid"), ({"version": " "}, {}, "provider_health_invalid"), ({"version": "0.4.0"}, {"version": "0.4.0"}, "provider_capabilities_invalid"), ({}, {"version": "0.5.0"}, "provider_capabilities_invalid"), ({}, {"tools": {"c2patool": 1}}, "provider_capabilities_invalid"),
    ({}, {"operations": ["inspect"]}, None), ({}, {"operations": ["burn"]}, "provider_capabilities_invalid"), ({}, {"formats": ["png", 3]}, "provider_capabilities_invalid"), ({}, {"limits": {"max_concurrency": 2, "max_input_bytes": None}}, None), ({}, {"limits": {"max_concurrency": 0}}, "provider_capabilities_invalid"), ({}, {"limits": []}, "provider_capabilities_invalid"),
])
def test_capabilities(spark, health, change, error):
    row = spark.createDataFrame([(json.dumps({"ok": True, "version": "v0.5.0", **health}), json.dumps(capabilities(**change)))], "h string, c string")
    assert row.select(records.capability_error(F.parse_json("h"), F.parse_json("c")).alias("e")).first().e == error
    if error is None:
        wanted = row.select(records.not_offered(F.parse_json("c"), F.lit("clean"), F.lit("png")).alias("e")).first().e
        assert wanted == ("provider_operation_unsupported" if "operations" in change else None)


# Intervals and units.


def test_overlaps(spark):
    from quillspark.operators import intervals

    dice = random.Random(11)
    rows = [(dice.choice(["hot", "hot", "cold", None]), k, (a := dice.randrange(400)), dice.choice([a, a + dice.randrange(8), a + dice.randrange(8), a - 3, None])) for k in range(300)] + [("t", 900, 0, 5), ("t", 901, 5, 9), ("u", 902, 0, 5), ("u", 903, 0, 5), ("v", 904, 0, 1000), ("v", 905, 999, 1001), (None, 906, None, 4)]
    df = spark.createDataFrame(rows, "g string, k long, s long, e long").repartition(5)
    got = {r.k: r.overlaps for r in intervals.overlapping(df, ["g"], "s", "e", ranges=9).collect()}
    real = lambda r: r[2] is not None and r[3] is not None and r[2] < r[3]
    for r in rows:
        assert got[r[1]] == any(real(r) and real(o) and o[1] != r[1] and o[0] == r[0] and r[2] < o[3] and o[2] < r[3] for o in rows), r
    assert 40 < sum(got.values()) < 250


def test_units_are_renumbered(spark):
    from quillspark.operators import assembly

    df = spark.createDataFrame([("a", k, f"t{k}") for k in range(1, 7)] + [("b", 1, "x"), (None, 2, "y"), (None, 3, "z")], "part string, pos long, text string")
    own = lambda d: {r.pos: r.new_pos for r in d.filter("part = 'a'").collect()}
    assert own(assembly.insert_units(df, "pos", 3, 2)) == {1: 1, 2: 2, 3: 5, 4: 6, 5: 7, 6: 8}
    assert own(assembly.remove_units(df, "pos", 2, 3)) == {1: 1, 2: None, 3: None, 4: 2, 5: 3, 6: 4}
    merged = sorted((r.part or "-", r.new_pos, r.text, r.merged) for r in assembly.merge_units(df, "part", "pos", 2, rule="|").collect())
    assert merged == [("-", 2, "y|z", True), ("a", 1, "t1", False), ("a", 2, "t2|t3", True), ("a", 3, "t4", False), ("a", 4, "t5", False), ("a", 5, "t6", False), ("b", 1, "x", False)]


def test_runs_and_seams_cross_ranges(spark):
    from quillspark.operators import manuscript

    dice = random.Random(12)
    rows = [("hot", k, dice.choice("aab")) for k in range(200)] + [("one", 1, "a"), (None, 1, None), (None, 2, None), (None, 3, None)]
    df = spark.createDataFrame(rows, "part string, place long, v string").repartition(4)
    want = []
    for part in ("hot", "one", None):
        own, run = [r for r in rows if r[0] == part], []
        for r in [*own, None]:
            if run and (r is None or r[2] != run[0][2]):
                if len(run) >= 3:
                    want.append((str(part), str(run[0][2]), run[0][1], run[-1][1], len(run)))
                run = []
            run.append(r)
    got = sorted((str(r.part), str(r.v), r.first, r["last"], r.length) for r in manuscript.runs(df, ["part"], ["place"], "v").collect())
    assert got == sorted(want)
    tails = {(r.part, r.place): (r["tail"], r.tail_words) for r in manuscript.tail_words(df.withColumn("text", F.concat(F.lit("x y "), "place")), "part", "place", n=2).collect()}
    assert tails["hot", 0][0] is None or tails["hot", 0][0] == ""
    assert all(tails["hot", k] == (f"y {k - 1}", 2) for k in range(1, 200))


def test_phrases_are_met_by_their_first_word(spark):
    from quillspark.operators import manuscript

    dice, words = random.Random(13), ["the", "of", "cat", "it's", "größe"]
    texts = [(k, " ".join(dice.choice(words) for _ in range(40)).replace("cat", "Cat,")) for k in range(20)] + [(20, None), (21, "")]
    phrases = [(c, " ".join(dice.choice(words) for _ in range(dice.randrange(1, 4)))) for c in "xyz" for _ in range(12)] + [("x", "  "), ("y", None)]
    got = {(r.doc_id, r.category): (r.hits, r.phrases) for r in manuscript.phrase_hits(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(phrases, "category string, phrase string")).collect()}
    want = {}
    for d, t in texts:
        own = (t or "").lower().replace(",", "").split()
        for c in "xyz":
            n = [sum(own[k : k + len(p)] == list(p) for k in range(len(own))) for p in {tuple(p.split()) for x, p in phrases if x == c and p and p.strip()}]
            if any(n):
                want[d, c] = (sum(n), sum(map(bool, n)))
    assert got == want and len(want) > 40


# Progress and review tables.


def test_saves_themes_and_settings(spark):
    from quillspark.operators import progress

    messages = ["Saved after drafting chapter 3", "Saved after editor review of chapter 2", "Saved work in progress on x", "Saved: my words", "Initial save of Book", "Merge track a", "Saved oddly", "Proposal: saved"]
    log = spark.createDataFrame([("p", k, m) for k, m in enumerate(messages)], "p string, at long, m string")
    assert [r.action for r in progress.save_history(log, "p", ["at"], "m").orderBy("n").collect()] == ["Saved oddly", "Started Book", "my words", "Work in progress on x", "Reviewed chapter 2", "Drafted chapter 3"]
    assert [r.at for r in progress.save_history(log, "p", ["at"], "m", 2).orderBy("n").collect()] == [6, 4]
    themes = spark.createDataFrame([("a", t) for t in ("x", "y", "z", "w")], "part string, theme string")
    units = spark.createDataFrame([("a", k) for k in range(7)], "part string, unit long")
    mentions = spark.createDataFrame([("a", k, "x") for k in range(5)] + [("a", 0, "x"), ("a", 0, "y"), ("a", 1, "y"), ("a", 2, "z"), ("a", 6, "other")], "part string, unit long, theme string")
    strength, bare = progress.theme_strength(themes, units, mentions, "part")
    assert {r.theme: (r.units, r.strength) for r in strength.collect()} == {"x": (5, "strong"), "y": (2, "moderate"), "z": (1, "emerging"), "w": (0, "dormant")}
    assert sorted(r.unit for r in bare.collect()) == [5, 6]
    made = lambda js: spark.createDataFrame([(js,)], "js string").select(progress.migrate_settings(F.col("js")).alias("m")).first().m
    assert made('{"runtime":"r","x":[1]}') == {"runtime": '"r"', "x": "[1]", "runtimes": '["r"]', "scope": '"global"', "install_mode": '"interactive"', "profile": '"full"'}
    assert made("[]") is None and made(None) is None and made("{}")["runtimes"] == "[]"


def test_positions_ages_and_glossaries(spark):
    from quillspark.operators import progress

    df = spark.createDataFrame([(1, True, False), (2, True, True), (3, None, True)], "k long, a boolean, b boolean")
    done = {s: F.col("a") if k % 2 else F.col("b") for k, s in enumerate(progress.STAGES)}
    got = {r.k: (r["index"], r.stage) for r in progress.pipeline_position(df, "k", done).collect()}
    assert got == {1: (1, "seed"), 2: (None, None), 3: (2, "voice")}
    untranslated = {**{s: F.lit(True) for s in progress.STAGES}, "translate": F.lit(False)}
    assert progress.pipeline_position(df, "k", untranslated, translated=False).first()["index"] is None
    people = spark.createDataFrame([("p", "2000-06-15"), ("q", "2000-02-29")], "who string, born string").withColumn("born", F.to_date("born"))
    told = spark.createDataFrame([("p", "2030-06-14", 29), ("p", "2030-06-15", 29), ("q", "2001-02-28", 1), ("p", "1999-01-01", -2), ("x", "2000-01-01", 5)], "who string, at string, age long").withColumn("at", F.to_date("at"))
    assert sorted((str(r["at"]), r.expected) for r in progress.age_conflicts(told, people, "who", "at", "age", "born").collect()) == [("1999-01-01", -2), ("2030-06-15", 30)]
    terms = spark.createDataFrame([("a", "x"), ("a ", "y"), ("b", "x"), ("b", "x"), ("c", None), ("d", " "), ("d", "z")], "t string, x string")
    assert sorted((r.term, r.kind, r.translations) for r in progress.conflicting_terms(terms, "t", "x").collect()) == [("a", "several", ["x", "y"]), ("c", "untranslated", [])]
    refs = spark.createDataFrame([("/cmd:a:b", "own", None), ("/cmd:a-b", None, "hint"), ("/cmd:c-d", "", None)], "ref string, description string, hint string")
    listed, clashes = progress.inventory(refs, spark.createDataFrame([("a-b", "cat", "known")], "key string, category string, description string"))
    assert sorted(tuple(r)[:4] for r in listed.collect()) == [("/cmd:a-b", "a-b", "cat", "known"), ("/cmd:a:b", "a-b", "cat", "own"), ("/cmd:c-d", "c-d", "uncategorized", "c d")]
    assert [(r.skill, r.refs) for r in clashes.collect()] == [("a-b", 2)]


# Sources.


@pytest.mark.parametrize("folder", ["data", "da.ta+x", "data/data"])
def test_trees_are_cut_at_their_root(spark, tmp_path, folder):
    from quillspark.sources import files

    root = tmp_path / "data" / folder
    for name in ("a.md", "data/b.TXT", ".git/c", f"sub/{folder}/d"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"text of {name}")
    for given in (str(root), f"{root}/", f"file://{root}"):
        assert sorted(r.rel_path for r in files.read_tree(spark, given).collect()) == sorted(["a.md", "data/b.TXT", f"sub/{folder}/d"])
    tree = files.read_tree(spark, str(root))
    walked = collect.collect(collect.listing(tree.select("rel_path", "length"), "root"))
    assert walked[0].count() == 3 and tuple(walked[2].first())[0] == 3
    with pytest.raises(ValueError, match="no scope"):
        files.in_scope(tree, "odd")


def test_target_kinds_and_texts(spark):
    from quillspark.sources import files

    kinds = spark.createDataFrame([(t,) for t in ("https://x", "HTTP://y", "s3://z", "mailto:a", "/local", "c/d", None)], "t string").select(files.target_kind(F.col("t")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["remote_unsupported", "remote_unsupported", "scheme_unsupported", "scheme_unsupported", "local", "local", "local"]
    df = spark.createDataFrame([(bytearray("ü".encode()),), (bytearray(b"\xff"),), (bytearray(b"a\0b"),), (None,)], "content binary")
    assert [r.text for r in files.texts(df).collect()] == ["ü", None, None, None]


def test_inventories_of_commands(spark):
    from quillspark.sources import files

    rows = [("commands/a.md", "---\ndescription: 'first one'\n---\nbody"), ("commands/x/b.md", "no front matter"), ("commands/c.txt", "---\ndescription: z\n---\n"), ("other/d.md", "---\ndescription: z\n---\n")]
    found = files.command_inventory(spark.createDataFrame(rows, "rel_path string, text string")).collect()
    assert sorted((r.ref, r.description) for r in found) == [("a", "first one"), ("x:b", None)]
    profiles = spark.createDataFrame([(p,) for p in ("profiles/one/manifest.yaml", "profiles/Two/manifest.yml", "profiles/three/other.yml", "profiles/one/manifest.yml")], "rel_path string")
    assert [r.name for r in files.profile_listing(profiles, "profiles").collect()] == ["one"]


def test_voice_fixtures_are_read(spark, tmp_path):
    from quillspark.sources import files

    made = {"version": 1, "fixtures": [{"id": "f", "sample": "s.md", "expected_pass": True, "min_markers": 1, "max_forbidden": 0, "required_markers": ["a"], "forbidden_patterns": []}]}
    (tmp_path / "fixtures.json").write_text(json.dumps(made, indent=1))
    row = files.read_fixtures(spark, str(tmp_path / "fixtures.json")).first()
    assert (row.id, row.expected_pass, row.required_markers) == ("f", True, ["a"])


def test_small_operators_that_no_query_calls(spark):
    from quillspark.operators import assembly, drift, guidance, manuscript, metadata, registry

    merged = registry.merge_settings(spark.createDataFrame([("k", "old", "mine", "kept")], "key string, a string, b string, d string"), spark.createDataFrame([("k", "new", "theirs", "c")], "key string, a string, b string, c string"), "key", ["a"])
    assert tuple(merged.select("key", "a", "b", "c", "d").first()) == ("k", "new", "mine", "c", "kept")
    text = spark.createDataFrame([("body  ",), ("x\nNext commands:\n",)], "t string").select(registry.next_commands_contract(F.col("t")).alias("t"))
    assert [r.t for r in text.collect()] == ["body\n\nNext commands:\n", "x\nNext commands:\n"]
    counts = spark.createDataFrame([("a", 3), ("b", 1)], "term string, n int")
    assert [r.term for r in translation.glossary_gaps(counts, spark.createDataFrame([("a",), ("a",)], "term string")).collect()] == ["b"]
    elements = spark.createDataFrame([("x", "minimum"), ("y", "balanced"), ("z", "maximum")], "name string, min_level string")
    assert [r.name for r in assembly.eligible_matter(elements, "balanced").collect()] == ["x", "y"]
    sessions = spark.createDataFrame([("p", 0, "2024-01-01", "2024-01-02"), ("p", 1, "2024-01-09", "2024-01-09"), ("p", 2, "2024-01-20", "2024-01-21")], "part string, session long, started string, ended string").select("part", "session", F.to_timestamp("started").alias("started"), F.to_timestamp("ended").alias("ended"))
    assert [(r.session, r.days) for r in drift.session_gaps(sessions, "part").collect()] == [(2, 11)]
    tracks = spark.createDataFrame([("One", "active", 2, 3), ("one", "merged", 2, 3), ("two", "active", 1, 1)], "label string, status string, ahead int, behind int")
    assert sorted((r.status, r.ahead) for r in guidance.track_lookup(tracks, "ONE").collect()) == [("active", 2), ("merged", None)]
    said = spark.createDataFrame([(1, '“Hello,” she said.\nplain\n"Yes."')], "doc_id long, text string")
    assert [(r.dialogue, r.attributed) for r in manuscript.dialogue_lines(said).orderBy("n").collect()] == [(True, True), (False, False), (True, False)]
    svg = spark.createDataFrame([(1, "<svg><metadata>\n<dc:creator>me</dc:creator></metadata></svg>")], "page_id long, svg string")
    assert [(r.line, r.rule_id) for r in metadata.svg_metadata(svg).collect()] == [(2, "metadata.generator")]
    places = spark.createDataFrame([(1, 2, 3, None, None, None)], "line int, column int, offset int, member string, segment string, tool string").select(reports.location_text(F.struct("*")).alias("t"))
    assert places.first().t == "line 1, column 2, offset 3"
    diff = spark.createDataFrame([("t", "r", "probable", "U+1", 2, 0, 1)], "target string, rule_id string, confidence string, code_point string, removed int, remaining int, added int")
    assert reports.compared_lines(diff, "target").first().section == "added r probable U+1 x1\nremoved r probable U+1 x2"


def test_phrases_meet_by_their_first_words(spark):
    """Phrases of one to six words, repeated and overlapping, at ends of texts; phrases of one first word don't all meet its places."""
    dice = random.Random(5)
    texts = [(k, " ".join(dice.choice(["the", "a", "cat", "sat", "Mat"]) for _ in range(dice.randrange(0, 40)))) for k in range(40)] + [(40, None), (41, "a"), (42, "the cat")]
    listed = sorted({(str(dice.randrange(2)), " ".join(dice.choice(["the", "a", "cat", "sat", "mat"]) for _ in range(n))) for n in range(1, 7) for _ in range(25)})
    found = manuscript.phrase_hits(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(listed, "category string, phrase string"))
    want = {}
    for k, t in texts:
        w = (t or "").lower().split()
        for c, p in listed:
            n = sum(w[i : i + len(p.split())] == p.split() for i in range(len(w)))
            if n:
                a = want.get((k, c), (0, 0))
                want[k, c] = (a[0] + n, a[1] + 1)
    assert {(r.doc_id, r.category): (r.hits, r.phrases) for r in found.collect()} == want
    assert "xxhash64(slice(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_recurring_phrases_sort_in_sparks_own_order(spark):
    dice = random.Random(8)
    texts = [(k, " ".join(dice.choice(["The", "a", "ä", "cat"]) for _ in range(dice.randrange(0, 30)))) for k in range(30)] + [(30, None), (31, " a  a a a "), (32, "")]
    found = manuscript.recurring_phrases(spark.createDataFrame(texts, "doc_id long, text string"), least=4)
    held = [[" ".join(w[i : i + 3]) for i in range(len(w) - 2)] for w in ((t or "").lower().split() for _, t in texts)]
    want = {p: (sum(h.count(p) for h in held), sum(p in h for h in held)) for h in held for p in h}
    assert {r.phrase: (r.occurrences, r.docs) for r in found.collect()} == {p: x for p, x in want.items() if x[0] >= 4}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan


def test_writing_policy_is_one_class(spark):
    df = spark.createDataFrame([(1, "a — b – –\n\u00a9 é\u203c x\n\U0001f600\U0001f600"), (2, "é plain ‐"), (3, None)], "doc_id long, text string")
    found = hidden.writing_policy(df)
    assert sorted((r.doc_id, r.line, r.code_point, r["count"]) for r in found.collect()) == [(1, 1, "U+2013", 2), (1, 1, "U+2014", 1), (1, 2, "U+00A9", 1), (1, 2, "U+203C", 1), (1, 3, "U+1F600", 2)]
    assert "]|[" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_addresses_are_read_once(spark):
    """The query's plan holds each pattern of an address once for the events, however many columns come from it."""
    from quillspark.plans import drivers

    plan = drivers.ip_networks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    reads = [line for line in plan.splitlines() if "substring_index" in line and "_d#" not in line]
    assert len(reads) == 1 and reads[0].count("substring_index") == 1
