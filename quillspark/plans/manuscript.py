"""Queries of manuscript statistics, pacing, style and phrases, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import manuscript as m


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def _stats(spark, sf):
    return m.doc_stats(_docs(spark, sf), keep=("source", "lang"))


def doc_stats(spark, sf):
    return _stats(spark, sf)


def doc_stats_rollup(spark, sf):
    return m.rollup_totals(_stats(spark, sf), ["source", "lang"])


def length_outliers(spark, sf):
    return m.length_outliers(_stats(spark, sf), "source")


def middle_band(spark, sf):
    return m.middle_band(_stats(spark, sf).select("source", "doc_id", "words"), "source", "doc_id")


def tempo_runs(spark, sf):
    tempo = F.when(F.col("words") < 150, "fast").when(F.col("words") < 600, "even").otherwise("slow")
    return m.runs(_stats(spark, sf).withColumn("tempo", tempo), ["source"], ["doc_id"], "tempo")


def whiplash(spark, sf):
    """Adjacent units of high intensity."""
    return m.adjacent(_stats(spark, sf), "source", "doc_id", F.col("words") > 900, ("doc_id", "next_doc"))


def seam_pairs(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    rate = lambda n: F.when(n >= 200, "strong").otherwise("weak")
    return m.seam_pairs(conv, "conv_id", "turn", rate(F.length("text")), rate(F.length("text") * 2))


def breathers(spark, sf):
    return m.breathers(_stats(spark, sf), "source", "doc_id", F.col("words") < 400)


def seam_runs(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    rate = lambda n: F.when(n >= 200, "strong").otherwise("weak")
    return m.seam_runs(conv.select((F.col("conv_id") % 7).alias("part"), (F.col("conv_id") * 1000 + F.col("turn")).alias("place"), "role", "text"), "part", "place", rate(F.length("text")), rate(F.length("text") * 2), F.substring("role", 1, 1))


def phrase_hits(spark, sf):
    """Neighbouring words of the benchmark, as phrases, in all documents."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}'-]+"), lambda w: w != "")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", words.alias("w")).filter(F.size("w") >= 3)
    pairs = items.select((F.col("item_id") % 3).cast("string").alias("category"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("phrase"))
    return m.phrase_hits(_docs(spark, sf), pairs)


def sentence_runs(spark, sf):
    return m.sentence_runs(_docs(spark, sf))


PHRASES = [("hedge", "the"), ("hedge", "of the"), ("filler", "and"), ("filler", "que"), ("vague", "thing")]


def lexical_density(spark, sf):
    return m.phrase_density(_docs(spark, sf), spark.createDataFrame(PHRASES, "category string, phrase string"))


def chunk_profile(spark, sf):
    return m.chunk_profile(_docs(spark, sf))


def style_measures(spark, sf):
    return m.style_measures(_docs(spark, sf))


def variant_forms(spark, sf):
    return m.variant_forms(_docs(spark, sf))


TRIMS = [("5x8", 250, 828), ("6x9", 300, 800), ("large", 180, 30)]


def page_estimate(spark, sf):
    return m.page_estimate(_stats(spark, sf), spark.createDataFrame(TRIMS, "trim string, words_per_page int, page_cap int"))


RANGES = [("flash", 0, 100), ("short", 100, 750), ("story", 750, 2000)]


def range_guidance(spark, sf):
    return m.range_guidance(_stats(spark, sf), spark.createDataFrame(RANGES, "kind string, low int, high int"))


def tail_words(spark, sf):
    found = m.tail_words(spark.read.parquet(f"{sf}/conversations.parquet"), "conv_id", "turn", n=20)
    return found.select("conv_id", "turn", F.coalesce("tail", F.lit("")).alias("tail"), F.greatest("tail_words", F.lit(0)).alias("tail_words"))


def recurring_phrases(spark, sf):
    return m.recurring_phrases(_docs(spark, sf), least=6)


TERMS = ["the", "und", "que", "les", "thing"]


def concordance(spark, sf):
    return m.concordance(_docs(spark, sf), TERMS)


FIXTURES = [("guided", ["the", "and", "of"], ["xxx", "idiot"], 2, 0), ("foreign", ["und", "que", "les"], ["the "], 1, 0)]


def voice_marker_score(spark, sf):
    fixtures = spark.createDataFrame(FIXTURES, "fixture_id string, required array<string>, forbidden array<string>, min_markers int, max_forbidden int")
    return m.voice_markers(_docs(spark, sf), fixtures)


def dialogue_runs(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    return m.runs(conv.withColumn("short", F.length("text") < 300), ["conv_id"], ["turn"], "short", 2)


def three_word_counts(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", tx.words_prose(t).cast("long").alias("prose"), tx.words_wc(t).cast("long").alias("wc"), tx.words_print(t).cast("long").alias("print_words"))


QUERIES = {f.__name__: f for f in (
    doc_stats, doc_stats_rollup, length_outliers, middle_band, tempo_runs, whiplash, seam_pairs, breathers, seam_runs, phrase_hits, sentence_runs, lexical_density, chunk_profile, style_measures, variant_forms,
    page_estimate, range_guidance, tail_words, recurring_phrases, concordance, voice_marker_score, dialogue_runs, three_word_counts,
)}

_WORDS = r"len(regexp_extract_all({}, '\S+'))"
_PROSE = r"coalesce(list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda ln: NOT regexp_matches(trim(ln), '^(---+|#+|)$')), lambda ln: len(regexp_extract_all(ln, '\S+')))), 0)::BIGINT"
_STATS = f"st AS (SELECT doc_id, source, lang, {_PROSE} AS words, {_WORDS.format('text')}::BIGINT AS words_wc, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents)"
_SENT = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(10)) <> '')"
_LENS = rf"list_transform({_SENT}, lambda s: len(regexp_extract_all(s, '\S+')))"


def _values(rows):
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


ORACLES = {
    "doc_stats": f"WITH {_STATS} SELECT doc_id, source, lang, words, words_wc, lines, ceil(words / 250.0)::BIGINT AS pages, ceil(words / 250.0)::BIGINT AS fast_minutes, ceil(words / 200.0)::BIGINT AS slow_minutes, (ceil(words / 200.0)::BIGINT // 60) || 'h ' || (ceil(words / 200.0)::BIGINT % 60) || 'm' AS slow_time FROM st",
    "doc_stats_rollup": f"WITH {_STATS} SELECT source, lang, count(*) AS units, sum(words)::BIGINT AS words, (grouping(source) + grouping(lang))::BIGINT AS level FROM st GROUP BY ROLLUP (source, lang)",
    "length_outliers": f"WITH {_STATS}, md AS (SELECT source, median(words)::DOUBLE AS median, round(avg(words), 4) AS mean FROM st GROUP BY source) SELECT source, doc_id, words, median, mean, CASE WHEN words > median * 1.5 THEN 'long' ELSE 'short' END AS kind FROM st JOIN md USING (source) WHERE words > median * 1.5 OR words < median * 0.5",
    "middle_band": f"WITH {_STATS}, c AS (SELECT source, doc_id, words, (sum(words) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto, (sum(words) OVER (PARTITION BY source))::BIGINT AS total FROM st) SELECT * FROM c WHERE upto >= 0.4::DOUBLE * total AND upto <= 0.6::DOUBLE * total",
    "tempo_runs": f"WITH {_STATS}, t AS (SELECT source, doc_id, CASE WHEN words < 150 THEN 'fast' WHEN words < 600 THEN 'even' ELSE 'slow' END AS tempo FROM st), g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - row_number() OVER (PARTITION BY source, tempo ORDER BY doc_id) AS g FROM t) SELECT source, tempo, min(doc_id) AS first, max(doc_id) AS last, count(*) AS length FROM g GROUP BY source, tempo, g HAVING count(*) >= 3",
    "whiplash": f"WITH {_STATS}, n AS (SELECT source, doc_id, words, lead(words) OVER w AS nw, lead(doc_id) OVER w AS next_doc FROM st WINDOW w AS (PARTITION BY source ORDER BY doc_id)) SELECT source, doc_id, next_doc FROM n WHERE words > 900 AND nw > 900",
    "breathers": f"WITH {_STATS}, t AS (SELECT source, doc_id, words < 400 AS calm FROM st), g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - row_number() OVER (PARTITION BY source, calm ORDER BY doc_id) AS g FROM t) SELECT source, min(doc_id) AS first, max(doc_id) AS last, count(*) AS length FROM g WHERE calm GROUP BY source, g HAVING count(*) >= 3",
    "seam_runs": """WITH r AS (SELECT conv_id % 7 AS part, conv_id * 1000 + turn AS place, CASE WHEN length(text) >= 200 THEN 'strong' ELSE 'weak' END AS o, CASE WHEN length(text) * 2 >= 200 THEN 'strong' ELSE 'weak' END AS c, role[1] AS d FROM conversations),
w AS (SELECT part, place, 'device' AS what, d AS value FROM r UNION ALL SELECT part, place, 'open', o FROM r UNION ALL SELECT part, place, 'close', c FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY part, what ORDER BY place) - row_number() OVER (PARTITION BY part, what, value ORDER BY place) AS g FROM w)
SELECT part, what, value, min(place) AS first, max(place) AS last, count(*) AS length FROM g WHERE value IS NOT NULL AND (what = 'device' OR value = 'weak') GROUP BY part, what, value, g HAVING count(*) >= 3""",
    "phrase_hits": r"""WITH i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}''-]+'), lambda w: w <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT (item_id % 3)::VARCHAR AS category, w[k : k + 2] AS p FROM i, unnest(range(1, len(w) - 1)) t(k) WHERE len(w) >= 3),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}''-]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, w[k : k + 2] AS p FROM d, unnest(range(1, len(w) - 1)) t(k))
SELECT doc_id, category, count(*) AS hits, count(DISTINCT p) AS phrases FROM g JOIN p USING (p) GROUP BY doc_id, category""",
    "seam_pairs": """WITH r AS (SELECT conv_id, turn, CASE WHEN length(text) >= 200 THEN 'strong' ELSE 'weak' END AS open, CASE WHEN length(text) * 2 >= 200 THEN 'strong' ELSE 'weak' END AS close FROM conversations),
p AS (SELECT conv_id, turn, close, lead(open) OVER w AS next_open, lead(turn) OVER w AS next FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT *, CASE WHEN close = 'strong' AND next_open = 'strong' THEN 'tight' WHEN close = 'weak' AND next_open = 'weak' THEN 'slack' WHEN close = 'weak' THEN 'weak_close' ELSE 'weak_open' END AS kind FROM p WHERE next_open IS NOT NULL""",
    "sentence_runs": f"""WITH s AS (SELECT doc_id, {_LENS} AS n FROM documents), e AS (SELECT doc_id, unnest(n) AS x, generate_subscripts(n, 1) AS i FROM s),
w AS (SELECT doc_id, x, lag(x) OVER o AS a, lag(x, 2) OVER o AS b FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE b IS NOT NULL AND greatest(x, a, b) - least(x, a, b) <= 0.15::DOUBLE * greatest(x, a, b)) AS similar_runs FROM w GROUP BY doc_id""",
    "lexical_density": f"""WITH p(category, phrase) AS (VALUES {_values(PHRASES)}), h AS (SELECT doc_id, category, sum((length(lower(text)) - length(replace(lower(text), phrase, ''))) // length(phrase))::BIGINT AS hits, any_value({_WORDS.format("text")})::BIGINT AS words FROM documents, p GROUP BY ALL)
SELECT *, round(hits * 1000 / words, 4) AS per_1000 FROM h WHERE hits > 0""",
    "chunk_profile": r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents WHERE len(regexp_extract_all(text, '\S+')) >= 360),
e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i, len(w) AS n FROM w),
c AS (SELECT doc_id, (i // 120)::BIGINT AS chunk, sum(length(x)) / 120 AS ml FROM e WHERE i // 120 < n // 120 GROUP BY ALL),
z AS (SELECT *, CASE WHEN stddev_pop(ml) OVER o > 0 THEN round((ml - avg(ml) OVER o) / (stddev_pop(ml) OVER o), 3) ELSE 0 END AS z FROM c WINDOW o AS (PARTITION BY doc_id))
SELECT doc_id, chunk, round(ml, 4) AS mean_length, z FROM z WHERE abs(z) > 2""",
    "style_measures": rf"""WITH s AS (SELECT doc_id, {_LENS} AS n, regexp_extract_all(lower(text), '\S+') AS w FROM documents)
SELECT doc_id, len(w)::BIGINT AS words, len(n)::BIGINT AS sentences, round(list_stddev_pop(n) / list_avg(n), 4) AS burstiness, round(len(list_distinct(w)) / len(w), 4) AS diversity FROM s WHERE len(n) > 0""",
    "variant_forms": r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '\p{L}[\p{L}-]*\p{L}')) AS form FROM documents), c AS (SELECT form, count(*) AS n FROM t GROUP BY form)
SELECT replace(lower(form), '-', '') AS key, count(*) AS forms, sum(n)::BIGINT AS total, arg_max(form, (n, form)) AS chosen FROM c GROUP BY 1 HAVING count(*) > 1""",
    "page_estimate": f"WITH {_STATS}, p(trim, wpp, cap) AS (VALUES {_values(TRIMS)}) SELECT doc_id, trim, words, floor(words / wpp + 0.5)::BIGINT AS pages, CASE WHEN floor(words / wpp + 0.5) > cap THEN 'block' WHEN floor(words / wpp + 0.5) > 0.9 * cap THEN 'warn' ELSE 'ok' END AS verdict FROM st, p",
    "range_guidance": f"WITH {_STATS}, p(kind, low, high) AS (VALUES {_values(RANGES)}) SELECT doc_id, words, coalesce(kind, 'outside') AS kind FROM st LEFT JOIN p ON words >= low AND words < high",
    "tail_words": r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '\S+') AS w FROM conversations)
SELECT conv_id, turn, array_to_string(w[-20:], ' ') AS tail, least(20, len(w))::BIGINT AS tail_words FROM t""",
    "recurring_phrases": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS phrase FROM e WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT phrase, count(*) AS occurrences, count(DISTINCT doc_id) AS docs FROM g WHERE phrase IS NOT NULL GROUP BY phrase HAVING count(*) >= 6""",
    "concordance": rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\S+')) AS term FROM documents)
SELECT term, count(*) AS occurrences, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM w WHERE term IN ({", ".join(repr(t) for t in TERMS)}) GROUP BY term""",
    "voice_marker_score": " UNION ALL ".join(
        f"SELECT doc_id, '{i}' AS fixture_id, ({' + '.join(f'contains(lower(text), {p!r})::BIGINT' for p in r)})::BIGINT AS hits, ({' + '.join(f'contains(lower(text), {p!r})::BIGINT' for p in f)})::BIGINT AS forbidden_hits, ({' + '.join(f'contains(lower(text), {p!r})::BIGINT' for p in r)}) >= {a} AND ({' + '.join(f'contains(lower(text), {p!r})::BIGINT' for p in f)}) <= {b} AS passed FROM documents" for i, r, f, a, b in FIXTURES),
    "dialogue_runs": "WITH t AS (SELECT conv_id, turn, length(text) < 300 AS short FROM conversations), g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, short ORDER BY turn) AS g FROM t) SELECT conv_id, short, min(turn) AS first, max(turn) AS last, count(*) AS length FROM g GROUP BY conv_id, short, g HAVING count(*) >= 2",
    "three_word_counts": f"SELECT doc_id, {_PROSE} AS prose, {_WORDS.format('text')}::BIGINT AS wc, {_WORDS.format('text')}::BIGINT AS print_words FROM documents",
}
