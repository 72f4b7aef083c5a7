"""Queries on wording and display: section numbers, clocks, plans, errors, hashtags, paragraphs, titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import bangla, display, publishing, wording
from quire.functions import text as t
from quire.functions.times import rounded
from quire.plans.registry import query
from quire.plans.table_queries import TOKENS
from quire.sources.table_kits import kit_json
from quire.sources.tables import table

_EDGE, _TAIL = r"^[\s\-–—•·§#]*[\[{(]?", r"[\]})]?[.:]?[\s\-–—•·]*$"
_ROMANS = "SELECT ['', 'C', 'CC', 'CCC'][n // 100 + 1] || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][n // 10 % 10 + 1] || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS r FROM range(1, 400) t(n)"


@query(f"""WITH w AS (SELECT DISTINCT unnest({TOKENS.format('text')}) AS w FROM documents UNION SELECT o_orderkey % 1200 || '.' FROM orders UNION SELECT unnest(['I', 'II.', '§ 3', '- 4 -', 'Ul', 'MILD', 'mix', 'DID', 'IIII', 'xliv', '(IV)', 'cdi', 'U|'])),
m AS (SELECT w, regexp_matches(trim(w), '{_EDGE}[0-9০-৯]{{1,3}}{_TAIL}') AS d, regexp_extract(trim(w), '{_EDGE}([IVXLCDM]{{1,7}}|[ivxlcdm]{{1,7}}){_TAIL}', 1) AS r, regexp_extract(trim(w), '{_EDGE}([Il1|U]{{1,4}}){_TAIL}', 1) AS o FROM w)
SELECT w, CASE WHEN d THEN true WHEN r <> '' THEN upper(r) IN ({_ROMANS}) ELSE regexp_matches(o, '[Il1|]') END AS number FROM m""")
def section_numbers(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select(F.explode(t.tokens(F.col("text"))).alias("w"))
    n = table(spark, sf, "orders").select(F.concat((F.col("o_orderkey") % 1200).cast("string"), F.lit(".")).alias("w"))
    own = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("I", "II.", "§ 3", "- 4 -", "Ul", "MILD", "mix", "DID", "IIII", "xliv", "(IV)", "cdi", "U|")])).alias("w"))
    return w.unionByName(n).unionByName(own).distinct().select("w", wording.numbered_section(F.col("w")).alias("number"))


@query("""WITH s AS (SELECT o_orderkey, o_totalprice AS x, floor(o_totalprice)::BIGINT AS c, floor(o_totalprice / 50 + 0.5)::BIGINT AS d, ['silent', 'quiet', 'balanced', 'fast'][o_orderkey % 4 + 1] AS mode, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN c >= 3600 THEN c // 3600 || ':' || lpad((c % 3600 // 60)::VARCHAR, 2, '0') ELSE (c % 3600 // 60)::VARCHAR END || ':' || lpad((c % 60)::VARCHAR, 2, '0') AS clock,
CASE WHEN d < 60 THEN d || ' s' WHEN d >= 3600 THEN d // 3600 || ' h ' || d % 3600 // 60 || ' min' WHEN d % 60 > 0 THEN d // 60 || ' min ' || d % 60 || ' s' ELSE d // 60 || ' min' END AS long,
floor((x / 155 / greatest(0.5, o_orderkey % 3) * 60) * 10000 + 0.5) / 10000 AS narration, floor((x / CASE mode WHEN 'silent' THEN 0.45 WHEN 'quiet' THEN 2.9 WHEN 'balanced' THEN 5.7 ELSE 6.2 END + CASE WHEN o_orderkey % 2 = 0 THEN x / CASE mode WHEN 'silent' THEN 2.0 WHEN 'quiet' THEN 6.4 ELSE 12.0 END ELSE 0 END) / 3600 * 10000 + 0.5) / 10000 AS hours,
strftime(o_orderdate, '%b %-d, %Y, %-I:%M %p') AS day FROM s""")
def shown_times(spark: SparkSession, sf: str) -> DataFrame:
    x, k = F.col("o_totalprice"), F.col("o_orderkey")
    mode = F.element_at(F.array(*[F.lit(m) for m in display.MODE_SPEED]), (k % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        "o_orderkey", display.clock(x).alias("clock"), display.long_duration(x / 50).alias("long"), rounded(display.narration_seconds(x, (k % 3).cast("double")), 4).alias("narration"),
        rounded(display.work_hours(x, mode, k % 2 == 0), 4).alias("hours"), display.date_text(F.col("o_orderdate")).alias("day"),
    )


@query("""WITH d AS (SELECT event_id, ts, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 1000000 AS s FROM events), n AS (SELECT *, abs(s) AS a, floor(s / 60 + 0.5)::BIGINT AS m, floor(s / 3600 + 0.5)::BIGINT AS h, floor(s / 86400 + 0.5)::BIGINT AS d FROM d)
SELECT event_id, CASE WHEN a > 604800 THEN strftime(ts, '%b %-d, %Y, %-I:%M %p') WHEN a < 45 THEN 'just now' WHEN a < 3600 THEN CASE WHEN s < 0 THEN '' ELSE 'in ' END || abs(m) || ' minute' || CASE WHEN abs(m) = 1 THEN '' ELSE 's' END || CASE WHEN s < 0 THEN ' ago' ELSE '' END
WHEN a < 86400 THEN CASE WHEN h = 0 THEN 'this hour' ELSE CASE WHEN s < 0 THEN '' ELSE 'in ' END || abs(h) || ' hour' || CASE WHEN abs(h) = 1 THEN '' ELSE 's' END || CASE WHEN s < 0 THEN ' ago' ELSE '' END END
WHEN d = -1 THEN 'yesterday' WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'tomorrow' ELSE CASE WHEN s < 0 THEN '' ELSE 'in ' END || abs(d) || ' day' || CASE WHEN abs(d) = 1 THEN '' ELSE 's' END || CASE WHEN s < 0 THEN ' ago' ELSE '' END END AS said FROM n""")
def relative_times(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return table(spark, sf, "events").select("event_id", display.relative_time(F.col("ts").cast("timestamp"), now).alias("said"))


@query("""WITH p AS (SELECT p_partkey, ['silent', 'quiet', 'balanced', 'fast'][p_size % 4 + 1] AS m, p_size % 3 = 0 AS bat, p_size % 2 = 0 AS q, p_size AS cpus, p_size % 5 AS s, p_size % 7 AS v FROM part), n AS (SELECT *, bat AND q AND m IN ('balanced', 'fast') AS low FROM p), o AS (SELECT *, CASE WHEN low THEN 'quiet' ELSE m END AS mode FROM n)
SELECT p_partkey, mode, CASE WHEN low THEN 'on battery' END AS reason, CASE mode WHEN 'fast' THEN greatest(1, s) WHEN 'balanced' THEN least(2, greatest(1, s)) ELSE 1 END AS speech, CASE mode WHEN 'silent' THEN 1 WHEN 'fast' THEN greatest(2, floor(cpus * 0.6 / greatest(1, s))::INT) ELSE 2 END AS threads,
CASE mode WHEN 'fast' THEN greatest(1, v) WHEN 'balanced' THEN least(2, greatest(1, v)) ELSE 1 END AS video, CASE mode WHEN 'silent' THEN 15 WHEN 'quiet' THEN 10 WHEN 'fast' THEN 0 ELSE 5 END AS nice FROM o""")
def resource_plans(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_size")
    mode = F.element_at(F.array(*[F.lit(m) for m in display.MODE_SPEED]), n % 4 + 1)
    return table(spark, sf, "part").select("p_partkey", display.resources(mode, n % 3 == 0, n % 2 == 0, n, n % 5, n % 7).alias("x")).select("p_partkey", "x.*")


@query("""WITH e AS (SELECT event_id, ['PDF_EMPTY', 'TTS_FAILED', 'ENOSPC', 'ECONNREFUSED', 'EPIPE'][event_id % 5 + 1] AS code, [6379, 5433, 11434, 80][event_id % 4 + 1] AS port FROM events)
SELECT event_id, CASE code WHEN 'ENOSPC' THEN 'DISK_FULL' WHEN 'EPIPE' THEN 'INTERNAL' WHEN 'ECONNREFUSED' THEN CASE port WHEN 6379 THEN 'REDIS_UNAVAILABLE' WHEN 5433 THEN 'DB_UNAVAILABLE' WHEN 11434 THEN 'OLLAMA_UNAVAILABLE' ELSE 'INTERNAL' END ELSE code END AS code, code <> 'PDF_EMPTY' AS retryable FROM e""")
def user_errors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    code = F.element_at(F.array(*[F.lit(c) for c in ("PDF_EMPTY", "TTS_FAILED", "ENOSPC", "ECONNREFUSED", "EPIPE")]), (k % 5 + 1).cast("int"))
    port = F.element_at(F.array(*[F.lit(p) for p in (6379, 5433, 11434, 80)]), (k % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", display.user_error(code, port).alias("x")).select("event_id", "x.code", "x.retryable")


@query("""WITH c AS (SELECT c_custkey, c_name, ['public_domain', 'open', 'restricted', 'unknown'][c_nationkey % 4 + 1] AS r, CASE WHEN c_nationkey % 3 = 0 THEN 'CC BY 4.0' END AS l, CASE WHEN c_nationkey % 5 > 0 THEN 1900 + c_nationkey END AS y, c_nationkey % 7 AS p FROM customer)
SELECT c_custkey, CASE WHEN r IN ('open', 'restricted') AND l IS NOT NULL THEN l ELSE CASE r WHEN 'public_domain' THEN 'Public domain' WHEN 'open' THEN 'Open licence' WHEN 'restricted' THEN 'Restricted licence' ELSE 'Rights unknown' END END AS badge,
array_to_string(list_filter([c_name, y::VARCHAR, CASE WHEN p > 0 THEN p || ' pages' END, 'English'], lambda x: x IS NOT NULL), ' · ') AS line FROM c""")
def book_cards(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("c_nationkey")
    rights = F.element_at(F.array(*[F.lit(r) for r in display.RIGHTS]), n % 4 + 1)
    line = display.book_line(F.col("c_name"), F.when(n % 5 > 0, n + 1900), n % 7, F.lit("English"))
    return table(spark, sf, "customer").select("c_custkey", display.rights_badge(rights, F.when(n % 3 == 0, "CC BY 4.0")).alias("badge"), line.alias("line"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,\n;]+'), lambda x: trim(regexp_replace(x, '^[\s#*•-]+|[\s*]+$', '', 'g'))), lambda x: x <> ''), '|') AS entries,
len(regexp_extract_all(text, '#?([\pL\pM\pN_]+)', 1)) AS words, trim(regexp_extract(text, '^\s*([^.!?।]*[.!?।]*)', 1)) AS first FROM documents""")
def listed_entries(spark: SparkSession, sf: str) -> DataFrame:
    own = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.array_join(wording.listed(own), "|").alias("entries"), F.size(wording.hashtag_words(own)).alias("words"), wording.first_sentence(own).alias("first"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(text, '\b(the|der|el|le)\s', '#Tag\1 and link in bio! ', 'g') AS s FROM documents), b AS (SELECT doc_id, s, trim(regexp_replace(s, '(?i)\s*\(?\blink in (?:the )?bio\b\)?[.!]*', '', 'g')) AS t FROM d)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '(^|\s)#[\pL\pM\pN_]+', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), '\s+([.,!?])', '\1', 'g')) AS text, array_to_string(list_transform(regexp_extract_all(t, '#([\pL\pM\pN_]+)', 1), lambda x: CASE WHEN lower(x) = 'tagthe' THEN 'TagThe' ELSE x END), ',') AS tags FROM b""")
def posts_without_hashtags(spark: SparkSession, sf: str) -> DataFrame:
    said = F.regexp_replace("text", r"(?<![A-Za-z0-9_])(the|der|el|le)\s", "#Tag$1 and link in bio! ")
    rows = table(spark, sf, "documents").select("doc_id", wording.without_hashtags(wording.without_bio_link(said, F.lit(False))).alias("x"))
    return rows.select("doc_id", "x.text", F.array_join(wording.recased(F.col("x.tags"), F.array(F.lit("TagThe"))), ",").alias("tags"))


_SENTENCES = r"""regexp_extract_all(s, '[^.!?।]+[.!?।]+["''’”)]*\s*|[^.!?।]+$')"""


@query(rf"""WITH d AS (SELECT doc_id, replace(text, chr(10), ' ') AS s FROM documents), x AS (SELECT doc_id, s, len(regexp_split_to_array(s, '\s+')) AS n, {_SENTENCES} AS l FROM d)
SELECT doc_id, CASE WHEN n >= 90 AND len(l) > 0 THEN array_to_string(list_filter(list_transform(range(0, (len(l) - 1) // 3 + 1), lambda k: trim(array_to_string(l[k * 3 + 1 : k * 3 + 3], ''), ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda g: g <> ''), chr(10) || chr(10)) ELSE s END AS text FROM x""")
def three_sentence_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", wording.paragraphs_of_three(F.replace("text", F.lit("\n"), F.lit(" "))).alias("text"))


@query(r"""WITH p AS (SELECT p_partkey, p_size % 2 = 0 AS part, 'Read-along with the ' || ['full', 'Complete', 'short', 'whole'][p_size % 4 + 1] || ' ' || ['audiobook', 'novel', 'song'][p_size % 3 + 1] || ': read along text' AS t FROM part),
a AS (SELECT *, 'Follow-along with the ' || regexp_replace(substr(t, 21), 'read along', 'follow along') AS u FROM p)
SELECT p_partkey, CASE WHEN part THEN regexp_replace(u, '(?i)\b(full|complete|unabridged|entire|whole)[- ](length )?(audiobook|audio book|book|novel|story)\b', '\3', 'g') ELSE u END AS text,
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)\bread[- ]along\s+(text|video|audiobook)\b', '\1', 'g'), '(?i)\s*[:|–-]?\s*\bread[- ]along\b', '', 'g'), '\s{2,}', ' ', 'g'), '\s*[:|–-]\s*$', '')) AS title FROM a""")
def scrubbed_texts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_size")
    said = F.concat(F.lit("Read-along with the "), F.element_at(F.array(*[F.lit(x) for x in ("full", "Complete", "short", "whole")]), n % 4 + 1), F.lit(" "), F.element_at(F.array(*[F.lit(x) for x in ("audiobook", "novel", "song")]), n % 3 + 1), F.lit(": read along text"))
    return table(spark, sf, "part").select("p_partkey", wording.scrubbed(said, n % 2 == 0).alias("text"), wording.scrubbed_title(said).alias("title"))


@query(r"""WITH c AS (SELECT p_partkey, unnest([p_name || ' by Jane Austen | Audiobook', 'A long look at ' || p_name || ' READ ALOUD FULL of it all, with text and more words', p_type]) AS t, unnest([0, 1, 2]) AS i, lower(p_name) AS b, p_size % 2 = 0 AS part FROM part),
s AS (SELECT *, CASE WHEN i = 0 THEN 4 WHEN i = 1 THEN 2 ELSE 0 END + CASE WHEN i = 0 THEN 5 ELSE 0 END + CASE WHEN length(t) BETWEEN 45 AND 70 THEN 2 WHEN length(t) BETWEEN 30 AND 80 THEN 1 ELSE 0 END - CASE WHEN len(regexp_extract_all(t, '\b[A-Z]{4,}\b')) > 1 THEN 2 ELSE 0 END - CASE WHEN part AND i = 1 THEN 8 ELSE 0 END AS score FROM c),
f AS (SELECT p_partkey, coalesce(min_by(t, i) FILTER (length(t) <= 70), min_by(t, (length(t), i))) AS fitting FROM c GROUP BY 1) SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, i) AS place, t AS title, score, fitting FROM s JOIN f USING (p_partkey)""")
def ranked_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of videos, the best first; and the first of the candidates that search shows whole."""
    name = F.col("p_name")
    titles = F.array(F.concat(name, F.lit(" by Jane Austen | Audiobook")), F.concat(F.lit("A long look at "), name, F.lit(" READ ALOUD FULL of it all, with text and more words")), F.col("p_type"))
    rows = table(spark, sf, "part").select("p_partkey", name.alias("book"), (F.col("p_size") % 2 == 0).alias("partial"), wording.fitting_title(titles).alias("fitting"), F.posexplode(titles).alias("i", "title"))
    scored = rows.withColumn("score", wording.title_score(F.col("title"), F.col("book"), F.lit("Austen"), F.lit("audiobook"), F.col("partial"), F.lit(None).cast("string"))).where("score > -100")
    order = Window.partitionBy("p_partkey").orderBy(F.desc("score"), "i")
    return scored.withColumn("place", F.row_number().over(order)).where("place <= 6").select("p_partkey", "place", "title", "score", "fitting")


@query("""SELECT o_orderkey, translate(o_orderkey::VARCHAR, '0123456789', '০১২৩৪৫৬৭৮৯') AS bangla, o_orderkey::VARCHAR AS ascii, CASE o_orderkey % 4 WHEN 0 THEN 'Opening Pages' WHEN 1 THEN 'পর্ব ' || translate((o_orderkey % 30)::VARCHAR, '0123456789', '০১২৩৪৫৬৭৮৯') WHEN 2 THEN 'Part ' || o_orderkey % 30 ELSE 'সম্পূর্ণ বই' END AS title FROM orders""")
def bangla_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    own = bangla.to_bangla(k)
    kind = F.when(k % 4 == 0, "opening").when(k % 4 < 3, "part").otherwise("full")
    return table(spark, sf, "orders").select("o_orderkey", own.alias("bangla"), bangla.to_ascii(own).alias("ascii"), bangla.section_title(kind, k % 2 == 1, k % 30).alias("title"))


@query("""SELECT p_partkey, '{"title":"' || p_name || '","tags":["' || p_brand || '","x"]' || CASE WHEN p_size % 2 = 0 THEN ',"comment":"' || p_type || '"' ELSE '' END || '}' AS kit FROM part""")
def publishing_kits(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that a site asks for, as JSON; what is missing is left out."""
    return table(spark, sf, "part").select("p_partkey", kit_json({"title": F.col("p_name"), "tags": F.array(F.col("p_brand"), F.lit("x")), "comment": F.when(F.col("p_size") % 2 == 0, F.col("p_type"))}).alias("kit"))


@query(r"""WITH p AS (SELECT p_partkey, p_name AS title, p_type AS body, CASE WHEN p_size % 3 = 0 THEN '#' || p_brand ELSE '' END AS tags FROM part)
SELECT p_partkey, 'TITLE' || chr(10) || title || chr(10) || chr(10) || 'DESCRIPTION' || chr(10) || body || CASE WHEN tags <> '' THEN chr(10) || chr(10) || 'HASHTAGS' || chr(10) || tags ELSE '' END AS kit FROM p""")
def kit_texts(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.when(F.col("p_size") % 3 == 0, publishing.hashtag_text(F.array("p_brand"))).otherwise("")
    return table(spark, sf, "part").select("p_partkey", publishing.kit_text({"TITLE": F.col("p_name"), "DESCRIPTION": F.col("p_type"), "HASHTAGS": tags}).alias("kit"))


@query("""WITH e AS (SELECT event_id, ['EXTRACT', 'TTS', 'VIDEO', 'ODD'][event_id % 4 + 1] AS stage, CASE WHEN event_id % 3 = 0 THEN event_id % 9 END AS ch, CASE WHEN event_id % 2 = 0 THEN 'T' || event_id END AS title, CASE event_id % 5 WHEN 0 THEN 'INTERRUPTED' WHEN 1 THEN NULL ELSE 'X' END AS code, CASE event_id % 7 WHEN 0 THEN 'TTS_CHAPTER_' || event_id % 12 WHEN 1 THEN 'VIDEO' ELSE 'k' END AS step FROM events)
SELECT event_id, CASE WHEN ch IS NOT NULL THEN coalesce(ch + 1 || '. ' || title, 'Chapter ' || ch + 1) ELSE coalesce(CASE stage WHEN 'EXTRACT' THEN 'Reading' WHEN 'TTS' THEN 'Narration' WHEN 'VIDEO' THEN 'Video' END, 'key') END AS step,
CASE WHEN code IS NULL THEN 'Retry' WHEN code = 'INTERRUPTED' THEN 'Resume' WHEN ch IS NOT NULL THEN 'Retry Chapter ' || ch + 1 WHEN step LIKE 'TTS_CHAPTER_%' THEN 'Retry Chapter ' || event_id % 12 WHEN step = 'VIDEO' THEN 'Retry Video' ELSE 'Retry' END AS retry FROM e""")
def step_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    stage = F.element_at(F.array(*[F.lit(x) for x in ("EXTRACT", "TTS", "VIDEO", "ODD")]), (k % 4 + 1).cast("int"))
    chapter, title = F.when(k % 3 == 0, k % 9), F.when(k % 2 == 0, F.concat(F.lit("T"), k.cast("string")))
    code = F.when(k % 5 == 0, "INTERRUPTED").when(k % 5 > 1, "X")
    step = F.when(k % 7 == 0, F.concat(F.lit("TTS_CHAPTER_"), (k % 12).cast("string"))).when(k % 7 == 1, "VIDEO").otherwise("k")
    return table(spark, sf, "events").select("event_id", display.step_label(stage, chapter, title, F.lit("key")).alias("step"), display.retry_label(code, chapter, step).alias("retry"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 432.0 WHEN 2 THEN 500.0 ELSE CASE WHEN l_orderkey % 2 = 0 THEN 432.0 ELSE 612.0 END END AS width, floor(l_extendedprice / 7 * 10 + 0.5) / 10 AS x0 FROM lineitem WHERE NOT (l_orderkey % 2 = 1 AND l_linenumber = 1)""")
def page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    size = {p: F.array(F.lit(w), F.lit(648.0)) for p, w in ((1, 432.0), (2, 500.0))}
    sizes = F.when(k % 2 == 0, F.create_map(F.lit(1), size[1], F.lit(2), size[2])).otherwise(F.create_map(F.lit(2), size[2]))
    rows = table(spark, sf, "lineitem").where(~((k % 2 == 1) & (n == 1)))
    return rows.select("l_orderkey", "l_linenumber", display.page_size(sizes, n)[0].alias("width"), display.rounded_box(F.array(F.col("l_extendedprice") / 7))[0].alias("x0"))
