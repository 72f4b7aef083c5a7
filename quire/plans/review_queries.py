"""Queries on reviews, coverage, reports, sizes and metadata checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators import catalog, furniture, layout, reviews, seo
from quire.plans.registry import query
from quire.plans.table_queries import TOKENS
from quire.plans.text_queries import LINES, _lines, furniture_sql
from quire.sources.tables import laid_out, table

CHAPTERS = "SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'Contents' WHEN 1 THEN 'Index' WHEN 2 THEN 'About the author' WHEN 3 THEN 'Opening Pages' ELSE 'Chapter ' || o_orderkey END AS title FROM orders"


def _chapters(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    title = F.when(k % 6 == 0, "Contents").when(k % 6 == 1, "Index").when(k % 6 == 2, "About the author").when(k % 6 == 3, "Opening Pages").otherwise(F.concat(F.lit("Chapter "), k.cast("string")))
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), idx.alias("idx"), k.alias("k"), title.alias("title"))


@query(f"""WITH c AS ({CHAPTERS}) SELECT doc, idx, CASE WHEN idx = 0 AND count(*) OVER (PARTITION BY doc) > 1 AND k % 6 IN (0, 2, 3) THEN 'front' WHEN k % 6 IN (1, 2) THEN 'back' END AS matter FROM c""")
def chapter_matter(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.matter(_chapters(spark, sf), ["doc"], "idx", "title").select("doc", "idx", "matter")


@query(f"""WITH c AS ({CHAPTERS}), s AS (SELECT doc, sha256('[' || string_agg('{{"idx":' || idx || ',"title":"' || title || '","page_start":' || k || ',"page_end":' || k + 9 || '}}', ',' ORDER BY idx) || ']') AS sig, max(k) AS k FROM c GROUP BY 1)
SELECT doc, sig AS signature, CASE WHEN doc % 3 = 0 THEN true WHEN doc % 3 = 1 THEN false ELSE doc % 2 = 0 END AS applies FROM s""")
def review_states(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures of chapter lists, and whether reviews with an old key, an old list, or neither still apply."""
    rows = _chapters(spark, sf).select("doc", F.col("idx").cast("int"), "title", F.col("k").alias("page_start"), (F.col("k") + 9).alias("page_end"))
    now = reviews.signature(rows, ["doc"])
    d = F.col("doc")
    given = now.select("doc", F.when(d % 3 == 0, "new").otherwise("old").alias("analysis_key"), F.when(d % 3 == 1, "other").when(d % 2 == 0, F.col("signature")).otherwise("x").alias("signature"))
    return reviews.applicable(given, now.withColumn("analysis_key", F.lit("new")), ["doc"]).join(now, "doc").select("doc", "signature", "applies")


@query(f"""WITH c AS ({CHAPTERS}), e AS (SELECT doc, idx + CASE WHEN k % 50 = 0 THEN 100 ELSE 0 END AS idx, doc % 4 = 0 OR k % 2 = 0 AS ex FROM c),
u AS (SELECT e.doc, array_to_string(list_sort(list(DISTINCT e.idx + 1)), ', ') AS ids FROM e LEFT JOIN c ON c.doc = e.doc AND c.idx = e.idx WHERE c.doc IS NULL GROUP BY 1), l AS (SELECT DISTINCT c.doc FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc = c.doc AND e.idx = c.idx AND ex))
SELECT d.doc, CASE WHEN ids IS NOT NULL THEN 'unknown: ' || ids ELSE 'nothing is kept' END AS problem FROM (SELECT DISTINCT doc FROM e) d LEFT JOIN u USING (doc) LEFT JOIN l ON l.doc = d.doc WHERE ids IS NOT NULL OR l.doc IS NULL""")
def review_problems(spark: SparkSession, sf: str) -> DataFrame:
    rows = _chapters(spark, sf)
    edits = rows.select("doc", (F.col("idx") + F.when(F.col("k") % 50 == 0, 100).otherwise(0)).alias("idx"), ((F.col("doc") % 4 == 0) | (F.col("k") % 2 == 0)).alias("exclude"))
    return reviews.review_problems(rows, edits, ["doc"])


@query(f"""WITH c AS (SELECT *, k % 3 <> 0 AS inc, CASE WHEN k % 5 = 0 THEN ' New ' ELSE title END AS t, k % 4 = 0 AS mg FROM ({CHAPTERS}))
SELECT doc, idx, NOT inc AS exclude, CASE WHEN inc AND trim(t) <> title THEN trim(t) END AS title, inc AND mg AND coalesce(max(inc::INT) OVER (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS merge FROM c""")
def chapter_edits(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    rows = _chapters(spark, sf).select("doc", "idx", (k % 3 != 0).alias("include"), F.when(k % 5 == 0, " New ").otherwise(F.col("title")).alias("title"), F.col("title").alias("original"), (k % 4 == 0).alias("merge"))
    return reviews.edits_of(rows, ["doc"])


@query(f"""WITH c AS (SELECT conv_id AS doc, sum(len({TOKENS.format('text')})) FILTER (role <> 'system') AS words FROM conversations GROUP BY 1), s AS (SELECT conv_id AS doc, sum(len({TOKENS.format('text')})) AS narrated, min(turn) AS a, max(turn) AS b FROM conversations WHERE turn % 3 <> 2 GROUP BY 1)
SELECT doc, coalesce(narrated, 0) AS narrated, coalesce(words, 0) AS words, a AS first_page, b AS last_page, CASE WHEN coalesce(words, 0) > 0 THEN coalesce(narrated, 0) >= words * 0.85 ELSE true END AS complete FROM c LEFT JOIN s USING (doc)""")
def narration_coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), "turn", "role", "text")
    chapters = rows.select("doc", F.size(t.tokens(F.col("text"))).alias("words"), F.when(F.col("role") == "system", "front").alias("matter"))
    return reviews.coverage(chapters, rows.where("turn % 3 <> 2").select("doc", "text", F.col("turn").alias("page")), ["doc"], F.max(F.lit(False)))


@query(f"""WITH f AS ({furniture_sql()}), l AS ({LINES}), s AS (SELECT book, reason, trim(text) AS txt, count(*) AS n, min(page * 1000000 + line_no) AS pos FROM f JOIN l USING (page, line_no) WHERE reason IS NOT NULL GROUP BY 1, 2, 3)
SELECT book, reason, CAST(sum(n) AS BIGINT) AS n, array_to_string(list(txt ORDER BY pos, txt)[1:20], '|') AS texts FROM s GROUP BY 1, 2""")
def cleaning_reports(spark: SparkSession, sf: str) -> DataFrame:
    found = furniture.classified(laid_out(_lines(spark, sf)))
    return reviews.cleaning_report(found, ["book"]).withColumn("texts", F.array_join("texts", "|"))


@query("""WITH v AS (SELECT CASE s_nationkey % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN 'en_GB' WHEN 2 THEN 'bn' ELSE '' END AS language, CASE WHEN s_nationkey % 4 = 1 THEN 'British' END AS accent, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 3 END AS g, s_name AS name FROM supplier),
l AS (SELECT CASE WHEN language = '' THEN 'other' ELSE regexp_split_to_array(language, '[-_]')[1] END AS language, string_agg(name, ',' ORDER BY coalesce(accent, ''), g, name) AS voices FROM v GROUP BY 1) SELECT row_number() OVER (ORDER BY CASE WHEN language = 'en' THEN 0 ELSE 1 END, language) - 1 AS place, language, voices FROM l""")
def voice_lists(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("s_nationkey") % 4
    voices = table(spark, sf, "supplier").select(F.when(n == 0, "en-US").when(n == 1, "en_GB").when(n == 2, "bn").otherwise("").alias("language"), F.when(n == 1, "British").alias("accent"), F.when(F.col("s_suppkey") % 3 == 0, "male").when(F.col("s_suppkey") % 3 == 1, "female").alias("gender"), F.col("s_name").alias("name"))
    return reviews.voice_groups(voices, "en").withColumn("voices", F.array_join("voices", ","))


@query("""WITH l AS (SELECT l_orderkey AS page, l_linenumber AS line_no, l_quantity AS size, l_suppkey AS chars FROM lineitem), s AS (SELECT page, size, sum(chars) AS n FROM l GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY size ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY page) AS total FROM s),
m AS (SELECT page, min(size) AS mid FROM r WHERE 2 * run >= total GROUP BY 1) SELECT page, line_no, CASE WHEN size BETWEEN mid * 0.5 AND mid * 1.5 THEN mid ELSE size END AS size FROM l JOIN m USING (page)""")
def even_line_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_no"), F.col("l_quantity").alias("size"), F.col("l_suppkey").alias("chars"))
    return reviews.even_sizes(rows, ["page"], 0.5, 1.5).select("page", "line_no", "size")


@query("""WITH w AS (SELECT l_orderkey AS page, l_partkey % 9 + 1 AS chars, l_linenumber % 2 = 1 AS counts, l_suppkey % 3 = 0 AS broken, l_suppkey % 4 = 0 AS legacy FROM lineitem),
s AS (SELECT page, sum(chars) AS c, sum(CASE WHEN legacy THEN chars ELSE 0 END) AS l, count(*) FILTER (counts) AS n, count(*) FILTER (counts AND broken) AS b FROM w GROUP BY 1) SELECT page, CASE WHEN c >= 20 AND l / c > 0.3 THEN 1.0 WHEN n > 0 THEN b / n ELSE 0.0 END AS damage FROM s""")
def page_damage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 9 + 1).alias("chars"), (F.col("l_linenumber") % 2 == 1).alias("counts"), (F.col("l_suppkey") % 3 == 0).alias("broken"), (F.col("l_suppkey") % 4 == 0).alias("legacy"))
    return reviews.damage_ratios(rows, ["page"])


@query(f"""WITH l AS (SELECT book, page, line_no, text, CASE WHEN line_no % 4 = 0 THEN 24.0 ELSE 11.0 END AS size, CASE WHEN line_no % 4 = 0 THEN 54.0 ELSE 80.0 END AS x0, 20.0 + line_no * 15 AS y0, 20.0 + line_no * 15 + CASE WHEN line_no % 4 = 0 THEN 24.0 ELSE 11.0 END AS y1 FROM ({LINES}))
SELECT page, line_no, CASE WHEN size >= 11 * 1.18 AND len({TOKENS.format('text')}) >= 5 AND EXISTS (SELECT 1 FROM l n WHERE n.book = l.book AND n.page = l.page AND n.line_no <> l.line_no AND abs(n.size - 11) <= 2.2 AND n.y0 > l.y0 AND n.y0 < l.y1 - 4.4 AND n.x0 >= l.x0 + 11 AND n.x0 < l.x0 + 66) THEN 11.0 ELSE size END AS size FROM l""")
def drop_cap_sizes(spark: SparkSession, sf: str) -> DataFrame:
    tall = F.col("line_no") % 4 == 0
    top, size = F.lit(20.0) + F.col("line_no") * 15, F.when(tall, 24.0).otherwise(11.0)
    lines = _lines(spark, sf).select("*", size.alias("size"), F.when(tall, 54.0).otherwise(80.0).alias("x0"), top.alias("y0"), (top + size).alias("y1"), F.lit(11.0).alias("body"))
    return reviews.drop_cap_heights(lines, ["book", "page"]).select("page", "line_no", "size")


@query(f"""SELECT book, count(*) FILTER (regexp_matches({TOKENS.format('t')}[-1], '[\\pL\\pM]\\x{{2010}}$')) >= 3 AS auto FROM (SELECT book, CASE WHEN line_no % 9 = 0 AND book <> 'src0' THEN text || ' bro' || chr(8208) ELSE text END AS t FROM ({LINES})) GROUP BY 1""")
def automatic_hyphens(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.when((F.col("line_no") % 9 == 0) & (F.col("book") != "src0"), F.concat("text", F.lit(" bro‐"))).otherwise(F.col("text"))
    return reviews.auto_hyphens(_lines(spark, sf).withColumn("text", marked), "book")


@query(f"""WITH w AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS w, generate_subscripts({TOKENS.format('text')}, 1) - 1 AS k FROM documents), o AS (SELECT doc_id, k, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, length(w) AS n FROM w),
s AS (SELECT doc_id, unnest([0, 1]) AS span, unnest([0, 40]) AS a, unnest([25, 90]) AS b FROM documents) SELECT s.doc_id, span, min(k) AS first, max(k) AS last FROM s JOIN o ON o.doc_id = s.doc_id AND o.a < s.b AND o.a + o.n > s.a GROUP BY 1, 2""")
def tokens_in_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    spans = docs.select("doc_id", F.inline(F.array(*[F.struct(F.lit(i).alias("span"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a, b in ((0, 0, 25), (1, 40, 90))])))
    return reviews.tokens_in_spans(reviews.token_offsets(docs, "doc_id"), spans, "doc_id")


@query("""WITH g AS (SELECT p_partkey AS id, unnest(['video.fps', 'audio.voice', 'extra']) AS path, unnest([CASE WHEN p_size > 25 THEN p_size::VARCHAR END, CASE WHEN p_size % 2 = 0 THEN p_brand END, CASE WHEN p_size % 5 = 0 THEN 'x' END]) AS value FROM part), d AS (SELECT unnest(['video.fps', 'audio.voice', 'video.mode']) AS path, unnest(['30', 'amy', 'follow']) AS v)
SELECT i.id, d.path, coalesce(g.value, d.v) AS value FROM (SELECT DISTINCT id FROM g) i, d LEFT JOIN g ON g.id = i.id AND g.path = d.path UNION ALL SELECT id, path, value FROM g WHERE path = 'extra' AND value IS NOT NULL""")
def resolved_settings(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_size")
    leaves = F.array(*[F.struct(F.lit(p).alias("path"), v.alias("value")) for p, v in (("video.fps", F.when(n > 25, n.cast("string"))), ("audio.voice", F.when(n % 2 == 0, F.col("p_brand"))), ("extra", F.when(n % 5 == 0, F.lit("x"))))])
    given = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.inline(leaves))
    return reviews.resolved(given, {"video.fps": "30", "audio.voice": "amy", "video.mode": "follow"}, ["id"])


@query("""SELECT p_partkey, '{' || array_to_string(list_filter([CASE WHEN p_size <> 7 THEN '"p_size":' || p_size END, CASE WHEN p_brand <> 'Brand#11' THEN '"p_brand":"' || p_brand || '"' END], lambda x: x IS NOT NULL), ',') || '}' AS options FROM part""")
def sparse_options(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.sparse(table(spark, sf, "part"), ["p_partkey"], {"p_size": 7, "p_brand": "Brand#11"})


@query("""WITH s AS (SELECT l_orderkey AS doc, list(l_partkey ORDER BY l_linenumber) AS now, list(l_partkey + CASE WHEN l_suppkey % 7 = 0 THEN 1 ELSE 0 END ORDER BY l_linenumber) AS before FROM lineitem GROUP BY 1) SELECT doc, now = before AS reuse FROM s""")
def reused_pictures(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("key"), "l_suppkey")
    made = rows.withColumn("key", F.col("key") + F.when(F.col("l_suppkey") % 7 == 0, 1).otherwise(0))
    return reviews.same_pictures(rows, made, ["doc"])


@query("""SELECT l_orderkey AS chapter, 'c' || l_orderkey || '-p' || l_partkey % 3 || '-s' || l_linenumber * 5 AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 3, l_linenumber) AS place FROM lineitem""")
def sentences_in_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("l_partkey") % 3
    key = F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.lit("-p"), p.cast("string"), F.lit("-s"), (F.col("l_linenumber") * 5).cast("string"))
    return reviews.reading_order(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chapter"), p.alias("paragraph"), key.alias("key"))).select("chapter", "key", "place")


@query("""SELECT o_custkey % 7 AS owner, count(*) AS files, sum(o_orderkey % 1000) AS bytes FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1""")
def freed_space(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    files = table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("owner"), k.cast("string").alias("path"), (k % 1000).alias("size"))
    return reviews.freed_bytes(files, files.where("cast(path AS long) % 3 = 0"), ["owner"])


@query("""SELECT event_id, event_type AS step, n.r_name AS stage_title FROM events e JOIN region n ON n.r_regionkey = e.event_id % 5""")
def titled_steps(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("stage_title"))
    steps = table(spark, sf, "events").select("event_id", F.col("event_type").alias("step"), (F.col("event_id") % 5).cast("int").alias("k"))
    return layout.titled(steps, titles, "k").select("event_id", "step", "stage_title")


_PHRASE = r"regexp_extract_all(lower({0}), '[\pL\pN][\pL\pM\pN''’]*')"
DRAFTS = f"""WITH p AS (SELECT p_partkey, p_name || ' by Jane Austen | Audiobook' AS title, CASE WHEN p_size % 4 = 0 THEN '' ELSE lower(p_name) END AS keyword, p_size % 3 = 0 AS partial, p_type AS description, p_size, p_brand,
 CASE WHEN p_size % 2 = 0 THEN list_resize([lower(p_name), p_brand, 'a b'], (p_size % 4)::INT) ELSE [lower(p_name), p_brand, 'x', 'y', 'z', 'w w'] END AS tags FROM part),
q AS (SELECT *, CASE WHEN keyword <> '' AND list_has_all({_PHRASE.format('title')}, {_PHRASE.format('keyword')}) THEN 0 ELSE -1 END AS pos, list_contains({_PHRASE.format('title')}, 'austen') AS author FROM p)"""


@query(DRAFTS + r""", c AS (SELECT p_partkey, unnest(list_filter([
 {'id': 'title-length', 's': CASE WHEN length(title) > 100 THEN 'fail' WHEN length(title) > 70 OR length(title) < 30 THEN 'warn' ELSE 'pass' END, 'w': 3}, CASE WHEN keyword = '' THEN {'id': 'keyword', 's': 'warn', 'w': 2} END,
 CASE WHEN keyword <> '' THEN {'id': 'title-keyword', 's': CASE WHEN pos < 0 THEN 'warn' ELSE 'pass' END, 'w': 3} END, {'id': 'title-format', 's': CASE WHEN author THEN 'pass' ELSE 'warn' END, 'w': 2}, CASE WHEN partial THEN {'id': 'scope', 's': 'warn', 'w': 3} END,
 {'id': 'desc-length', 's': 'warn', 'w': 2}, CASE WHEN keyword <> '' THEN {'id': 'desc-hook', 's': 'warn', 'w': 2} END, {'id': 'desc-cta', 's': 'warn', 'w': 1}, {'id': 'chapters', 's': CASE WHEN p_size % 2 = 0 THEN 'pass' ELSE 'warn' END, 'w': 2},
 {'id': 'tags', 's': CASE WHEN len(list_filter(tags, lambda x: x IS NOT NULL)) < 5 THEN 'warn' ELSE 'pass' END, 'w': 1}, CASE WHEN keyword <> '' AND len(tags) > 0 AND NOT list_contains(tags, keyword) THEN {'id': 'tags-keyword', 's': 'warn', 'w': 1} END,
 {'id': 'hashtags', 's': CASE WHEN p_size % 5 = 0 THEN 'fail' ELSE 'pass' END, 'w': 1}, {'id': 'thumbnail', 's': CASE WHEN p_size > 25 THEN 'pass' ELSE 'warn' END, 'w': 2}, {'id': 'pinned', 's': CASE WHEN p_size > 10 THEN 'pass' ELSE 'warn' END, 'w': 1}, {'id': 'file-tags', 's': 'pass', 'w': 1}], lambda x: x IS NOT NULL)) AS x FROM q)
SELECT p_partkey, x.id AS check_id, x.s AS status, x.w::DOUBLE AS weight, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE x.s WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, x.w DESC, x.id) AS place FROM c""")
def metadata_checks(spark: SparkSession, sf: str) -> DataFrame:
    """All checks of the metadata of videos named after parts, the worst first."""
    n, name = F.col("p_size"), F.lower("p_name")
    few = F.slice(F.array(name, F.col("p_brand"), F.lit("a b")), F.lit(1), F.pmod(n, F.lit(4)))
    drafts = table(spark, sf, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" by Jane Austen | Audiobook")).alias("title"), F.when(n % 4 == 0, "").otherwise(name).alias("keyword"), F.lit("Jane Austen").alias("book_author"),
        (n % 3 == 0).alias("partial"), F.lit("Zzz").alias("part"), F.col("p_type").alias("description"), F.col("p_type").alias("composed"), F.lit(True).alias("include_chapters"),
        F.when(n % 2 == 1, "few").alias("chapters_problem"), F.when(n % 2 == 0, few).otherwise(F.array(name, F.col("p_brand"), *[F.lit(x) for x in ("x", "y", "z", "w w")])).alias("tags"),
        F.when(n % 5 == 0, F.array(F.lit("not one"))).otherwise(F.array(F.lit("One"))).alias("hashtags"), F.when(n > 25, "t.jpg").otherwise("").alias("thumbnail"), F.when(n > 10, "Hello?").otherwise(" ").alias("pinned"), F.lit("current").alias("applied"),
    )
    return seo.worst_first(seo.metadata_checks(drafts, ["p_partkey"]), ["p_partkey"])


@query("""WITH w AS (SELECT c_custkey, 's' || c_nationkey * 3 AS pref, CASE c_nationkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'bn' ELSE 'fr' END AS lang FROM customer), v AS (SELECT 's' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'en-US' ELSE 'bn' END AS language, s_suppkey AS place FROM supplier),
f AS (SELECT c_custkey, CASE WHEN pref IN (SELECT id FROM v) THEN pref END AS p, (SELECT min_by(id, place) FROM v WHERE starts_with(language, lang)) AS o FROM w) SELECT c_custkey AS key, coalesce(p, o, (SELECT min_by(id, place) FROM v)) AS voice FROM f""")
def picked_voices(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("c_nationkey"), F.col("s_suppkey")
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.concat(F.lit("s"), (n * 3).cast("string")).alias("preferred"), F.when(n % 3 == 0, "en").when(n % 3 == 1, "bn").otherwise("fr").alias("language"))
    voices = table(spark, sf, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.when(k % 2 == 0, "en-US").otherwise("bn").alias("language"), k.alias("place"))
    return reviews.picked_voices(wanted, voices)


@query("""SELECT p_partkey, p_size % 4 > 0 AS same FROM part""")
def unchanged_drafts(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", F.lit(1).alias("saved"))
    b = a.withColumn("p_name", F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))).withColumn("saved", F.lit(2))
    return reviews.same_drafts(a, b, ["p_partkey"], ["saved"])


@query("""SELECT 'repeated' AS what, o_custkey AS key, count(*) AS n FROM orders GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'dangling', o_custkey, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey > 3) GROUP BY 2""")
def broken_constraints(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that a unique column repeats, and references to rows that aren't there."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_nationkey > 3")
    repeated = catalog.repeated_keys(orders, ["o_custkey"]).select(F.lit("repeated").alias("what"), F.col("o_custkey").alias("key"), "n")
    return repeated.unionByName(catalog.dangling(orders, customers, "o_custkey", "c_custkey").select(F.lit("dangling").alias("what"), F.col("o_custkey").alias("key"), "n"))


@query("""WITH r AS (SELECT l_orderkey AS run, l_linenumber - 1 AS place, count(*) AS n FROM lineitem WHERE l_partkey % 4 > 0 GROUP BY 1, 2), g AS (SELECT run, coalesce(min(i), 7) AS gap FROM (SELECT DISTINCT run FROM r), (SELECT unnest(range(0, 7)) AS i) t WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.run = r.run AND x.place = i) GROUP BY 1)
SELECT r.run, r.place FROM r LEFT JOIN g ON g.run = r.run WHERE r.place < coalesce(gap, 7)""".replace("(SELECT DISTINCT run FROM r),", "(SELECT DISTINCT run FROM r) r,"))
def results_in_order(spark: SparkSession, sf: str) -> DataFrame:
    from quire.streaming import progress

    rows = table(spark, sf, "lineitem").where("l_partkey % 4 > 0").select(F.col("l_orderkey").alias("run"), (F.col("l_linenumber") - 1).alias("place")).distinct()
    return progress.in_order(rows, ["run"], "place", 7)
