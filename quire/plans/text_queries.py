"""Queries over the texts of ``documents``, ``pages``, ``conversations`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import sequences as q
from quire.functions import text as t
from quire.functions.times import rounded, speech_weight
from quire.operators import furniture, similarity, statistics, structure
from quire.plans.registry import query
from quire.sources.stages import small_batches, spread
from quire.sources.tables import document_lines, joined_text, keep_first_content, laid_out, systematic_sample, table

LINES = "SELECT source AS book, doc_id AS page, i - 1 AS line_no, text FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(text) <> ''"
KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[0-9০-৯]+', '#', 'g'), '\b[ivxlcdm]{{1,7}}\b', '#', 'g'), '[^\pL\pM#]+', ' ', 'g'))"
WORDS = r"regexp_extract_all(lower({0}), '[\pL\pM\pN]+')"
TOKENS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
LAID = f"SELECT *, CASE WHEN line_no % 7 = 0 THEN 68.0 ELSE 54.0 END AS x0, 20.0 + line_no * 15 AS y0, CASE WHEN line_no % 7 = 0 THEN 68.0 ELSE 54.0 END + length(text) * 5 AS x1, 20.0 + line_no * 15 + CASE WHEN line_no = 0 THEN 14.0 ELSE 11.0 END AS y1, CASE WHEN line_no = 0 THEN 14.0 ELSE 11.0 END AS size, 648.0 AS height FROM ({LINES})"
PAGE_NUMBER = r"(?i)^[\s\-–—|•·]*[\[{(]?(page\s+|পৃষ্ঠা\s*[:ঃ]?\s*|পৃ[.ঃ]\s*)?([0-9০-৯]{1,4}|[ivxlcdm]{1,7})(\s*(of|/)\s*[0-9০-৯]{1,4})?[\]})]?[\s\-–—|•·]*$"
CONTENTS = r"(\.\s*){4,}\s*[0-9০-৯]{1,4}\s*$|(…\s*){2,}\s*[0-9০-৯]{1,4}\s*$"
BARE = r"(?i)^[\[{(]?([0-9০-৯]{1,4}|[ivxlcdm]{1,7})[\]})]?$"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return document_lines(table(spark, sf, "documents"))


@query(f"SELECT page, line_no, {KEY.format('text')} AS key FROM ({LINES})")
def header_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("page", "line_no", t.header_key(F.col("text")).alias("key"))


@query(f"""SELECT regexp_matches(w, '{PAGE_NUMBER}') AS page_number, regexp_matches(w, '{BARE}') AS bare, regexp_matches(w, '{CONTENTS}') AS contents,
regexp_matches(w, '^(["“‘(]?\\p{{Lu}}|["“‘])$') AS drop_cap, regexp_matches(w, '[\\pL\\pN]') AS speakable, count(*) AS n
FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) GROUP BY ALL""".replace("['“", "[\"'“"))
def token_classes(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("w")
    rows = table(spark, sf, "documents").select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    classes = [t.is_page_number(w).alias("page_number"), t.is_bare_number(w).alias("bare"), t.is_contents_leader(w).alias("contents"), w.rlike(r'^(["“‘(]?\p{Lu}|["“‘])$').alias("drop_cap"), t.is_speakable(w).alias("speakable")]
    return rows.groupBy(*classes).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT book, {KEY.format('text')} AS key, count(DISTINCT page) AS pages FROM ({LINES}) GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2")
def repeated_headers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).groupBy("book", t.header_key(F.col("text")).alias("key")).agg(F.countDistinct("page").alias("pages"))
    return rows.where("pages >= 2")


_BODY = f"""WITH l AS ({LAID}), k AS (SELECT book, floor(size * 2 + 0.5) / 2 AS k, sum(length(text)) AS w, min((page, line_no)) AS o FROM l GROUP BY 1, 2),
body AS (SELECT book, k AS body FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY w DESC, o) AS r FROM k) WHERE r = 1)"""


@query(_BODY + " SELECT * FROM body")
def body_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return furniture.body_size(laid_out(_lines(spark, sf)))


def furniture_sql() -> str:
    return (
        _BODY
        + f""", n AS (SELECT book, count(DISTINCT page) AS pages FROM l GROUP BY 1),
b AS (SELECT body.*, CASE WHEN pages <= 4 THEN 2 ELSE greatest(3, ceil(pages * 0.2)) END AS strong FROM body JOIN n USING (book)),
f AS (SELECT l.book, strong, CASE WHEN (y0 + y1) / 2 <= height * 0.25 THEN 'top' WHEN (y0 + y1) / 2 >= height * 0.75 THEN 'bottom' END AS edge, (y0 + y1) / 2 AS c, height
      FROM l JOIN b USING (book) WHERE regexp_matches(text, '{PAGE_NUMBER}') AND regexp_matches(text, '[0-9০-৯]') AND size <= body * 1.15),
d AS (SELECT book, strong, edge, CASE WHEN edge = 'top' THEN c ELSE height - c END AS d FROM f WHERE edge IS NOT NULL),
w AS (SELECT book, strong, edge, d AS hi, count(*) OVER x AS n, min(d) OVER x AS lo FROM d WINDOW x AS (PARTITION BY book, edge ORDER BY d RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)),
e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book, edge ORDER BY n DESC, hi) AS r FROM w) WHERE r = 1 AND n >= strong),
g AS (SELECT book, max(lo) FILTER (edge = 'top') AS tlo, max(hi) FILTER (edge = 'top') AS thi, max(lo) FILTER (edge = 'bottom') AS blo, max(hi) FILTER (edge = 'bottom') AS bhi FROM e GROUP BY 1),
z AS (SELECT l.*, b.body, b.strong, g.tlo, g.thi, g.blo, g.bhi, {KEY.format('text')} AS key,
      CASE WHEN y1 <= CASE WHEN thi IS NULL THEN greatest(36, height * 0.09) ELSE least(height * 0.25, greatest(36, height * 0.09, thi + body)) END THEN 'top'
           WHEN y0 >= height - CASE WHEN bhi IS NULL THEN greatest(36, height * 0.09) ELSE least(height * 0.25, greatest(36, height * 0.09, bhi + body)) END THEN 'bottom' END AS zone
      FROM l JOIN b USING (book) LEFT JOIN g USING (book)),
c AS (SELECT book, zone, key, count(DISTINCT page) AS seen FROM z WHERE zone IS NOT NULL AND key <> '' GROUP BY 1, 2, 3),
r AS (SELECT z.*, len({TOKENS.format('text')}) AS words, seen, CASE WHEN z.zone = 'top' THEN (y0 + y1) / 2 ELSE height - (y0 + y1) / 2 END AS dist, CASE WHEN z.zone = 'top' THEN tlo ELSE blo END AS lo, CASE WHEN z.zone = 'top' THEN thi ELSE bhi END AS hi
      FROM z LEFT JOIN c ON c.book = z.book AND c.zone = z.zone AND c.key = z.key)
SELECT page, line_no, zone, CASE WHEN regexp_matches(text, '{CONTENTS}') THEN 'contents' WHEN regexp_matches(text, '{BARE}') AND size <= body * 0.85 THEN 'page number' WHEN zone IS NULL THEN NULL
  WHEN regexp_matches(text, '{PAGE_NUMBER}') AND size <= body * 1.15 THEN 'page number' WHEN words = 1 AND length(text) <= 4 AND size <= body * 1.6 AND dist >= lo - 3 AND dist <= hi + 3 THEN 'page number'
  WHEN key = '' THEN NULL WHEN seen >= strong OR (seen >= 3 AND size <= body * 1.1 AND words <= 12) THEN CASE WHEN zone = 'top' THEN 'header' ELSE 'footer' END END AS reason FROM r"""
    )


@query(furniture_sql())
def furniture_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return furniture.classified(laid_out(_lines(spark, sf))).select("page", "line_no", "zone", "reason")


@query(f"""WITH l AS (SELECT book, page, line_no, {TOKENS.format('text')} AS t FROM ({LINES})),
m AS (SELECT *, coalesce(regexp_matches(t[-1], '[\\pL\\pM][-\\x{{2010}}\\x{{2011}}\\x{{AD}}]$'), false) AS broken FROM l),
n AS (SELECT *, coalesce(lag(broken) OVER (PARTITION BY book ORDER BY page, line_no), false) AS after FROM m),
w AS (SELECT book, unnest(list_filter(t, lambda x, i: NOT (i = 1 AND after) AND NOT (i = len(t) AND broken))) AS w FROM n)
SELECT DISTINCT book, regexp_replace(lower(w), '^[^\\pL\\pN]+|[^\\pL\\pM\\pN]+$', '', 'g') AS word FROM w WHERE regexp_replace(lower(w), '^[^\\pL\\pN]+|[^\\pL\\pM\\pN]+$', '', 'g') <> ''""")
def book_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return furniture.vocabulary(_lines(spark, sf))


@query(f"""SELECT doc_id, list_sort({WORDS.format('text')})[1] AS first_word, len({WORDS.format('text')}) AS words,
CASE WHEN len({WORDS.format('text')}) < 3 THEN 0 ELSE len(list_distinct([concat_ws(' ', w[i], w[i + 1], w[i + 2]) for i in range(1, len(w) - 1)])) END AS shingles FROM (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents)""")
def word_shingles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", t.words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.array_min("w").alias("first_word"), F.size("w").alias("words"), F.size(t.runs_of("w", 3)).alias("shingles"))


_SETS = f"SELECT id, list_distinct([concat_ws(' ', w[i], w[i + 1], w[i + 2]) for i in range(1, len(w) - 1)]) AS s FROM (SELECT {{0}} AS id, {WORDS.format('text')} AS w FROM {{1}}) WHERE len(w) >= 3"


@query(f"""WITH s AS ({_SETS.format('doc_id', 'documents')}), x AS (SELECT id, len(s) AS n, unnest(s) AS x FROM s WHERE len(s) >= 4),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2)
SELECT a, b, 'script' AS why FROM p WHERE m / (na + nb - m) >= 0.4""")
def similar_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.lit("").alias("title"), "text")
    return similarity.similar_pairs(docs, "doc_id", "title", "text")


@query(f"""WITH d AS ({_SETS.format('doc_id', 'documents')}), b AS ({_SETS.format('item_id', 'benchmark')}),
x AS (SELECT id, unnest(s) AS x FROM d), y AS (SELECT id, len(s) AS n, unnest(s) AS x FROM b)
SELECT x.id AS doc, y.id AS passage, count(*) AS shared, n AS "of" FROM x JOIN y ON x.x = y.x GROUP BY x.id, y.id, n HAVING count(*) / n >= 0.6""")
def contained_passages(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    return similarity.contained(docs, items.withColumnRenamed("item_id", "doc_id"), "doc_id", "doc_id", "text")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS t, text FROM documents),
c AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: regexp_matches(x, '^\\pL$'))) AS one, len(list_filter(t, lambda x: regexp_matches(x, '^\\pL{{26,}}$'))) AS glued, length(regexp_replace(text, '[^\\pL]', '', 'g')) AS letters,
 length(regexp_replace(text, '[\\pL\\pM\\pN\\pZ\\pP$%&+=<>|~^`°§¶©®™±×÷€£¥¢\\x{{2010}}-\\x{{2015}}\\x{{200C}}\\x{{200D}}]', '', 'g')) AS odd, regexp_matches(text, '[\\x{{FFFD}}\\x{{FB00}}-\\x{{FB06}}]') AS lig FROM t)
SELECT doc_id, (n >= 6 AND one / greatest(n, 1) > 0.5) OR lig OR (letters >= 20 AND odd / greatest(letters, 1) > 0.08) OR glued >= 2 AS damaged FROM c""")
def damaged_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.is_damaged(F.col("text")).alias("damaged"))


@query("""WITH c AS (SELECT doc_id, text, substr(text, 1, 179) AS cut FROM documents), s AS (SELECT *, CASE WHEN contains(cut, ' ') THEN length(cut) - strpos(reverse(cut), ' ') ELSE -1 END AS space FROM c)
SELECT doc_id, CASE WHEN length(text) <= 180 THEN text ELSE rtrim(CASE WHEN space > 180 * 0.6 THEN substr(cut, 1, space) ELSE cut END) || '…' END AS preview FROM s""")
def previews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.clip(F.col("text"), 180).alias("preview"))


@query(r"""WITH p AS (SELECT page_id, list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '(?i)https?://\S+|www\.\S+', '', 'g'), '[<>]', '', 'g'), chr(10)),
 lambda x: NOT regexp_matches(x, '^\s*([0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2}\b') AND NOT regexp_matches(x, '^\s*(#[\pL\pM\pN_]+\s*)+$')), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))) AS l FROM pages),
j AS (SELECT page_id, regexp_replace(regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM p),
c AS (SELECT *, substr(text, 1, 299) AS cut FROM j), s AS (SELECT *, CASE WHEN contains(cut, ' ') THEN length(cut) - strpos(reverse(cut), ' ') ELSE -1 END AS space FROM c)
SELECT page_id, CASE WHEN length(text) <= 300 THEN text ELSE rtrim(CASE WHEN space > 180 THEN substr(cut, 1, space) ELSE cut END) || '…' END AS text FROM s""")
def cleaned_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", t.clean_text(F.col("html"), 300).alias("text"))


@query(r"""SELECT book, size AS median_length, lo AS p10, hi AS p90 FROM (SELECT book, median(n) AS size, list_sort(list(n))[CAST(floor(0.1 * (count(*) - 1) + 0.5) AS INT) + 1] AS lo, list_sort(list(n))[CAST(floor(0.9 * (count(*) - 1) + 0.5) AS INT) + 1] AS hi
FROM (SELECT book, length(text) AS n FROM (""" + LINES + ")) GROUP BY book)")
def line_lengths(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).select("book", F.length("text").alias("n"))
    middle = rows.groupBy("book").agg(statistics.median(F.col("n")).alias("median_length"))
    return middle.join(statistics.nearest_ranks(rows, ["book"], "n", {"p10": 10, "p90": 90}), "book")


@query(f"""WITH w AS (SELECT source, unnest({TOKENS.format('text')}) AS w FROM documents),
k AS (SELECT source, regexp_replace(regexp_replace(lower(w), '^[^\\pL\\pN]+', ''), '[,;:!?"''”’)\\]]+$', '') AS word, regexp_matches(w, '^[^\\pL]*\\p{{Ll}}') AS low FROM w)
SELECT source, word, count(*) AS n, count(*) FILTER (low) AS n_lower FROM k WHERE word <> '' GROUP BY 1, 2""")
def word_form_counts(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.word_counts(table(spark, sf, "documents"), "source")


@query(f"""WITH t AS (SELECT source, {TOKENS.format('text')} AS t FROM documents), p AS (SELECT source, unnest(range(2, len(t) + 1)) AS i, t FROM t),
q AS (SELECT source, t[i - 1] AS x, regexp_replace(regexp_replace(lower(t[i - 1]), '^[^\\pL\\pN]+', ''), '[,;:!?"''”’)\\]]+$', '') AS a, regexp_replace(regexp_replace(lower(t[i]), '^[^\\pL\\pN]+', ''), '[,;:!?"''”’)\\]]+$', '') AS b FROM p)
SELECT source, regexp_replace(a, '\\.$', '') || ' ' || b AS pair, count(*) AS n FROM q WHERE a <> '' AND b <> '' AND NOT (regexp_matches(x, '[.!?]["''”’)]*$') AND NOT regexp_matches(x, '^\\p{{Lu}}\\p{{Ll}}?\\.$')) GROUP BY 1, 2""")
def word_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.word_pairs(table(spark, sf, "documents"), "source")


@query(f"""WITH t AS (SELECT source, doc_id, {TOKENS.format('text')} AS t FROM documents), p AS (SELECT source, doc_id, t, unnest(range(2, len(t) + 1)) AS i FROM t),
q AS (SELECT source, doc_id, i, regexp_extract(t[i], '^(\\p{{Lu}}\\p{{Ll}}+)', 1) AS name FROM p WHERE regexp_matches(t[i], '^\\p{{Lu}}\\p{{Ll}}+') AND NOT regexp_matches(t[i - 1], '[.!?…।॥]["''”’)\\]]*$')),
c AS (SELECT source, name, count(*) AS n, min((doc_id, i)) AS o FROM q GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT source, name, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, o) AS rank FROM c)
SELECT * FROM r WHERE rank <= 150""")
def names_in_sources(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.name_candidates(table(spark, sf, "documents"), "source", "doc_id")


_SPOKEN = r"length(regexp_replace(w, '[^\pL\pM\pN]+|[\x{09BC}\x{09CD}]', '', 'g'))"
_WEIGHT = rf"""CASE WHEN {_SPOKEN} = 0 THEN 0.5 ELSE {_SPOKEN} + length(regexp_replace(w, '[^\pN]+', '', 'g')) * 1.5 + 1 + CASE WHEN last OR regexp_matches(w, '(?i)^(?:mr|mrs|ms|dr|st|jr|sr|prof|rev|gen|capt|col|lt|sgt|vs|etc|no|vol|fig|p|pp|ch)\.$|^(?:\pL\pM*\.)+$') THEN 0.0
 WHEN regexp_matches(w, '[—–-]$') THEN 2.0 WHEN regexp_matches(w, '[.!?…।॥]["''”’)\]]*$') THEN 5.0 WHEN regexp_matches(w, '[;:]$') THEN 4.0 WHEN regexp_matches(w, '[,)\]”’"'']$') THEN 2.5 ELSE 0.0 END END"""


@query(f"""WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), x AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) = len(t) AS last FROM t)
SELECT doc_id, sum({_WEIGHT}) AS weight FROM x GROUP BY 1""")
def speech_weights(spark: SparkSession, sf: str) -> DataFrame:
    own = t.let(t.tokens(F.col("text")), lambda w: F.transform(w, lambda x, i: F.struct(x.alias("w"), (i == F.size(w) - 1).alias("last"))))
    rows = table(spark, sf, "documents").select("doc_id", F.explode(own).alias("x"))
    return rows.groupBy("doc_id").agg(F.sum(speech_weight(F.col("x.w"), F.col("x.last"))).alias("weight"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN url LIKE 'https://%' THEN 'https' ELSE 'http' END AS scheme, coalesce(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), ''), NULL) AS page,
'https://library.example/search?q=' || replace(replace(replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '%', '%25'), ' ', '%20'), ':', '%3A') AS search FROM pages""")
def link_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    host = F.parse_url(url, F.lit("HOST"))
    search = F.concat(F.lit("https://library.example/search?q="), F.replace(F.url_encode(host), F.lit("+"), F.lit("%20")))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), F.parse_url(url, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(url, F.lit("QUERY"), F.lit("page")).alias("page"), search.alias("search"))


@query("""SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1""")
def upload_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return keep_first_content(table(spark, sf, "documents"), "text", "doc_id")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE n <= 12 OR floor((k + 1) * 12 / n) > floor(k * 12 / n)""")
def sampled_pages(spark: SparkSession, sf: str) -> DataFrame:
    return systematic_sample(table(spark, sf, "documents"), "source", "doc_id", 12).select("doc_id", "source")


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role || ': ' || text) AS text FROM conversations GROUP BY 1""")
def conversation_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("said"))
    return joined_text(rows, ["conv_id"], "turn", "said", "\n")


@query(
    r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\pL\pM\pN]+'), lambda w: replace(upper(substr(w, 1, 1)), 'ẞ', 'SS') || substr(w, 2)), '') AS camel,
regexp_replace(substr(regexp_replace(regexp_replace(lower(text), '[^\pL\pM\pN]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug,
substr(regexp_replace(regexp_replace(text, '^#+', ''), '[^\pL\pM\pN_]', '', 'g'), 1, 50) AS hashtag,
trim(substr(trim(regexp_replace(regexp_replace(text, '[<>,"#]', ' ', 'g'), '\s+', ' ', 'g')), 1, 60)) AS tag FROM documents""")
def names_from_titles(spark: SparkSession, sf: str) -> DataFrame:
    own = F.col("text")
    return table(spark, sf, "documents").select("doc_id", t.camel_tag(own).alias("camel"), t.slug(own).alias("slug"), t.sanitize_hashtag(own).alias("hashtag"), t.sanitize_tag(own).alias("tag"))


@query(r"""WITH d AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '[\pL\pN][\pL\pM\pN''’]*') AS have, regexp_extract_all('the of', '[\pL\pN][\pL\pM\pN''’]*') AS want FROM documents)
SELECT doc_id, CASE WHEN list_has_all(have, want) THEN strpos(t, 'the') - 1 ELSE -1 END AS at FROM d""")
def phrase_places(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.phrase_index(F.col("text"), F.lit("the of")).alias("at"))


@query()  # DuckDB's distance counts bytes, Spark's counts characters
def neighbour_similarity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "text")
    other = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"), F.col("doc_id").alias("b"))
    joined = spread(rows, "doc_id").join(other, "doc_id")
    return joined.select(F.col("doc_id").alias("a"), "b", rounded(t.letter_similarity(F.col("text"), F.col("next")), 4).alias("similarity"))


@query()
def document_sentences(spark: SparkSession, sf: str) -> DataFrame:
    small_batches(spark)
    rows = table(spark, sf, "documents").select("doc_id", F.explode(q.split_sentences("text")).alias("s"))
    return rows.select("doc_id", "s.idx", "s.start", "s.end", "s.text")


@query()
def narration_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.narration(F.col("text")).alias("narration"), t.heading_narration(F.col("text")).alias("heading"))


@query()
def caption_chunks(spark: SparkSession, sf: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf, "documents").select("doc_id", F.posexplode(q.split_cues("text")).alias("idx", "text"))


@query()
def script_parts(spark: SparkSession, sf: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.posexplode(q.split_scripts("text", F.lit(4))).alias("part", "text"))


@query()
def turn_differences(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf, "conversations").withColumn("before", before).where("before IS NOT NULL")
    return rows.select("conv_id", "turn", F.posexplode(q.diff_texts("before", "text")).alias("idx", "run")).select("conv_id", "turn", "idx", "run.kind", "run.text")


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    lines = laid_out(_lines(spark, sf)).withColumn("bold", F.lit(False)).withColumn("body", F.lit(11.0))
    return structure.paragraphs(lines)


@query()
def book_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _paragraphs(spark, sf).drop("bold")


@query()
def book_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return structure.chapters(_paragraphs(spark, sf))


@query()
def word_anchors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").withColumn("spoken", t.narration(F.col("text")))
    return rows.select("item_id", F.explode(q.align_words("text", "spoken")).alias("a")).select("item_id", "a.i", "a.j")
