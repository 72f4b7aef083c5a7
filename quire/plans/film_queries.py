"""Queries on camera moves, excerpts within a budget, broken Bangla words, checked files and checked answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import bangla, engines
from quire.functions.times import rounded
from quire.operators import budgets, camera
from quire.plans.registry import query
from quire.sources import checked
from quire.sources.stages import shared_folder
from quire.sources.tables import table

#: Characters for the digits 0 to 9: letters, signs, a hasanta, a nukta and a joiner, so that numbers become clusters of all kinds.
CLUSTERS = "কিেরা্অ়‍ৗ"


@query(f"""WITH w AS (SELECT o_orderkey, translate((o_orderkey * 7919 % 1000003)::VARCHAR, '0123456789', '{CLUSTERS}') AS word FROM orders), c AS (SELECT *, list_transform(range(1, length(word) + 1), lambda i: unicode(substr(word, i, 1))) AS c FROM w),
p AS (SELECT *, list_transform(range(1, len(c) + 1), lambda i: [c[i], CASE WHEN i = 1 THEN 0 ELSE c[i - 1] END]) AS pairs FROM c)
SELECT o_orderkey, word, c[1] IN (8204, 8205) OR c[len(c)] IN (8204, 8205) OR len(list_filter(pairs, lambda x: (x[1] = 2492 OR x[1] BETWEEN 2494 AND 2509 OR x[1] = 2519) AND x[1] <> x[2]
AND NOT (x[2] BETWEEN 2453 AND 2489 OR x[2] IN (2510, 2524, 2525, 2527, 2544, 2545, 2492) OR (x[1] = 2509 AND x[2] IN (8204, 8205)) OR (x[1] IN (2494, 2519) AND x[2] = 2503)))) > 0 AS broken FROM p""")
def broken_bangla_words(spark: SparkSession, sf: str) -> DataFrame:
    word = F.translate((F.col("o_orderkey") * 7919 % 1000003).cast("string"), "0123456789", CLUSTERS)
    words = table(spark, sf, "orders").select("o_orderkey", word.alias("word"))
    return words.withColumn("broken", bangla.is_broken(F.col("word")))


@query("""WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE text <> ''),
k AS (SELECT * FROM r WHERE p >= n // 3 AND p < n // 3 + 600 AND doc_id % 5 <> 0), c AS (SELECT *, sum(length(text) + 1) OVER w - 1 AS c, row_number() OVER w AS j FROM k WINDOW w AS (PARTITION BY source ORDER BY p))
SELECT source, count(*) AS n_texts, string_agg(text, ' ' ORDER BY p) AS text FROM c WHERE c + (j = 1)::INT <= 20000 GROUP BY 1""")
def source_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return budgets.excerpts(table(spark, sf, "documents"), ["source"], ["doc_id"], "text", 20000, part=1, parts=3, passes=F.col("doc_id") % 5 != 0)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS run, l_linenumber AS k, l_linenumber * 2.0 AS t0, l_orderkey * l_linenumber % 50 * 12.0 AS y FROM lineitem), m AS (SELECT *, coalesce(lag(y) OVER (PARTITION BY run ORDER BY k), y) AS y_from, CASE WHEN k % 3 = 0 THEN 0.0 ELSE 0.5 + k % 2 END AS s FROM l),
t AS (SELECT DISTINCT run, unnest([0.5, 2.25, 4.75, 6.0, 9.0]) AS t FROM l), j AS (SELECT t.run, t.t, max(m.k) AS k FROM t LEFT JOIN m ON m.run = t.run AND m.t0 <= t.t GROUP BY 1, 2), f AS (SELECT run, min_by(y_from, k) AS y FROM m GROUP BY 1),
u AS (SELECT j.run, j.t, j.k, f.y AS first_y, m.y_from, m.y, m.s, CASE WHEN m.s > 0 THEN least(1, (j.t - m.t0) / m.s) ELSE 1 END AS u FROM j JOIN f ON f.run = j.run LEFT JOIN m ON m.run = j.run AND m.k = j.k)
SELECT run, t, k, floor(coalesce(y_from + (y - y_from) * u * u * u * (u * (u * 6 - 15) + 10), first_y) * 100 + 0.5) / 100 AS y FROM u""")
def camera_places(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), n.alias("k"), (n * 2.0).alias("t0"), (F.col("l_orderkey") * n % 50 * 12.0).alias("y_to")).distinct()
    moves = camera.joined_moves(lines, ["run"]).withColumn("seconds", F.when(F.col("k") % 3 == 0, 0.0).otherwise(0.5 + F.col("k") % 2))
    times = lines.select("run").distinct().select("run", F.explode(F.array(*[F.lit(x) for x in (0.5, 2.25, 4.75, 6.0, 9.0)])).alias("t"))
    return camera.at(moves, times, ["run"]).select("run", "t", "k", rounded(F.col("y"), 2).alias("y"))


@query("""SELECT source, CASE WHEN doc_id % 7 = 0 THEN 'corrupt' END AS reason, count(*) AS n_lines, sum(CASE WHEN doc_id % 7 > 0 THEN doc_id END) AS pages, sum(CASE WHEN doc_id % 7 > 0 THEN length(text) END) AS n_chars FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2""")
def checked_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as lines of page files, one in seven cut short, read back with what is wrong with each."""
    folder = f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents").where("source IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    line = F.to_json(F.struct(F.col("doc_id").alias("page"), "source", "text"))
    docs.select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit('{"page": '), F.col("doc_id").cast("string"))).otherwise(line).alias("line"), F.col("source").alias("book")).write.partitionBy("book").text(folder)
    checked.register(spark)
    rows = spark.read.format("checked_pages").load(folder)
    found = rows.select(F.regexp_extract("path", "book=([^/]*)", 1).alias("source"), "reason", "page", F.length(F.get_json_object("line", "$.text")).alias("n"))
    return found.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("page").alias("pages"), F.sum("n").alias("n_chars"))


@query(r"""WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, length(text) % 8 AS words, doc_id % 3 > 0 AS images, count(*) OVER (PARTITION BY source) AS n FROM documents),
s AS (SELECT DISTINCT source, i * (n - 1) // 11 AS k FROM p, (SELECT unnest(range(12)) AS i) WHERE i < n), j AS (SELECT p.* FROM p JOIN s ON s.source = p.source AND s.k = p.k)
SELECT source, n AS n_pages, floor(sum(words) / count(*) * n)::BIGINT AS estimated_words, count(*) FILTER (words < 5 AND images) >= greatest(1, floor(count(*) * 0.6)) AS likely_scanned FROM j GROUP BY source, n""")
def inspected_sources(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "documents").select("source", "doc_id", (F.length("text") % 8).alias("words"), (F.col("doc_id") % 3 > 0).alias("images"))
    return checked.inspected(pages, ["source"], "doc_id", "words", "images")


@query("""WITH a AS (SELECT p_partkey, p_name, p_size, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '{"title": "' || p_name || '"' WHEN 2 THEN '{"title": "' || p_name || '"}' WHEN 3 THEN '{"title": "' || p_name || '", "rank": ' || p_size || '}'
WHEN 4 THEN '```json' || chr(10) || '{"rank": ' || p_size || ', "title": "' || p_name || '"}' || chr(10) || '```' ELSE '[1, 2]' END AS answer FROM part),
r AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'form' WHEN 2 THEN 'field: rank' WHEN 5 THEN 'form' ELSE CASE WHEN p_size > 40 THEN 'rule: rank' END END AS reason FROM a)
SELECT p_partkey, answer, reason, CASE WHEN reason IS NULL THEN p_name ELSE upper(p_name) END AS title, CASE WHEN reason IS NULL THEN p_size ELSE 0 END AS rank FROM r""")
def checked_answers(spark: SparkSession, sf: str) -> DataFrame:
    name, size, kind = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey") % 6
    given = F.concat(F.lit('{"title": "'), name, F.lit('"'))
    answer = (
        F.when(kind == 0, F.lit(None)).when(kind == 1, given).when(kind == 2, F.concat(given, F.lit("}"))).when(kind == 3, F.concat(given, F.lit(', "rank": '), size, F.lit("}")))
        .when(kind == 4, F.concat(F.lit('```json\n{"rank": '), size, F.lit(', "title": "'), name, F.lit('"}\n```'))).otherwise("[1, 2]")
    )
    answers = table(spark, sf, "part").select("p_partkey", "p_name", answer.alias("answer"))
    shape = T.StructType([T.StructField("title", T.StringType()), T.StructField("rank", T.IntegerType())])
    found = engines.checked(answers, shape, {"title": lambda x: F.length(x).between(1, 100), "rank": lambda x: x <= 40}, F.struct(F.upper("p_name").alias("title"), F.lit(0).alias("rank")))
    return found.select("p_partkey", "answer", "reason", "value.title", "value.rank")
