"""Queries over the catalogue tables, events and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import sequences as q
from quire.functions import text as t
from quire.functions import times as tm
from quire.operators import catalog, statistics, timeline
from quire.plans import lineage
from quire.plans.registry import query
from quire.sources.scripts import read_script_batch
from quire.sources.stages import small_batches, spread
from quire.sources.tables import latest_per_key, table
from quire.streaming import progress, timed

# --- conversations as chapters (conv_id) of paragraphs (turn) ---------------------------------------------------------

TOKENS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
TURNS = f"SELECT conv_id, turn, role, text, len({TOKENS.format('text')}) * 0.5 AS dur FROM conversations"
OFFSETS = f"SELECT *, coalesce(sum(dur) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ({TURNS})"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of unique (conv_id, turn), with half a second a word and their start."""
    rows = table(spark, sf, "conversations").withColumn("dur", F.size(t.tokens(F.col("text"))) * 0.5)
    return rows.withColumn("start", timeline.exclusive_sum(F.col("dur"), ["conv_id"], "turn"))


@query(f"SELECT conv_id, turn, start, start + dur AS \"end\" FROM ({OFFSETS})")
def turn_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf).select("conv_id", "turn", "start", (F.col("start") + F.col("dur")).alias("end"))


@query(f"""WITH t AS ({OFFSETS}), s AS (SELECT *, floor(start * 1000 + 0.5)::BIGINT AS a, floor((start + dur) * 1000 + 0.5)::BIGINT AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t),
f AS (SELECT conv_id, turn, n || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, a // 60000 % 60, a // 1000 % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b // 60000 % 60, b // 1000 % 60, b % 1000) || chr(10) || role || chr(10) AS cue FROM s)
SELECT conv_id, string_agg(cue, chr(10) ORDER BY turn) AS text FROM f GROUP BY 1""")
def subtitle_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    cue = F.concat(F.col("n").cast("string"), F.lit("\n"), tm.srt_time(F.col("start")), F.lit(" --> "), tm.srt_time(F.col("start") + F.col("dur")), F.lit("\n"), F.col("role"), F.lit("\n"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("x"))
    return listed.select("conv_id", F.array_join(F.transform("x", lambda x: x["cue"]), "\n").alias("text"))


@query(f"""WITH t AS ({OFFSETS}), s AS (SELECT conv_id, turn, floor(start)::BIGINT AS s, role, max(start) OVER (PARTITION BY conv_id) >= 3600 AS long FROM t)
SELECT conv_id, string_agg(CASE WHEN long THEN (s // 3600) || ':' ELSE '' END || printf('%02d:%02d', s // 60 % 60, s % 60) || ' ' || role, chr(10) ORDER BY turn) AS text FROM s GROUP BY 1""")
def chapter_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).withColumn("long", F.max("start").over(Window.partitionBy("conv_id")) >= 3600)
    line = F.concat(tm.chapter_time(F.col("start"), F.col("long")), F.lit(" "), F.col("role"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return listed.select("conv_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


@query(f"""WITH c AS (SELECT conv_id, turn, start, start + dur AS e FROM ({OFFSETS})), g AS (SELECT conv_id, count(*) AS n, floor(min(start)) AS first, count(*) FILTER (e - start < 10) AS short FROM c GROUP BY 1)
SELECT conv_id, CASE WHEN n < 3 THEN 'few' WHEN first <> 0 THEN 'first' WHEN short > 0 THEN 'short' END AS problem FROM g""")
def chapter_problems(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.chapters_problem(_turns(spark, sf).withColumn("end", F.col("start") + F.col("dur")), "conv_id")


@query(f"""WITH w AS (SELECT conv_id, turn, start, dur, unnest({TOKENS.format('text')}) AS word, generate_subscripts({TOKENS.format('text')}, 1) AS i FROM ({OFFSETS})),
x AS (SELECT *, (length(word) + 1)::DOUBLE AS wt FROM w), r AS (SELECT *, sum(wt) OVER (PARTITION BY conv_id, turn) AS total, coalesce(sum(wt) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, i = max(i) OVER (PARTITION BY conv_id, turn) AS last FROM x)
SELECT conv_id, turn, i - 1 AS word_no, floor((start + dur * before / total) * 1000 + 0.5) / 1000 AS start, floor(CASE WHEN last THEN start + dur ELSE start + dur * (before + wt) / total END * 1000 + 0.5) / 1000 AS "end" FROM r""")
def word_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).withColumn("stop", F.col("start") + F.col("dur")).select("conv_id", "turn", "start", "stop", F.posexplode(t.tokens(F.col("text"))).alias("word_no", "word"))
    timed = timeline.shares(rows, ["conv_id", "turn"], ["word_no"], (F.length("word") + 1).cast("double"), "start", "stop", "a", "b")
    return timed.select("conv_id", "turn", "word_no", tm.rounded(F.col("a"), 3).alias("start"), tm.rounded(F.col("b"), 3).alias("end"))


@query(f"""WITH d AS (SELECT conv_id AS doc_id, turn AS chapter, dur FROM ({TURNS})), o AS (SELECT *, coalesce(sum(dur) OVER (PARTITION BY doc_id ORDER BY chapter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM d),
r AS (SELECT conv_id AS doc_id, turn AS sentence_id, p AS page, length(text) % 7 + p AS chars FROM conversations, (SELECT unnest([0, 1]) AS p)),
t AS (SELECT o.doc_id, o.chapter, o.chapter AS sentence_id, off AS a, off + dur AS b FROM o WHERE dur > 0),
j AS (SELECT t.*, r.page, greatest(1, r.chars)::DOUBLE AS w FROM t JOIN r USING (doc_id, sentence_id)),
s AS (SELECT *, sum(w) OVER k AS total, coalesce(sum(w) OVER (PARTITION BY doc_id, chapter, sentence_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, lead(1) OVER (PARTITION BY doc_id, chapter, sentence_id ORDER BY page) IS NULL AS last FROM j WINDOW k AS (PARTITION BY doc_id, chapter, sentence_id))
SELECT doc_id, row_number() OVER w - 1 AS i, chapter, sentence_id, page, floor((a + (b - a) * before / total) * 10000 + 0.5) / 10000 AS start, floor(CASE WHEN last THEN b ELSE a + (b - a) * (before + s.w) / total END * 10000 + 0.5) / 10000 AS "end", coalesce(page <> lag(page) OVER w, true) AS page_change FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY chapter, a, sentence_id, page)""")
def built_timeline(spark: SparkSession, sf: str) -> DataFrame:
    turns = _turns(spark, sf)
    durations = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chapter"), F.col("dur").alias("duration"))
    timings = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chapter"), F.col("turn").alias("sentence_id"), F.lit(0.0).alias("start"), F.col("dur").alias("end"))
    regions = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sentence_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page"), F.length("text").alias("n"))
    return timeline.build(timings, regions.withColumn("chars", F.col("n") % 7 + F.col("page")).drop("n"), durations)


@query("""SELECT conv_id, turn, CASE WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 1000 ELSE 600 + CASE WHEN role = 'system' THEN 250 ELSE 0 END END AS pause_ms FROM conversations""")
def turn_pauses(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("chapter"), F.col("turn").alias("paragraph"), F.lit(0).alias("sentence"), (F.col("role") == "system").alias("heading"))
    return timeline.pauses(rows, [], 300, 600, 1000).select(F.col("chapter").alias("conv_id"), F.col("paragraph").alias("turn"), "pause_ms")


@query(f"""SELECT conv_id, count(*) AS turns, sum(len({TOKENS.format('text')})) AS words, sum(length(text)) AS chars FROM conversations GROUP BY GROUPING SETS ((conv_id), ())""")
def conversation_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn("w", F.size(t.tokens(F.col("text"))))
    return rows.rollup("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("w").alias("words"), F.sum(F.length("text")).alias("chars"))


@query()
def caption_cards(spark: SparkSession, sf: str) -> DataFrame:
    small_batches(spark)
    words = timeline.word_times(_turns(spark, sf).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", F.col("start"), (F.col("start") + F.col("dur")).alias("end")), "id")
    listed = words.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("word_no", F.col("word").alias("t"), "start", "end"))).alias("w"), F.max("end").alias("total"))
    return listed.select("id", F.posexplode(q.group_captions("w", "total")).alias("idx", "card")).select("id", "idx", "card.start", "card.end", F.array_join("card.words", " ").alias("text"))


@query()
def script_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Texts pasted as a batch of two labelled scripts each, read again."""
    own = F.regexp_replace("text", r"\s+", " ")
    title = F.regexp_extract(own, r"^\s*(\S+)", 1)
    pasted = F.concat(F.lit("Title: "), title, F.lit("\nScript: "), own, F.lit("\n---\nTitle: Next\nScript: "), own)
    rows = table(spark, sf, "documents").where("text rlike '[A-Za-z]'").select("doc_id", read_script_batch(pasted).alias("b"))
    return rows.select("doc_id", F.col("b.format").alias("format"), F.posexplode("b.items").alias("idx", "x")).select("doc_id", "format", "idx", "x.title", "x.script")


PARTED = f"""WITH o AS ({OFFSETS}), w AS (SELECT conv_id, turn, start, dur, unnest({TOKENS.format('text')}) AS word, generate_subscripts({TOKENS.format('text')}, 1) - 1 AS k FROM o),
x AS (SELECT *, (length(word) + 1)::DOUBLE AS wt FROM w), r AS (SELECT *, sum(wt) OVER (PARTITION BY conv_id, turn) AS total, coalesce(sum(wt) OVER (PARTITION BY conv_id, turn ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, k = max(k) OVER (PARTITION BY conv_id, turn) AS last FROM x),
t AS (SELECT conv_id, turn, k, word, dur * before / total AS a, CASE WHEN last THEN dur ELSE dur * (before + wt) / total END AS b FROM r),
p AS (SELECT conv_id, turn, k, a, b, CASE WHEN k % 5 = 4 THEN 2 ELSE 1 END AS n, k // 5 AS page, length(word) * 4.0 AS w FROM t),
g AS (SELECT *, page + i AS pg, greatest(1.0, CASE WHEN i = 0 THEN w ELSE w / 2 END) AS width FROM p, (SELECT unnest([0, 1]) AS i) WHERE i < n),
s AS (SELECT *, sum(width) OVER (PARTITION BY conv_id, turn, k) AS all_, coalesce(sum(width) OVER (PARTITION BY conv_id, turn, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM g),
q AS (SELECT conv_id, turn, k AS word_no, pg AS page, floor((a + (b - a) * done / all_) * 10000 + 0.5) / 10000 AS start, floor(CASE WHEN i = n - 1 THEN b ELSE a + (b - a) * (done + width) / all_ END * 10000 + 0.5) / 10000 AS "end", k * 10.0 AS x0 FROM s)"""


def _parted_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of turns, timed from the turn's start; five are printed on a page, and the last of them goes on on the next."""
    turns = spread(_turns(spark, sf).select("conv_id", "turn", "dur", "text"), "conv_id", "turn")
    rows = turns.select("conv_id", "turn", F.lit(0.0).alias("zero"), "dur", F.posexplode(t.tokens(F.col("text"))).alias("word_no", "word"))
    timed = timeline.shares(rows, ["conv_id", "turn"], ["word_no"], (F.length("word") + 1).cast("double"), "zero", "dur", "start", "end")
    k, page, width = F.col("word_no"), F.floor(F.col("word_no") / 5).cast("int"), F.length("word") * 4.0

    def part(i: int, w: Column) -> Column:
        return F.struct((page + i).alias("page"), (k * 10.0).alias("x0"), F.lit(0.0).alias("y0"), (k * 10.0 + w).alias("x1"), F.lit(9.0).alias("y1"))

    parts = F.when(k % 5 == 4, F.array(part(0, width), part(1, width / 2))).otherwise(F.array(part(0, width)))
    return timeline.words_by_page(timed.select("conv_id", "turn", "word_no", "start", "end", parts.alias("parts")), ["conv_id", "turn"])


@query(PARTED + """ SELECT conv_id, turn, word_no, page, start, "end", x0 FROM q""")
def words_on_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _parted_words(spark, sf).select("conv_id", "turn", "word_no", "page", "start", "end", F.col("rects")[0][0].alias("x0"))


@query(PARTED + f""", d AS (SELECT conv_id, turn, dur, start AS off FROM o WHERE dur > 0), pg AS (SELECT conv_id, turn, page, min(start) AS f, max("end") AS u, max(x0) AS x FROM q GROUP BY 1, 2, 3),
y AS (SELECT d.conv_id AS doc_id, d.turn AS chapter, page, off + f AS a, off + u AS b, CASE WHEN page % 2 = 0 THEN x END AS own, x FROM d JOIN pg USING (conv_id, turn))
SELECT doc_id, row_number() OVER v - 1 AS i, chapter, page, floor(a * 10000 + 0.5) / 10000 AS start, floor(b * 10000 + 0.5) / 10000 AS "end", coalesce(page <> lag(page) OVER v, true) AS page_change, CASE WHEN page % 2 = 0 THEN -1.0 ELSE x END AS x FROM y WINDOW v AS (PARTITION BY doc_id ORDER BY chapter, page)""")
def timeline_by_words(spark: SparkSession, sf: str) -> DataFrame:
    """A timeline that turns pages by words and shows the paragraph's place on even pages."""
    turns, words = _turns(spark, sf), _parted_words(spark, sf)
    named = [F.col("conv_id").alias("doc_id"), F.col("turn").alias("chapter"), F.col("turn").alias("sentence_id")]
    said = words.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sentence_id"), "page", "start", "end", F.col("rects")[0].alias("r"))
    regions = said.groupBy("doc_id", "sentence_id", "page").agg(F.count(F.lit(1)).alias("chars"), F.array(F.max("r")).alias("rects"))
    paragraphs = regions.where("page % 2 = 0").select("doc_id", "sentence_id", "page", F.array(F.array(F.lit(-1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("rects"))
    timings, durations = turns.select(*named, F.lit(0.0).alias("start"), F.col("dur").alias("end")), turns.select(*named[:2], F.col("dur").alias("duration"))
    built = timeline.build(timings, regions, durations, words=said, paragraphs=paragraphs)
    return built.select("doc_id", "i", "chapter", "page", "start", "end", "page_change", F.col("rects")[0][0].alias("x"))


@query()
def printed_word_times(spark: SparkSession, sf: str) -> DataFrame:
    """When each printed word of a turn is said, though the narration has other words."""
    turns = spread(_turns(spark, sf), "conv_id", "turn")
    rows = turns.select("conv_id", "turn", "start", (F.col("start") + F.col("dur")).alias("end"), t.tokens(F.col("text")).alias("w"), t.narration(F.col("text")).alias("said"))
    timed = rows.withColumn("x", q.time_printed_words("w", "said", "start", "end"))
    return timed.select("conv_id", "turn", F.posexplode("x").alias("word_no", "t")).select("conv_id", "turn", "word_no", tm.rounded(F.col("t.start"), 4).alias("start"), tm.rounded(F.col("t.end"), 4).alias("end"))


# --- events as progress -----------------------------------------------------------------------------------------------

STEPS = """SELECT user_id AS project, event_type AS stage, CASE WHEN value > 60 THEN 'COMPLETED' WHEN value < 5 THEN 'FAILED' WHEN value < 20 THEN 'SKIPPED' WHEN value < 40 THEN 'RUNNING' ELSE 'PENDING' END AS status, value AS progress, event_id % 3 = 0 AS cached, ts, event_id AS seq FROM events"""


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    status = F.when(v > 60, "COMPLETED").when(v < 5, "FAILED").when(v < 20, "SKIPPED").when(v < 40, "RUNNING").otherwise("PENDING")
    return table(spark, sf, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("stage"), status.alias("status"), v.alias("progress"), (F.col("event_id") % 3 == 0).alias("cached"), "ts", F.col("event_id").alias("seq"))


@query(f"""WITH s AS ({STEPS}), g AS (SELECT project, stage, count(*) AS steps, count(*) FILTER (status IN ('COMPLETED', 'SKIPPED')) AS done, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'SKIPPED') AS skipped,
 count(*) FILTER (status = 'COMPLETED' AND cached) AS cached, avg(CASE WHEN status IN ('COMPLETED', 'SKIPPED') THEN 100.0 ELSE greatest(0.0, least(100.0, progress)) END) AS mean, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN skipped = steps THEN 'skipped' WHEN done = steps THEN 'done' WHEN running > 0 THEN 'running' WHEN done > 0 THEN 'partial' ELSE 'pending' END AS state FROM g)
SELECT project, stage, steps, done, cached, state, CASE WHEN state IN ('done', 'skipped') THEN 100.0 ELSE floor(mean + 0.5) END AS progress, first_ts, last_ts FROM h""")
def stage_states(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.stage_rollup(_steps(spark, sf), ["project"], "seq")


WEIGHTS = {"click": 3.0, "view": 2.0, "purchase": 5.0}


@query(f"""WITH s AS ({STEPS}), w AS (SELECT project, CASE stage WHEN 'click' THEN 3.0 WHEN 'view' THEN 2.0 WHEN 'purchase' THEN 5.0 ELSE 0.0 END AS w, progress FROM s)
SELECT project, least(100.0, floor(coalesce(sum(w * progress) / nullif(sum(w), 0), 0) * 10 + 0.5) / 10) AS progress FROM w GROUP BY 1""")
def project_progress(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.progress(_steps(spark, sf), ["project"], WEIGHTS, "seq")


@query(f"""WITH s AS ({STEPS}), r AS (SELECT *, row_number() OVER (PARTITION BY project, stage ORDER BY status IN ('COMPLETED', 'FAILED', 'SKIPPED', 'CANCELLED') DESC, CASE WHEN status IN ('COMPLETED', 'FAILED', 'SKIPPED', 'CANCELLED') THEN -seq ELSE seq END DESC) AS k FROM s)
SELECT project, stage, status, progress, seq FROM r WHERE k = 1""")
def folded_progress(spark: SparkSession, sf: str) -> DataFrame:
    return progress.fold(_steps(spark, sf).select("project", "stage", "status", "progress", "seq"), ["project", "stage"])


@query("""SELECT * FROM (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""".replace("SELECT * FROM", "SELECT user_id, event_id, ts, event_type, value FROM"))
def latest_events(spark: SparkSession, sf: str) -> DataFrame:
    return latest_per_key(table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "ts", "event_type", "value")


@query(f"""WITH s AS ({STEPS}), n AS (SELECT *, floor(epoch_us(ts) / 3600000000) AS slot, status IN ('COMPLETED', 'FAILED', 'SKIPPED', 'CANCELLED') AS final FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY project, slot ORDER BY ts DESC, seq DESC) AS k FROM n WHERE NOT final)
SELECT project, status, ts, seq FROM r WHERE k = 1 UNION ALL SELECT project, status, ts, seq FROM n WHERE final""")
def throttled_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = _steps(spark, sf).select("project", "ts", "seq", "status")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return progress.throttled(rows, ["project"], "ts", 3600).select("project", "status", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq")


@query("""WITH e AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'),
u AS (SELECT user_id, ts, max_by(struct_pack(event_id, value), event_id) AS f FROM e GROUP BY 1, 2)
SELECT p.event_id AS probe, u.f.event_id AS fact, u.f.value AS value FROM p ASOF LEFT JOIN u ON p.user_id = u.user_id AND p.ts >= u.ts""")
def last_click_before_view(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    facts = events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max_by(F.struct("event_id", "value"), "event_id").alias("f")).select("user_id", "ts", F.col("f.event_id").alias("fact"), F.col("f.value").alias("value"))
    probes = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("probe"))
    return timeline.as_of(facts, probes, ["user_id"], "ts", ["fact", "value"], ["probe"]).select("probe", "fact", "value")


@query("""WITH e AS (SELECT user_id, event_id, event_type, value, ts, row_number() OVER w AS n, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN n = 1 OR event_type IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS run FROM e)
SELECT user_id, run, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY 1, 2, 3""")
def event_runs(spark: SparkSession, sf: str) -> DataFrame:
    marked = timeline.runs(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return marked.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""WITH s AS (SELECT user_id, event_id % 4 AS page, row_number() OVER w - 1 AS i, (row_number() OVER w - 1) * 2.0 AS start, (row_number() OVER w - 1) * 2.0 + 1.5 AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT *, lag(page) OVER (PARTITION BY user_id ORDER BY i) AS p FROM s), r AS (SELECT *, sum(CASE WHEN p IS NULL OR p = page THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i) AS run FROM m),
g AS (SELECT user_id, run, any_value(page) AS page, min(i) AS seg_from, max(i) + 1 AS seg_to, min_by(start, i) AS fs, max_by(e, i) AS le FROM r GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN lag(run) OVER w IS NULL THEN 0.0 ELSE greatest(lag(le) OVER w, fs - 0.3) END AS show_from, max(le) OVER (PARTITION BY user_id) AS final FROM g WINDOW w AS (PARTITION BY user_id ORDER BY run))
SELECT user_id, run, page, seg_from, seg_to, floor(show_from * 10000 + 0.5) / 10000 AS show_from, floor(coalesce(lead(show_from) OVER (PARTITION BY user_id ORDER BY run), final) * 10000 + 0.5) / 10000 AS show_to FROM h""")
def page_turns(spark: SparkSession, sf: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf, "events").select("user_id", (F.col("event_id") % 4).alias("page"), i.alias("i")).withColumn("start", F.col("i") * 2.0).withColumn("end", F.col("i") * 2.0 + 1.5)
    shown = timeline.page_runs(rows, ["user_id"], 0.0, None)
    return shown.select("user_id", "run", "page", "seg_from", "seg_to", tm.rounded(F.col("show_from"), 4).alias("show_from"), tm.rounded(F.col("show_to"), 4).alias("show_to"))


@query("""SELECT event_type, try_cast(json_extract_string(props, '$.k') AS INT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2""")
def event_props(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"] % 10
    return table(spark, sf, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT event_id, (value / 100 - floor(value / 100)) AS f, value FROM events), y AS (SELECT event_id, f * f * f * (f * (f * 6 - 15) + 10) AS e, value FROM x)
SELECT event_id, floor(e * 1000000 + 0.5) / 1000000 AS eased, CAST(floor(value * 30 + 0.5) AS BIGINT) AS frame, floor(floor(value * 60) / 3600)::BIGINT::VARCHAR AS hours FROM y""")
def eased_values(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("value") / 100 - F.floor(F.col("value") / 100)
    rows = table(spark, sf, "events")
    return rows.select("event_id", tm.rounded(g.smootherstep(f), 6).alias("eased"), timeline.frames(F.lit(0.0), F.col("value"), 30)["count"].alias("frame"), F.floor(F.floor(F.col("value") * 60) / 3600).cast("string").alias("hours"))


@query("""SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def windowed_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = progress.event_windows(table(spark, sf, "events"), "ts", "6 hours", "1 day", "event_type")
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query()
def job_claims(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "release").otherwise(F.when(F.col("value") > 90, "cancel").otherwise("claim"))
    rows = table(spark, sf, "events").select((F.col("event_id") % 200).alias("job"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string")).alias("who"))
    return progress.claims(rows, "job")


@query("""WITH e AS (SELECT DISTINCT user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events), n AS (SELECT *, lead(ms) OVER (PARTITION BY user_id, event_type ORDER BY ms) AS nx FROM e)
SELECT user_id, event_type, make_timestamp(ms * 1000) AS used, make_timestamp((ms + 21600000) * 1000) AS expired FROM n WHERE nx IS NULL OR nx - ms > 21600000""")
def entry_expiries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries (a user and a type of event) that nothing renewed for six hours."""
    found = timed.expiries(table(spark, sf, "events"), ["user_id", "event_type"], "ts", 6 * 3600)
    return found.select("user_id", "event_type", F.col("used").cast("timestamp_ntz").alias("used"), F.col("expired").cast("timestamp_ntz").alias("expired"))


# --- catalogue ----------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, c_name, n_name, r_name, coalesce(count(o_orderkey), 0) AS orders, coalesce(sum(o_totalprice), 0) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4""".replace("coalesce(sum(o_totalprice), 0)", "round(coalesce(sum(o_totalprice), 0), 2)"))
def customer_details(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    rows = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(orders, "c_custkey", "left")
    return rows.select("c_custkey", "c_name", "n_name", "r_name", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus IN ('O', 'F') AND l_returnflag <> 'N'""")
def lines_of_segment(spark: SparkSession, sf: str) -> DataFrame:
    people = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("O", "F")).join(people, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").where("l_returnflag <> 'N'").join(orders, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT n_nationkey, n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, coalesce((SELECT string_agg(s_name, ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS names FROM nation""")
def nations_with_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = catalog.nested(table(spark, sf, "nation"), table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", ["s_suppkey"], ["s_name"], "s")
    return rows.select("n_nationkey", "n_name", F.size("s").cast("long").alias("suppliers"), F.array_join(F.transform("s", lambda x: x["s_name"]), ",").alias("names"))


@query("""SELECT l_suppkey AS owner, l_partkey AS key FROM lineitem GROUP BY 1, 2 HAVING l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1)""")
def unreferenced_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("key"))
    return catalog.unreferenced(rows, rows, "owner", "key")


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)""")
def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit(0).alias("toxic"))
    return catalog.with_edits(rows, table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"])


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def unlabelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.only_left(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("""SELECT i AS pos, n_nationkey, n_name FROM (SELECT unnest([7, 3, 99, 12]) AS k, generate_subscripts([7, 3, 99, 12], 1) - 1 AS i) JOIN nation ON n_nationkey = k""")
def nations_in_order(spark: SparkSession, sf: str) -> DataFrame:
    ids = spark.range(1).select(F.array(*[F.lit(k) for k in (7, 3, 99, 12)]).alias("ids"))
    return catalog.in_order(ids, table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("pos", "n_nationkey", "n_name")


FILES = """SELECT source AS item, CASE doc_id % 4 WHEN 0 THEN 'book' || doc_id // 8 || '.pdf' WHEN 1 THEN 'book' || doc_id // 8 || '_text.pdf' WHEN 2 THEN 'Book' || doc_id // 8 || '_bw.pdf' ELSE 'vol' || doc_id // 8 || '.pdf' END AS name FROM documents"""


@query(f"""WITH f AS ({FILES}) SELECT item, name FROM f WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.item = f.item AND lower(b.name) = regexp_replace(lower(f.name), '\\.pdf$', '_text.pdf'))
AND NOT (ends_with(lower(f.name), '_bw.pdf') AND EXISTS (SELECT 1 FROM f b WHERE b.item = f.item AND lower(b.name) = regexp_replace(lower(f.name), '_bw\\.pdf$', '.pdf')))""")
def best_file_copies(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.floor(F.col("doc_id") / 8).cast("string"), F.col("doc_id") % 4
    name = F.when(k == 0, F.concat(F.lit("book"), n, F.lit(".pdf"))).when(k == 1, F.concat(F.lit("book"), n, F.lit("_text.pdf"))).when(k == 2, F.concat(F.lit("Book"), n, F.lit("_bw.pdf"))).otherwise(F.concat(F.lit("vol"), n, F.lit(".pdf")))
    return catalog.best_copies(table(spark, sf, "documents").select(F.col("source").alias("item"), name.alias("name")))


@query("""WITH a AS (SELECT p_partkey AS id, unnest(['brand', 'type', 'size']) AS path, unnest([p_brand, p_type, p_size::VARCHAR]) AS v FROM part), b AS (SELECT p_partkey + 1 AS id, unnest(['brand', 'type', 'size']) AS path, unnest([p_brand, p_type, p_size::VARCHAR]) AS v FROM part)
SELECT coalesce(a.id, b.id) AS id, coalesce(a.path, b.path) AS path, a.v AS before, b.v AS after FROM a FULL JOIN b ON a.id = b.id AND a.path = b.path WHERE a.v IS DISTINCT FROM b.v""")
def part_differences(spark: SparkSession, sf: str) -> DataFrame:
    leaves = F.map_from_arrays(F.array(F.lit("brand"), F.lit("type"), F.lit("size")), F.array("p_brand", "p_type", F.col("p_size").cast("string")))
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(leaves).alias("path", "value"))
    return catalog.tree_diff(a, a.withColumn("id", F.col("id") + 1), ["id", "path"])


@query("""SELECT DISTINCT unnest(CASE WHEN path LIKE 'audio.%' OR path = 'audio' THEN ['TTS', 'MASTER'] ELSE ['VIDEO'] END) AS stage FROM (SELECT CASE WHEN p_size > 25 THEN 'audio.voice' ELSE 'video.fps' END AS path FROM part)""")
def affected_stages(spark: SparkSession, sf: str) -> DataFrame:
    changes = table(spark, sf, "part").select(F.when(F.col("p_size") > 25, "audio.voice").otherwise("video.fps").alias("path"))
    return catalog.impacted(changes, {"audio": ["TTS", "MASTER"], "video": ["VIDEO"]})


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24 OFFSET 48""")
def third_page_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return catalog.page(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 5""")
def newest_orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return timeline.session_rank(rows, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey", "rank")


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS partial FROM orders GROUP BY 1""")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    of = F.col("o_orderstatus")
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(of == "O").alias("open"), F.count_if(of == "F").alias("done"), F.count_if(of == "P").alias("partial"))


@query("""WITH c AS (SELECT p_partkey, length(p_name) AS n, p_retailprice AS p, p_size AS s FROM part), k AS (SELECT p_partkey, unnest([CASE WHEN n = 0 THEN 0.0 WHEN n > 12 THEN 0.5 ELSE 1.0 END, CASE WHEN p > 1500 THEN 0.0 WHEN p > 1200 THEN 0.5 ELSE 1.0 END, CASE WHEN s > 45 THEN 0.0 WHEN s > 30 THEN 0.5 ELSE 1.0 END]) AS v, unnest([3.0, 2.0, 1.0]) AS w FROM c)
SELECT p_partkey, CAST(floor(100 * sum(v * w) / sum(w) + 0.5) AS INT) AS score, count(*) FILTER (v = 0) AS blocking FROM k GROUP BY 1""")
def part_scores(spark: SparkSession, sf: str) -> DataFrame:
    n, p, s = F.length("p_name"), F.col("p_retailprice"), F.col("p_size")
    checked = catalog.checks(table(spark, sf, "part"), ["p_partkey"], {"name": (n == 0, n > 12, 3), "price": (p > 1500, p > 1200, 2), "size": (s > 45, s > 30, 1)})
    return catalog.score(checked, ["p_partkey"])


@query("""SELECT p_partkey, unnest(list_filter([CASE WHEN NOT p_size BETWEEN 1 AND 40 THEN 'size' END, CASE WHEN NOT p_retailprice < 1800 THEN 'price' END], lambda x: x IS NOT NULL)) AS rule FROM part""")
def broken_part_rules(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.broken_rules(table(spark, sf, "part"), ["p_partkey"], {"size": F.col("p_size").between(1, 40), "price": F.col("p_retailprice") < 1800})


@query("""WITH c AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, CASE WHEN o_orderkey % 5 = 0 THEN 'Index' ELSE 'Chapter ' || o_orderkey END AS title, o_orderkey AS page_end, CASE WHEN o_orderkey % 7 = 0 THEN true WHEN o_orderkey % 11 = 0 THEN false END AS ex, o_orderkey % 3 = 0 AS mg, CASE WHEN o_orderkey % 4 = 0 THEN ' New ' END AS nt FROM orders),
b AS (SELECT *, regexp_matches(trim(title), '(?i)^index') AND NOT coalesce(ex = false, false) AS back FROM c), t AS (SELECT *, min(back::INT) OVER (PARTITION BY doc_id ORDER BY idx DESC ROWS UNBOUNDED PRECEDING) = 1 AND idx <> min(idx) OVER (PARTITION BY doc_id) AS tail FROM b),
i AS (SELECT *, NOT tail AND NOT coalesce(ex, false) AS inn FROM t), m AS (SELECT *, inn AND mg AND coalesce(max(inn::INT) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS merged FROM i),
p AS (SELECT *, CASE WHEN inn THEN sum((inn AND NOT merged)::INT) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS part FROM m),
h AS (SELECT *, min(CASE WHEN inn THEN idx END) OVER (PARTITION BY doc_id, part) AS head, max(page_end) OVER (PARTITION BY doc_id, part) AS pe FROM p),
r AS (SELECT *, CASE WHEN tail THEN 'back-matter' WHEN NOT inn THEN 'excluded' WHEN merged THEN 'merged' WHEN NOT head + 1 BETWEEN 2 AND 6 THEN 'range' END AS reason FROM h)
SELECT doc_id, idx, part, CASE WHEN reason IS NULL THEN coalesce(nullif(trim(nt), ''), title) END AS title, CASE WHEN reason IS NULL THEN pe END AS page_end, reason FROM r""")
def chapter_plans(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("idx"),
        F.when(k % 5 == 0, "Index").otherwise(F.concat(F.lit("Chapter "), k.cast("string"))).alias("title"), k.alias("page_end"),
        F.when(k % 7 == 0, True).when(k % 11 == 0, False).alias("exclude"), (k % 3 == 0).alias("merge"), F.when(k % 4 == 0, " New ").alias("new_title"),
    )
    return catalog.plan(rows, 2, 6)


@query("""SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'public_domain' WHEN 1 THEN 'restricted' WHEN 2 THEN 'open' WHEN 3 THEN 'public_domain' ELSE 'unknown' END AS rights, CASE c_nationkey % 5 WHEN 0 THEN 'Not in copyright' WHEN 1 THEN 'CC BY-NC 4.0' WHEN 2 THEN 'CC BY' WHEN 3 THEN 'CC0' END AS license,
CASE WHEN c_nationkey % 2 = 0 THEN 'en' ELSE 'fre' END AS lang, 1900 + c_nationkey AS year FROM customer""")
def rights_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_nationkey") % 5
    url = F.when(k == 1, "https://creativecommons.org/licenses/by-nc/4.0/").when(k == 2, "http://creativecommons.org/licenses/by/").when(k == 3, "https://creativecommons.org/publicdomain/zero/1.0/").otherwise("https://example.org/terms")
    r = t.rights(url, F.when(k == 0, "NOT_IN_COPYRIGHT"))
    rows = table(spark, sf, "customer").select("c_custkey", r.alias("r"), t.language_code(F.when(F.col("c_nationkey") % 2 == 0, "English").otherwise("fre")).alias("lang"), t.year_of(F.concat(F.lit("["), (F.col("c_nationkey") + 1900).cast("string"), F.lit("-01]"))).alias("year"))
    return rows.select("c_custkey", "r.rights", "r.license", "lang", "year")


@query("""SELECT c_custkey, '(title:(' || x || ') OR creator:(' || x || ') OR subject:(' || x || ')) AND mediatype:texts' AS query FROM (SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(c_name, '[#+\\-&|!]', ' ', 'g'), '\\s+'), lambda w: w <> ''), ' AND ') AS x FROM customer)""")
def catalogue_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", t.search_query(F.replace("c_name", F.lit("#"), F.lit(" ")), ["mediatype:texts"]).alias("query"))


@query("""SELECT s_suppkey, row_number() OVER (ORDER BY regexp_replace(lower(s_name), '[0-9]+', '', 'g'), try_cast(regexp_extract(s_name, '[0-9]+') AS INT), s_suppkey) AS place FROM supplier""")
def natural_name_order(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.places(table(spark, sf, "supplier").select("s_suppkey", t.natural_key(F.col("s_name")).alias("key")), "key", "s_suppkey").select("s_suppkey", "place")


@query("""SELECT p_partkey, p_name, p_type, p_size FROM part WHERE contains(lower(p_name || ' ' || p_type), 'steel') AND p_size IN (1, 5, 9, 14, 21, 33)""")
def part_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(F.lower(F.concat_ws(" ", "p_name", "p_type")).contains("steel") & F.col("p_size").isin(1, 5, 9, 14, 21, 33)).select("p_partkey", "p_name", "p_type", "p_size")


@query("""WITH a AS (SELECT l_suppkey, l_quantity AS v, sum(l_extendedprice) AS w, min((l_orderkey, l_linenumber)) AS o FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, v AS l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(w, 2) DESC, o) AS r FROM a) WHERE r = 1""")
def heaviest_quantities(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", F.round("l_extendedprice", 2).cast("decimal(18,2)").alias("w"), F.struct("l_orderkey", "l_linenumber").alias("o"))
    return statistics.weighted_mode(rows, ["l_suppkey"], "l_quantity", "w", "o").select("l_suppkey", "l_quantity")


@query("""WITH a AS (SELECT l_partkey, l_quantity AS v, count(*) AS w FROM lineitem GROUP BY 1, 2), b AS (SELECT *, sum(w) OVER (PARTITION BY l_partkey ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY l_partkey) AS total FROM a)
SELECT l_partkey, min(v) AS median FROM b WHERE 2 * run >= total GROUP BY 1""")
def weighted_medians(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.weighted_median(table(spark, sf, "lineitem").withColumn("one", F.lit(1)), ["l_partkey"], "l_quantity", "one")


BOXES = "SELECT l_orderkey AS page, l_linenumber AS i, l_quantity AS x0, l_tax * 100 AS y0, l_quantity + 20 AS x1, l_tax * 100 + 10 AS y1 FROM lineitem"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("l_quantity"), F.col("l_tax") * 100
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("i"), g.box(x, y, x + 20, y + 10).alias("b"))


@query(f"""WITH b AS ({BOXES}) SELECT a.page, a.i AS a, b.i AS b, floor(w * h / (400 - w * h) * 10000 + 0.5) / 10000 AS iou FROM (SELECT *, 1 AS one FROM b) a JOIN b ON a.page = b.page AND a.i < b.i, LATERAL (SELECT greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS w, greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS h) WHERE w * h > 0""")
def overlapping_boxes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _boxes(spark, sf)
    other = rows.select("page", F.col("i").alias("j"), F.col("b").alias("c"))
    met = rows.join(other, "page").where((F.col("i") < F.col("j")) & (g.shared(F.col("b"), F.col("c")) > 0))
    return met.select("page", F.col("i").alias("a"), F.col("j").alias("b"), tm.rounded(g.iou(F.col("b"), F.col("c")), 4).alias("iou"))


@query(f"""WITH b AS ({BOXES}), p AS (SELECT o_orderkey AS page, o_custkey % 60 AS x, o_orderkey % 12 AS y FROM orders) SELECT p.page, min(b.i) AS hit FROM p JOIN b ON b.page = p.page AND x BETWEEN x0 - 3 AND x1 + 3 AND y BETWEEN y0 - 3 AND y1 + 3 GROUP BY 1""")
def box_hits(spark: SparkSession, sf: str) -> DataFrame:
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_custkey") % 60).alias("x"), (F.col("o_orderkey") % 12).alias("y"))
    return points.join(_boxes(spark, sf), "page").where(g.holds(F.col("b"), F.col("x"), F.col("y"))).groupBy("page").agg(F.min("i").alias("hit"))


@query(f"""WITH b AS ({BOXES}) SELECT a.page, a.i, min_by(b.i, (abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2), b.i)) AS nearest FROM b a JOIN b ON a.page = b.page AND a.i <> b.i AND b.x0 <= a.x1 + 1 AND b.x1 >= a.x0 - 1 GROUP BY 1, 2""")
def nearest_boxes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _boxes(spark, sf)
    other = rows.select("page", F.col("i").alias("j"), F.col("b").alias("c"))
    b, c = F.col("b"), F.col("c")
    met = rows.join(other, "page").where((F.col("i") != F.col("j")) & (c["x0"] <= b["x1"] + 1) & (c["x1"] >= b["x0"] - 1))
    away = F.abs((b["y0"] + b["y1"]) / 2 - (c["y0"] + c["y1"]) / 2)
    return met.groupBy("page", "i").agg(F.min_by("j", F.struct(away, F.col("j"))).alias("nearest"))


# --- lineage -------------------------------------------------------------------------------------------------------------


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    inputs = {"EXTRACT": ["p_name"], "TTS": ["p_brand"], "VIDEO": ["p_type", "p_size"]}
    return lineage.stage_keys(table(spark, sf, "part"), ["p_partkey"], inputs)


@query("""WITH a AS (SELECT *, substr(sha256('v1:EXTRACT' || chr(10) || '{"i0":"","i1":' || to_json(p_name)::VARCHAR || '}'), 1, 20) AS a FROM part), b AS (SELECT *, substr(sha256('v1:TTS' || chr(10) || '{"i0":"' || a || '","i1":' || to_json(p_brand)::VARCHAR || '}'), 1, 20) AS b FROM a),
c AS (SELECT *, substr(sha256('v1:VIDEO' || chr(10) || '{"i0":"' || b || '","i1":' || to_json(p_type)::VARCHAR || ',"i2":' || p_size || '}'), 1, 20) AS c FROM b), k AS (SELECT p_partkey, unnest(['EXTRACT', 'TTS', 'VIDEO']) AS stage, unnest([a, b, c]) AS key FROM c)
SELECT p_partkey, stage, key, 'artifacts/' || lower(stage) || '/' || substr(key, 1, 2) || '/' || key AS path FROM k""")
def artifact_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(spark, sf).withColumn("path", lineage.artifact_path("artifacts", F.col("stage"), F.col("key")))


@query("""SELECT p_partkey, s AS stage, CASE WHEN s = 'VIDEO' THEN 'SKIPPED' WHEN p_partkey % 2 = 0 THEN 'COMPLETED' ELSE 'PENDING' END AS status, s <> 'VIDEO' AND p_partkey % 2 = 0 AS cached FROM part, (SELECT unnest(['EXTRACT', 'TTS', 'VIDEO']) AS s)""")
def planned_steps(spark: SparkSession, sf: str) -> DataFrame:
    keys = _keys(spark, sf).withColumn("key", F.concat_ws("-", "key", "p_partkey"))
    return lineage.steps(keys, keys.where("p_partkey % 2 = 0"), ["EXTRACT", "TTS"]).select("p_partkey", "stage", "status", "cached")


@query("""SELECT p_partkey, s AS stage FROM part, (SELECT unnest(['EXTRACT', 'TTS', 'VIDEO']) AS s) WHERE p_partkey % 2 = 1 OR s = 'TTS'""")
def work_to_do(spark: SparkSession, sf: str) -> DataFrame:
    keys = _keys(spark, sf).withColumn("key", F.concat_ws("-", "key", "p_partkey"))
    return lineage.work_list(keys, keys.where("p_partkey % 2 = 0"), ["TTS"]).select("p_partkey", "stage")


# --- the flagship -----------------------------------------------------------------------------------------------------------


#: A document's headers are kept in so many lists, so that a line is compared with few of them.
HEADER_CELLS = 1024


@query()
def timeline_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each source without its repeated headers, as sentences on one timeline: source, doc_id, sentence_idx, start, end, text."""
    from quire.sources.tables import document_lines

    docs = table(spark, sf, "documents").where("source IS NOT NULL").withColumn("doc_id", F.struct("doc_id"))  # joins and groups also where it is null
    pages = docs.where(F.col("text").rlike(r"[^ \n]")).groupBy(F.col("source").alias("book")).agg(F.countDistinct("doc_id.doc_id").alias("n"))  # those with a line that isn't blank
    lines = document_lines(docs).withColumn("line", F.xxhash64("text"))
    # Headers: keys are compared by their digests, and a document's lines by their hashes, so no text is shuffled here.
    alike = Window.partitionBy("book", "key")
    keyed = lines.select("book", "page", "line", F.unhex(F.md5(t.header_key(F.col("text")))).alias("key"))
    known = F.col("page.doc_id")
    seen = keyed.withColumn("nth", F.when(known.isNotNull(), F.dense_rank().over(alike.orderBy(known.asc_nulls_last())))).withColumn("seen", F.max("nth").over(alike)).where("seen > 1")
    strong = F.when(F.col("n") <= 4, 2).otherwise(F.greatest(F.lit(3), F.ceil(F.col("n") * 0.2)))
    found = seen.join(pages, "book").where(F.col("seen") >= strong).groupBy("book", "page", F.pmod("line", F.lit(HEADER_CELLS)).alias("cell")).agg(F.collect_set("line").alias("of"))
    headers = found.groupBy(F.col("book").alias("source"), F.col("page").alias("doc_id")).agg(F.map_from_entries(F.collect_list(F.struct("cell", "of"))).alias("headers"))
    # Lines are split once: both uses of them read one exchange. So it has the same columns for both, and no plain
    # explode stands above it: Spark would put a filter for that, with a split of its own, below it.
    parts = F.transform(q.split_sentences("text"), lambda s: F.struct("line_no", s["idx"].alias("idx"), s["text"].alias("text"), F.size(t.tokens(s["text"])).alias("words")))
    split = lines.select(F.col("book").alias("source"), F.col("page").alias("doc_id"), "line", parts.alias("parts")).repartition("source", "doc_id")
    header = F.array_contains(F.col("headers")[F.pmod("line", F.lit(HEADER_CELLS))], F.col("line"))
    kept = split.join(headers, ["source", "doc_id"], "left").where(~F.coalesce(header, F.lit(False)))
    # Words before a sentence in two steps, so that no source has to pass through one task sentence by sentence.
    spoken = F.aggregate("parts", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    per_doc = kept.groupBy("source", "doc_id").agg(F.sum(spoken).alias("total")).withColumn("offset", timeline.exclusive_sum(F.col("total"), ["source"], "doc_id")).select("source", "doc_id", "offset")
    said = kept.select("source", "doc_id", F.explode_outer(F.when(F.col("doc_id.doc_id").isNotNull(), F.col("parts"))).alias("s")).where("s IS NOT NULL").select("source", "doc_id", "s.*")
    order = Window.partitionBy("source", "doc_id").orderBy("line_no", "idx")
    before = timeline.exclusive_sum(F.col("words"), ["source", "doc_id"], "line_no", "idx")
    placed = said.select("*", (F.row_number().over(order) - 1).alias("sentence_idx"), before.alias("before")).join(per_doc, ["source", "doc_id"])
    start = F.col("offset") + F.col("before")
    return placed.select("source", "doc_id.doc_id", "sentence_idx", tm.rounded(start * 60 / 155.0, 4).alias("start"), tm.rounded((start + F.col("words")) * 60 / 155.0, 4).alias("end"), "text")
