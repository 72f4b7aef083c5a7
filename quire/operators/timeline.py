"""Timelines: interval series without gaps, built from durations, shares and order; as-of look-ups; page runs; cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.times import rounded, speech_weight


def exclusive_sum(x: Column, keys: list[str], *order: str) -> Column:
    """The sum over all rows before this one; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(x).over(w), F.lit(0))


def shares(rows: DataFrame, keys: list[str], order: list[str], weight: Column, start: str, end: str, begin_as: str, end_as: str) -> DataFrame:
    """Share the interval [start, end] of a key among its rows by weight, in order, without gaps; the last ends exactly at ``end``."""
    rows = rows.withColumn("_w", weight)
    all_ = Window.partitionBy(*keys)
    total = F.when(F.sum("_w").over(all_) == 0, F.lit(1.0)).otherwise(F.sum("_w").over(all_))
    before = exclusive_sum(F.col("_w"), keys, *order)
    last = F.lead(F.lit(1)).over(all_.orderBy(*order)).isNull()
    span = F.col(end) - F.col(start)
    begin, stop = F.col(start) + span * before / total, F.col(start) + span * (before + F.col("_w")) / total
    return rows.withColumn("_a", begin).withColumn("_b", F.when(last, F.col(end)).otherwise(stop)).withColumnRenamed("_a", begin_as).withColumnRenamed("_b", end_as).drop("_w")


def word_times(sentences: DataFrame, key: str) -> DataFrame:
    """key, word_no, word, start, end: the time of each word of ``text`` in [start, end], by speaking weight."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    marked = F.element_at(F.transform(F.array(words), lambda w: F.transform(w, lambda x, i: F.struct(x.alias("t"), (i == F.size(w) - 1).alias("last")))), 1)
    rows = sentences.select(key, "start", "end", F.posexplode(marked).alias("word_no", "_x")).select(key, "start", "end", "word_no", F.col("_x.t").alias("word"), F.col("_x.last").alias("_last"))
    weight = speech_weight(F.col("word"), F.col("_last"))
    timed = shares(rows, [key], ["word_no"], weight, "start", "end", "word_start", "word_end")
    return timed.select(key, "word_no", "word", rounded(F.col("word_start"), 4).alias("start"), rounded(F.col("word_end"), 4).alias("end"))


def words_by_page(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word_no, page, start, end, rects for words (keys, word_no, start, end, parts = array of (page, x0, y0, x1, y1)).

    A word that is printed on two pages is shared between them by printed width (one point at least for each part), in the
    order in which its parts come. Times have four places.
    """
    parts = words.select(*keys, "word_no", "start", "end", F.posexplode("parts").alias("_k", "_p"))
    width = F.greatest(F.lit(1.0), F.col("_p.x1") - F.col("_p.x0"))
    rect = F.struct("_k", F.array("_p.x0", "_p.y0", "_p.x1", "_p.y1").alias("r"))
    pages = parts.groupBy(*keys, "word_no", F.col("_p.page").alias("page")).agg(F.min("_k").alias("_k"), F.first("start").alias("_from"), F.first("end").alias("_to"), F.sum(width).alias("_w"), F.sort_array(F.collect_list(rect)).alias("_r"))
    shared = shares(pages, [*keys, "word_no"], ["_k"], F.col("_w"), "_from", "_to", "start", "end")
    return shared.select(*keys, "word_no", "page", rounded(F.col("start"), 4).alias("start"), rounded(F.col("end"), 4).alias("end"), F.transform("_r", lambda x: x["r"]).alias("rects"))


def build(timings: DataFrame, regions: DataFrame, durations: DataFrame, *, words: DataFrame | None = None, paragraphs: DataFrame | None = None) -> DataFrame:
    """Segments of each document.

    ``durations``: doc_id, chapter, duration. ``timings``: doc_id, chapter, sentence_id, start, end (from the chapter's
    start). ``regions``: doc_id, sentence_id, page, chars, and rects if there are ``paragraphs``. A sentence on several pages
    gives a segment for each, by characters (one at least); empty intervals and sentences without a region give none.

    ``words`` (doc_id, sentence_id, page, start, end; from the chapter's start) turn the page exactly where the first word on
    the next one is said. ``paragraphs`` (doc_id, sentence_id, page, rects) give their rects in place of the sentence's.
    """
    offsets = durations.withColumn("offset", exclusive_sum(F.col("duration"), ["doc_id"], "chapter"))
    timed = timings.where("end > start").join(offsets, ["doc_id", "chapter"])
    timed = timed.select("doc_id", "chapter", "sentence_id", "offset", (F.col("offset") + F.col("start")).alias("a"), (F.col("offset") + F.col("end")).alias("b"))
    rows = timed.join(regions, ["doc_id", "sentence_id"])
    parts = shares(rows, ["doc_id", "chapter", "sentence_id"], ["page"], F.greatest(F.lit(1.0), F.col("chars").cast("double")), "a", "b", "start", "end")
    if words is not None:
        said = words.groupBy("doc_id", "sentence_id", "page").agg(F.min("start").alias("_from"), F.max("end").alias("_to"))
        parts = parts.join(said, ["doc_id", "sentence_id", "page"], "left").withColumn("start", F.coalesce(F.col("offset") + F.col("_from"), "start")).withColumn("end", F.coalesce(F.col("offset") + F.col("_to"), "end"))
    rects = []
    if paragraphs is not None:
        parts = parts.join(paragraphs.select("doc_id", "sentence_id", "page", F.col("rects").alias("_own")), ["doc_id", "sentence_id", "page"], "left")
        rects = [F.coalesce("_own", "rects").alias("rects")]
    order = Window.partitionBy("doc_id").orderBy("chapter", "a", "sentence_id", "page")
    before = F.lag("page").over(order)
    return parts.select("doc_id", (F.row_number().over(order) - 1).alias("i"), "chapter", "sentence_id", "page", rounded(F.col("start"), 4).alias("start"), rounded(F.col("end"), 4).alias("end"), (before.isNull() | (before != F.col("page"))).alias("page_change"), *rects)


def as_of(facts: DataFrame, probes: DataFrame, keys: list[str], time: str, values: list[str], probe_values: list[str]) -> DataFrame:
    """Each probe with the values of the last fact at or before its time (nulls, if none). No join: one sort of both sides."""
    left = facts.select(*keys, time, F.lit(0).alias("_side"), F.struct(*values).alias("_fact"), *[F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probe_values])
    right = probes.select(*keys, time, F.lit(1).alias("_side"), F.lit(None).cast(left.schema["_fact"].dataType).alias("_fact"), *probe_values)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_last", F.last("_fact", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*keys, time, *probe_values, *[F.col(f"_last.{c}").alias(c) for c in values])


def as_of_valid(facts: DataFrame, probes: DataFrame, keys: list[str], time: str, end: str, values: list[str], probe_values: list[str]) -> DataFrame:
    """``as_of``, with nulls where the fact has ended; the last fact of a key never ends."""
    last = F.lead(time).over(Window.partitionBy(*keys).orderBy(time)).isNull()
    found = as_of(facts.withColumn("_open", last), probes, keys, time, [*values, end, "_open"], probe_values)
    live = F.col("_open") | (F.col(time) < F.col(end))
    own = [c for c in values if c != end]
    return found.select(*keys, time, *probe_values, *[F.when(live, F.col(c)).alias(c) for c in [*own, end]])


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with run: the number, from 0, of the stretch of equal values that a row is in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    marked = rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 0).otherwise(new))
    return marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def page_runs(segments: DataFrame, keys: list[str], start: float | Column, end: Column, lead: float = 0.30) -> DataFrame:
    """keys, run, page, seg_from, seg_to, show_from, show_to: when each page is on screen. It comes ``lead`` seconds early, but not before the page before has ended."""
    marked = runs(segments, keys, ["i"], "page")
    grouped = marked.groupBy(*keys, "run").agg(F.first("page").alias("page"), F.min("i").alias("seg_from"), (F.max("i") + 1).alias("seg_to"), F.min_by("start", "i").alias("first_start"), F.max_by("end", "i").alias("last_end"))
    w = Window.partitionBy(*keys).orderBy("run")
    show = F.when(F.lag("run").over(w).isNull(), start if isinstance(start, Column) else F.lit(start)).otherwise(F.greatest(F.lag("last_end").over(w), F.col("first_start") - lead))
    shown = grouped.withColumn("show_from", show)
    final = F.max("last_end").over(Window.partitionBy(*keys)) if end is None else end
    return shown.withColumn("show_to", F.coalesce(F.lead("show_from").over(w), final)).drop("first_start", "last_end")


def pauses(sentences: DataFrame, keys: list[str], sentence_ms: int, paragraph_ms: int, chapter_ms: int, heading_ms: int = 250) -> DataFrame:
    """``sentences`` (chapter, paragraph, sentence, heading) with pause_ms: what follows each; longer after a heading."""
    in_paragraph = Window.partitionBy(*keys, "chapter", "paragraph").orderBy("sentence")
    in_chapter = Window.partitionBy(*keys, "chapter").orderBy("paragraph", "sentence")
    last_in_paragraph, last_in_chapter = F.lead(F.lit(1)).over(in_paragraph).isNull(), F.lead(F.lit(1)).over(in_chapter).isNull()
    pause = F.when(last_in_chapter, chapter_ms).when(last_in_paragraph, paragraph_ms + F.when(F.col("heading"), heading_ms).otherwise(0)).otherwise(sentence_ms)
    return sentences.withColumn("pause_ms", pause)


def frames(start: Column, end: Column, fps: float) -> Column:
    """struct<first, count>: frames from absolute times, so that they never drift."""
    a, b = F.floor(start * fps + 0.5), F.floor(end * fps + 0.5)
    return F.struct(a.alias("first"), (b - a).alias("count"))


def session_rank(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The ``most`` first rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def places(rows: DataFrame, key: str, tie: str, width: int = 18) -> DataFrame:
    """Rows with their place (from 1) in the order of the string ``key``, then ``tie``, without a window over all rows.

    Rows are ranked among those whose keys begin alike (``width`` characters), and the beginnings, of which there are far
    fewer, among each other by the running sum of their counts.
    """
    own = rows.withColumn("_head", F.substring(key, 1, width))
    heads = own.groupBy("_head").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_head").orderBy(key, tie))
    return own.withColumn("_in", inside).join(heads.select("_head", before.alias("_before")), "_head").withColumn("place", F.col("_before") + F.col("_in")).drop("_head", "_in", "_before")
