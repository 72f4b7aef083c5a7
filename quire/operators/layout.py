"""Operators on printed boxes: regions by page, reading order over columns, drop caps, overlapping words, section openings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.operators.statistics import form_key


def merged_regions(regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, page, rects (in order), chars: the regions of one page together."""
    listed = regions.groupBy(*keys, "page").agg(F.sort_array(F.collect_list(F.struct("ord", "rects"))).alias("_r"), F.sum("chars").alias("chars"))
    return listed.select(*keys, "page", F.flatten(F.transform("_r", lambda r: r["rects"])).alias("rects"), "chars")


def segments_by_page(segments: DataFrame, keys: list[str]) -> DataFrame:
    return segments.groupBy(*keys, "page").agg(F.sort_array(F.collect_list("i")).alias("segments"))


def extents(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The left-most and right-most edge, the highest and the lowest, of the boxes of a key."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def reading_parts(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, start, end: an interval shared, by width, among the columns that its boxes (ord, x0, y0, x1, y1; start, end) run through.

    A new column begins where a box lies more than two line heights above the one before.
    """
    w = Window.partitionBy(*keys).orderBy("ord")
    y, h = F.lag("y0").over(w), F.greatest(F.lit(1.0), F.lag("y1").over(w) - F.lag("y0").over(w))
    up = F.coalesce((F.col("y0") < y - 2 * h).cast("int"), F.lit(0))
    parted = boxes.withColumn("_up", up).withColumn("part", F.sum("_up").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    widths = parted.groupBy(*keys, "part").agg(F.sum(F.greatest(F.lit(1.0), F.col("x1") - F.col("x0"))).alias("width"), F.first("start").alias("_s"), F.first("end").alias("_e"))
    inner = Window.partitionBy(*keys).orderBy("part")
    total = F.sum("width").over(Window.partitionBy(*keys))
    before = F.coalesce(F.sum("width").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    span = F.col("_e") - F.col("_s")
    last = F.lead(F.lit(1)).over(inner).isNull()
    return widths.select(*keys, "part", (F.col("_s") + span * before / total).alias("start"), F.when(last, F.col("_e")).otherwise(F.col("_s") + span * (before + F.col("width")) / total).alias("end"))


def drop_caps(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cap, line, joined: each drop cap with the nearest body line beside it, and that line's first word with the cap.

    Lines have line_no, text, x0, y0, x1, y1, size and body. A cap is one large letter; of two caps beside one line the first takes it.
    """
    cap = lines.where(t.is_drop_cap(F.col("text")) & (F.col("size") >= F.col("body") * 1.6))
    cap = cap.select(*keys, F.col("line_no").alias("cap"), F.col("text").alias("letter"), F.col("x1").alias("cx"), F.col("y0").alias("cy"), (F.col("y1") - F.col("y0")).alias("ch"))
    dx, dy, body = F.col("x0") - F.col("cx"), F.col("y0") - F.col("cy"), F.col("body")
    near = cap.join(lines, keys).where((F.col("line_no") != F.col("cap")) & (F.abs(F.col("size") - body) <= body * 0.2) & (dx >= -body * 0.3) & (dx <= body * 1.5) & (dy >= -body * 0.6) & (dy <= F.col("ch") * 0.5))
    best = near.groupBy(*keys, "cap", "letter").agg(F.min_by(F.struct("line_no", "text"), F.struct(F.abs(dx) + F.abs(dy), F.col("line_no"))).alias("l"))
    best = best.where(F.col("l.text").rlike(r"""^[\p{L}"'“‘]""")).select(*keys, "cap", F.col("l.line_no").alias("line"), F.concat("letter", F.substring_index("l.text", " ", 1)).alias("joined"))
    first = Window.partitionBy(*keys, "line").orderBy("cap")
    return best.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def words_in_boxes(words: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, box, text: the words (x0, y0, x1, y1, t) of which more than half the width lies in a box of the same height, left to right."""
    b = boxes.select(*keys, F.col("box"), *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = F.least("x1", "bx1") - F.greatest("x0", "bx0")
    high = F.least("y1", "by1") - F.greatest("y0", "by0")
    met = words.join(b, keys).where((high > 0) & (inside > 0.5 * (F.col("x1") - F.col("x0"))))
    listed = met.groupBy(*keys, "box").agg(F.sort_array(F.collect_list(F.struct("x0", "t"))).alias("_w"))
    return listed.select(*keys, "box", F.array_join(F.transform("_w", lambda x: x["t"]), "").alias("text"))


def contents_runs_removed(starts: DataFrame, keys: list[str], most_gap: int = 2, least_run: int = 3) -> DataFrame:
    """Starts (page, para) without runs of ``least_run`` or more on one page with at most ``most_gap`` between neighbours: a list of contents."""
    w = Window.partitionBy(*keys).orderBy("para")
    new = F.coalesce(((F.col("page") != F.lag("page").over(w)) | (F.col("para") - F.lag("para").over(w) > most_gap)).cast("int"), F.lit(1))
    marked = starts.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sized = marked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run")))
    return sized.where(F.col("_n") < least_run).select(starts.columns)


def current_steps(steps: DataFrame, project: str, done: Column) -> DataFrame:
    """Steps of the latest run: what ended before the run's EXTRACT step began is pending again, or left out where the run is ``done``."""
    began = F.max(F.when(F.col("step") == "EXTRACT", F.col("started_at"))).over(Window.partitionBy(project))
    ended = F.col("status").isin("COMPLETED", "FAILED", "SKIPPED")
    old = (F.col("step") != "EXTRACT") & ended & began.isNotNull() & (F.col("finished_at").isNull() | (F.col("finished_at") < began))
    rows = steps.withColumn("_old", old).withColumn("_ended", ended)
    rows = rows.where(~done | (F.col("step") == "EXTRACT") | (F.col("_ended") & ~F.col("_old") & (F.col("status") != "FAILED")))
    return rows.withColumn("status", F.when(F.col("_old"), "PENDING").otherwise(F.col("status"))).withColumn("progress", F.when(F.col("_old"), 0.0).otherwise(F.col("progress"))).drop("_old", "_ended")


def restored_openings(openings: DataFrame, counts: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """key, fragment, next, word: the first word of a section whose decorative first letter is missing.

    Readings are the fragment itself and each letter A to Z before it; the book's own words decide: how often the next word
    follows, then how often the word occurs. A reading with a letter must occur three times and be better, not as good.
    """
    letters = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(65), F.lit(90)), lambda c: F.char(c)))
    tried = openings.select(key, "fragment", "next", F.posexplode(letters).alias("place", "letter"))
    tried = tried.withColumn("reading", F.concat("letter", "fragment")).withColumn("word", form_key(F.col("reading"))).withColumn("pair", F.concat_ws(" ", F.regexp_replace("word", r"\.$", ""), form_key(F.col("next"))))
    scored = tried.join(counts.select(key, "word", F.col("n").alias("uni")), [key, "word"], "left").join(pairs.select(key, "pair", F.col("n").alias("bi")), [key, "pair"], "left").na.fill(0, ["uni", "bi"])
    able = scored.where("place = 0 OR uni >= 3")
    best = able.groupBy(key, "fragment", "next").agg(F.max_by("reading", F.struct("bi", "uni", -F.col("place"))).alias("reading"))
    titled = F.concat(F.substring("reading", 1, 1), F.lower(F.substring("reading", 2, 99)))
    return best.select(key, "fragment", "next", F.when(F.col("reading") != F.col("fragment"), titled).otherwise(F.col("reading")).alias("word"))


def titled(steps: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """Steps with the titles of their stages; steps of unknown stages go."""
    return steps.join(titles, key)
