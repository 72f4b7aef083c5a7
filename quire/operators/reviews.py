"""Reviews of chapter lists, coverage, reports and sizes: operators on the tables around a book."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.functions.display import voice_language

#: Share of a book's words from which a narration counts as the whole of it.
COMPLETE = 0.85


def signature(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, signature: SHA-256 of the ordered list of (idx, title, page_start, page_end) as JSON."""
    listed = F.sort_array(F.collect_list(F.struct("idx", "title", "page_start", "page_end")))
    return chapters.groupBy(*keys).agg(F.sha2(F.to_json(listed), 256).alias("signature"))


def applicable(reviews: DataFrame, analyses: DataFrame, keys: list[str]) -> DataFrame:
    """keys, applies: whether a review (analysis_key, signature) is of the current analysis (analysis_key, signature).

    It is if the analysis has no key or the same one, or else the same chapters.
    """
    now = analyses.select(*keys, F.col("analysis_key").alias("_key"), F.col("signature").alias("_sig"))
    same = F.col("_key").isNull() | F.equal_null("analysis_key", "_key") | F.coalesce(F.col("signature") == F.col("_sig"), F.lit(False))
    return reviews.join(now, keys).select(*keys, same.alias("applies"))


def review_problems(chapters: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem of reviews that can't be saved: numbers (from 1) that no chapter has, else that nothing is kept."""
    known = chapters.select(*keys, "idx")
    unknown = edits.join(known, [*keys, "idx"], "left_anti").groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_set("idx")), lambda i: (i + 1).cast("string")), ", ").alias("_ids"))
    left = known.join(edits.where("exclude").select(*keys, "idx").distinct(), [*keys, "idx"], "left_anti").select(*keys).distinct().withColumn("_some", F.lit(True))
    rows = edits.select(*keys).distinct().join(unknown, keys, "left").join(left, keys, "left")
    problem = F.when(F.col("_ids").isNotNull(), F.concat(F.lit("unknown: "), F.col("_ids"))).when(F.col("_some").isNull(), "nothing is kept")
    return rows.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def edits_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, idx, exclude, title, merge of reviewed rows (idx, include, title, original, merge).

    A title only if it is new, and a merge only after a row that is kept; of excluded rows neither.
    """
    before = F.max(F.col("include").cast("int")).over(Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    own = F.trim("title")
    title = F.when(F.col("include") & (own != "") & ~F.equal_null(own, F.col("original")), own)
    return rows.select(*keys, "idx", (~F.col("include")).alias("exclude"), title.alias("title"), (F.col("include") & F.col("merge") & (F.coalesce(before, F.lit(0)) == 1)).alias("merge"))


def coverage(chapters: DataFrame, segments: DataFrame, keys: list[str], ranged: Column) -> DataFrame:
    """keys, narrated, words, first_page, last_page, complete: how much of the body chapters (words, matter) the segments (text, page) say.

    Without words in the body, a narration is complete unless a range was asked for (``ranged``, an aggregate over chapters).
    """
    body = chapters.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("matter").isNull(), F.col("words"))), F.lit(0)).alias("words"), ranged.alias("_ranged"))
    said = segments.groupBy(*keys).agg(F.sum(F.size(t.tokens(F.col("text")))).alias("narrated"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    both = body.join(said, keys, "left").withColumn("narrated", F.coalesce("narrated", F.lit(0)))
    complete = F.when(F.col("words") > 0, F.col("narrated") >= F.col("words") * COMPLETE).otherwise(~F.col("_ranged"))
    return both.select(*keys, "narrated", "words", "first_page", "last_page", complete.alias("complete"))


def cleaning_report(lines: DataFrame, keys: list[str], most: int = 20, parts: int = 32) -> DataFrame:
    """keys, reason, n, texts: how many lines (page, line_no, text) were dropped for each reason, and their first ``most`` distinct texts as they come.

    Texts are counted first, and the first of each of ``parts`` shares of them are found before the first of all.
    """
    texts = lines.where("reason IS NOT NULL").groupBy(*keys, "reason", F.trim("text").alias("_t")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("page", "line_no")).alias("_at"))
    counts = texts.groupBy(*keys, "reason").agg(F.sum("_n").alias("n"))
    share = Window.partitionBy(*keys, "reason", F.pmod(F.xxhash64("_t"), F.lit(parts))).orderBy("_at", "_t")
    first = texts.withColumn("_r", F.row_number().over(share)).where(F.col("_r") <= most)
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "reason").orderBy("_at", "_t"))).where(F.col("_r") <= most)
    listed = first.groupBy(*keys, "reason").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_t"))), lambda x: x["_t"]).alias("texts"))
    return counts.join(listed, [*keys, "reason"])


def voice_groups(voices: DataFrame, preferred: str) -> DataFrame:
    """place, language, voices: names by language, the preferred language first; in one, by accent, then gender, then name."""
    gender = F.when(F.col("gender") == "female", 0).when(F.col("gender") == "male", 1).when(F.col("gender") == "neutral", 2).otherwise(3)
    own = voices.withColumn("_lang", voice_language(F.col("language")))
    listed = own.groupBy(F.col("_lang").alias("language")).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("accent", F.lit("")).alias("a"), gender.alias("g"), t.natural_key(F.col("name")).alias("k"), F.col("name").alias("n")))).alias("x"))
    first = Window.orderBy(F.when(F.col("language") == preferred, 0).otherwise(1), "language")  # a row for each language
    return listed.select((F.row_number().over(first) - 1).alias("place"), "language", F.transform("x", lambda x: x["n"]).alias("voices"))


def even_sizes(lines: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Lines with the weighted median size (by characters) of their key in place of sizes within [low, high] of it."""
    sums = lines.groupBy(*keys, "size").agg(F.sum("chars").alias("_n"))
    running = Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_run", F.sum("_n").over(running)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    middle = sums.where("2 * _run >= _all").groupBy(*keys).agg(F.min("size").alias("_mid"))
    return lines.join(middle, keys).withColumn("size", F.when(F.col("size").between(F.col("_mid") * low, F.col("_mid") * high), F.col("_mid")).otherwise(F.col("size"))).drop("_mid")


def damage_ratios(words: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """keys, damage: the share of a page's words (chars, counts, broken, legacy) that are broken, of those that count.

    1 if the page has ``least`` characters, and more than three tenths of them in fonts that stand for other letters.
    """
    sums = words.groupBy(*keys).agg(F.sum("chars").alias("c"), F.sum(F.when(F.col("legacy"), F.col("chars")).otherwise(0)).alias("l"), F.count_if("counts").alias("n"), F.count_if(F.col("counts") & F.col("broken")).alias("b"))
    return sums.select(*keys, F.when((F.col("c") >= least) & (F.col("l") / F.col("c") > 0.3), 1.0).when(F.col("n") > 0, F.col("b") / F.col("n")).otherwise(0.0).alias("damage"))


def drop_cap_heights(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the body's size where only a drop cap made them tall: five words or more, and an indented line of the body's
    size begins inside them."""
    own = lines.withColumn("_row", F.monotonically_increasing_id()) if "line_no" not in lines.columns else lines.withColumn("_row", F.col("line_no").cast("long"))
    tall = own.where((F.col("size") >= F.col("body") * 1.18) & (F.size(t.tokens(F.col("text"))) >= 5)).select(*keys, "_row", "x0", "y0", "y1", "body")
    beside = own.where(F.abs(F.col("size") - F.col("body")) <= F.col("body") * 0.2).select(*keys, F.col("_row").alias("_other"), F.col("x0").alias("_x"), F.col("y0").alias("_y"))
    inside = (F.col("_other") != F.col("_row")) & (F.col("_y") > F.col("y0")) & (F.col("_y") < F.col("y1") - F.col("body") * 0.4) & (F.col("_x") >= F.col("x0") + F.col("body")) & (F.col("_x") < F.col("x0") + F.col("body") * 6)
    fixed = tall.join(beside, keys).where(inside).select(*keys, "_row").distinct().withColumn("_fix", F.lit(True))
    return own.join(fixed, [*keys, "_row"], "left").withColumn("size", F.when(F.col("_fix"), F.col("body")).otherwise(F.col("size"))).select(lines.columns)


def auto_hyphens(lines: DataFrame, key: str) -> DataFrame:
    """key, auto: whether a book marks automatic breaks with U+2010: three lines or more end with a letter and that mark."""
    last = F.try_element_at(t.tokens(F.col("text")), F.lit(-1))
    return lines.groupBy(key).agg((F.count_if(F.coalesce(last.rlike(r"[\p{L}\p{M}]\x{2010}$"), F.lit(False))) >= 3).alias("auto"))


def token_offsets(texts: DataFrame, key: str) -> DataFrame:
    """key, k, start, end: where each token stands in the text of tokens joined by single spaces."""
    rows = texts.select(key, F.posexplode(t.tokens(F.col("text"))).alias("k", "w"))
    before = F.coalesce(F.sum(F.length("w") + 1).over(Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", before).select(key, "k", "start", (F.col("start") + F.length("w")).alias("end"))


def tokens_in_spans(offsets: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, span, first, last: the tokens that overlap each span (span, a, b)."""
    met = spans.join(offsets, key).where("start < b AND end > a")
    return met.groupBy(key, "span").agg(F.min("k").alias("first"), F.max("k").alias("last"))


def resolved(given: DataFrame, defaults: Mapping[str, str], keys: list[str]) -> DataFrame:
    """keys, path, value: the leaves of settings (path, value), a default wherever a key gives none (a deep merge, by leaves)."""
    own = given.where("value IS NOT NULL").select(*keys, "path", "value")
    leaves = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("_default")) for p, v in defaults.items()])
    all_ = given.select(*keys).distinct().select(*keys, F.inline(leaves))
    return all_.join(own, [*keys, "path"], "full").select(*keys, "path", F.coalesce("value", "_default").alias("value"))


def sparse(rows: DataFrame, keys: list[str], defaults: Mapping[str, object]) -> DataFrame:
    """keys, options: the values that aren't the default's, as JSON."""
    own = F.struct(*[F.when(~F.equal_null(F.col(c), F.lit(v)), F.col(c)).alias(c) for c, v in defaults.items()])
    return rows.select(*keys, F.to_json(own, {"ignoreNullFields": "true"}).alias("options"))


def same_pictures(segments: DataFrame, made: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reuse: whether the list of segment keys is that of the picture made before."""
    def listed(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "key"))), lambda x: x["key"]).alias(name))

    return listed(segments, "_now").join(listed(made, "_then"), keys, "left").select(*keys, F.coalesce(F.col("_now") == F.col("_then"), F.lit(False)).alias("reuse"))


def reading_order(rows: DataFrame) -> DataFrame:
    """Rows (chapter, paragraph, key) with their place in reading order within a chapter; the sentence's number ends the key (…-s12)."""
    n = F.coalesce(F.regexp_extract("key", r"-s([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("chapter").orderBy("paragraph", n, "key")))


def freed_bytes(files: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """keys, files, bytes: what deleting the paths in ``dropped`` frees."""
    return files.join(dropped.select("path").distinct(), "path", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def picked_voices(wanted: DataFrame, voices: DataFrame) -> DataFrame:
    """key, voice for rows (key, preferred, language): the preferred voice if it is there, else the first (by place) of the language,
    else the first of all. ``voices``: id, language, place.

    A voice is of each language that its own begins with; the beginnings of the distinct ones are listed, so both look-ups are equi-joins.
    """
    ids = voices.where(F.col("id").isNotNull()).select(F.col("id").alias("preferred")).distinct().withColumn("_known", F.lit(True))
    spoken = voices.where(F.col("language").isNotNull()).groupBy(F.col("language").alias("_l")).agg(F.min(F.struct("place", "id")).alias("_v"))
    begins = F.transform(F.sequence(F.lit(0), F.length("_l")), lambda n: F.substring("_l", F.lit(1), n))
    own = spoken.select(F.explode(begins).alias("language"), "_v").groupBy("language").agg(F.min("_v")["id"].alias("_own"))
    first = voices.agg(F.min(F.struct("place", "id"))["id"].alias("_first"))  # one row
    rows = wanted.join(ids, "preferred", "left").join(own, "language", "left").join(F.broadcast(first))
    return rows.select("key", F.when(F.col("_known"), F.col("preferred")).otherwise(F.coalesce("_own", "_first")).alias("voice"))


def same_drafts(a: DataFrame, b: DataFrame, keys: list[str], ignored: list[str]) -> DataFrame:
    """keys, same: whether two versions of a draft are equal but for the columns in ``ignored``."""
    own = [c for c in a.columns if c not in keys and c not in ignored]
    def whole(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(*keys, F.to_json(F.struct(*own)).alias(name))

    return whole(a, "_a").join(whole(b, "_b"), keys).select(*keys, (F.col("_a") == F.col("_b")).alias("same"))
