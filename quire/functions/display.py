"""What is shown to people, as Spark columns: clocks, durations, estimates, relative times, badges, error texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.publishing import joined

# Speed of each mode, in seconds of narration a second; words a minute; rights; errors.
MODE_SPEED = {"silent": (0.45, 2.0), "quiet": (2.9, 6.4), "balanced": (5.7, 12.0), "fast": (6.2, 12.0)}
WORDS_A_MINUTE = 155
RIGHTS = {"public_domain": "Public domain", "open": "Open licence", "restricted": "Restricted licence", "unknown": "Rights unknown"}
ERRORS = {
    "PDF_CORRUPT": ("This PDF could not be opened. It may be damaged or not a real PDF.", False),
    "PDF_UNSUPPORTED": ("This file is not a supported PDF document.", False),
    "PDF_PASSWORD": ("This PDF is password-protected. Remove the password and upload it again.", False),
    "PDF_EMPTY": ("This PDF is empty — it has no pages.", False),
    "PDF_NO_TEXT": ("No readable text was found in this PDF.", False),
    "TTS_ENGINE_UNAVAILABLE": ("The selected voice engine is not installed.", True),
    "TTS_VOICE_NOT_FOUND": ("The selected voice is not installed.", False),
    "TTS_FAILED": ("Speech generation failed.", True),
    "FFMPEG_MISSING": ("FFmpeg is not installed.", True),
    "FFMPEG_FAILED": ("Video encoding failed.", True),
    "OUT_OF_MEMORY": ("The computer ran out of memory.", True),
}
PORTS = {6379: "REDIS_UNAVAILABLE", 5432: "DB_UNAVAILABLE", 5433: "DB_UNAVAILABLE", 11434: "OLLAMA_UNAVAILABLE"}
STAGE_LABELS = {"EXTRACT": "Reading", "CLEAN": "Cleaning", "ANALYZE": "Chapters", "TTS": "Narration", "MASTER": "Mastering", "TIMELINE": "Timeline", "VIDEO": "Video", "MUX": "Finishing"}
PAGE_SIZE = (612.0, 792.0)
# End of the fixed values.


def _text(x: Column) -> Column:
    return x.cast("long").cast("string")


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clock(seconds: Column) -> Column:
    """1:02:05, or 1:05 under an hour; null counts as zero."""
    s = F.floor(F.greatest(F.lit(0.0), F.coalesce(seconds, F.lit(0.0))))
    tail = F.lpad(_text(s % 60), 2, "0")
    minutes = F.floor(s % 3600 / 60)
    return F.when(s >= 3600, F.concat_ws(":", _text(F.floor(s / 3600)), F.lpad(_text(minutes), 2, "0"), tail)).otherwise(F.concat_ws(":", _text(minutes), tail))


def long_duration(seconds: Column) -> Column:
    """1 h 2 min, 1 min 35 s, 2 min or 12 s; a dash for null."""
    s = _half_up(seconds)
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    minutes = F.when(r > 0, F.concat(_text(m), F.lit(" min "), _text(r), F.lit(" s"))).otherwise(F.concat(_text(m), F.lit(" min")))
    return F.when(seconds.isNull(), "—").when(s < 60, F.concat(_text(s), F.lit(" s"))).when(h > 0, F.concat(_text(h), F.lit(" h "), _text(m), F.lit(" min"))).otherwise(minutes)


def narration_seconds(words: Column, speed: Column) -> Column:
    """How long so many words take, at a voice's speed (0.5 at least)."""
    return words / WORDS_A_MINUTE / F.greatest(F.lit(0.5), speed) * 60


def work_hours(seconds: Column, mode: Column, video: Column) -> Column:
    """Hours of work for so much narration in a mode, with or without a video."""
    speech = F.coalesce(*[F.when(mode == k, F.lit(v[0])) for k, v in MODE_SPEED.items()])
    picture = F.coalesce(*[F.when(mode == k, F.lit(v[1])) for k, v in MODE_SPEED.items()])
    return (seconds / speech + F.when(video, seconds / picture).otherwise(0.0)) / 3600


def date_text(ts: Column) -> Column:
    """Jan 5, 2024, 3:07 PM, in the session's time zone."""
    return F.date_format(ts, "MMM d, yyyy, h:mm a")


def relative_time(ts: Column, now: Column) -> Column:
    """just now, 3 minutes ago, in 2 hours, yesterday; a date from a week on, and a dash for null."""
    diff = (F.unix_micros(ts.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1_000_000
    away = F.abs(diff)

    def said(unit: str, size: int, special: Mapping[int, str]) -> Column:
        n = _half_up(diff / size).cast("long")
        words = F.concat(F.abs(n).cast("string"), F.lit(f" {unit}"), F.when(F.abs(n) == 1, "").otherwise("s"))
        named = [F.when(n == k, F.lit(v)) for k, v in special.items()]
        return F.coalesce(*named, F.when(diff < 0, F.concat(words, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), words)))

    return (
        F.when(ts.isNull(), "—")
        .when(away > 7 * 86_400, date_text(ts))
        .when(away < 45, "just now")
        .when(away < 3600, said("minute", 60, {0: "this minute"}))
        .when(away < 86_400, said("hour", 3600, {0: "this hour"}))
        .otherwise(said("day", 86_400, {-1: "yesterday", 0: "today", 1: "tomorrow"}))
    )


def rights_badge(rights: Column, license_: Column) -> Column:
    """The label of a book's rights; a licence says more than the class it is in."""
    label = F.coalesce(*[F.when(rights == k, F.lit(v)) for k, v in RIGHTS.items()])
    return F.when(rights.isin("open", "restricted"), F.coalesce(license_, label)).otherwise(label)


def book_line(author: Column, year: Column, pages: Column, language: Column) -> Column:
    """Jane Austen · 1894 · 518 pages · English, without what is missing."""
    return joined(author, year.cast("string"), F.when(pages > 0, F.concat(pages.cast("string"), F.lit(" pages"))), language, sep=" · ")


def user_error(code: Column, port: Column) -> Column:
    """struct<code, message, retryable> of a technical error, by its code, or by the port that refused a connection."""

    def made(c: Column | str, message: str, retry: bool) -> Column:
        return F.struct((F.lit(c) if isinstance(c, str) else c).alias("code"), F.lit(message).alias("message"), F.lit(retry).alias("retryable"))

    known = [F.when(code == k, made(k, *v)) for k, v in ERRORS.items()]
    refused = code.isin("ECONNREFUSED", "ENOTFOUND")
    names = {"REDIS_UNAVAILABLE": "The background job service (Redis) is not running.", "DB_UNAVAILABLE": "The database (PostgreSQL) is not running.", "OLLAMA_UNAVAILABLE": "The local AI model service (Ollama) is not running."}
    services = [F.when(refused & (port == p), made(c, names[c], True)) for p, c in PORTS.items()]
    disk = F.when(code == "ENOSPC", made("DISK_FULL", "Your disk is full.", True))
    return F.coalesce(*known, disk, *services, made("INTERNAL", "Something went wrong while processing.", True))


def resources(mode: Column, on_battery: Column, quiet_on_battery: Column, cpus: Column, most_speech: Column, most_video: Column) -> Column:
    """struct<mode, reason, speech, threads, video, nice>: how much of a machine (without efficiency cores) a mode may use."""
    lowered = on_battery & quiet_on_battery & mode.isin("balanced", "fast")
    now = F.when(lowered, "quiet").otherwise(mode)
    speech, video = F.greatest(F.lit(1), most_speech), F.greatest(F.lit(1), most_video)

    def plan(p: Column | int, threads: Column | int, v: Column | int, nice: int) -> Column:
        own = [x if isinstance(x, Column) else F.lit(x) for x in (p, threads, v)]
        return F.struct(now.alias("mode"), F.when(lowered, "on battery").alias("reason"), own[0].cast("int").alias("speech"), own[1].cast("int").alias("threads"), own[2].cast("int").alias("video"), F.lit(nice).alias("nice"))

    fast = plan(speech, F.greatest(F.lit(2), F.floor(cpus * 0.6 / speech).cast("int")), video, 0)
    return F.when(now == "silent", plan(1, 1, 1, 15)).when(now == "quiet", plan(1, 2, 1, 10)).when(now == "fast", fast).otherwise(plan(F.least(F.lit(2), speech), 2, F.least(F.lit(2), video), 5))


def main_title(title: Column) -> Column:
    """A title without its subtitle."""
    return F.trim(F.element_at(F.split(title, r"\s+:\s+"), 1))


def voice_language(voice: Column) -> Column:
    """The language of a voice's name: en of en-US or en_GB, other of nothing."""
    return F.element_at(F.split(F.lower(F.coalesce(F.nullif(voice, F.lit("")), F.lit("other"))), "[-_]"), 1)


def stage_label(stage: Column) -> Column:
    return F.coalesce(*[F.when(stage == k, F.lit(v)) for k, v in STAGE_LABELS.items()])


def step_label(stage: Column, chapter: Column, title: Column, key: Column) -> Column:
    """A step by its chapter (from 0) and the chapter's title, else by its stage, else by its key."""
    number = (chapter + 1).cast("string")
    return F.when(chapter.isNotNull(), F.coalesce(F.concat(number, F.lit(". "), title), F.concat(F.lit("Chapter "), number))).otherwise(F.coalesce(stage_label(stage), key))


def retry_label(code: Column, chapter: Column, step: Column) -> Column:
    """What a button says after an error: resume what was interrupted, else retry a chapter, a stage, or all."""
    numbered = F.regexp_extract(F.coalesce(step, F.lit("")), r"^(?:TTS|VIDEO)_CHAPTER_([0-9]+)$", 1)
    stage = stage_label(step)
    return (
        F.when(code.isNull(), "Retry")
        .when(code == "INTERRUPTED", "Resume")
        .when(chapter.isNotNull(), F.concat(F.lit("Retry Chapter "), (chapter + 1).cast("string")))
        .when(numbered != "", F.concat(F.lit("Retry Chapter "), numbered))
        .when(stage.isNotNull(), F.concat(F.lit("Retry "), stage))
        .otherwise("Retry")
    )


def page_size(sizes: Column, page: Column) -> Column:
    """The size of a page in a map of sizes (array<double>) by page; else that of page 1, else a letter's."""
    return F.coalesce(F.try_element_at(sizes, page), F.try_element_at(sizes, F.lit(1)), F.array(*[F.lit(v) for v in PAGE_SIZE]))


def rounded_box(b: Column) -> Column:
    """A box (array<double>) to one place."""
    return F.transform(b, lambda v: F.floor(v * 10 + 0.5) / 10)
