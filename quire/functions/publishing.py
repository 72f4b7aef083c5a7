"""Publishing metadata as Spark columns: labels, descriptions, social posts, media tags, verdicts on length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERAL, NAMED_PART = r"(?i)^([ivxlcdm]+|[0-9]+)\.?$", r"(?i)^(chapter|part|book|section|volume)(\s|$)"
#: Limits of video sites. Fixed values.
TITLE_MOST, TITLE_VISIBLE, DESCRIPTION_MOST, TAGS_MOST, LINK_CHARS = 100, 70, 5000, 500, 23


def _bare(title: Column) -> Column:
    return F.regexp_replace(title, r"\.$", "")


def _one(title: Column) -> Column:
    return F.when(title.rlike(NAMED_PART), title).when(title.rlike(NUMERAL), F.concat(F.lit("Chapter "), _bare(title))).otherwise(title)


def part_label(titles: Column) -> Column:
    """What a range of chapters is called: one by its title, several by the first and the last."""
    first, last = F.coalesce(F.try_element_at(titles, F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(titles, F.lit(-1)), F.lit(""))
    both = F.when(first.rlike(NUMERAL) & last.rlike(NUMERAL), F.concat(F.lit("Chapters "), _bare(first), F.lit("–"), _bare(last))).otherwise(F.concat(_one(first), F.lit(" – "), _one(last)))
    return F.when(F.size(titles) <= 1, _one(first)).otherwise(both)


def joined(*parts: Column, sep: str = "\n\n") -> Column:
    """The parts that aren't empty, one after another."""
    return F.concat_ws(sep, *[F.nullif(F.trim(F.coalesce(p, F.lit(""))), F.lit("")) for p in parts])


def hashtag_text(tags: Column) -> Column:
    return F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " ")


def description(body: Column, chapters: Column, note: Column, tags: Column) -> Column:
    """The full description: body, chapter lines, a note on the voice, hashtags."""
    listed = F.when(F.size(chapters) > 0, F.concat(F.lit("Chapters:\n"), F.array_join(chapters, "\n")))
    return joined(body, listed, note, hashtag_text(tags))


def social_length(text: Column, tags: Column, url: Column, short_links: bool) -> Column:
    """Length of a post as a site counts it; some count every link as 23 characters."""
    own = joined(text, hashtag_text(tags))
    linked = F.coalesce(F.trim(url), F.lit("")) != ""
    if short_links:
        return F.length(own) + F.when(linked, F.when(own != "", 2).otherwise(0) + LINK_CHARS).otherwise(0)
    return F.length(joined(text, url, hashtag_text(tags)))


def media_tags(fields: dict[str, Column], body: Column, tags: Column, audio: bool = False) -> Column:
    """The map of tags of a media file; empty values clear a tag. The description is clipped at 255 characters."""
    flat = F.trim(F.regexp_replace(body, r"\s+", " "))
    short = F.when(F.length(flat) > 255, F.concat(F.rtrim(F.substring(flat, 1, 254)), F.lit("…"))).otherwise(flat)
    own = {k: F.trim(F.coalesce(v, F.lit(""))) for k, v in fields.items()} | {"description": short, "keywords": F.array_join(tags, ",")}
    if audio:
        own["media_type"] = F.lit("2")
    return F.map_from_arrays(F.array(*[F.lit(k) for k in own]), F.array(*own.values()))


def metadata_text(value: Column) -> Column:
    """A value as a line of an ffmetadata file can hold it."""
    return F.regexp_replace(value, r"([=;#\\\n])", r"\\$1")


def title_verdict(title: Column) -> Column:
    n = F.length(F.trim(title))
    return F.when(n == 0, "missing").when(n > TITLE_MOST, "too long").when(n > TITLE_VISIBLE, "may be cut off").when(n < 30, "short").otherwise("good")


def bytes_text(n: Column) -> Column:
    """1.5 MB, 12 KB, 3 B: to one place from a megabyte on."""
    return (
        F.when(n >= 1 << 30, F.concat(F.format_string("%.1f", n / (1 << 30)), F.lit(" GB")))
        .when(n >= 1 << 20, F.concat(F.format_string("%.1f", n / (1 << 20)), F.lit(" MB")))
        .when(n >= 1 << 10, F.concat(F.floor(n / (1 << 10) + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def elapsed_text(start: Column, end: Column) -> Column:
    """The time between two timestamps; null if one is missing or they are the wrong way round."""
    ms = F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))
    s = F.floor(ms / 1000)
    text = F.when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).when(s < 60, F.concat(s.cast("string"), F.lit(" s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" m "), (s % 60).cast("string"), F.lit(" s"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit(" h "), (F.floor(s / 60) % 60).cast("string"), F.lit(" m")))
    return F.when(ms >= 0, text)


def phase(status: Column, queued: Column) -> Column:
    """A project's phase: idle, queued, active, review, completed, failed or cancelled."""
    return (
        F.when(status == "COMPLETED", "completed").when(status == "FAILED", "failed").when(status == "CANCELLED", "cancelled")
        .when(status == "AWAITING_REVIEW", "review").when(status == "PENDING", F.when(queued, "queued").otherwise("idle")).otherwise("active")
    )


def quantized_speed(speed: Column) -> Column:
    """A voice's speed: 0.5 to 2, in steps of 0.05."""
    return F.floor(F.least(F.greatest(speed, F.lit(0.5)), F.lit(2.0)) * 20 + 0.5) / 20


def short_parts(words: Column, per_minute: float = 165.0, seconds: float = 58.0, most: int = 10) -> Column:
    """How many short videos a script of so many words makes."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(words * 60 / per_minute / seconds).cast("int")))


def kit_text(parts: dict[str, Column]) -> Column:
    """Everything that a site asks for, as text under headings; what is empty is left out."""
    return joined(*[F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(F.lit(f"{k}\n"), v)) for k, v in parts.items()])
