"""Durations, clocks and speaking times as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """Half up on the binary value: Spark's own ``round`` goes by the decimal text."""
    k = 10**digits
    return F.floor(x * k + 0.5) / k


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def srt_time(seconds: Column) -> Column:
    """00:00:00,000; less than zero counts as zero."""
    ms = F.floor(F.greatest(seconds, F.lit(0.0)) * 1000 + 0.5)
    s = F.floor(ms / 1000)
    return F.concat(F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lit(":"), _two(F.floor(s / 60) % 60), F.lit(":"), _two(s % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def chapter_time(seconds: Column, long: Column | None = None) -> Column:
    """00:00 under an hour, 0:00:00 from an hour on (or where ``long``)."""
    s = F.floor(F.greatest(seconds, F.lit(0.0)))
    long = (seconds >= 3600) if long is None else long
    short = F.concat(_two(F.floor(s / 60) % 60), F.lit(":"), _two(s % 60))
    return F.when(long, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), short)).otherwise(short)


def duration_text(seconds: Column) -> Column:
    """1 h 05 m, 3 m 20 s or 12 s."""
    s = F.floor(F.greatest(seconds, F.lit(0.0)) + 0.5)
    h, m = F.floor(s / 3600), F.floor(s / 60) % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(" h "), _two(m), F.lit(" m"))).when(m > 0, F.concat(m.cast("string"), F.lit(" m "), _two(s % 60), F.lit(" s"))).otherwise(F.concat(s.cast("string"), F.lit(" s")))


def parse_time(text: Column) -> Column:
    """Seconds of ``1:02:03``, ``62:03``, ``1h2m3s`` or a plain number; null for anything else."""
    t = F.lower(F.trim(text))

    def part(pattern: str, k: int) -> Column:
        return F.coalesce(F.regexp_extract(t, pattern, k).try_cast("double"), F.lit(0.0))

    clock, units = r"^(?:([0-9]+):)?([0-9]{1,2}):([0-9]{1,2})$", r"^(?:([0-9]+)h)?(?:([0-9]+)m)?(?:([0-9]+)s)?$"
    def total(p: str) -> Column:
        return part(p, 1) * 3600 + part(p, 2) * 60 + part(p, 3)
    return F.when(t == "", None).when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), t.try_cast("double")).when(t.rlike(clock), total(clock)).when(t.rlike(units), total(units))


#: Words that end with a full stop without a pause. Fixed values.
SPOKEN_ABBREVIATION = r"(?i)^(?:mr|mrs|ms|dr|st|jr|sr|prof|rev|gen|capt|col|lt|sgt|vs|etc|no|vol|fig|p|pp|ch)\.$|^(?:\p{L}\p{M}*\.)+$"


def speech_weight(word: Column, last: Column) -> Column:
    """Relative time to say a word, in characters: letters, half as much again for digits, and the pause its marks invite."""
    spoken = F.length(F.regexp_replace(word, r"[^\p{L}\p{M}\p{N}]+|[\x{09BC}\x{09CD}]", ""))
    digits = F.length(F.regexp_replace(word, r"[^\p{N}]+", ""))
    pause = (
        F.when(last | word.rlike(SPOKEN_ABBREVIATION), 0.0)
        .when(word.rlike("[—–-]$"), 2.0)
        .when(word.rlike(r"""[.!?…।॥]["'”’)\]]*$"""), 5.0)
        .when(word.rlike("[;:]$"), 4.0)
        .when(word.rlike(r"""[,)\]”’"']$"""), 2.5)
        .otherwise(0.0)
    )
    # Most words are ASCII letters only: one test instead of seven.
    return F.when(word.rlike("^[A-Za-z]+$"), F.length(word) + 1.0).when(spoken == 0, 0.5).otherwise(spoken + digits * 1.5 + 1 + pause)
