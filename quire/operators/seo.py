"""Checks of a video's metadata, as rows of (check_id, status, weight), for ``catalog.score``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.functions.publishing import DESCRIPTION_MOST, TAGS_MOST, TITLE_MOST, TITLE_VISIBLE
from quire.functions.wording import CLAIM, TERM

# Characters of a description that search shows; hashtags beyond which they count as spam, or as none.
SNIPPET, HASHTAGS_GOOD, HASHTAGS_IGNORED = 150, 15, 60
# End of the fixed values.


def _norm(phrase: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(phrase), r"\s+", " "))


def metadata_checks(drafts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, check_id, status, weight for drafts with the columns title, keyword, book_author, partial, part, description, composed,
    include_chapters, chapters_problem, tags, hashtags, thumbnail, pinned, applied.

    A check that doesn't apply (a part of a whole book, a phrase that isn't set) gives no row.
    """
    title, keyword, body = F.trim("title"), _norm(F.col("keyword")), F.col("description")
    n, tags, hashtags = F.length(title), F.col("tags"), F.col("hashtags")
    surname = F.element_at(F.split(F.trim("book_author"), r"\s+"), -1)
    at = t.phrase_index(title, keyword)

    def check(name: str, weight: int, status: Column, applies: Column | None = None) -> Column:
        row = F.struct(F.lit(name).alias("check_id"), status.alias("status"), F.lit(float(weight)).alias("weight"))
        return row if applies is None else F.when(applies, row)

    def lacks(x: Column) -> Column:
        return F.coalesce(t.phrase_index(title, x) < 0, F.lit(False))

    set_ = keyword != ""
    claim = F.concat_ws(" ", title, body, "thumbnail").rlike(CLAIM)
    chars, invalid = t.tag_chars(tags), F.exists(hashtags, lambda h: t.sanitize_hashtag(h) != h)
    problem = F.col("chapters_problem").isNotNull()
    checks = [
        check("title-length", 3, F.when((n == 0) | (n > TITLE_MOST), "fail").when((n > TITLE_VISIBLE) | (n < 30), "warn").otherwise("pass")),
        check("keyword", 2, F.lit("warn"), ~set_),
        check("title-keyword", 3, F.when((at < 0) | (at > 40), "warn").otherwise("pass"), set_),
        check("title-format", 2, F.when(lacks(F.lit("audiobook")) | lacks(surname), "warn").otherwise("pass"), n > 0),
        check("scope", 3, F.when(claim, "fail").when(lacks(F.coalesce("part", F.lit("part of the book"))), "warn").otherwise("pass"), F.col("partial")),
        check("brackets", 2, F.lit("fail"), title.rlike("[<>]") | F.col("composed").rlike("[<>]")),
        check("desc-length", 2, F.when(F.length("composed") > DESCRIPTION_MOST, "fail").when(F.size(F.regexp_extract_all(F.lower(body), F.lit(f"({TERM})"), F.lit(1))) < 80, "warn").otherwise("pass")),
        check("desc-hook", 2, F.when(t.phrase_index(F.substring(F.trim(body), 1, SNIPPET), keyword) >= 0, "pass").otherwise("warn"), set_),
        check("desc-cta", 1, F.when(body.rlike("(?i)subscribe|comment|সাবস্ক্রাইব|কমেন্ট|মন্তব্য"), "pass").otherwise("warn")),
        check("chapters", 2, F.when(~F.col("include_chapters"), F.when(problem, "pass").otherwise("warn")).when(problem, "warn").otherwise("pass")),
        check("tags", 1, F.when(chars > TAGS_MOST, "fail").when(F.size(tags) < 5, "warn").otherwise("pass")),
        check("tags-keyword", 1, F.lit("warn"), set_ & (F.size(tags) > 0) & ~F.exists(tags, lambda x: _norm(x) == keyword)),
        check("hashtags", 1, F.when(invalid | (F.size(hashtags) > HASHTAGS_IGNORED), "fail").when((F.size(hashtags) > HASHTAGS_GOOD) | (F.size(hashtags) == 0), "warn").otherwise("pass")),
        check("thumbnail", 2, F.when(F.col("thumbnail") != "", "pass").otherwise("warn")),
        check("pinned", 1, F.when(F.trim("pinned") != "", "pass").otherwise("warn")),
        check("file-tags", 1, F.when(F.col("applied") == "current", "pass").otherwise("warn")),
    ]
    return drafts.select(*keys, F.inline(F.filter(F.array(*checks), lambda c: c.isNotNull())))


#: Statuses from the worst to the best.
_WORST_FIRST = ("fail", "warn", "pass")


def worst_first(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Checks with their place in a list that has the worst first, then the heaviest."""
    from pyspark.sql import Window

    rank = F.coalesce(*[F.when(F.col("status") == s, F.lit(k)) for k, s in enumerate(_WORST_FIRST)])
    return checked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, F.desc("weight"), "check_id")))
