"""Wording of scripts, titles and posts as Spark columns: clean-up, paragraphs, hashtags, titles and their scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.functions.publishing import TITLE_MOST, TITLE_VISIBLE

# Code points of pictographs, what marks a claim of the whole book, words that name an audiobook.
PICTOGRAPH = r"[\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{2199}\x{21A9}\x{21AA}\x{231A}\x{231B}\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}\x{2690}-\x{2705}\x{2708}-\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1F0FF}\x{1F10D}-\x{1F10F}\x{1F12F}\x{1F16C}-\x{1F171}\x{1F17E}\x{1F17F}\x{1F18E}\x{1F191}-\x{1F19A}\x{1F1AD}-\x{1F1E5}\x{1F201}-\x{1F20F}\x{1F21A}\x{1F22F}\x{1F232}-\x{1F23A}\x{1F23C}-\x{1F23F}\x{1F249}-\x{1F3FA}\x{1F400}-\x{1F53D}\x{1F546}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F774}-\x{1F77F}\x{1F7D5}-\x{1F7FF}\x{1F80C}-\x{1F80F}\x{1F848}-\x{1F84F}\x{1F85A}-\x{1F85F}\x{1F888}-\x{1F88F}\x{1F8AE}-\x{1F8FF}\x{1F90C}-\x{1F93A}\x{1F93C}-\x{1F945}\x{1F947}-\x{1FAFF}\x{1FC00}-\x{1FFFD}]\x{FE0F}?"
TAG = r"[\p{L}\p{M}\p{N}_]+"
WHOLE_BOOK = r"(full|complete|unabridged|entire|whole)[- ](length )?(audiobook|audio book|book|novel|story)"
SENTENCE = r"""[^.!?।]+[.!?।]+["'’”)]*\s*|[^.!?।]+$"""
CLAIM = r"(?i)(?<![A-Za-z0-9_])(full|complete|unabridged|entire|whole)(?![A-Za-z0-9_])"
TERM = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}'’]*"
SCRIPT_MOST = 4000
# End of the fixed values.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_script(raw: Column, most: int = SCRIPT_MOST) -> Column:
    """What a voice may read of a script: without bullets, emphasis, speakers, directions, hashtags and pictographs."""

    def line(x: Column) -> Column:
        x = F.regexp_replace(F.regexp_replace(x, r"^\s*(?:[-*•]+|[0-9]+[.)])\s+", ""), "[*_`~]+", "")
        return F.regexp_replace(F.regexp_replace(x, r"(?i)^\s*(?:narrator|voice ?over|vo|host|speaker)\s*:\s*", ""), r"^\s*#{1,6}\s+", "")

    lines = F.transform(F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r\n?", "\n"), "\n"), line)
    text = F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^\s*[\[(].*[\])]\s*$")), "\n")
    text = F.regexp_replace(text, r"(?i)\[[^\]\n]{0,40}\]|\((?:music|pause|beat|sfx|sound)[^)\n]{0,30}\)", "")
    text = F.regexp_replace(F.regexp_replace(text, rf"(^|\s)#{TAG}", "$1"), PICTOGRAPH, "")
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), " *\n *", "\n")
    return t.clean_text(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""), most)


def clean_batch_title(raw: Column) -> Column:
    """One line without emphasis, hashtags, pictographs and quotes around it, of 100 characters at most."""
    text = F.regexp_replace(F.regexp_replace(raw, "[*_`#]+", ""), PICTOGRAPH, "")
    return t.clip(_squeezed(F.regexp_replace(text, r"""^["'“”‘’\s]+|["'“”‘’\s]+$""", "")), TITLE_MOST)


def title_of_script(script: Column) -> Column:
    """A script's first sentence, as a title."""
    first = F.element_at(F.split(script, r"(?<=[.!?।])\s|\n"), 1)
    own = clean_batch_title(F.regexp_replace(first, "[.।]$", ""))
    return F.when(own == "", "Untitled short").otherwise(own)


def listed(raw: Column) -> Column:
    """The entries of a list separated by commas, semicolons or lines, without marks around them."""
    parts = F.transform(F.split(raw, r"[,\n;]+"), lambda x: F.trim(F.regexp_replace(x, r"^[\s#*•-]+|[\s*]+$", "")))
    return F.filter(parts, lambda x: x != "")


def hashtag_words(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit(f"#?({TAG})"), F.lit(1))


def without_hashtags(text: Column) -> Column:
    """struct<text, tags>: hashtags written in a text, moved to a list."""
    bare = F.regexp_replace(F.regexp_replace(text, rf"(^|\s)#{TAG}", "$1"), "[ \t]{2,}", " ")
    return F.struct(F.trim(F.regexp_replace(bare, r"\s+([.,!?])", "$1")).alias("text"), F.regexp_extract_all(text, F.lit(f"#({TAG})"), F.lit(1)).alias("tags"))


def recased(tags: Column, known: Column) -> Column:
    """Tags in the spelling of those that are known, whatever their case; of known ones with one lower-case form the last counts."""
    return F.transform(tags, lambda x: F.coalesce(F.try_element_at(F.filter(known, lambda k: F.lower(k) == F.lower(x)), F.lit(-1)), x))


def without_bio_link(text: Column, own_bio: Column) -> Column:
    """A text without "link in bio" where a site has none."""
    return F.when(own_bio, text).otherwise(F.trim(F.regexp_replace(text, rf"(?i)\s*\(?{_B}link in (?:the )?bio{_E}\)?[.!]*", "")))


def without_trailing_tag(text: Column, tags: Column) -> Column:
    """A text without a hashtag written as its last word."""
    last = F.regexp_extract(text, rf"\s+({TAG})[.!]?$", 1)
    return F.when((last != "") & F.exists(tags, lambda x: F.lower(x) == F.lower(last)), F.trim(F.regexp_replace(text, rf"\s+{TAG}[.!]?$", ""))).otherwise(text)


def paragraphs_of_three(text: Column) -> Column:
    """A text of 90 words or more without a line break, as paragraphs of three sentences."""

    def cut(s: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 3).cast("int")), lambda k: F.trim(F.array_join(F.slice(s, k * 3 + 1, F.lit(3)), "")))
        return F.array_join(F.filter(groups, lambda g: g != ""), "\n\n")

    long = ~text.contains("\n") & (F.size(F.split(text, r"\s+")) >= 90)
    return F.when(long, t.let(F.regexp_extract_all(text, F.lit(f"({SENTENCE})"), F.lit(1)), lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(text))).otherwise(text)


def scrubbed(text: Column, partial: Column) -> Column:
    """A text that says "follow along" for "read along" and, where a part of a book is narrated, claims no whole one."""
    out = F.regexp_replace(F.regexp_replace(text, rf"{_B}R(?i:ead)([- ])(?i:along){_E}", "Follow$1along"), rf"{_B}r(?i:ead)([- ])(?i:along){_E}", "follow$1along")
    out = F.when(partial, F.regexp_replace(out, rf"(?i){_B}{WHOLE_BOOK}{_E}", "$3")).otherwise(out)
    return F.regexp_replace(out, "[ \t]{2,}", " ")


def scrubbed_title(title: Column) -> Column:
    """A title without "read-along"."""
    out = F.regexp_replace(title, rf"(?i){_B}read[- ]along\s+(text|video|audiobook){_E}", "$1")
    out = F.regexp_replace(out, rf"(?i)\s*[:|–-]?\s*{_B}read[- ]along{_E}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\s{2,}", " "), r"\s*[:|–-]\s*$", ""))


def title_score(title: Column, book: Column, surname: Column, word: Column, partial: Column, part: Column) -> Column:
    """How well a title works in search: the book early on, the author, the word, the length; no false claims."""
    n = F.length(title)
    at = t.phrase_index(title, book)

    def has(x: Column) -> Column:
        return F.coalesce(t.phrase_index(title, x) >= 0, F.lit(False))

    length = F.when((n >= 45) & (n <= TITLE_VISIBLE), 2).when((n >= 30) & (n <= 80), 1).otherwise(0)
    loud = F.size(F.regexp_extract_all(title, F.lit(f"({_B}[A-Z]{{4,}}{_E})"), F.lit(1))) > 1
    score = F.when(at < 0, 0).when(at <= 8, 4).otherwise(2) + F.when(has(surname), 2).otherwise(0) + F.when(has(word), 3).otherwise(0) + length
    score = score - F.when(title.rlike("(?i)read[- ]?along"), 3).otherwise(0) - F.when(loud, 2).otherwise(0)
    part_score = F.when(has(part), 3).otherwise(0) - F.when(title.rlike(CLAIM), 8).otherwise(0)
    return F.when(n > TITLE_MOST, -100).otherwise(score + F.when(partial, part_score).otherwise(0))


def fitting_title(candidates: Column) -> Column:
    """The first candidate that search results show whole, else the shortest, clipped."""
    clean = F.filter(F.transform(candidates, _squeezed), lambda c: F.coalesce(c != "", F.lit(False)))
    fits = F.try_element_at(F.filter(clean, lambda c: F.length(c) <= TITLE_VISIBLE), F.lit(1))
    shortest = F.array_min(F.transform(clean, lambda c, i: F.named_struct(F.lit("n"), F.length(c), F.lit("i"), i, F.lit("c"), c)))["c"]
    return F.coalesce(fits, F.trim(F.substring(shortest, 1, TITLE_MOST)), F.lit("Audiobook"))


def suggested_tags(title: Column, hashtags: Column, book: Column, author: Column, most: int = 15) -> Column:
    """Search tags made of a book, its author and a short's title and hashtags (English), as many as the budget holds."""
    own = F.element_at(F.split(F.trim(book), r"\s+:\s+"), 1)
    readable = F.filter(hashtags, lambda h: ~F.lower(h).isin("shorts") & (h.rlike(r"\p{Lu}") | h.rlike(r"[^\p{IsLatin}\p{N}_]")))
    of_book = F.when(own.isNotNull(), F.array(*[F.lit(x) for x in ("audiobook", "book summary", "booktok", "books")])).otherwise(F.array().cast("array<string>"))
    first = F.array(own, F.concat(own, F.lit(" "), author), author, F.concat(own, F.lit(" audiobook")), F.concat(own, F.lit(" summary")), F.concat(author, F.lit(" books")), F.when(F.length(title) <= 60, F.trim(F.regexp_replace(title, "[*#]", ""))))
    all_ = F.concat(first, F.transform(readable, t.un_camel), of_book, F.array(F.lit("shorts"), F.lit("youtube shorts")))
    return F.slice(t.fit_tags(F.filter(all_, lambda x: F.coalesce(x != "", F.lit(False)))), 1, most)


def first_sentence(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"^\s*([^.!?।]*[.!?।]*)", 1))


def numbered_section(text: Column) -> Column:
    """Whether a text is nothing but the number of a section or page: digits, a well-formed roman number under 400, or what
    text recognition makes of one."""
    own = F.trim(text)
    edge, tail = r"^[\s\-–—•·§#]*[\[{(]?", r"[\]})]?[.:]?[\s\-–—•·]*$"
    roman = F.regexp_extract(own, f"{edge}([IVXLCDM]{{1,7}}|[ivxlcdm]{{1,7}}){tail}", 1)
    digits, shape = own.rlike(rf"{edge}[0-9\x{{09E6}}-\x{{09EF}}]{{1,3}}{tail}"), F.regexp_extract(own, f"{edge}([Il1|U]{{1,4}}){tail}", 1)
    value = t.roman_to_int(roman)
    return F.when(digits, True).when(roman != "", F.coalesce((value < 400) & (roman_text(value) == F.upper(roman)), F.lit(False))).otherwise(shape.rlike("[Il1|]"))


def roman_text(n: Column) -> Column:
    """The roman number of 1 to 3999."""
    digits = [["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c] for a, b, c in (("I", "V", "X"), ("X", "L", "C"), ("C", "D", "M"))]
    places = [F.element_at(F.array(*[F.lit(x) for x in own]), (F.floor(n / 10**k) % 10 + 1).cast("int")) for k, own in enumerate(digits)]
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), *reversed(places))
