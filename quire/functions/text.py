"""Text functions as Spark columns: classes of printed lines, keys, clean-up, titles, tags, names and rights.

Patterns state `\\b` as look-arounds on ASCII word characters: Java's own `\\b` takes accented letters for word characters.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_DIGIT = r"[0-9\x{09E6}-\x{09EF}]"
_DASHES = r"[\s\-–—|•·]*"

PAGE_NUMBER = rf"(?i)^{_DASHES}[\[{{(]?(page\s+|পৃষ্ঠা\s*[:ঃ]?\s*|পৃ[.ঃ]\s*)?({_DIGIT}{{1,4}}|[ivxlcdm]{{1,7}})(\s*(of|/)\s*{_DIGIT}{{1,4}})?[\]}})]?{_DASHES}$"
BARE_NUMBER = rf"(?i)^[\[{{(]?({_DIGIT}{{1,4}}|[ivxlcdm]{{1,7}})[\]}})]?$"
DROP_CAP = r"""^(["'“‘(]?\p{Lu}|["'“‘])$"""
CONTENTS_LEADER = rf"(\.\s*){{4,}}\s*{_DIGIT}{{1,4}}\s*$|(…\s*){{2,}}\s*{_DIGIT}{{1,4}}\s*$"
TERMINAL = r"""[.!?…।॥]["'”’)\]]*$"""
LOWER_START = r"""^["'“‘(\[]?\p{Ll}"""
WORD = r"[\p{L}\p{M}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once and not at each of its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_page_number(text: Column) -> Column:
    return text.rlike(PAGE_NUMBER)


def is_bare_number(text: Column) -> Column:
    return text.rlike(BARE_NUMBER)


def is_drop_cap(text: Column) -> Column:
    return text.rlike(DROP_CAP)


def is_contents_leader(text: Column) -> Column:
    return text.rlike(CONTENTS_LEADER)


def is_speakable(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def ends_sentence(text: Column) -> Column:
    return text.rlike(TERMINAL)


def starts_lower(text: Column) -> Column:
    return text.rlike(LOWER_START)


def header_key(text: Column) -> Column:
    """The form in which running headers of different pages are alike: numbers and roman numerals are ``#``."""
    key = F.regexp_replace(F.lower(text), rf"{_DIGIT}+", "#")
    key = F.regexp_replace(key, rf"{_B}[ivxlcdm]{{1,7}}{_E}", "#")
    return F.trim(F.regexp_replace(key, r"[^\p{L}\p{M}#]+", " "))


def tokens(text: Column) -> Column:
    """Non-empty parts between white space."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def runs_of(words: Column | str, n: int = 3) -> Column:
    """Distinct runs of ``n`` of an array's words; none if there are fewer words."""
    w = F.col(words) if isinstance(words, str) else words
    each = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
    return F.when(F.size(w) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct runs of ``n`` words; none if there are fewer words."""
    return let(words(text), lambda w: runs_of(w, n))


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the smaller size of two arrays; 0 if one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def letter_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length over all letters and digits of two texts; 1 if both have none."""
    from quire.functions.sequences import edit_distances

    pair = F.struct(*[F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "").alias(c) for x, c in ((a, "a"), (b, "b"))])
    return let(edit_distances(pair), lambda d: F.when(d["longest"] == 0, F.lit(1.0)).otherwise(1 - d["distance"] / d["longest"]))


def is_damaged(text: Column) -> Column:
    """Signs of a broken text layer: single letters apart, unresolved ligatures, odd symbols, glued words."""
    t = tokens(text)
    count = F.size(t)
    single = F.size(F.filter(t, lambda x: x.rlike(r"^\p{L}$")))
    glued = F.size(F.filter(t, lambda x: x.rlike(r"^\p{L}{26,}$")))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\p{N}\p{Z}\p{P}$%&+=<>|~^`°§¶©®™±×÷€£¥¢\x{2010}-\x{2015}\x{200C}\x{200D}]", ""))
    return ((count >= 6) & (single / F.greatest(count, F.lit(1)) > 0.5)) | text.rlike(r"[\x{FFFD}\x{FB00}-\x{FB06}]") | ((letters >= 20) & (odd / F.greatest(letters, F.lit(1)) > 0.08)) | (glued >= 2)


def clip(text: Column, most: int) -> Column:
    """At most ``most`` characters: cut at the last space if that is beyond 60 %, with an ellipsis."""
    cut = F.substring(text, 1, most - 1)
    space = F.when(F.locate(" ", cut) > 0, F.length(cut) - F.locate(" ", F.reverse(cut))).otherwise(-1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.when(space > most * 0.6, F.substring(cut, F.lit(1), space)).otherwise(cut)), F.lit("…")))


def clean_text(raw: Column, most: int) -> Column:
    """Without links, angle brackets, time-stamp lines and lines of hashtags; blanks squeezed; clipped. Null: empty."""
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)https?://\S+|www\.\S+", ""), "[<>]", "")
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(rf"^\s*([0-9]{{1,2}}:)?[0-9]{{1,2}}:[0-9]{{2}}{_E}") & ~x.rlike(r"^\s*(#[\p{L}\p{M}\p{N}_]+\s*)+$"))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return clip(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""), most)


def clean_title(raw: Column, most: int = 100) -> Column:
    """One line, without quotes around it, clipped."""
    one = F.trim(F.regexp_replace(raw, r"\s+", " "))
    return clip(F.trim(F.regexp_replace(one, r"""^["'“”‘’]+|["'“”‘’]+$""", "")), most)


def sanitize_tag(raw: Column) -> Column:
    """A search tag: no marks that tags can't hold, single spaces, 60 characters."""
    t = F.regexp_replace(F.regexp_replace(raw, r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]", ""), '[<>,"#]', " ")
    return F.trim(F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, 60))


def sanitize_hashtag(raw: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(raw, "^#+", ""), r"[^\p{L}\p{M}\p{N}_]", ""), 1, 50)


def tag_chars(tags: Column) -> Column:
    """Characters that a tag list takes: commas between tags, and quotes around tags with spaces."""
    total = F.aggregate(tags, F.lit(0), lambda n, t: n + F.length(t) + F.when(t.rlike(r"\s"), 2).otherwise(0))
    return F.when(F.size(tags) > 0, total + F.size(tags) - 1).otherwise(0)


def fit_tags(tags: Column, budget: int = 500) -> Column:
    """Clean tags without repeats, as many as the budget holds: one that doesn't fit is passed over, later ones may fit."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("used"))

    def step(s: Column, raw: Column) -> Column:
        # ``used`` is tag_chars of the tags so far, and a comma: each tag costs its own length, however many there are.
        def take(t: Column) -> Column:
            grown = s["used"] + F.length(t) + F.when(t.rlike(r"\s"), 2).otherwise(0)
            ok = (t != "") & (s["used"] + F.length(t) <= budget) & (grown <= budget) & ~F.array_contains(s["seen"], F.lower(t))
            return F.when(ok, F.struct(F.concat(s["out"], F.array(t)).alias("out"), F.concat(s["seen"], F.array(F.lower(t))).alias("seen"), (grown + 1).alias("used"))).otherwise(s)

        return F.when(s["used"] >= budget, s).otherwise(let(sanitize_tag(raw), take))

    return F.aggregate(tags, empty, step, lambda s: s["out"])


def fit_hashtags(tags: Column, most: int) -> Column:
    """Clean hashtags, the first of each spelling, at most ``most``."""

    def step(out: Column, raw: Column) -> Column:
        def take(t: Column) -> Column:
            fresh = (t != "") & ~F.exists(out, lambda o: F.lower(o) == F.lower(t))
            return F.when(fresh, F.concat(out, F.array(t))).otherwise(out)

        return F.when(F.size(out) >= most, out).otherwise(let(sanitize_hashtag(raw), take))

    return F.aggregate(tags, F.array().cast("array<string>"), step)


def camel_tag(text: Column) -> Column:
    return F.array_join(F.transform(words(text), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def un_camel(text: Column) -> Column:
    return F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case words joined by hyphens, for file names."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", "-"), "^-+|-+$", ""), 1, most), "-+$", "")


def phrase_index(text: Column, phrase: Column) -> Column:
    """Where the longest word of a phrase stands in the text, if all its words occur; else -1."""
    pattern = F.lit(r"([\p{L}\p{N}][\p{L}\p{M}\p{N}'’]*)")
    want, have = (F.regexp_extract_all(F.lower(x), pattern, F.lit(1)) for x in (phrase, text))
    longest = F.aggregate(want, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    return F.when((F.size(want) > 0) & (F.size(F.array_except(want, have)) == 0), F.instr(F.lower(text), longest) - 1).otherwise(-1)


def display_author(raw: Column) -> Column:
    """``Surname, Given, 1800-1870`` as ``Given Surname``."""
    bare = F.trim(F.regexp_replace(raw, r",?\s*\(?[0-9]{4}\s*-?\s*([0-9]{4})?\)?\.?\s*$", ""))
    parts = F.transform(F.split(bare, ","), lambda p: F.trim(p))
    return F.when(F.size(parts) == 2, F.concat_ws(" ", parts[1], parts[0])).otherwise(bare)


def language_code(raw: Column) -> Column:
    """Names and codes of the two languages with own rules as ``en`` and ``bn``; others lower-cased."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin("eng", "english", "en"), "en").when(low.isin("ben", "bengali", "bangla", "bn"), "bn").when(low != "", low)


def year_of(raw: Column) -> Column:
    """The first number of exactly four digits, from 1 to 2999."""
    year = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)", 1).try_cast("int")
    return F.when((year > 0) & (year < 3000), year)


def rights(license_url: Column, status: Column) -> Column:
    """struct<rights, license> of a license link and a copyright status."""
    url = F.lower(F.coalesce(F.trim(license_url), F.lit("")))
    kind = F.regexp_extract(url, r"creativecommons\.org/licenses/([a-z-]+)(?:/([0-9.]+))?", 1)
    version = F.regexp_extract(url, r"creativecommons\.org/licenses/([a-z-]+)(?:/([0-9.]+))?", 2)
    parts = F.split(kind, "-")

    def out(r: str | Column, name: str | Column | None) -> Column:
        return F.struct((F.lit(r) if isinstance(r, str) else r).alias("rights"), (F.lit(name).cast("string") if name is None or isinstance(name, str) else name).alias("license"))

    cc = out(F.when(F.array_contains(parts, "nd") | F.array_contains(parts, "nc"), "restricted").otherwise("open"), F.concat(F.lit("CC "), F.upper(kind), F.when(version != "", F.concat(F.lit(" "), version)).otherwise("")))
    return (
        F.when(F.trim(status) == "NOT_IN_COPYRIGHT", out("public_domain", "Not in copyright"))
        .when(url.contains("publicdomain/zero"), out("public_domain", "CC0"))
        .when(url.contains("publicdomain"), out("public_domain", "Public domain mark"))
        .when(kind != "", cc)
        .otherwise(out("unknown", None))
    )


def search_query(q: Column, filters: Sequence[str] = ()) -> Column:
    """A query that asks for all words, at most 12, in title, creator or subject, and for all ``filters``."""
    bare = F.filter(F.split(F.regexp_replace(q, r"""[+\-&|!(){}\[\]^"~*?:\\/]""", " "), r"\s+"), lambda w: w != "")
    asked = F.transform(F.slice(bare, 1, 12), lambda w: F.when(w.isin("AND", "OR", "NOT", "TO"), F.lower(w)).otherwise(w))
    terms = F.concat(F.lit("("), F.array_join(asked, " AND "), F.lit(")"))
    own = F.when(F.size(asked) > 0, F.concat(F.lit("(title:"), terms, F.lit(" OR creator:"), terms, F.lit(" OR subject:"), terms, F.lit(")")))
    return F.concat_ws(" AND ", own, *[F.lit(f) for f in filters])


def natural_key(name: Column) -> Column:
    """A key that sorts names by the value of the numbers in them, of any length; letters sort by their code points.

    Before a number, without zeros in front, stands how many digits it has: a longer number is a larger one.
    """
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def key(p: Column) -> Column:
        return let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda n: F.concat(F.lpad(F.length(n).cast("string"), 6, "0"), n))

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), key(p)).otherwise(p)), "")


def roman_to_int(text: Column) -> Column:
    """The value of a string of roman digits, 1 to 3999; else null."""

    def value(c: Column) -> Column:
        return F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50).when(c == "c", 100).when(c == "d", 500).when(c == "m", 1000)

    # Read from the right: a digit less than the one before it (to its right) counts against the sum.
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("before"))
    summed = F.aggregate(F.transform(F.split(F.reverse(F.lower(text)), ""), value), start, lambda s, v: F.struct((s["sum"] + F.when(v < s["before"], -v).otherwise(v)).alias("sum"), v.alias("before")), lambda s: s["sum"])
    return F.when(F.lower(text).rlike("^[ivxlcdm]+$"), let(summed, lambda n: F.when((n > 0) & (n < 4000), n)))


#: Rewrites of English narration, in the order in which they apply. Fixed values.
EN_NARRATION: list[tuple[str, str]] = [
    (rf"(?i){_B}e\.\s?g\.,?", "for example,"),
    (rf"(?i){_B}i\.\s?e\.,?", "that is,"),
    (rf"(?i){_B}etc\.", "et cetera."),
    (rf"(?i){_B}vs\.?(?=\s)", "versus"),
    (rf"(?i){_B}cf\.", "compare"),
    (rf"(?i){_B}approx\.", "approximately"),
    (rf"{_B}No\.\s?(?=[0-9])", "number "),
    (rf"{_B}pp\.\s?(?=[0-9])", "pages "),
    (rf"{_B}p\.\s?(?=[0-9])", "page "),
    (rf"(?i){_B}ch\.\s?(?=[0-9])", "chapter "),
    (rf"(?i){_B}fig\.\s?(?=[0-9])", "figure "),
    (r"\s&\s", " and "),
    ("%", " percent"),
]


def narration(text: Column, english: bool = True, lexicon: dict[str, str] | None = None) -> Column:
    """What a voice is asked to say for a printed text: quotes, footnote marks, links, dashes and abbreviations rewritten."""
    s = F.regexp_replace(text, r"[\x{200B}\x{FEFF}]", "")
    s = F.regexp_replace(F.regexp_replace(s, "[“”„]", '"'), "[‘’‚]", "'")
    s = F.regexp_replace(s, rf"""\[{_DIGIT}{{1,3}}\]|(?<=[A-Za-z\x{{C0}}-\x{{24F}}][.,;!?"'])[0-9]{{1,3}}(?=\s|$)""", "")
    s = F.regexp_replace(s, r"https?://(\S+?)/?(?=\s|$)", "$1")
    s = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s*[—–]\s*", ", "), "…", "..."), r"\s+", " "))
    if english:
        for pattern, to in EN_NARRATION:
            s = F.regexp_replace(s, pattern, to)
    for word, say in (lexicon or {}).items():
        s = F.regexp_replace(s, rf"(?<![\p{{L}}])\Q{word}\E(?![\p{{L}}])", say.replace("\\", "\\\\").replace("$", "\\$"))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r",\s*,", ","), r"\s+([,.;:!?])", "$1"), r"^,\s*", ""))


def heading_narration(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(r"[.!?:।॥]$"), t).otherwise(F.concat(t, F.lit(".")))
