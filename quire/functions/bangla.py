"""Bangla text as Spark columns: digits, repairs of damaged words, and what a voice is asked to say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that depend on a letter, abbreviations and their spoken forms, centuries, months.
SIGN = r"[\x{0981}-\x{0983}\x{09BC}\x{09BE}-\x{09CD}\x{09D7}]"
CONSONANT = r"[\x{0995}-\x{09B9}\x{09CE}\x{09DC}-\x{09DF}\x{09F0}\x{09F1}]"
_W = r"(?<![\p{L}\p{M}])"
_END = "[.ঃ:]"
ABBREVIATIONS = [
    (rf"{_W}ডা{_END}\s*", "ডাক্তার "),
    (rf"{_W}ড{_END}\s*(?=\p{{IsBengali}})", "ডক্টর "),
    (rf"{_W}মো(?:হা)?{_END}\s*", "মোহাম্মদ "),
    (rf"{_W}মিঃ\s*", "মিস্টার "),
    (rf"{_W}মি\.\s*(?=\p{{IsBengali}})", "মিস্টার "),
    (rf"{_W}খ্রি(?:ষ্টাব্দ|স্টাব্দ)?{_END}", "খ্রিস্টাব্দ"),
    (rf"{_W}খ্রিস্টপূর্ব{_END}", "খ্রিস্টপূর্ব"),
    (rf"{_W}পৃ{_END}\s*", "পৃষ্ঠা "),
    (rf"{_W}বি{_END}\s*দ্র{_END}", "বিশেষ দ্রষ্টব্য"),
    (rf"{_W}লিঃ", "লিমিটেড"),
    (rf"{_W}প্রাঃ", "প্রাইভেট"),
    (rf"{_W}কোং", "কোম্পানি"),
    (rf"{_W}নং(?![\p{{L}}\p{{M}}])", "নম্বর"),
    (rf"{_W}ইং(?![\p{{L}}\p{{M}}])", "ইংরেজি"),
    (r"\(\s*সা[.ঃ]?\s*\)", "সাল্লাল্লাহু আলাইহি ওয়াসাল্লাম"),
    (r"\(\s*রা[.ঃ]?\s*\)", "রাদিয়াল্লাহু আনহু"),
    (r"\(\s*আ[.ঃ]?\s*\)", "আলাইহিস সালাম"),
    (r"\(\s*রহ[.ঃ]?\s*\)", "রহমাতুল্লাহি আলাইহি"),
]
CENTURIES = {11: "এগারো", 12: "বারো", 13: "তেরো", 14: "চোদ্দো", 15: "পনেরো", 16: "ষোলো", 17: "সতেরো", 18: "আঠারো", 19: "উনিশ"}
MONTHS = "জানুয়ারি|ফেব্রুয়ারি|মার্চ|এপ্রিল|মে|জুন|জুলাই|আগস্ট|সেপ্টেম্বর|অক্টোবর|নভেম্বর|ডিসেম্বর|বৈশাখ|জ্যৈষ্ঠ|আষাঢ়|শ্রাবণ|ভাদ্র|আশ্বিন|কার্তিক|অগ্রহায়ণ|পৌষ|মাঘ|ফাল্গুন|চৈত্র"
YEAR_WORDS = "সাল|সন|খ্রি|ইং|বঙ্গাব্দ|শতাব্দ"
DIGITS, ASCII = "০১২৩৪৫৬৭৮৯", "0123456789"
# End of the fixed values.


# Letters of the Bengali block that carry signs, and the signs that hang on a letter.
CARRIERS = r"\x{0995}-\x{09B9}\x{09CE}\x{09DC}\x{09DD}\x{09DF}\x{09F0}\x{09F1}"
HANGING = [0x09BC, *range(0x09BE, 0x09CE), 0x09D7]
# End of the fixed values.


def to_ascii(text: Column) -> Column:
    """Bengali digits as ASCII digits."""
    return F.translate(text, DIGITS, ASCII)


def to_bangla(text: Column) -> Column:
    """ASCII digits as Bengali digits."""
    return F.translate(text.cast("string"), ASCII, DIGITS)


def repaired(word: Column) -> Column:
    """A word without repetitions of one dependent sign: no spelling has two in a row."""
    return F.regexp_replace(word, rf"({SIGN})\1+", "$1")


def orphans(text: Column) -> Column:
    """How many words begin with a dependent sign: signs of a damaged text layer."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{M}]+", "").rlike(f"^{SIGN}")))


def _stray_sign() -> str:
    """A dependent sign in a place where none can stand, as a pattern: what may come before a sign is a state of its own for each."""
    may_follow = {0x09CD: r"\x{200C}\x{200D}", 0x09BE: r"\x{09C7}", 0x09D7: r"\x{09C7}"}
    return "|".join(rf"(?<![{CARRIERS}\x{{09BC}}\x{{{sign:04X}}}{may_follow.get(sign, '')}])\x{{{sign:04X}}}" for sign in HANGING)


def is_broken(word: Column) -> Column:
    """Whether a word can't be whole: an unmapped glyph, a joiner at an edge, or a dependent sign that follows neither a
    consonant nor a nukta.

    A sign may repeat itself (``repaired`` mends that), a hasanta may follow a joiner, and e may be completed to o or au. Null
    stays null, and an empty word is whole.
    """
    return word.rlike(r"[\x{FFFD}\x{E000}-\x{F8FF}]") | word.rlike(r"^[\x{200C}\x{200D}]|[\x{200C}\x{200D}]\z") | word.rlike(_stray_sign())


def _year(s: Column, hundreds: int, spoken: str) -> Column:
    """Years of one century, said in hundreds: before a word for years, or after a month."""
    a, b = str(hundreds)[0], str(hundreds)[1]
    head = f"[{a}{a.translate(str.maketrans(ASCII, DIGITS))}][{b}{b.translate(str.maketrans(ASCII, DIGITS))}]"
    free, end = r"(?<![0-9০-৯])", r"(?![0-9০-৯])"
    after, before = rf"(?<=(?:{MONTHS})[,\s]{{1,3}})", rf"(?=\s*(?:{YEAR_WORDS}))"
    for pattern in (rf"{free}{after}{head}%s{end}", rf"{free}{head}%s{end}{before}"):
        s = F.regexp_replace(s, pattern % "[0০][0০]", f"{spoken}শো")
        s = F.regexp_replace(s, pattern % "[0০]([1-9১-৯])", f"{spoken}শো $1")
        s = F.regexp_replace(s, pattern % "([1-9১-৯][0-9০-৯])", f"{spoken}শো $1")
    return s


def narration(text: Column) -> Column:
    """What a Bangla voice is asked to say: abbreviations in full, years in hundreds, no footnote numbers, and neither a stop nor
    a visarga where the voice would end the sentence."""
    s = F.regexp_replace(text, r"[\x{200C}\x{200D}]", "")
    for pattern, said in ABBREVIATIONS:
        s = F.regexp_replace(s, pattern, said)
    for hundreds, spoken in CENTURIES.items():
        s = _year(s, hundreds, spoken)
    s = F.regexp_replace(s, r"""(?<=[\p{L}\p{M}][।,;!?"'”’)]?)[০-৯]{1,2}(?=\s|$)""", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s*%", " শতাংশ"), r"\s&\s", " ও ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?<=[তশ])ঃ(?=[\s,;:।!?]|$)", ""), r"ঃ(?=\s|$)", ":")
    return F.regexp_replace(s, r"(?<=[\p{L}\p{M}])\.(?=\s+\S)", "")


def section_title(kind: Column, bangla: Column, n: Column) -> Column:
    """The name of a chapter that has none: opening, part or full."""
    english = F.when(kind == "opening", "Opening Pages").when(kind == "part", F.concat(F.lit("Part "), n.cast("string"))).otherwise("Full Text")
    own = F.when(kind == "opening", "প্রারম্ভিক অংশ").when(kind == "part", F.concat(F.lit("পর্ব "), to_bangla(n))).otherwise("সম্পূর্ণ বই")
    return F.when(bangla, own).otherwise(english)
