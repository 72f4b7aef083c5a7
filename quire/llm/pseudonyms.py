"""Operator 10: format-preserving pseudonyms for personal numbers, dates and addresses, in Spark's own functions only.

Candidates are found by one pattern and validated: cards by Luhn's check digit, social security numbers and IP addresses
by the ranges of their parts, dates by the calendar (yyyy-mm-dd, mm/dd/yyyy and dd.mm.yyyy), phones (of ten digits) by their form. A valid value is taken apart into two numbers (l, r) with
0 <= l < a and 0 <= r < b, and a keyed Feistel network permutes these pairs: rounds add a hash of one half to the other,
modulo a and b in turn. So each pseudonym is a valid value in the same format, different values get different ones, and
equal values get equal ones in all documents. Whoever has the key can run the rounds backwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .space import table

ROUNDS = 10
#: The key of the query; give your own, and keep it out of what others can read (a plan shows it).
DEMO_KEY = "quire-demonstration-key"

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
_PHONE = r"(?<![0-9+])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_MONTH, _DAY, _YEAR = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])", "(?:19|20)[0-9]{2}"
_DATE = rf"(?<![0-9-]){_YEAR}-{_MONTH}-{_DAY}(?![0-9-])|(?<![0-9/]){_MONTH}/{_DAY}/{_YEAR}(?![0-9/])|(?<![0-9.]){_DAY}\.{_MONTH}\.{_YEAR}(?![0-9]|\.[0-9])"
_IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
#: Cards in their usual groups (with the three digits that may follow), then without marks, then in any groups: but not from
#: a place in a run of digits after which one of the former begins, so that numbers before a card don't hide it.
_GROUPS = r"(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9])"
_CARD = rf"(?<![0-9])(?:{_GROUPS}|(?!(?:[0-9]++[ -]){{1,18}}?{_GROUPS})[0-9](?:[ -]?[0-9]){{12,18}}(?![0-9]))"
#: Values whose places are added up at a time.
BLOCK = 256
#: Kinds in the order in which the pattern tries them at one place.
KINDS: dict[str, str] = {"email": _EMAIL, "phone": _PHONE, "ssn": _SSN, "date": _DATE, "ip": _IP, "card": _CARD}
PATTERN = "|".join(KINDS.values())
#: Days from 1900-01-01 to 2099-12-31, as the product of the sizes of the halves.
_DAYS = (17, 4297)


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _feistel(l: Column, r: Column, a: Column, b: Column, tag: Column, key: str) -> Column:  # noqa: E741
    """The struct (l, r) permuted among 0 <= l < a, 0 <= r < b, in a way that depends on ``key`` and ``tag``."""

    def noise(i: Column, half: Column) -> Column:
        text = F.concat_ws(":", F.lit(key), tag, i.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, (s["l"] + noise(i, s["r"])) % a).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise((s["r"] + noise(i, s["l"])) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    begin = F.struct(l.cast("long").alias("l"), r.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step)


def _padded(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _refilled(x: Column, chars: Column, kind: str) -> Column:
    """``x`` with the characters of ``chars`` one after another in the places that match ``kind``."""

    def step(s: Column, c: Column) -> Column:
        own = c.rlike(kind)
        return F.struct((s["k"] + own.cast("int")).alias("k"), F.concat(s["out"], F.when(own, F.substring(chars, s["k"], F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(x, ""), F.struct(F.lit(1).alias("k"), F.lit("").alias("out")), step, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """The sum of Luhn's rule over a string of digits, the last of which is the check digit."""

    def step(s: Column, i: Column) -> Column:
        return s + _let(F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def _power(base: int, n: Column) -> Column:
    return F.aggregate(F.array_repeat(F.lit(base).cast("long"), n), F.lit(1).cast("long"), lambda p, x: p * x)


def _in_radix(chars: Column, base: int, tag: Column, key: str) -> Column:
    """A string of digits of ``base`` (at most 36), of 1 to 22 characters, permuted among those of its length."""
    half = F.floor(F.length(chars) / 2).cast("int")

    def number(s: Column) -> Column:
        return F.coalesce(F.conv(s, base, 10).cast("long"), F.lit(0).cast("long"))

    left, right = F.substring(chars, F.lit(1), half), F.substring(chars, half + 1, F.length(chars))
    done = _feistel(number(left), number(right), _power(base, half), _power(base, F.length(chars) - half), F.concat_ws(":", tag, F.length(chars).cast("string")), key)

    def shown(n: Column, width: Column) -> Column:
        return F.when(width > 0, F.lpad(F.lower(F.conv(n.cast("string"), 10, base)), width, "0")).otherwise("")

    return _let(done, lambda s: F.concat(shown(s["l"], half), shown(s["r"], F.length(chars) - half)))


def _card(x: Column, key: str) -> Column:
    """A valid card's new number; of 17 digits or more that aren't valid, the first 16 may be, and what follows stays."""

    def checked(body: Column) -> Column:
        return F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))

    def renewed(d: Column) -> Column:
        # The first digit, which names the kind of card, and the check digit's rule stay.
        return _let(F.concat(F.substring(d, 1, 1), _in_radix(F.substring(d, F.lit(2), F.length(d) - 2), 10, F.lit("card"), key)), checked)

    def made(d: Column) -> Column:
        first = F.substring(d, 1, 16)
        valid = F.when(luhn_sum(d) % 10 == 0, d).when((F.length(d) > 16) & (luhn_sum(first) % 10 == 0), first)
        return _let(valid, lambda v: F.when(v.isNotNull(), F.concat(renewed(v), F.substring(d, F.length(v) + 1, F.length(d)))))

    new = _let(_digits(x), made)
    return _let(new, lambda n: F.when(n.isNotNull(), _refilled(x, n, "[0-9]")))


def _phone(x: Column, key: str) -> Column:
    d = F.substring(_digits(x), F.length(_digits(x)) - 9, F.lit(10))

    # Area codes that aren't in use, too: a number that is written as one is a person's, whoever runs the exchange.
    done = _feistel(F.substring(d, 1, 4).cast("long"), F.substring(d, 5, 6).cast("long"), F.lit(10_000), F.lit(1_000_000), F.lit("phone"), key)
    new = _let(done, lambda s: F.concat(_padded(s["l"], 4), _padded(s["r"], 6)))
    country = F.when(F.length(_digits(x)) > 10, F.lit("1")).otherwise(F.lit(""))
    return _let(F.concat(country, new), lambda n: _refilled(x, n, "[0-9]"))


def _ssn(x: Column, key: str) -> Column:
    area, group, serial = (F.substring(x, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    done = _feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key)
    def shown(s: Column) -> Column:
        own = F.floor(s["l"] / 99)
        return F.concat_ws("-", _padded(F.when(own >= 665, own + 2).otherwise(own + 1), 3), _padded(s["l"] % 99 + 1, 2), _padded(s["r"] + 1, 4))
    return F.when(valid, _let(done, shown))


def _date(x: Column, key: str) -> Column:
    """A date of one of the three forms; dates that are equal in different forms stay so."""

    def part(value: Column, *places: int) -> list[Column]:
        return [F.substring(value, p, 4 if k == 0 else 2) for k, p in enumerate(places)]

    iso, slashed = F.substring(x, 5, 1) == "-", F.substring(x, 3, 1) == "/"
    plain = F.when(iso, x).when(slashed, F.concat_ws("-", *part(x, 7, 1, 4))).otherwise(F.concat_ws("-", *part(x, 7, 4, 1)))
    a, b = _DAYS

    def shown(d: Column) -> Column:
        year, month, day = part(d, 1, 6, 9)
        return F.when(iso, d).when(slashed, F.concat_ws("/", month, day, year)).otherwise(F.concat_ws(".", day, month, year))

    def made(day: Column) -> Column:
        number = F.datediff(day, F.lit("1900-01-01").cast("date"))
        done = _feistel(F.floor(number / b), number % b, F.lit(a), F.lit(b), F.lit("date"), key)
        new = _let(done, lambda s: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (s["l"] * b + s["r"]).cast("int")), "yyyy-MM-dd"))
        return F.when(day.isNotNull(), _let(new, shown))

    return _let(F.try_to_timestamp(plain, F.lit("yyyy-MM-dd")).cast("date"), made)


def _ip(x: Column, key: str) -> Column:
    p = F.split(x, r"\.")
    n = [p[i].cast("long") for i in range(4)]
    valid = F.forall(p, lambda o: (o.cast("int") < 256) & (F.length(o) == F.length(o.cast("int").cast("string"))))
    done = _feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), F.lit("ip"), key)
    return F.when(valid, _let(done, lambda s: F.concat_ws(".", *[c.cast("string") for h in ("l", "r") for c in (F.floor(s[h] / 256), s[h] % 256)])))


def _email(x: Column, key: str) -> Column:
    """Letters (lower-cased) and digits of the part before @ are permuted, up to 22 at a time; marks and the domain stay."""
    local, domain = F.lower(F.substring_index(x, "@", 1)), F.substring_index(x, "@", -1)
    chars = F.regexp_replace(local, "[^a-z0-9]", "")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(chars) - 1) / 22)).cast("int")), lambda i: _let(F.substring(chars, i * 22 + 1, F.lit(22)), lambda c: _in_radix(c, 36, F.concat_ws(":", F.lit("email"), i.cast("string"), F.lower(domain)), key)))
    return F.when(F.length(chars) > 0, F.concat(_let(F.array_join(parts, ""), lambda n: _refilled(local, n, "[a-z0-9]")), F.lit("@"), F.lower(domain)))


def _running(lengths: Column) -> Column:
    """The sums of an array of integers up to each, in blocks: an array that grows value by value is copied each time."""
    none = F.array().cast("array<int>")

    def sums(values: Column, start: Column) -> Column:
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
        return F.aggregate(values, F.struct(start.alias("at"), none.alias("out")), step, lambda s: s["out"])

    def blocks(values: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda s, x: s + x))
        return F.flatten(F.zip_with(parts, sums(totals, F.lit(0)), lambda p, end: sums(p, end - F.aggregate(p, F.lit(0), lambda s, x: s + x))))

    return F.when(F.size(lengths) > 0, _let(lengths, lambda v: _let(blocks(v), whole))).otherwise(none)


def pseudonymize(docs: DataFrame, key: str, *, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms for the personal values in column ``text``, and the array pii: (kind, start, end, found) of each.

    Places are code points of the original text, ends exclusive. Values that a candidate's check refuses stay. A null text
    stays null and has an empty array; so has an empty one. Other columns stay as they are; ``pii`` and helper columns
    replace any of the same name. Time grows with the length of a text and the number of its values. Rows are independent, so repeated rows and ids need no rule.
    """
    makers = {"email": _email, "phone": _phone, "ssn": _ssn, "date": _date, "ip": _ip, "card": _card}
    column = F.col(f"`{text}`")
    has = column.rlike(PATTERN)

    def judged(x: Column) -> Column:
        kind, new = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name in reversed(KINDS):
            own = x.rlike(f"^(?:{KINDS[name]})$")
            kind, new = F.when(own, F.lit(name)).otherwise(kind), F.when(own, makers[name](x, key)).otherwise(new)
        return F.struct(x.alias("old"), kind.alias("kind"), new.alias("new"))

    none = F.array().cast("array<string>")
    found = docs.withColumn("_quire_old", F.when(has, F.regexp_extract_all(column, F.lit(PATTERN), F.lit(0))).otherwise(none))
    found = found.withColumn("_quire_rest", F.when(F.size("_quire_old") > 0, F.split(column, PATTERN, -1)).otherwise(none))
    found = found.withColumn("_quire_new", F.transform("_quire_old", judged))
    woven = F.array_join(F.zip_with("_quire_rest", "_quire_new", lambda a, b: F.concat(a, F.coalesce(b["new"], b["old"], F.lit("")))), "")

    # Each value's end is the sum of all lengths up to it.
    lengths = F.zip_with(F.slice("_quire_rest", F.lit(1), F.size("_quire_old")), "_quire_old", lambda a, b: F.length(a) + F.length(b))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,found:string>>")
    entries = F.zip_with("_quire_new", _running(lengths), lambda x, end: F.when(x["new"].isNotNull(), F.struct(x["kind"].alias("kind"), (end - F.length(x["old"])).alias("start"), end.alias("end"), x["old"].alias("found"))))
    listed = F.filter(entries, lambda x: x.isNotNull())
    found = found.withColumn("pii", F.when(F.size("_quire_old") > 0, listed).otherwise(empty))
    return found.withColumn(text, F.when(F.size("_quire_old") > 0, woven).otherwise(column)).drop("_quire_old", "_quire_rest", "_quire_new")


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, how many values of each kind were found, their places (kind:start:end, comma-joined), and the new text."""
    done = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = F.array_join(F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return done.select("doc_id", *[count(kind) for kind in KINDS], spans.alias("spans"), "text")
