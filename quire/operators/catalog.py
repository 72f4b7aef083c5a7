"""Catalogue operators: look-ups by id, nesting, unreferenced keys, better copies, tree differences, chapter plans, checks."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.sequences import nfc


def nested(parents: DataFrame, children: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """Parents with an array of their children in order; empty where there are none."""
    listed = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias(name))
    kind = listed.schema[name].dataType
    return parents.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def unreferenced(mine: DataFrame, all_: DataFrame, owner: str, key: str) -> DataFrame:
    """owner, key of the rows of ``mine`` whose key no other owner has."""
    shared = all_.groupBy(key).agg(F.countDistinct(owner).alias("_n")).where("_n > 1")
    return mine.select(owner, key).distinct().join(shared, key, "left_anti").select(owner, key)


def only_left(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti").select(a.columns)


def appended(page: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """A list with the rows of ``more`` that it doesn't have."""
    return page.unionByName(only_left(more, page, keys))


def in_order(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the ids in array column ``ids``, with their place; unknown ids give none."""
    return ids.select(F.posexplode("ids").alias("pos", key)).join(rows, key)


def with_edits(chapters: DataFrame, edits: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with the edited values in place of their own, where an edit has one."""
    new = edits.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = chapters.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in chapters.columns])


def best_copies(files: DataFrame) -> DataFrame:
    """Files (item, name) without those of which the item has a better copy: ``x.pdf`` beside ``x_text.pdf``, ``x_bw.pdf`` beside ``x.pdf``."""
    low = F.lower("name")
    own = files.withColumn("_name", low)
    names = own.select("item", F.col("_name").alias("_better")).distinct()
    text = own.join(names, (own["item"] == names["item"]) & (F.regexp_replace("_name", r"\.pdf$", "_text.pdf") == F.col("_better")), "left_anti")
    return text.join(names, (text["item"] == names["item"]) & F.col("_name").endswith("_bw.pdf") & (F.regexp_replace("_name", r"_bw\.pdf$", ".pdf") == F.col("_better")), "left_anti").drop("_name")


def tree_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, before, after of the leaves (rows of path and value) that differ between two trees; a missing leaf is null."""
    left, right = (x.select(*keys, F.col(value).alias(n)) for x, n in ((a, "before"), (b, "after")))
    return left.join(right, keys, "full").where("before IS DISTINCT FROM after")


def impacted(changes: DataFrame, rules: Mapping[str, list[str]]) -> DataFrame:
    """Stages that changed settings (column path) affect: a rule holds for its path and all below it."""
    hit = [F.when((F.col("path") == p) | F.col("path").startswith(f"{p}."), F.array(*[F.lit(s) for s in stages])) for p, stages in rules.items()]
    return changes.select(F.explode(F.flatten(F.filter(F.array(*hit), lambda x: x.isNotNull()))).alias("stage")).distinct()


# Titles of what comes before and after a book's own text, in normalization form C.
BACK_MATTER = unicodedata.normalize(
    "NFC",
    r"(?i)^(index|general index|bibliography|about the (author|authors|translator|illustrator)|also by(?![A-Za-z0-9_])|other (books|titles) by|colophon|(the )?full project gutenberg licen[sc]e|section [0-9]+\.\s.*project gutenberg|.*project gutenberg(-tm)? (licen[sc]e|literary archive)|licen[sc]e|reading group guide|a note on the type|praise for)"
    "|^(নির্ঘণ্ট|নির্ঘন্ট|গ্রন্থপঞ্জি|গ্রন্থপঞ্জী|গ্রন্থপঞ্জিকা|তথ্যসূত্র|সহায়ক গ্রন্থ|লেখক পরিচিতি|লেখক-পরিচিতি|লেখকের অন্যান্য|একই লেখকের|লেখকের আরও)",
)
FRONT_MATTER = unicodedata.normalize(
    "NFC",
    r"(?i)^(cover|title( page)?|copyright|contents|table of contents|dedication|also by|half title|about the author|praise for)(?![A-Za-z0-9_])"
    r"|^(সূচিপত্র|সূচীপত্র|সূচি|সূচী|বিষয়সূচি|বিষয়সূচী|উৎসর্গ|প্রচ্ছদ|কৃতজ্ঞতা|কৃতজ্ঞতা স্বীকার|প্রকাশকের কথা|সর্বস্বত্ব|স্বত্ব)(?![\p{L}\p{M}])",
)
OPENING_TITLES = ["Opening Pages", "প্রারম্ভিক অংশ"]
END_OF_TEXT = r"(?i)^[*]{3}\s*end of (the|this) project gutenberg"
# End of the fixed values.


def matter(rows: DataFrame, keys: list[str], order: str, title: str) -> DataFrame:
    """Rows with matter: front for a first of several that is named so, back by its title, else null. Titles are compared in form C."""
    book = Window.partitionBy(*keys)
    first = (F.row_number().over(book.orderBy(order)) == 1) & (F.count(F.lit(1)).over(book) > 1)
    own = F.trim(nfc(F.col(title)))
    front = own.isin([unicodedata.normalize("NFC", x) for x in OPENING_TITLES]) | own.rlike(FRONT_MATTER)
    return rows.withColumn("matter", F.when(first & front, "front").when(own.rlike(BACK_MATTER), "back"))


def without_license(paras: DataFrame, key: str, order: str) -> DataFrame:
    """Paragraphs (key, order, text) before the line that ends a book's own text; what follows it is its license."""
    ends = paras.where(F.trim("text").rlike(END_OF_TEXT)).groupBy(key).agg(F.min(order).alias("_end"))
    return paras.join(ends, key, "left").where(F.col("_end").isNull() | (F.col(order) < F.col("_end"))).drop("_end")


def plan(chapters: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Chapters (doc_id, idx, title, page_end, exclude, merge, new_title) with part, kept title and reason (null: kept).

    Trailing back matter goes, unless an edit keeps it (exclude is false) and never the whole book; excluded chapters go;
    merged ones join the chapter before (the first kept one can't); then the range of numbers, from 1, applies.
    """
    book = Window.partitionBy("doc_id")
    tail = book.orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    matter = F.trim(nfc(F.col("title"))).rlike(BACK_MATTER) & ~F.coalesce(F.col("exclude") == False, F.lit(False))  # noqa: E712
    rows = chapters.withColumn("_back", matter).withColumn("_tail", F.min(F.col("_back").cast("int")).over(tail) == 1)
    rows = rows.withColumn("_tail", F.col("_tail") & (F.col("idx") != F.min("idx").over(book)))
    rows = rows.withColumn("_in", ~F.col("_tail") & ~F.coalesce("exclude", F.lit(False)))
    before = book.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    merges = F.col("_in") & F.coalesce("merge", F.lit(False)) & (F.coalesce(F.max(F.col("_in").cast("int")).over(before), F.lit(0)) == 1)
    rows = rows.withColumn("_merged", merges)
    part = F.sum((F.col("_in") & ~F.col("_merged")).cast("int")).over(book.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("part", F.when(F.col("_in"), part))
    head = F.min(F.when(F.col("_in"), F.col("idx"))).over(Window.partitionBy("doc_id", "part"))
    inside = (head + 1).between(1 if first is None else first, 2**31 - 1 if last is None else last)
    reason = F.when(F.col("_tail"), "back-matter").when(~F.col("_in"), "excluded").when(F.col("_merged"), "merged").when(~inside, "range")
    title = F.coalesce(F.nullif(F.trim("new_title"), F.lit("")), F.col("title"))
    return rows.select("doc_id", "idx", "part", F.when(reason.isNull(), title).alias("title"), F.when(reason.isNull(), F.max("page_end").over(Window.partitionBy("doc_id", "part"))).alias("page_end"), reason.alias("reason"))


def checks(rows: DataFrame, keys: list[str], tests: Mapping[str, tuple[Column, Column, float]]) -> DataFrame:
    """A row for each row and test: check_id, status (fail, warn, pass) and weight. A test is (fails, warns, weight)."""
    made = [F.struct(F.lit(k).alias("check_id"), F.when(bad, "fail").when(odd, "warn").otherwise("pass").alias("status"), F.lit(float(w)).alias("weight")) for k, (bad, odd, w) in tests.items()]
    return rows.select(*keys, F.inline(F.array(*made)))


def score(checked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score (0 to 100, a warning counts half), blocking (failed checks)."""
    value = F.when(F.col("status") == "pass", 1.0).when(F.col("status") == "warn", 0.5).otherwise(0.0)
    return checked.groupBy(*keys).agg(F.floor(100 * F.sum(F.col("weight") * value) / F.sum("weight") + 0.5).cast("int").alias("score"), F.count_if(F.col("status") == "fail").alias("blocking"))


def broken_rules(rows: DataFrame, keys: list[str], rules: Mapping[str, Column]) -> DataFrame:
    """keys, rule: the constraints that a row breaks; a null result breaks none."""
    named = F.array(*[F.when(~ok, F.lit(k)) for k, ok in rules.items()])
    return rows.select(*keys, F.explode(F.filter(named, lambda x: x.isNotNull())).alias("rule"))


def defaults(rows: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows with a default in place of each null."""
    return rows.select(*[F.coalesce(F.col(c), F.lit(values[c])).alias(c) if c in values else F.col(c) for c in rows.columns])


def page(rows: DataFrame, order: list[Column], number: int, size: int = 24) -> DataFrame:
    """One page of an ordered list, numbered from 1."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def chapters_problem(chapters: DataFrame, key: str, least: int = 3, shortest: float = 10.0) -> DataFrame:
    """Why a list of chapters (start, end) isn't shown by players; null: it is."""
    rows = chapters.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.floor(F.min("start")).alias("first"), F.count_if(F.col("end") - F.col("start") < shortest).alias("short"))
    problem = F.when(F.col("n") < least, "few").when(F.col("first") != 0, "first").when(F.col("short") > 0, "short")
    return rows.select(key, problem.alias("problem"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n of the keys that more than one row has: a table doesn't enforce them itself."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """key, n of the references (nulls aside) that no parent has."""
    known = parents.select(F.col(parent_key).alias(key)).distinct()
    return children.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(known, key, "left_anti")
