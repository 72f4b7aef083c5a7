"""Chapters from paragraphs: by a book's outline, by how headings are worded, by their size, or by pages.

Each rule is a column of the paragraph or of its neighbours. Only short paragraphs can begin a chapter, so all but the last
step works on a slim table of them; neighbours are met in ranges of a book (see ``ranges.beside``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t
from quire.functions.chapter_forms import is_marker, is_numbered, names_chapter
from quire.functions.sequences import nfc
from quire.operators import ranges
from quire.operators.layout import contents_runs_removed
from quire.sources.stages import settled

# Words of a heading, of a subtitle, of an outline's paragraph; share of words it has in common with the entry;
# characters of a candidate; sizes of the body from which a short paragraph is a candidate; most starts by words and by size,
# as shares of all paragraphs; starts by size, and candidates for each start, beyond which they are doubtful.
HEADING_WORDS, SUBTITLE_WORDS, OUTLINE_WORDS, OUTLINE_SHARE = 16, 14, 25, 0.6
SHOWN, LARGER, MOST_BY_WORDS, MOST_BY_SIZE, DOUBTFUL, DOUBTFUL_RATIO = 120, 1.05, 3, 4, 80, 3
OPENING, SECTION = "Opening Pages", "Part {}"
# End of the fixed values.


def _featured(paras: DataFrame) -> DataFrame:
    """book, para, kind, page_start, page_end, size, bold, short, text (of those that may matter), and the neighbours' facts."""
    bold = F.col("bold") if "bold" in paras.columns else F.lit(False)
    n = F.size(t.tokens(F.col("text")))
    slim = paras.select("book", F.col("para").cast("int").alias("para"), "kind", F.col("page_start").cast("long").alias("page_start"), F.col("page_end").cast("long").alias("page_end"), "size", bold.alias("bold"), n.alias("n"), F.when(n <= OUTLINE_WORDS, F.col("text")).alias("text"))
    slim = slim.withColumn("last_page", F.col("page_end"))
    beside = {"before_end": ("last_page", -1), "before_kind": ("kind", -1), "next_kind": ("kind", 1), "next_page": ("page_start", 1), "next_n": ("n", 1), "next_text": ("text", 1)}
    return ranges.beside(slim, "book", "para", beside).withColumn("short", F.col("n") <= HEADING_WORDS)


def _title() -> Column:
    """A heading's text, with that of a subtitle right after it."""
    sub = (F.col("next_kind") == "heading") & (F.col("next_page") == F.col("page_start")) & (F.col("next_n") <= SUBTITLE_WORDS) & ~names_chapter(F.col("next_text"))
    joint = F.when(F.col("text").rlike("[:.—ঃ।-]$"), " ").otherwise(": ")
    return F.when(F.coalesce(sub, F.lit(False)), F.concat("text", joint, "next_text")).otherwise(F.col("text"))


def candidates(paras: DataFrame) -> DataFrame:
    """book, para, text, page, size: the paragraphs that a person, or a helper, may be asked about: short, and headings or larger than the body."""
    return _candidates(_featured(paras)).select("book", "para", F.substring("text", 1, SHOWN).alias("text"), F.col("page_start").alias("page"), "size")


def _candidates(rows: DataFrame) -> DataFrame:
    body = rows.groupBy("book").agg(F.percentile(F.when(F.col("kind") == "body", F.col("size")), F.lit(0.5)).alias("body"))
    return rows.where("short").join(body, "book").where((F.col("kind") == "heading") | (F.col("size") > LARGER * F.col("body")))


def worded_starts(rows: DataFrame) -> DataFrame:
    """book, page, para, title: headings, or first, bold or marker paragraphs of a page, that are worded as chapters are.

    A numbered heading right after a start is its subtitle, and so on in turn. Three or more starts with next to nothing
    between them on one page are a table of contents.
    """
    marked, named = is_marker(F.col("text")), names_chapter(F.col("text"))
    heads_page = F.coalesce(F.col("before_end") != F.col("page_start"), F.lit(True))
    strong = marked | (named & ((F.col("kind") == "heading") | heads_page | F.col("bold")))
    weak = (F.col("kind") == "heading") & is_numbered(F.col("text"))
    found = rows.where(F.col("short")).withColumn("worded", marked | named).where(strong | weak)
    order = Window.partitionBy("book").orderBy("para")
    gap = F.coalesce(F.col("para") - F.lag("para").over(order) > 1, F.lit(True))
    anchor = F.last(F.when(gap | F.col("worded"), F.col("para")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("_gap", gap).withColumn("_anchor", anchor).where("(para - _anchor) % 2 = 0")
    starts = found.select("book", F.col("page_start").alias("page"), "para", _title().alias("title"))
    return contents_runs_removed(starts, ["book"])


def sized_starts(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """book, para, title: the headings of the largest size that two or more have, but not more than a share of all paragraphs."""
    heads = rows.where((F.col("kind") == "heading") & F.col("short")).withColumn("tier", F.floor(F.col("size") + 0.5))
    tiers = heads.groupBy("book", "tier").agg(F.count(F.lit(1)).alias("n_tier")).join(counts, "book")
    tiers = tiers.where((F.col("n_tier") >= 2) & (F.col("n_tier") <= F.greatest(F.lit(2), F.col("paras") / MOST_BY_SIZE))).groupBy("book").agg(F.max("tier").alias("tier"))
    return heads.join(tiers, ["book", "tier"]).select("book", "para", _title().alias("title"))


def _bare(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(nfc(text)), r"[^\p{L}\p{M}\p{N}]+", " "), " "), lambda w: w != ""))


def listed_starts(rows: DataFrame, outline: DataFrame, counts: DataFrame) -> DataFrame:
    """book, para, title for the entries of outlines (book, n, level, page, title), each after the one before.

    Entries of the first level count; of the second, if the first has fewer than three and the second three or more. An
    entry's paragraph is the first short one on its page that shares enough of the words of the shorter of the two, else the
    first that begins on its page or later. An outline of fewer than two entries with pages isn't used, nor one that leads to
    fewer than two paragraphs.
    """
    paged = outline.where("page > 0")
    level = paged.groupBy("book").agg(F.count(F.lit(1)).alias("all"), F.when((F.count_if(F.col("level") == 1) < 3) & (F.count_if(F.col("level") == 2) >= 3), 2).otherwise(1).alias("used"))
    entries = paged.join(level.where("all >= 2"), "book").where((F.col("level") == F.col("used")) & (F.trim("title") != "")).select("book", "n", F.col("page").cast("long").alias("page"), F.trim("title").alias("title"))
    pages = entries.select("book", "page").distinct()
    near = rows.where(F.col("n") <= OUTLINE_WORDS).withColumn("page", F.col("page_start")).join(pages, ["book", "page"]).select("book", "page", "para", _bare(F.col("text")).alias("have"))
    wanted = entries.select("book", "n", "page", _bare(F.col("title")).alias("want"))
    least = F.least(F.size("want"), F.size("have"))
    alike = wanted.join(near, ["book", "page"]).where((least > 0) & (F.size(F.array_intersect("want", "have")) >= OUTLINE_SHARE * least))
    alike = alike.groupBy("book", "n").agg(F.sort_array(F.collect_list("para")).alias("alike"))
    # The first paragraph of each page, carried back to the entries whose page has none.
    begun = rows.groupBy("book", F.col("page_start").alias("page")).agg(F.min("para").alias("at"))
    back = Window.partitionBy("book").orderBy(F.desc("page"), F.col("at").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = begun.select("book", "page", "at", F.lit(None).cast("long").alias("n")).unionByName(entries.select("book", "page", F.lit(None).cast("int").alias("at"), F.col("n").cast("long").alias("n")))
    at = both.withColumn("at", F.min("at").over(back)).where("n IS NOT NULL").select("book", "n", "at")
    placed = entries.join(at, ["book", "n"]).join(alike, ["book", "n"], "left").groupBy("book").agg(F.sort_array(F.collect_list(F.struct("n", "title", "at", "alike"))).alias("e")).join(counts, "book")
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<para:int,title:string>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        same = F.get(F.filter(F.coalesce(x["alike"], F.array().cast("array<int>")), lambda p: p >= acc["free"]), F.lit(0))
        later = F.when(x["at"].isNotNull() & (F.greatest(x["at"], acc["free"]) < F.col("paras")), F.greatest(x["at"], acc["free"]))
        place = F.coalesce(same, later)
        return F.when(place.isNull(), acc).otherwise(F.struct((place + 1).alias("free"), F.concat(acc["found"], F.array(F.struct(place.alias("para"), x["title"].alias("title")))).alias("found")))

    found = placed.select("book", F.aggregate("e", start, step, lambda a: a["found"]).alias("found")).where(F.size("found") >= 2)
    return found.select("book", F.inline("found"))


def _sections(rows: DataFrame, pages: int) -> DataFrame:
    """book, para, title: sections of about ``pages`` pages, each after body text. One row a page is looked at in order."""
    first = F.col("para") == 0
    able = rows.where(first | (F.col("before_kind") == "body")).groupBy("book", "page_start").agg(F.min("para").alias("para"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}["book"]

    def walk(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("page_start", ignore_index=True)
        starts, due = [], None
        for page, para in zip(own["page_start"].tolist(), own["para"].tolist(), strict=True):
            if due is None or page >= due:
                starts.append(para)
                due = page + pages
        return pd.DataFrame({"book": own["book"].iloc[0], "para": starts, "title": [SECTION.format(k + 1) for k in range(len(starts))]})

    return able.groupBy("book").applyInPandas(walk, f"book {kind}, para int, title string")


def chapters(paras: DataFrame, outline: DataFrame | None = None, pages_per_section: int = 12) -> DataFrame:
    """book, idx, title, para_start, para_end (exclusive), page_start, page_end, source, ambiguous.

    ``paras`` (book, para, kind, page_start, page_end, size, text, and bold if known) are numbered from 0 without gaps in each
    book. Chapters come from the book's outline (book, n, level, page, title), if one is given and leads to two or more, else
    from how headings are worded, else from their sizes, else from sections of about ``pages_per_section`` pages.
    """
    rows = settled(_featured(paras))
    counts = rows.groupBy("book").agg(F.count(F.lit(1)).alias("paras"))
    worded, sized = worded_starts(rows).drop("page"), sized_starts(rows, counts)
    found = worded.withColumn("source", F.lit("pattern")).unionByName(sized.withColumn("source", F.lit("font")))
    if outline is not None:
        found = found.unionByName(listed_starts(rows, outline, counts).withColumn("source", F.lit("toc")))
    found = settled(found)
    tally = found.groupBy("book").agg(*[F.count_if(F.col("source") == s).alias(s) for s in ("toc", "pattern", "font")])
    maybe = _candidates(rows).groupBy("book").agg(F.count(F.lit(1)).alias("maybe"))
    books = counts.join(tally, "book", "left").join(maybe, "book", "left").na.fill(0)
    source = F.when(F.col("toc") >= 2, "toc").when((F.col("pattern") >= 2) & (F.col("pattern") <= F.greatest(F.lit(2), F.col("paras") / MOST_BY_WORDS)), "pattern").when(F.col("font") >= 2, "font").otherwise("fallback")
    books = books.withColumn("source", source)
    doubt = (
        F.when(F.col("source") == "toc", False)
        .when(F.col("source") == "pattern", (F.col("font") > 0) & (F.abs(F.col("font") - F.col("pattern")) > F.greatest(F.lit(3), F.col("pattern"))))
        .when(F.col("source") == "font", (F.col("font") > DOUBTFUL) | (F.col("maybe") > DOUBTFUL_RATIO * F.col("font")))
        .otherwise(F.col("maybe") >= 2)
    )
    books = books.select("book", "paras", "source", doubt.alias("ambiguous"))
    without = rows.join(books.where("source = 'fallback'").select("book"), "book", "left_semi")
    found = found.unionByName(_sections(without, pages_per_section).withColumn("source", F.lit("fallback")))
    starts = found.join(books, ["book", "source"]).select("book", "source", "ambiguous", "paras", "para", "title")
    lead = starts.groupBy("book", "source", "ambiguous", "paras").agg(F.min("para").alias("least")).where("least > 0")
    starts = starts.unionByName(lead.select("book", "source", "ambiguous", "paras", F.lit(0).alias("para"), F.lit(OPENING).alias("title")))
    order = Window.partitionBy("book").orderBy("para")
    starts = starts.withColumn("idx", F.row_number().over(order) - 1).withColumn("para_end", F.coalesce(F.lead("para").over(order), F.col("paras")).cast("int"))
    # Paragraphs follow each other on pages, so a chapter ends on the page of its last one.
    begins = rows.select("book", "para", "page_start")
    ends = rows.select("book", (F.col("para") + 1).alias("para_end"), "page_end")
    made = starts.join(begins, ["book", "para"]).join(ends, ["book", "para_end"])
    return made.select("book", "idx", "title", F.col("para").alias("para_start"), "para_end", "page_start", "page_end", "source", "ambiguous")


def section_openings(paras: DataFrame) -> DataFrame:
    """Paragraphs that open a section: body text with a heading among the three before, and only short ones between."""
    near = paras.withColumn("_n", F.size(F.split("text", r"\s+")))
    found = ranges.beside(near, "book", "para", {f"_k{k}": ("kind", -k) for k in (1, 2, 3)} | {f"_n{k}": ("_n", -k) for k in (1, 2)})
    head = [F.coalesce(F.col(f"_k{k}") == "heading", F.lit(False)) for k in (1, 2, 3)]
    brief = [F.coalesce(F.col(f"_n{k}") <= 12, F.lit(False)) for k in (1, 2)]
    return found.where((F.col("kind") == "body") & (head[0] | (brief[0] & (head[1] | (brief[1] & head[2]))))).select(paras.columns)
