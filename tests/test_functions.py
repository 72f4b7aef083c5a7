"""Functions on single values, with expected values stated inline."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import sequences as q
from quire.functions import text as t
from quire.functions import times as tm


def values(spark, column, *rows):
    names = [f"c{i}" for i in range(len(rows[0]))]
    data = [(i, *r) for i, r in enumerate(rows)]
    kinds = {str: "string", float: "double", int: "long", bool: "boolean", list: "array<string>"}
    schema = "i int, " + ", ".join(f"{n} {kinds[type(next(r[k] for r in rows if r[k] is not None))]}" for k, n in enumerate(names))
    return [r["x"] for r in spark.createDataFrame(data, schema).select("i", column(*[F.col(n) for n in names]).alias("x")).orderBy("i").collect()]


def test_header_key(spark):
    rows = [("Chapter 3 — The Mill   47",), ("XIV",), ("leèvi",), ("১২ অধ্যায়",), ("",)]
    assert values(spark, t.header_key, *rows) == ["chapter # the # #", "#", "leè#", "# অধ্যায়", ""]


def test_line_classes(spark):
    assert values(spark, t.is_page_number, ("- 12 -",), ("page 4 of 9",), ("xii",), ("১২",), ("12 cats",)) == [True, True, True, True, False]
    assert values(spark, t.is_contents_leader, ("Intro . . . . . 7",), ("Intro 7",)) == [True, False]
    assert values(spark, t.is_drop_cap, ("I",), ("“T",), ("Ab",)) == [True, True, False]
    assert values(spark, t.is_damaged, ("T h e e n d s",), ("plain words that are whole",), ("�",)) == [True, False, True]


def test_clip_and_clean(spark):
    assert values(spark, lambda c: t.clip(c, 10), ("short",), ("one two three",), ("aaaaaaaaaaaaaaa",)) == ["short", "one two…", "aaaaaaaaa…"]
    raw = "See https://x.example/a <b>\n00:10 intro\n#tag #two\n\n\n\nlast  line "
    assert values(spark, lambda c: t.clean_text(c, 100), (raw,), (None,)) == ["See b\n\nlast line", ""]


def test_tags(spark):
    df = spark.createDataFrame([(["a b", "A B", "c" * 20, "d", "<e>"],)], "t array<string>")
    assert df.select(t.fit_tags(F.col("t"), 10)).first()[0] == ["a b", "d", "e"]
    df = spark.createDataFrame([(["#One", "one", "t w o", "x"],)], "t array<string>")
    assert df.select(t.fit_hashtags(F.col("t"), 2)).first()[0] == ["One", "two"]
    assert values(spark, t.un_camel, ("TheOldMan2Sea",)) == ["The Old Man2 Sea"]


def test_names_and_rights(spark):
    assert values(spark, t.display_author, ("Austen, Jane, 1775-1817",), ("Homer",)) == ["Jane Austen", "Homer"]
    assert values(spark, t.year_of, ("[1913]",), ("1913-1914",), ("12345",), (None,)) == [1913, 1913, None, None]
    rows = [(None, "NOT_IN_COPYRIGHT"), ("https://creativecommons.org/licenses/by-nd/3.0/", None), ("http://creativecommons.org/publicdomain/zero/1.0/", None), ("x", None)]
    got = values(spark, t.rights, *rows)
    assert [(r["rights"], r["license"]) for r in got] == [("public_domain", "Not in copyright"), ("restricted", "CC BY-ND 3.0"), ("public_domain", "CC0"), ("unknown", None)]
    assert values(spark, t.search_query, ("war AND peace!",)) == ["(title:(war AND and AND peace) OR creator:(war AND and AND peace) OR subject:(war AND and AND peace))"]


def test_roman_and_narration(spark):
    assert values(spark, t.roman_to_int, ("XIV",), ("mcmxc",), ("abc",), ("MMMM",)) == [14, 1990, None, None]
    assert values(spark, t.narration, ("He said “see p. 4” — e.g. cats & dogs, etc.",)) == ['He said "see page 4", for example, cats and dogs, et cetera.']
    assert values(spark, t.heading_narration, ("Part One",), ("Who?",)) == ["Part One.", "Who?"]


def test_similarities(spark):
    assert values(spark, t.letter_similarity, ("abcd", "abcx"), ("", "!"), ("A-b", "ab")) == [0.75, 1.0, 1.0]
    same = "ab-" * 500  # what follows on the first thousand letters counts, too
    assert values(spark, t.letter_similarity, (same + "c" * 1000, same), (same + "c" * 1000, same + "d" * 1000), (same + "c", same + "c")) == [0.5, 0.5, 1.0]
    assert values(spark, t.phrase_index, ("The Metamorphosis by Franz", "the metamorphosis"), ("The end", "the start")) == [4, -1]
    assert values(spark, lambda c: F.size(t.shingles(c)), ("a b",), ("a b c d",), ("x x x x",)) == [0, 2, 1]


def test_times(spark):
    assert values(spark, tm.srt_time, (3661.0015,), (-1.0,), (0.9996,)) == ["01:01:01,002", "00:00:00,000", "00:00:01,000"]
    assert values(spark, lambda c: tm.chapter_time(c), (59.9,), (3600.0,)) == ["00:59", "1:00:00"]
    assert values(spark, tm.parse_time, ("1:02:03",), ("1h2m3s",), ("75",), ("x",)) == [3723.0, 3723.0, 75.0, None]
    assert values(spark, lambda c: tm.rounded(c, 2), (1.005,), (2.675,)) == [1.0, 2.68]
    weights = values(spark, tm.speech_weight, ("cat", False), ("cat,", False), ("cat.", False), ("Mr.", False), ("cat.", True), ("12", False), ("—", False))
    assert weights == [4.0, 6.5, 9.0, 3.0, 4.0, 6.0, 0.5]


def test_geometry(spark):
    df = spark.range(1).select(g.box(F.lit(0), F.lit(0), F.lit(2), F.lit(2)).alias("a"), g.box(F.lit(1), F.lit(0), F.lit(3), F.lit(2)).alias("b"))
    row = df.select(g.iou(F.col("a"), F.col("b")).alias("i"), g.around(F.col("a"), F.col("b")).alias("u"), g.smootherstep_inverse(g.smootherstep(F.lit(0.3))).alias("s"), g.iou(g.box(*[F.lit(0)] * 4), g.box(*[F.lit(0)] * 4)).alias("z")).first()
    assert row["i"] == pytest.approx(1 / 3) and tuple(row["u"]) == (0, 0, 3, 2) and row["s"] == pytest.approx(0.3, abs=1e-6) and row["z"] == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mr. Hargreaves came. He sat.", ["Mr. Hargreaves came.", "He sat."]),
        ("J. R. R. Tolkien wrote. Yes!", ["J. R. R. Tolkien wrote.", "Yes!"]),
        ("cats, dogs etc. and more. Then rest.", ["cats, dogs etc. and more.", "Then rest."]),
        ("", []),
        ("...", []),
        ("সে এল। আমি গেলাম।", ["সে এল।", "আমি গেলাম।"]),
    ],
)
def test_sentences(text, want):
    assert [text[a:b] for a, b in q.sentence_spans(text)] == want


@given(st.text(alphabet="ab .,;!?\n—'\"", max_size=900))
@settings(max_examples=60, deadline=None)
def test_sentence_spans_are_ordered_and_short(text):
    spans = q.sentence_spans(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(b - a <= q.MOST_SENTENCE for a, b in spans)
    assert all(text[a:b] == text[a:b].strip() for a, b in spans)


def test_cues_and_cards():
    assert q.cue_chunks("a" * 84) == ["a" * 84]
    assert all(len(c) <= 84 for c in q.cue_chunks("word " * 60))
    assert q.two_lines("x" * 30 + " " + "y" * 30) == "x" * 30 + "\n" + "y" * 30
    words = [(w, float(i), i + 1.0) for i, w in enumerate("one two three four love? And then".split())]
    cards = q.caption_cards(words, 20.0)
    assert [c[2] for c in cards] == [["one", "two", "three", "four", "love?"], ["And", "then"]]
    assert cards[-1][1] == 20.0 and all(x[1] <= y[0] for x, y in zip(cards, cards[1:], strict=False))


def test_alignment_and_diff():
    assert q.common_runs(["cotton", "eg", "grew"], ["cotton", "for", "example", "grew"]) == [(0, 0), (2, 3)]
    assert q.word_diff("a b c", "a x c") == [("same", "a "), ("removed", "b "), ("added", "x "), ("same", "c")]
    assert q.word_diff("a", "b", most_cells=0) == [("removed", "a"), ("added", "b")]


@given(st.lists(st.sampled_from(["One two.", "Three!", "Four five six?", "Seven"]), min_size=1, max_size=12), st.integers(1, 5))
@settings(max_examples=50, deadline=None)
def test_script_parts_joined_are_the_script(parts, k):
    script = " ".join(parts)
    out = q.split_script(script, k)
    assert " ".join(out).split() == script.split() and len(out) <= k


def test_script_parts_are_even():
    script = " ".join("a b c d e f g h." for _ in range(40))
    assert [len(p.split()) for p in q.split_script(script, 4)] == [80, 80, 80, 80]
