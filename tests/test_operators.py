"""Operators on small tables."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import catalog, furniture, similarity, statistics, structure, timeline
from quire.plans import lineage
from quire.sources import scripts, tables
from quire.streaming import progress


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_pages_from_json_lines(spark, tmp_path):
    page = {"page": 1, "width": 432.0, "height": 648.0, "blocks": [{"b": [0, 0, 1, 1], "lines": [{"b": [54, 20, 90, 31], "size": 11.0, "font": "f", "bold": False, "italic": False, "words": [{"t": "one", "b": [54, 20, 70, 31]}, {"t": "one", "b": [54, 20, 70.5, 31]}, {"t": "so­ft", "b": [72, 20, 90, 31]}]}]}]}
    (tmp_path / "book.jsonl").write_text(json.dumps(page) + "\n\n")
    words = tables.page_words(tables.read_pages(spark, str(tmp_path / "book.jsonl")))
    assert rows(words.select("doc_id", "page", "line_no", "word_no", "t"), "word_no")[0] == ("book", 1, 0, 0, "one")
    assert [r["t"] for r in furniture.overprints(words).orderBy("word_no").collect()] == ["one", "soft"]


def test_furniture(spark):
    data = []
    for p in range(10):
        data += [("b", p, 0, "The Mill", 20.0, 31.0, 11.0), ("b", p, 1, f"Body text of page {p} goes on here", 100.0, 111.0, 11.0), ("b", p, 2, str(p + 1), 600.0, 611.0, 11.0)]
    data.append(("b", 3, 3, "{28}", 300.0, 308.0, 8.0))
    lines = spark.createDataFrame(data, "book string, page long, line_no int, text string, y0 double, y1 double, size double").withColumn("height", F.lit(648.0))
    reasons = furniture.classified(lines).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in reasons} == {None: 10, "header": 10, "page number": 11}
    assert furniture.cleaned(lines).count() == 10
    assert furniture.classified(lines.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("a", "b", "joined", "hyphen", "known", "want"),
    [
        ("Revolu-", "tion,", False, False, False, "Revolution,"),
        ("self-", "aware", False, False, False, "self-aware"),
        ("anti-", "American", False, False, False, "anti-American"),
        ("co-", "operate", False, False, True, "co-operate"),
        ("co-", "xyz", False, False, False, "coxyz"),
        ("so­", "ft", False, False, False, "soft"),
        ("দেওয়া-", "নেওয়া", False, False, False, "দেওয়া-নেওয়া"),
        ("plain", "word", True, False, False, None),
        ("-", "x", True, False, False, None),
    ],
)
def test_dehyphenate(spark, a, b, joined, hyphen, known, want):
    got = spark.range(1).select(furniture.dehyphenated(*[F.lit(x) for x in (a, b, joined, hyphen, known)])).first()[0]
    assert got == want


def test_statistics(spark):
    df = spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 4)], "k string, v double")
    row = df.groupBy("k").agg(statistics.median(F.col("v")).alias("m")).join(statistics.nearest_ranks(df, ["k"], "v", {"p": 50}), "k").first()
    assert (row["p"], row["m"]) == (3.0, 2.5)
    df = spark.createDataFrame([("k", 2, 1, 1), ("k", 1, 1, 2)], "k string, v int, w int, o int")
    assert rows(statistics.weighted_mode(df, ["k"], "v", "w", "o"), "k") == [("k", 2, 1)]


def test_timeline(spark):
    durations = spark.createDataFrame([("d", 0, 10.0), ("d", 1, 5.0)], "doc_id string, chapter int, duration double")
    timings = spark.createDataFrame([("d", 0, "s0", 0.0, 4.0), ("d", 1, "s1", 1.0, 3.0), ("d", 1, "s2", 3.0, 3.0)], "doc_id string, chapter int, sentence_id string, start double, end double")
    regions = spark.createDataFrame([("d", "s0", 1, 30), ("d", "s0", 2, 10), ("d", "s1", 2, 0), ("d", "s2", 2, 5)], "doc_id string, sentence_id string, page int, chars int")
    got = rows(timeline.build(timings, regions, durations).select("i", "sentence_id", "page", "start", "end", "page_change"), "i")
    assert got == [(0, "s0", 1, 0.0, 3.0, True), (1, "s0", 2, 3.0, 4.0, True), (2, "s1", 2, 11.0, 13.0, False)]


def test_as_of(spark):
    facts = spark.createDataFrame([("k", 1.0, 2.0, "a"), ("k", 3.0, 4.0, "b")], "k string, t double, end double, v string")
    probes = spark.createDataFrame([("k", t, i) for i, t in enumerate((0.5, 1.0, 2.5, 9.0))], "k string, t double, i int")
    assert [r["v"] for r in timeline.as_of(facts, probes, ["k"], "t", ["v"], ["i"]).orderBy("i").collect()] == [None, "a", "a", "b"]
    assert [r["v"] for r in timeline.as_of_valid(facts, probes, ["k"], "t", "end", ["v"], ["i"]).orderBy("i").collect()] == [None, "a", None, "b"]


def test_word_times_are_contiguous(spark):
    df = spark.createDataFrame([("s", "One, two 3 — four.", 1.0, 5.0)], "id string, text string, start double, end double")
    got = rows(timeline.word_times(df, "id").select("word_no", "start", "end"), "word_no")
    assert got[0][1] == 1.0 and got[-1][2] == 5.0 and all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False))


def test_similarity(spark):
    text = "one two three four five six seven"
    items = spark.createDataFrame([(0, "Same", text), (1, "Other", text + " eight"), (2, "same!", "quite other words here now today"), (3, "", "")], "id int, title string, body string")
    assert sorted(rows(similarity.similar_pairs(items, "id", "title", "body"), "a", "b")) == [(0, 1, "script"), (0, 2, "title")]


def test_paragraphs_and_chapters(spark):
    data, y = [], 0
    for p in range(3):
        y = 60.0
        for n, (x0, size, text) in enumerate([(54.0, 16.0, f"Chapter {p + 1}"), (68.0, 11.0, "It was a long line of text that fills the page"), (54.0, 11.0, "and goes on with more of the same and ends here."), (68.0, 11.0, "A second paragraph is here, of one line only but long.")]):
            data.append(("b", p, n, x0, y, 54.0 + 300, y + size, size, False, 11.0, text))
            y += size + 4
    lines = spark.createDataFrame(data, "book string, page long, line_no int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, body double, text string")
    paras = structure.paragraphs(lines)
    assert [r["kind"] for r in paras.orderBy("para").collect()] == ["heading", "body", "body"] * 3
    found = structure.chapters(paras)
    assert rows(found.select("idx", "title", "page_start", "page_end", "source"), "idx") == [(k, f"Chapter {k + 1}", k, k, "pattern") for k in range(3)]
    assert structure.section_openings(paras).count() == 3


def test_regions(spark):
    words = spark.createDataFrame([("s", k, 1, 10.0 * k, 0.0, 10.0 * k + 8, 10.0, "ab") for k in range(3)] + [("s", 3, 1, 0.0, 14.0, 8.0, 24.0, "cd")], "id string, word_no int, page long, x0 double, y0 double, x1 double, y1 double, t string")
    assert rows(structure.line_regions(words, ["id"]), "id") == [("s", 1, [[0.0, 0.0, 28.0, 10.0], [0.0, 14.0, 8.0, 24.0]], 8)]


def test_catalogue(spark):
    files = spark.createDataFrame([("i", n) for n in ("a.pdf", "a_text.pdf", "b.pdf", "b_bw.pdf", "c.pdf")], "item string, name string")
    assert sorted(r["name"] for r in catalog.best_copies(files).collect()) == ["a_text.pdf", "b.pdf", "c.pdf"]
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, value string")
    b = spark.createDataFrame([("x", "1"), ("z", "3")], "path string, value string")
    assert sorted(tuple(r) for r in catalog.tree_diff(a, b, ["path"]).collect()) == [("y", "2", None), ("z", None, "3")]
    mine = spark.createDataFrame([("p", "k1"), ("p", "k2"), ("q", "k2")], "owner string, key string")
    assert rows(catalog.unreferenced(mine, mine, "owner", "key"), "key") == [("p", "k1")]


def test_plan(spark):
    data = [("d", 0, "One", 5, None, None, " First "), ("d", 1, "Two", 9, None, True, None), ("d", 2, "Three", 12, True, None, None), ("d", 3, "Index", 14, None, None, None)]
    df = spark.createDataFrame(data, "doc_id string, idx int, title string, page_end int, exclude boolean, merge boolean, new_title string")
    got = rows(catalog.plan(df).select("idx", "title", "page_end", "reason"), "idx")
    assert got == [(0, "First", 9, None), (1, None, None, "merged"), (2, None, None, "excluded"), (3, None, None, "back-matter")]


EVENTS = [("p", 1, "RUNNING", 10.0), ("p", 2, "COMPLETED", 100.0), ("p", 3, "RUNNING", 50.0), ("q", 1, "RUNNING", 5.0), ("q", 4, "RUNNING", 7.0)]


def test_fold_keeps_terminal_states(spark):
    df = spark.createDataFrame(EVENTS, "k string, seq int, status string, progress double")
    assert rows(progress.fold(df, ["k"]), "k") == [("p", 2, "COMPLETED", 100.0), ("q", 4, "RUNNING", 7.0)]


def test_stream_equals_batch(spark, tmp_path):
    schema = "k string, seq int, status string, progress double"
    for n, part in enumerate((EVENTS[:2], EVENTS[2:4], EVENTS[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        progress.write_latest(stream, ["k"], str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    last = max(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("batch="))
    assert rows(spark.read.parquet(str(tmp_path / "out" / last)).select("k", "seq", "status", "progress"), "k") == [("p", 2, "COMPLETED", 100.0), ("q", 4, "RUNNING", 7.0)]


def test_claims(spark):
    df = spark.createDataFrame([("j", 1, "claim", "a"), ("j", 2, "claim", "b"), ("j", 3, "release", "a"), ("j", 4, "claim", "b"), ("k", 1, "cancel", "x"), ("k", 2, "claim", "a")], "job string, seq int, kind string, who string")
    assert rows(progress.claims(df, "job"), "job") == [("j", "b", False), ("k", None, True)]


def test_lineage(spark):
    df = spark.createDataFrame([("p", "x", "v1"), ("q", "x", "v2")], "id string, text string, voice string")
    keys = {(r["id"], r["stage"]): r["key"] for r in lineage.stage_keys(df, ["id"], {"A": ["text"], "B": ["voice"]}).collect()}
    assert keys["p", "A"] == keys["q", "A"] and keys["p", "B"] != keys["q", "B"] and len(keys["p", "A"]) == 20


@pytest.mark.parametrize(
    ("raw", "kind", "titles"),
    [
        ('Here: [{"Title": "A", "Text": "One two."}, {"name": "B", "script": "Three."}]', "json", ["A", "B"]),
        ('title;script\n"A; b";"One ""two"" \nthree"\nC;Four', "table", ["A; b", "C"]),
        ("Short 1: First\nScript: One.\n---\nTitle: Second\nScript: Two.\nHashtags: #x #y", "sections", ["First", "Second"]),
        ("Just one text here. And more.", "single", ["Just one text here"]),
        ("", "empty", []),
    ],
)
def test_script_batches(raw, kind, titles):
    got, items = scripts.parse_batch(raw)
    assert (got, [i["title"] for i in items]) == (kind, titles)


def test_score(spark):
    df = spark.createDataFrame([(1, 0), (2, 5), (3, 50)], "id int, n int")
    checked = catalog.checks(df, ["id"], {"a": (F.col("n") == 0, F.col("n") > 10, 3), "b": (F.lit(False), F.lit(False), 1)})
    assert rows(catalog.score(checked, ["id"]), "id") == [(1, 25, 1), (2, 100, 0), (3, 63, 0)]


def test_pandas_fold_orders_rows(spark):
    df = spark.createDataFrame([("k", 2), ("k", 1), ("k", 3)], "k string, o int")
    out = structure.fold(df, ["k"], ["o"], lambda pdf: pd.DataFrame({"k": pdf["k"].iloc[:1], "s": [",".join(map(str, pdf["o"]))]}), "k string, s string")
    assert rows(out, "k") == [("k", "1,2,3")]
