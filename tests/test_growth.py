"""Work that must not grow faster than its input: results as before, by plans without the costly step."""

import random
import re
import time

from pyspark.sql import functions as F

from quire.functions import sequences as q
from quire.functions import text as t
from quire.operators import furniture, marks, regions, similarity, statistics, structure
from quire.plans.queries import QUERIES
from quire.sources import checked

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tags_are_not_counted_anew_for_each_tag(spark):
    df = spark.createDataFrame([(["a b", "cd", "A  B", "", None, "efgh", "x", "y"],)], "t array<string>")
    got = df.select(t.fit_tags(F.col("t"), 10).alias("a"), t.fit_tags(F.col("t"), 9).alias("b"), t.fit_tags(F.col("t"), 500).alias("c"), t.fit_hashtags(F.col("t"), 3).alias("h"))
    assert list(got.first()) == [["a b", "cd", "x"], ["a b", "cd"], ["a b", "cd", "efgh", "x", "y"], ["ab", "cd", "efgh"]]
    assert all(t_ == "" or n <= 10 for t_, n in got.select(F.array_join("a", ","), t.tag_chars(F.col("a"))).collect())
    assert plan(df.select(t.fit_tags(F.col("t"), 10).alias("x"))).count("aggregate(") == 1


def test_edit_distances_equal_sparks(spark):
    r = random.Random(4)
    rows = [("".join(r.choices("abcé😀", k=r.randrange(120))), "".join(r.choices("abcé😀", k=r.randrange(120)))) for _ in range(300)]
    df = spark.createDataFrame([*rows, ("", ""), ("abc", ""), (None, "a"), (None, None)], "a string, b string")
    both = df.select(q.edit_distances(F.struct("a", "b")).alias("d"), F.levenshtein("a", "b").alias("want"), F.greatest(F.length("a"), F.length("b")).alias("longest"))
    assert all(x["d"]["distance"] == x["want"] and (x["want"] is None or x["d"]["longest"] == x["longest"]) for x in both.collect())
    assert "levenshtein" not in plan(df.select(t.letter_similarity(F.col("a"), F.col("b"))))


def test_words_of_a_book_pass_no_window(spark):
    rows = [("b", 1, 0, "One two-"), ("b", 1, 1, "three Four"), ("b", 1, 2, "five-"), ("b", 1, 3, "six"), ("b", 2, 0, "seven end-"), ("b", 4, 0, "eight nine"), ("c", 3, 0, "ten"), (None, 5, 0, "zero-"), (None, 6, 0, "a b")]
    df = spark.createDataFrame(rows, "book string, page int, line_no int, text string")
    got = furniture.vocabulary(df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("b", "one"), ("b", "four"), ("b", "seven"), ("b", "nine"), ("c", "ten"), (None, "b")], key=str)
    windows = [x for x in plan(got).splitlines() if re.search(r"Window \[", x)]
    assert windows and not any(re.search(r"\[book#\d+\], \[page#\d+ ASC NULLS FIRST, line_no", x) for x in windows)


def test_shingles_take_words_in_place(spark):
    df = spark.createDataFrame([("b a c a b a c",), ("a b",), ("",)], "text string")
    got = df.select(t.shingles(F.col("text")).alias("s"), t.runs_of(F.split("text", " "), 2).alias("r"))
    assert [list(x) for x in got.collect()] == [[["b a c", "a c a", "c a b", "a b a"], ["b a", "a c", "c a", "a b"]], [[], ["a b"]], [[], []]]
    assert "slice(" not in plan(got)


def _longest_common(a, b):
    """As ``common_runs``, by the table of lengths."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] and a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_long_texts_are_aligned_by_bit_vectors():
    r = random.Random(6)
    for _ in range(1500):
        a, b = (r.choices(["", "a", "b", "c", "dd"][: r.randrange(2, 6)], k=r.randrange(25)) for _ in "ab")
        assert q.common_runs(a, b) == _longest_common(a, b)
    began = time.process_time()
    words = [str(r.randrange(900)) for _ in range(5000)]
    assert len(q.common_runs(words, words[:2000] + words[2010:])) == 4990
    assert time.process_time() - began < 0.5


def test_words_are_timed_in_many_tasks(spark):
    got = QUERIES["printed_word_times"](spark, SF)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_words_are_given_pages_in_many_tasks(spark):
    got = QUERIES["words_on_pages"](spark, SF)
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_forms_are_made_once_a_token(spark):
    texts = ["One two. Three, (four) J. Five!” six — a.  b", "x", "", None, "--", "Two two two TWO"]
    df = spark.createDataFrame([("k", x) for x in texts], "k string, text string")
    pairs, counts = statistics.word_pairs(df, "k"), statistics.word_counts(df, "k")
    assert sorted(map(tuple, pairs.collect())) == [("k", "four j.", 1), ("k", "j five", 1), ("k", "one two.", 1), ("k", "three four", 1), ("k", "two two", 3)]
    assert {(x["word"], x["n"], x["n_lower"]) for x in counts.collect()} >= {("two", 4, 2), ("two.", 1, 1), ("j.", 1, 0), ("x", 1, 1)}
    # No form of a printed word below the count, where each pair or word would have its own.
    assert plan(pairs).count("Aggregate [") == 1 and plan(pairs).count("lower(") == 1
    assert not any("Filter" in x and "lower(" in x for x in plan(counts).splitlines())


def test_boxes_are_made_of_lines_that_come_without_their_words(spark):
    lines = spark.createDataFrame([("a", 1, 14.0, [1, 2]), ("a", 0, 0.0, [2, 2, 3]), ("b", 5, 3.0, [4])], "doc string, line_no int, y0 double, chars array<int>")

    def parts(x):
        return F.transform(x["chars"], lambda n, k: F.struct(F.lit(1).cast("long").alias("page"), (k * 10.0).alias("x0"), x["y0"].alias("y0"), (k * 10.0 + 8).alias("x1"), (x["y0"] + 10).alias("y1"), n.cast("double").alias("chars")))

    got = {r["doc"]: (r["page"], [list(b) for b in r["rects"]], r["chars"]) for r in regions.regions_of_lines(lines, ["doc"], ["line_no"], parts).collect()}
    assert got == {"a": (1, [[0.0, 0.0, 28.0, 10.0], [0.0, 14.0, 18.0, 24.0]], 10), "b": (1, [[0.0, 3.0, 8.0, 13.0]], 4)}
    query = plan(QUERIES["sentence_regions"](spark, SF))
    assert query[query.index("Aggregate [") :].count("Generate ") == 1  # the lines of documents


def test_a_cursor_needs_no_join(spark):
    rows = [("a", 2, 0.0, 1.0, 50.0, 60.0, 0), ("a", 1, 3.0, 4.0, 10.0, 20.0, 0), (None, 1, 0.0, 1.0, 1.0, 2.0, 0)]
    words = spark.createDataFrame(rows, "doc string, word_no int, start double, end double, x0 double, x1 double, line int")
    times = spark.createDataFrame([("a", -1.0), ("a", 0.5), ("a", 9.0), ("z", 1.0), (None, 0.5)], "doc string, t double")
    got = marks.cursor(words, times, ["doc"])
    assert sorted(map(tuple, got.collect())) == [("a", -1.0, 1, 10.0), ("a", 0.5, 2, 55.0), ("a", 9.0, 1, 50.0)]
    assert "Join" not in plan(got) and "Join" not in plan(QUERIES["cursor_places"](spark, SF))


def test_readers_of_page_files_hold_few_lines_at_a_time(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    checked.register(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_prefixes_of_shingles_are_cut_without_reading_texts_again(spark):
    text = "one two three four five six seven"
    items = spark.createDataFrame([(0, "", text), (1, "", text + " eight"), (2, "", "quite other words here now today"), (3, "", ""), (4, "", text), (5, "", None)], "id int, title string, body string")
    got = similarity.similar_pairs(items, "id", "title", "body")
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(0, 1), (0, 4), (1, 4)]
    # Shingles are counted once, and made once more for each side of the pairs' prefixes.
    assert plan(got).count("explode(transform(") <= 4


def test_sets_of_near_copies_are_not_sent_with_each_pair(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_TEXTS", 16)  # several blocks, and a group of near copies in more than one of them
    r = random.Random(5)
    base, texts = [f"w{k}" for k in range(60)], ["a b", "", "few words of its own here", None]
    for k in range(120):
        own = list(base if k % 3 else base[k % 40 :] + [f"v{k % 4}{j}" for j in range(k % 40)])
        for i in r.sample(range(len(own)), r.choice((0, 0, 2, 6, 12))):
            own[i] = f"u{r.randrange(9)}"
        texts.append(" ".join(own))
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in enumerate((x or "").split() for x in texts)}
    want = {(i, j) for i in sets for j in sets if i < j and min(len(sets[i]), len(sets[j])) >= 4 and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.4}
    got = similarity.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, body string").withColumn("title", F.lit("")), "id", "title", "body")
    pairs = [(x["a"], x["b"]) for x in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want) > 1000
    assert "array_intersect" not in plan(got) and "FlatMapCoGroupsInArrow" in plan(got)


def test_boxes_that_lines_tell_are_made_once_paragraphs_are(spark):
    texts = [(0, "One two three bro-"), (1, "ken four five."), (2, " Six  seven "), (3, "eight bro-"), (4, "ken")]
    lines = spark.createDataFrame([("b", n // 3, n, 54.0, 20.0 + n * 15, 54.0 + len(x) * 5, 31.0 + n * 15, 11.0, False, 11.0, x) for n, x in texts], "book string, page long, line_no int, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, body double, text string")

    def box(x0, y0, y1, i):
        return F.struct((x0 + i * 20).alias("x0"), y0.alias("y0"), (x0 + i * 20 + 18).alias("x1"), y1.alias("y1"))

    carried = lines.withColumn("boxes", F.transform(t.tokens(F.col("text")), lambda w, i: box(F.col("x0"), F.col("y0"), F.col("y1"), i)))
    told = structure.paragraphs(lines, boxes=lambda x: F.transform(x["words"], lambda w, i: box(x["x0"], x["y0"], x["y1"], i)))
    got, want = ([tuple(r) for r in df.orderBy("para").collect()] for df in (told, structure.paragraphs(carried)))
    assert got == want and [len(x["parts"]) for r in got for x in r[-1]].count(2) == 2
    assert "boxes#" not in plan(QUERIES["book_sentences"](spark, SF))


def test_sentences_of_the_timeline_are_split_once(spark):
    got = QUERIES["timeline_slice"](spark, SF)
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ArrowEvalPython") == 1
    assert len(re.findall(r"ReusedExchange \[source#\d+, doc_id#\d+, line#", final)) == 1


def test_a_timeline_of_documents_without_id_or_lines(spark, tmp_path):
    rows = [(1, "Page 1\nOne two. Three.\nOwn line", "a"), (2, "page 22\nFour.\nPage 3", "a"), (2, "Five six.\nOther", "a"), (None, "Page 9\nSeven.", "a"), (3, None, "a"), (4, "\n", "a"), (5, "Page 1", None), (6, "Page 1", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["timeline_slice"](spark, str(tmp_path)).select("source", "doc_id", "text", F.round(F.col("start") * 155 / 60).cast("int"), F.round(F.col("end") * 155 / 60).cast("int")).collect()))
    assert [x for x in got if x[1] != 2] == [("a", 1, "One two.", 1, 3), ("a", 1, "Own line", 4, 6), ("a", 1, "Three.", 3, 4), ("b", 6, "Page 1", 0, 2)]  # a document without id takes its time
    assert sorted(x[2] for x in got if x[1] == 2) == ["Five six.", "Four.", "Other"] and max(x[4] for x in got) == 10


def test_sentence_breaks_compile_no_pattern(monkeypatch):
    for name in ("fullmatch", "match", "search"):
        monkeypatch.setattr(q.regex, name, None)
    text = "We saw Mr. Hill, e.g. at noon (vol. 2). Ann Bell left etc. and so on. ডা. রহিম এল। Was it No. 5? It was x1. Then done."
    assert [text[a:b] for a, b in q.sentence_spans(text)] == ["We saw Mr. Hill, e.g. at noon (vol. 2).", "Ann Bell left etc. and so on.", "ডা. রহিম এল।", "Was it No. 5?", "It was x1.", "Then done."]
