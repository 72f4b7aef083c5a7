"""Results and plans that must not change with the size or the order of a table."""

from __future__ import annotations

import random
import time

import duckdb
from pyspark.sql import functions as F

from quire.operators import characters, marks, regions, reviews, statistics
from quire.plans.queries import QUERIES, SQL


def _steps(spark, lists):
    rows = [(k, i, "click", "RUNNING", x, False) for k, values in enumerate(lists) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "project int, seq int, stage string, status string, progress double, cached boolean").coalesce(1).withColumn("ts", F.lit(0))


def test_rounded_means_do_not_hang_on_the_order_of_rows(spark):
    # Added as doubles, these four make 178 in one order and a little less in the other.
    steps = _steps(spark, [(92.11, 41.4, 22.45, 22.04), (92.11, 22.45, 22.04, 41.4)])
    assert [r["progress"] for r in statistics.stage_rollup(steps, ["project"]).collect()] == [45.0, 45.0]
    steps = _steps(spark, [(22.17, 21.52, 54.28, 59.83), (22.17, 54.28, 21.52, 59.83)])
    assert len({r["progress"] for r in statistics.progress(steps, ["project"], {"click": 3.0}).collect()}) == 1


def _in_sql(spark, tmp_path, name, lists):
    """A query over events whose users have these values, and its SQL over the same file, read by one thread."""
    rows = [(u, x) for k in range(len(lists[0])) for u, x in enumerate(v[k] for v in lists)]
    events = [(i, u, "click", x) for i, (u, x) in enumerate(rows)]
    df = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet' ORDER BY event_id")
    want = con.execute(f"SELECT project, progress FROM ({SQL[name]})").fetchall()
    return dict(QUERIES[name](spark, str(tmp_path)).select("project", "progress").collect()), dict(want)


def test_project_progress_adds_in_the_order_of_events(spark, tmp_path):
    # Means of 44.55 and 40.35: added one after the other, the doubles fall short of the first and exceed the second.
    got, want = _in_sql(spark, tmp_path, "project_progress", [(40.32, 34.25, 30.84, 59.34, 56.36, 46.19), (30.62, 58.77, 42.02, 42.95, 44.74, 23.0)])
    assert got == want == {0: 44.5, 1: 40.4}


def test_stage_states_add_in_the_order_of_events(spark, tmp_path):
    # Means of 42.5 and 35.5, which the doubles, added one after the other, don't reach.
    got, want = _in_sql(spark, tmp_path, "stage_states", [(39.57, 26.82, 53.24, 44.7, 38.39, 52.28), (45.72, 32.87, 29.35, 21.33, 47.23, 36.5)])
    assert got == want == {0: 42.0, 1: 35.0}


def test_sums_of_values_that_are_no_decimals(spark):
    rows = spark.createDataFrame([(1, 1e300), (1, 1.0), (2, float("inf")), (3, None), (4, 0.1), (4, 0.2)], "k int, x double")
    found = dict(rows.groupBy("k").agg(statistics.exact_sum(F.col("x")).alias("s")).collect())
    assert found == {1: 1e300, 2: float("inf"), 3: None, 4: 0.3}


def test_voices_are_looked_up_by_joins_on_keys(spark):
    wanted = spark.createDataFrame([(1, "v2", "fr"), (2, "none", "en"), (3, None, "bn"), (4, None, "xx"), (5, "none", None), (6, "none", "")], "key int, preferred string, language string")
    voices = spark.createDataFrame([("v9", None, 0), ("v1", "en-US", 3), ("v2", "en", 2), ("v3", "bn", 5), ("v3", "bn", 4), (None, "fr", 1)], "id string, language string, place int")
    found = reviews.picked_voices(wanted, voices)
    assert dict(found.collect()) == {1: "v2", 2: "v2", 3: "v3", 4: "v9", 5: "v9", 6: "v9"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and "collect_list" not in plan  # not all voices for each row


def test_camera_moves_start_no_group_in_python(spark):
    parts = spark.createDataFrame([(r, float(k), 60.0 * k * (1 + r % 2), 60.0 * k * (1 + r % 2) + 10) for r in range(300) for k in range(5)], "run int, start double, y0 double, y1 double").repartition(7)
    found = marks.camera_keys(parts, ["run"], 300.0, 648.0)
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()  # runs go to Python many at a time
    got = {}
    for r in found.orderBy("run", "k").collect():
        got.setdefault(r["run"], []).append((r["k"], round(r["t0"], 2), r["y_to"], r["seconds"]))
    assert len(got) == 300 and got[2] == got[0] == [(0, 0.0, 150.0, 0.0), (1, 3.65, 245.0, 0.9)]
    assert got[1] == [(0, 0.0, 150.0, 0.0), (1, 1.65, 245.0, 0.9), (2, 2.65, 365.0, 0.9), (3, 3.65, 485.0, 0.9)]


def test_regions_of_a_long_text_take_no_longer_than_its_length(spark):
    # 4,000 stretches of 25 words: each once carried all 100,000 words with it.
    words = [f"w{k}" for k in range(100_000)]
    rows = spark.createDataFrame([(1, " ".join(words))], "doc int, text string").withColumn("w", F.split("text", " "))
    rows = rows.select("doc", "text", F.transform("w", lambda t, k: F.struct(t.alias("t"), F.array(F.struct(F.floor(k / 100).alias("page"), (k % 10 * 30.0).alias("x0"), (F.floor(k / 10) * 15.0).alias("y0"), (k % 10 * 30.0 + 28).alias("x1"), (F.floor(k / 10) * 15.0 + 11).alias("y1"))).alias("parts"))).alias("tokens"))
    ends = [0]
    for k in range(0, len(words), 25):
        ends.append(ends[-1] + len(" ".join(words[k : k + 25])) + 1)
    spans = spark.createDataFrame([(1, [(a, b - 1) for a, b in zip(ends, ends[1:], strict=False)])], "doc int, spans array<struct<start:int,end:int>>")
    began = time.monotonic()
    own = regions.tokens_between(rows.join(F.broadcast(spans), "doc"), "text", "tokens", "spans", "own").select("doc", F.posexplode("own").alias("span", "own"))
    found = regions.located(own, F.col("own")).select("span", F.size("own").alias("n"), F.inline("regions")).orderBy("span").collect()
    assert time.monotonic() - began < 60
    assert len(found) == 4000 and {r["n"] for r in found} == {25}
    assert found[0]["rects"] == [[0.0, 0.0, 298.0, 11.0], [0.0, 15.0, 298.0, 26.0], [0.0, 30.0, 148.0, 41.0]] and found[0]["chars"] == sum(map(len, words[:25]))


def test_lists_of_characters_give_what_rows_of_characters_do(spark):
    r = random.Random(3)
    data = []
    for line in range(120):
        x = 0.0
        for k in range(r.randrange(0, 40)):
            x += r.choice([4.0, 5.0, 5.0, 9.0])
            c = r.choice(["a", "b", " ", "\t", " ", "é", "", None, "ক"])
            data.append((line % 7, line, k // 6, k, c, x, 0.0, x + r.choice([0.0, 4.0, 5.0]), None if r.random() < 0.1 else 9.0, r.choice([True, False, None]), r.choice([9.0, 11.0, None]), r.choice(["A", "B", None]), r.choice([True, False]), r.choice([True, None])))
    rows = spark.createDataFrame(data, "page int, line_no int, span int, k int, c string, x0 double, y0 double, x1 double, y1 double, ocr boolean, size double, font string, bold boolean, italic boolean")
    lines = rows.groupBy("page", "line_no").agg(F.shuffle(F.collect_list(F.struct(*rows.columns[2:]))).alias("chars"))
    lines = lines.unionByName(spark.createDataFrame([(9, 999, None)], "page int, line_no int, chars " + lines.schema["chars"].dataType.simpleString()))
    key = ["page", "line_no"]
    for listed, single in ((characters.words_of_lines(lines, key), characters.words_of(rows, key)), (characters.types_of_lines(lines, key), characters.lines_of(rows, key))):
        assert listed.columns == single.columns and [f.dataType for f in listed.schema] == [f.dataType for f in single.schema]
        assert sorted(map(str, listed.collect())) == sorted(map(str, single.collect())) and listed.count() > 50
        assert "Exchange" not in characters.words_of_lines(rows.select(*key, F.array(F.struct(*rows.columns[2:])).alias("chars")), key)._jdf.queryExecution().executedPlan().toString()


def test_python_workers_get_few_rows_at_a_time(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.createDataFrame([(1, "a. b.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("document_sentences", "caption_chunks", "script_parts"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        QUERIES[name](spark, str(tmp_path))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
