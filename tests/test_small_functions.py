"""Functions and operators that no query uses."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import publishing, times
from quire.functions import text as t
from quire.operators import layout
from quire.streaming import progress


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_titles_durations_and_layout(spark):
    assert one(spark, t.clean_title(F.lit(' “A  title\nof two lines”  ')), t.clean_title(F.lit("word " * 40), 20)) == ("A title of two lines", "word word word…")
    assert one(spark, *[times.duration_text(F.lit(s)) for s in (0.0, 12.4, 59.6, 200.0, 3900.0)]) == ("0 s", "12 s", "1 m 00 s", "3 m 20 s", "1 h 05 m")
    assert one(spark, g.scale_to_fit(F.lit(200.0), F.lit(50.0), 100.0, 100.0), g.clamp(F.lit(7), F.lit(1), F.lit(5)), g.clamp(F.lit(-7), F.lit(1), F.lit(5))) == (0.5, 5, 1)
    assert one(spark, *[t.ends_sentence(F.lit(x)) for x in ('so."', "so,", "এক।")], *[t.starts_lower(F.lit(x)) for x in ("“word", "Word")]) == (True, False, True, True, False)


def test_media_tags(spark):
    tags = one(spark, publishing.media_tags({"title": F.lit(" A "), "artist": F.lit(None).cast("string")}, F.lit("x \n" * 200), F.array(F.lit("a"), F.lit("b")), audio=True))[0]
    assert (tags["title"], tags["artist"], tags["keywords"], tags["media_type"]) == ("A", "", "a,b", "2")
    assert len(tags["description"]) <= 255 and tags["description"].endswith("…")


def test_regions_of_one_page_together(spark):
    rows = spark.createDataFrame([("s", 1, 2, [[3.0]], 5), ("s", 1, 1, [[1.0], [2.0]], 4), ("s", 2, 3, [[4.0]], 1)], "id string, page int, ord int, rects array<array<double>>, chars int")
    got = {r["page"]: (r["rects"], r["chars"]) for r in layout.merged_regions(rows, ["id"]).collect()}
    assert got == {1: ([[1.0], [2.0], [3.0]], 9), 2: ([[4.0]], 1)}


def test_jobs_of_one_topic(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(4):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"topic": "text" if k % 2 else "video", "project": f"p{k}", "seq": k, "payload": "{}"}))
    seen = []
    query = progress.jobs(spark, str(tmp_path / "in"), "text").writeStream.foreachBatch(lambda batch, _: seen.append([r["project"] for r in batch.collect()])).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(x for batch in seen for x in batch) == ["p1", "p3"] and max(map(len, seen)) == 1
