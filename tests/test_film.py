"""Camera moves, excerpts and broken words against plain Python."""

from __future__ import annotations

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from quire.functions import bangla
from quire.operators import budgets, camera

PARTS = "run string, start double, end double, rects array<struct<x0 double, y0 double, x1 double, y1 double>>"


def part(start, end, *lines, run="r"):
    return (run, float(start), float(end), [(0.0, float(a), 100.0, float(b)) for a, b in lines])


def moves(spark, parts, visible=300.0, height=648.0):
    found = camera.path(spark.createDataFrame(parts, PARTS), ["run"], visible, height)
    return found, [tuple(r)[2:] for r in found.orderBy("run", "k").collect()]


def test_camera_rests_in_its_dead_zone_and_leads_otherwise(spark):
    _, got = moves(spark, [part(0, 2, (140, 150)), part(2.5, 4, (170, 180)), part(5, 6, (300, 310))])
    assert got == [(0.0, 145.0, 145.0, 0.0), (4.65, 145.0, 305.0, 0.9)]


def test_camera_is_faster_in_short_pauses_and_words_are_seen(spark):
    parts = [part(0, 3, (600, 610)), part(3.1, 6, (40, 50)), part(6.8, 8, (600, 610))]
    found, got = moves(spark, parts)
    assert [m[3] for m in got] == [0.0, 0.4, pytest.approx(0.9)]
    times = spark.createDataFrame([("r", 3.35), ("r", 6.8), ("r", -1.0), ("s", 1.0)], "run string, t double")
    at = {(r["run"], r["t"]): (r["k"], r["y"]) for r in camera.at(found, times, ["run"]).collect()}
    assert at["r", -1.0] == (None, got[0][1]) and at["s", 1.0] == (None, None)
    assert at["r", 3.35][0] == 1 and at["r", 3.35][1] < 200  # a jump of a page within a pause of 0.1 s
    assert at["r", 6.8][1] + 150 >= 610 + 0.04 * 300 - 1e-6  # the next words are in the picture as they begin


def test_camera_places_are_smooth(spark):
    rng = random.Random(5)
    t, parts = 0.0, []
    for _ in range(60):
        y = rng.randrange(20, 620)
        parts.append(part(t, t + 1.2, (y, y + 10)))
        t += 1.2 + rng.choice([0.05, 0.3, 1.0])
    found, got = moves(spark, parts)
    for a, b in zip(got, got[1:]):
        assert b[0] >= a[0] + 0.05 - 1e-9 and 0.4 <= b[3] <= 0.9
    times = spark.createDataFrame([("r", k / 50) for k in range(int(t * 50))], "run string, t double")
    ys = [r["y"] for r in camera.at(found, times, ["run"]).orderBy("t").collect()]
    assert max(abs(a - b) for a, b in zip(ys, ys[1:])) < 648 * 1.875 / 0.4 / 50 + 1e-6  # no jumps: the fastest eased move
    ends = {m[0] + m[3]: m[2] for m, n in zip(got, [*got[1:], (1e9,)]) if m[0] + m[3] <= n[0]}
    check = camera.at(found, spark.createDataFrame([("r", e) for e in ends], "run string, t double"), ["run"]).collect()
    assert all(r["y"] == pytest.approx(ends[r["t"]]) for r in check)


def test_camera_stands_in_the_middle_of_a_page_that_fits(spark):
    _, got = moves(spark, [part(0, 1, (10, 20)), part(2, 3, (600, 610)), ("r", 4.0, 5.0, []), ("r", None, 5.0, [(0.0, 1.0, 1.0, 2.0)])], visible=800.0)
    assert got == [(0.0, 324.0, 324.0, 0.0)]
    assert moves(spark, [])[1] == []


def brute_excerpt(rows, budget, part, parts, most):
    rows = sorted(r for r in rows if r[0] is not None and r[1])
    begin = len(rows) * part // parts
    out, n = "", 0
    for _, text, passes in rows[begin : begin + most]:
        if not passes:
            continue
        if len(out) + len(text) + 1 > budget:
            break
        out, n = out + (" " if out else "") + text, n + 1
    return (n, out) if n else None


@pytest.mark.parametrize(("budget", "part", "parts", "most"), [(200, 0, 1, 600), (90, 2, 3, 12), (10_000, 1, 2, 600), (1, 0, 1, 5)])
def test_excerpts_equal_plain_python(spark, budget, part, parts, most):
    rng = random.Random(budget)
    rows = [(None if k > 970 else rng.choice("aaaaab"), None if k % 97 == 0 else k, rng.choice([None, "", "x" * rng.randrange(1, 30)]) if k % 4 else "é" * (k % 23), k % 5 > 0) for k in range(1000)]
    df = spark.createDataFrame(rows, "key string, no int, text string, good boolean").repartition(7)
    got = {r["key"]: (r["n_texts"], r["text"]) for r in budgets.excerpts(df, ["key"], ["no"], "text", budget, part=part, parts=parts, most=most, passes=F.col("good")).collect()}
    want = {k: brute_excerpt([r[1:] for r in rows if r[0] == k], budget, part, parts, most) for k in (None, "a", "b")}
    assert got == {k: v for k, v in want.items() if v}
    assert budgets.excerpts(df.where("false"), ["key"], ["no"], "text", budget).count() == 0


def brute_broken(word):
    """Whether some sign stands where none may, by looking at each pair of neighbours."""
    letters = [chr(c) for c in range(0x0995, 0x09BA)] + list("ৎড়ঢ়য়ৰৱ")
    signs = [chr(c) for c in (0x09BC, *range(0x09BE, 0x09CE), 0x09D7)]
    if word and (word[0] in "‌‍" or word[-1] in "‌‍"):
        return True
    for before, sign in zip(["", *word], word):
        completed = (before, sign) in {("ে", "া"), ("ে", "ৗ"), ("‌", "্"), ("‍", "্")}
        if sign in signs and not (before == sign or before in letters or before == "়" or completed):
            return True
    return any(c == "�" or "" <= c <= "" for c in word)


def test_broken_words_equal_plain_python(spark):
    alphabet = ["ক", "়", "া", "ে", "ৗ", "্", "‍", "অ", "a", "�"]
    words = ["".join(x) for n in range(5) for x in product(alphabet, repeat=n)] + ["িক", "িতীয়", "উেগ", "দ্বিতীয়", "উদ্বেগ", "দ্বাারা", "ক‌", "১ি"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", bangla.is_broken(F.col("w")).alias("b")).collect()
    assert [(r["w"], r["b"]) for r in got if r["b"] != brute_broken(r["w"])] == [] and len(got) == len(words)
    assert spark.sql("SELECT CAST(NULL AS STRING) AS w").select(bangla.is_broken(F.col("w"))).first()[0] is None
