"""Large families of the Jaccard operators, and the joins of tables that grow."""

import random

import pytest
from test_llm import brute_classes

from quire.llm import hyperminhash, jaccard, space

METHODS = {"op4": (jaccard.Method(), 90), "op12": (hyperminhash.METHOD, 85)}


@pytest.mark.parametrize("name", METHODS)
def test_a_common_passage_makes_no_large_family(spark, monkeypatch, name):
    method, percent = METHODS[name]
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage = [word() for _ in range(30)]
    texts = [" ".join(passage + [word() for _ in range(8)]) for _ in range(120)]
    texts += [t + " " + word() for t in texts[:10]]  # near copies
    placed = []
    real = jaccard._placed
    monkeypatch.setattr(jaccard, "_placed", lambda members, *a: (placed.append(members.count()), real(members, *a))[1])
    monkeypatch.setattr(jaccard, "LARGE_FAMILY", 16, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(x) for x in jaccard.jaccard_classes(df, size=3, percent=percent, method=method).collect()}
    assert got == brute_classes(list(enumerate(texts)), percent=percent)
    assert len({c for _, _, c in got}) < len(texts)
    assert placed[0] < len(texts) // 3


def test_arrays_and_exploded_rows_are_not_broadcast(spark):
    sets = space.cut_large(spark.range(40).selectExpr("id AS set", "sequence(id, id + 9) AS tokens"), "sets")
    posts = sets.selectExpr("set", "explode(tokens) AS token")
    common = posts.groupBy("token").count()
    for joined in (posts.join(common, "token"), spark.range(5).withColumnRenamed("id", "set").join(sets, "set")):
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", METHODS)
def test_a_large_family_of_near_copies_is_routed_by_few_hashes(spark, monkeypatch, name):
    method, percent = METHODS[name]
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(120)]
    texts = [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(120)]
    routed = []
    real = jaccard._families

    def families(sets, *a, **more):
        if more:
            routed.append(tuple(sets.selectExpr("sum(n)", "sum(size(tokens))").first()))
        return real(sets, *a, **more)

    monkeypatch.setattr(jaccard, "_families", families)
    monkeypatch.setattr(jaccard, "LARGE_FAMILY", 16)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(x) for x in jaccard.jaccard_classes(df, size=3, percent=percent, method=method).collect()}
    assert got == brute_classes(list(enumerate(texts)), percent=percent)
    ((hashes, tokens),) = routed
    assert tokens < 0.4 * hashes


def test_texts_are_filtered_before_they_are_shuffled_also_by_small_tables(spark, tmp_path):
    spark.range(50_000).selectExpr("cast(id as string) AS key", "repeat('text ', 20) AS text").write.parquet(f"{tmp_path}/texts")
    spark.range(40).selectExpr("cast(id * 7 as string) AS key", "id AS n").write.parquet(f"{tmp_path}/sets")
    texts, sets = spark.read.parquet(f"{tmp_path}/texts"), spark.read.parquet(f"{tmp_path}/sets").hint("merge")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")  # Spark's default
    try:
        with jaccard._filtered_joins(spark):
            found = texts.join(sets.where("n > 0"), "key").dropDuplicates(["key"])
            assert "might_contain" in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 39
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10MB"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
