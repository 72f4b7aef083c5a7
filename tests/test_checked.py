"""Damaged page files and bad answers: reasons in place of exceptions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import engines
from quire.sources import checked


def pages(n, start=1):
    return "".join(json.dumps({"page": k, "text": "é" * (k % 50)}) + "\n" for k in range(start, start + n))


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "good.jsonl").write_text(pages(3))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "head.jsonl").write_text('{"title": "A book"}\n\n' + pages(2).rstrip("\n"))
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "blank.jsonl").write_text("\n  \n\n")
    (tmp_path / "only-head.jsonl").write_text('{"title": "A book"}\n')
    (tmp_path / "locked.jsonl").write_text('{"encrypted": true}\n' + pages(1))
    (tmp_path / "print.pdf").write_bytes(b"%PDF-1.7\n\xff\xfe")
    (tmp_path / "cut.jsonl").write_bytes(pages(2).encode()[:-4] + b"\n" + b'{"page": "x"}\n[1]\n{"page": 9}\n{"page": 1, "t": "\xff"}\n')
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path)


def read(spark, path, **options):
    checked.register(spark)
    return spark.read.format("checked_pages").options(**options).load(path)


@pytest.mark.parametrize("size", [1, 17, 1 << 20])
def test_bad_files_are_rows_with_a_reason(spark, folder, size):
    found = {(r["doc_id"], r["page"], r["reason"]) for r in read(spark, folder, bytes_per_task=size).where("doc_id != 'cut'").collect()}
    assert found == {("good", 1, None), ("good", 2, None), ("good", 3, None), ("head", 1, None), ("head", 2, None), ("empty", None, "empty"), ("blank", None, "no pages"), ("only-head", None, "no pages"), ("locked", None, "protected"), ("print", None, "unsupported")}
    assert read(spark, folder, bytes_per_task=size).where("doc_id != 'cut'").count() == len(found)
    cut = [(r["page"], r["reason"]) for r in read(spark, folder, bytes_per_task=size).where("doc_id = 'cut'").orderBy("offset").collect()]
    assert cut == [(1, None), (None, "corrupt"), (None, "corrupt"), (None, "corrupt"), (9, None), (None, "corrupt")]


def test_missing_files_and_wrong_options(spark, tmp_path):
    assert [r["reason"] for r in read(spark, str(tmp_path / "none.jsonl")).collect()] == ["missing"]
    assert read(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="positive bytes_per_task"):
        read(spark, str(tmp_path), bytes_per_task=0).count()


def test_large_files_are_divided_without_losing_a_line(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text(pages(2000))
    (tmp_path / "small.jsonl").write_text(pages(5))
    rows = read(spark, str(tmp_path), bytes_per_task=4096)
    assert rows.rdd.getNumPartitions() > 20
    assert sorted(r["page"] for r in rows.where("file = 'big.jsonl'").collect()) == list(range(1, 2001))
    chosen = read(spark, str(tmp_path), bytes_per_task=4096).where("doc_id = 'small' AND page > 2")
    assert chosen.rdd.getNumPartitions() == 1 and sorted(r["page"] for r in chosen.collect()) == [3, 4, 5]
    assert read(spark, str(tmp_path)).where("doc_id IN ('small', 'none') AND file = 'big.jsonl'").count() == 0


@pytest.mark.parametrize("n", [1, 2, 11, 12, 13, 40, 250])
def test_twelve_pages_decide(spark, n):
    rows = [("b", k, (k * 7) % 9, k % 2 == 0) for k in range(n)]
    sample = [rows[i] for i in sorted({int(i * (n - 1) / 11) for i in range(min(12, n))})]
    empty = sum(w < 5 and images for _, _, w, images in sample)
    want = (n, int(sum(r[2] for r in sample) / len(sample) * n), empty >= max(1, int(len(sample) * 0.6)))
    df = spark.createDataFrame(rows, "book string, page int, words int, images boolean")
    assert [tuple(r)[1:] for r in checked.inspected(df, ["book"], "page", "words", "images").collect()] == [want]


def test_bad_answers_keep_their_reason(spark):
    shape = T.StructType([T.StructField("title", T.StringType()), T.StructField("picks", T.ArrayType(T.IntegerType()))])
    said = [None, " ", "no", '{"title": "a"', '{"title": "a"}', '{"title": "", "picks": [1]}', '{"title": "a", "picks": [9]}', '{"title": "a", "picks": ["x"]}', '{"title": "a", "picks": [2], "more": 1}', '```json\n{"title": "b", "picks": []}\n```', "[1]", "null"]
    rows = spark.createDataFrame(list(enumerate(said)), "id int, answer string")
    rules = {"title": lambda x: F.length(x) > 0, "picks": lambda x: F.forall(x, lambda p: p < 5)}
    got = engines.checked(rows, shape, rules, F.struct(F.lit("own").alias("title"), F.array(F.col("id")).alias("picks"))).orderBy("id").collect()
    assert [r["reason"] for r in got] == ["none", "none", "form", "form", "field: picks", "rule: title", "rule: picks", "form", None, None, "form", "form"]
    assert [(r["value"]["title"], r["value"]["picks"]) for r in got][7:10] == [("own", [7]), ("a", [2]), ("b", [])]
    assert [r["answer"] for r in got] == said
