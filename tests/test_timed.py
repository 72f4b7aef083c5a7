"""Streams with state and timers against their batch operators: input in shuffled files, and a restart in the middle."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire.streaming import progress, timed

START = datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "job string, seq long, ts timestamp, kind string, who string, status string"


def events(seed, n=160):
    r = random.Random(seed)
    out, at = [], 0
    for k in range(n):
        at += r.choice((1, 3, 20, 45))
        kind = r.choices(("claim", "release", "cancel"), (10, 6, 1))[0]
        out.append({"job": r.choice("abcde"), "seq": k, "ts": (START + timedelta(seconds=at)).isoformat(), "kind": kind, "who": r.choice("xyz"), "status": "COMPLETED" if r.random() < 0.05 else "RUNNING"})
    return out


def run(spark, folder, rows, stream, parts=4):
    """Rows of a stream over files of ``rows``, shuffled within spans of 20; the second half comes after a restart."""
    r = random.Random(5)
    shuffled = []
    for i in range(0, len(rows), 20):
        span = rows[i : i + 20]
        r.shuffle(span)
        shuffled += span
    flush = [[{"job": "flush", "seq": 10**6 + k, "ts": (START + timedelta(days=k + 1)).isoformat(), "kind": "claim", "who": "w", "status": "RUNNING"}] for k in range(3)]
    size = -(-len(shuffled) // parts)
    files = [shuffled[i : i + size] for i in range(0, len(shuffled), size)] + flush
    (folder / "in").mkdir()
    for half in (files[: len(files) // 2], files[len(files) // 2 :]):
        for part in half:
            name = f"{len(list((folder / 'in').iterdir())):03}.json"
            (folder / "in" / name).write_text("\n".join(json.dumps(x) for x in part))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
        query = stream(source).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        query.stop()
    return [x for x in spark.read.parquet(str(folder / "out")).collect() if x["job"] != "flush"]


@pytest.fixture
def rows(spark):
    own = events(3)
    return own, spark.createDataFrame([{**x, "ts": datetime.fromisoformat(x["ts"])} for x in own], SCHEMA)


def test_throttled_stream_equals_batch(spark, tmp_path, rows):
    own, batch = rows
    got = run(spark, tmp_path, own, lambda s: timed.throttled(s, ["job"], "ts", 60, "30 minutes"))
    want = progress.throttled(batch, ["job"], "ts", 60).select("job", "seq", "status").collect()
    assert sorted((r["job"], r["seq"], r["status"]) for r in got) == sorted(tuple(r) for r in want) and len(want) < len(own)


def test_claims_stream_equals_batch(spark, tmp_path, rows):
    own, batch = rows
    got = run(spark, tmp_path, own, lambda s: timed.claims(s, "job", "ts", "30 minutes"))
    assert len(got) == len(own)
    last = {r["job"]: (r["owner"], r["cancelled"]) for r in sorted(got, key=lambda r: r["seq"])}
    assert last == {r["job"]: (r["owner"], r["cancelled"]) for r in progress.claims(batch, "job").collect()}


def test_forgotten_jobs_can_be_claimed_again(spark, tmp_path):
    at = [START + timedelta(hours=h) for h in (0, 0.1, 5, 5.1)]
    own = [{"job": "a", "seq": k, "ts": t.isoformat(), "kind": kind, "who": who, "status": "RUNNING"} for k, (t, kind, who) in enumerate(zip(at, ("claim", "cancel", "claim", "claim"), "xxyz", strict=True))]
    got = run(spark, tmp_path, own, lambda s: timed.claims(s, "job", "ts", "10 minutes", keep_seconds=3600), parts=1)
    assert [(r["seq"], r["owner"], r["cancelled"]) for r in sorted(got, key=lambda r: r["seq"])] == [(0, "x", False), (1, None, True), (2, "y", False), (3, "y", False)]


def test_expiring_stream_equals_batch(spark, tmp_path, rows):
    own, batch = rows
    got = run(spark, tmp_path, own, lambda s: timed.expiring(s, ["job"], "ts", 90, "30 minutes"))
    want = timed.expiries(batch, ["job"], "ts", 90).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10


def test_expiries_of_one_key(spark):
    df = spark.createDataFrame([("k", START + timedelta(seconds=s)) for s in (0, 5, 5, 16, 30)], "key string, ts timestamp")
    got = timed.expiries(df, ["key"], "ts", 10).select((F.unix_millis("used") / 1000 - START.timestamp()).alias("s")).collect()
    assert sorted(r["s"] for r in got) == [5, 16, 30]
