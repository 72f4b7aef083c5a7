"""Sinks and stores: JSON lines, kits, file and memory stores, inventories of files and sweeps of what is stale."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the known files of a project are.
KINDS = {"book.mp4": "video", "book.m4a": "audio", "book.srt": "subtitles", "chapters.txt": "chapters", "thumbnail.jpg": "thumbnail", "timeline.json": "timeline"}
# End of the fixed values.


def kit_json(fields: Mapping[str, Column]) -> Column:
    """The fields as a JSON object, without those that are null."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "true"})


def write_ndjson(rows: DataFrame, path: str, kind: str) -> None:
    """Rows as JSON lines with their ``type`` first: progress, done or error. Files appear when the job has ended, or not at all."""
    rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), *rows.columns)).alias("value")).write.mode("append").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Replace the JSON lines at ``path`` as a whole; a job that fails leaves those that were there."""
    rows.write.mode("overwrite").json(path)


def read_json_if_exists(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON lines at ``path``; no rows, if there are none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(schema).json(path)
    return spark.createDataFrame([], schema)


class Store(Protocol):
    """Where the state of projects is kept: rows by the keys of a kind."""

    def save(self, kind: str, rows: DataFrame) -> None: ...

    def load(self, kind: str) -> DataFrame | None: ...


class FileStore:
    """A store of Parquet folders: a version of a kind is written beside the one before, and named when it is whole."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, kind: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(place):
            return []
        names = [s.getPath() for s in fs.listStatus(place)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def save(self, kind: str, rows: DataFrame) -> None:
        known = self._versions(kind)
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/v{known[-1] + 1 if known else 0}")

    def load(self, kind: str) -> DataFrame | None:
        known = self._versions(kind)
        return self.spark.read.parquet(f"{self.path}/{kind}/v{known[-1]}") if known else None


class MemoryStore:
    """A store that keeps plans, not rows: for tests, and for runs whose state nobody needs later."""

    def __init__(self) -> None:
        self.kinds: dict[str, DataFrame] = {}

    def save(self, kind: str, rows: DataFrame) -> None:
        self.kinds[kind] = rows

    def load(self, kind: str) -> DataFrame | None:
        return self.kinds.get(kind)


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, modified of all files below a folder; their content isn't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def inventory(files: DataFrame) -> DataFrame:
    """name, kind, size of the files that are known outputs."""
    kind = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in KINDS.items()])
    return files.select("name", kind.alias("kind"), "size").where("kind IS NOT NULL")


def folder_sizes(files: DataFrame) -> DataFrame:
    """folder, files, bytes."""
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def stale(files: DataFrame, now: Column, seconds: float) -> DataFrame:
    """Temporary files (their names hold ``.tmp``) that nobody has changed for so long."""
    age = F.unix_timestamp(now) - F.unix_timestamp("modified")
    return files.where(F.col("name").contains(".tmp") & (age >= seconds))


def fresh(entries: DataFrame, now: Column, seconds: float, most: int) -> DataFrame:
    """Entries of a cache (key, at, ...) that aren't older than ``seconds``, the ``most`` newest of them."""
    live = entries.where(F.unix_timestamp(now) - F.unix_timestamp("at") < seconds)
    return live.orderBy(F.desc("at"), "key").limit(most)
