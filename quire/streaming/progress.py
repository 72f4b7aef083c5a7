"""Progress events: folded to the latest state of each step, in batches and in Structured Streaming, with one rule for both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.tables import latest_per_key

TERMINAL_STATES = ("COMPLETED", "FAILED", "SKIPPED", "CANCELLED")


def last_write(columns: list[str], order: str) -> Column:
    """An aggregate: the struct of the last event; a terminal state is never overwritten by later progress."""
    final = F.col("status").isin(*TERMINAL_STATES)
    return F.max_by(F.struct(*columns), F.struct(final, F.when(final, -F.col(order)).otherwise(F.col(order))))


def fold(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One row for each key: its current state. Works on batches and streams alike (update or complete mode)."""
    own = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(last_write(own, order).alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in own])


def throttled(events: DataFrame, keys: list[str], time: str, seconds: float) -> DataFrame:
    """At most one event of each key in ``seconds``: the last; terminal ones always."""
    final = F.col("status").isin(*TERMINAL_STATES)
    slot = F.floor(F.unix_micros(time) / (seconds * 1_000_000))
    rest = latest_per_key(events.where(~final).withColumn("_slot", slot), [*keys, "_slot"], time).drop("_slot")
    return rest.select(events.columns).unionByName(events.where(final))


def recovered(steps: DataFrame, alive: list[str]) -> DataFrame:
    """Steps after a crash: what ran in a project that no worker has any more is pending again, with its progress gone."""
    orphan = (F.col("status") == "RUNNING") & ~F.col("worker").isin(alive)
    return steps.withColumns({"status": F.when(orphan, "PENDING").otherwise(F.col("status")), "progress": F.when(orphan, 0.0).otherwise(F.col("progress"))})


def claims(events: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """key, owner: who holds each job after claims, releases and cancellations, in order; a claim of a held job is refused."""

    def step(s: Column, e: Column) -> Column:
        free = s["owner"].isNull() & ~s["cancelled"]
        owner = (
            F.when((e["kind"] == "claim") & free, e["who"])
            .when((e["kind"] == "release") & (s["owner"] == e["who"]), F.lit(None).cast("string"))
            .when(e["kind"] == "cancel", F.lit(None).cast("string"))
            .otherwise(s["owner"])
        )
        return F.struct(owner.alias("owner"), (s["cancelled"] | (e["kind"] == "cancel")).alias("cancelled"))

    start = F.struct(F.lit(None).cast("string").alias("owner"), F.lit(False).alias("cancelled"))
    ordered = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "kind", "who"))).alias("_e"))
    done = ordered.withColumn("_s", F.aggregate("_e", start, step))
    return done.select(key, F.col("_s.owner").alias("owner"), F.col("_s.cancelled").alias("cancelled"))


def write_latest(stream: DataFrame, keys: list[str], path: str, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Keep the current state of each key as Parquet below ``path``, a folder for each batch; the greatest batch is current.

    Each batch folds its own events with the state before it. A batch that runs again writes the same folder again; the
    state two batches back is deleted, for nothing can ask for it any more.
    """
    schema = stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number > 0:
            rows = spark.read.schema(schema).parquet(f"{path}/batch={number - 1}").unionByName(batch)
        fold(rows, keys, order).select(*schema.names).write.mode("overwrite").parquet(f"{path}/batch={number}")
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number - 2}")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of ``value`` in tumbling windows of event time, under a watermark; time zones: the session's."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    grouped = timed.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def jobs(spark: SparkSession, path: str, topic: str, most: int = 1) -> DataFrame:
    """A stream of the jobs (topic, project, seq, payload) of one topic, from JSON lines that appear below ``path``.

    A batch takes ``most`` files at a time. A job that fails isn't tried again by itself: its query ends with the error.
    """
    rows = spark.readStream.schema("topic string, project string, seq long, payload string").option("maxFilesPerTrigger", most).json(path)
    return rows.where(F.col("topic") == topic)


def in_order(results: DataFrame, keys: list[str], place: str, upto: int) -> DataFrame:
    """What can be handed on of results that came out of order: each row whose predecessors (from 0) are all there, of ``upto`` in all."""
    have = results.groupBy(*keys).agg(F.collect_set(place).alias("_have"))
    first_gap = F.coalesce(F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(upto - 1)), "_have")), F.lit(upto))
    return results.join(have.select(*keys, first_gap.alias("_gap")), keys).where(F.col(place) < F.col("_gap")).drop("_gap")
