"""Lineage: stage keys from exact inputs, work lists, staleness, artifact layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages in order.
STAGES = ("EXTRACT", "CLEAN", "ANALYZE", "TTS", "MASTER", "TIMELINE", "VIDEO", "MUX")


def content_key(version: str, *inputs: Column) -> Column:
    """The first 20 hexadecimal digits of a SHA-256 over a version and inputs, in order; nulls count as missing fields."""
    fields = F.struct(*[c.alias(f"i{k}") for k, c in enumerate(inputs)])
    return F.substring(F.sha2(F.concat(F.lit(version), F.lit("\n"), F.to_json(fields)), 256), 1, 20)


def stage_keys(rows: DataFrame, keys: Sequence[str], inputs: Mapping[str, Sequence[str]], version: str = "v1") -> DataFrame:
    """keys, stage, key: each stage's key is made of its own inputs and of the key of the stage before."""
    columns: dict[str, Column] = {}
    before: Column = F.lit("")
    for stage, names in inputs.items():
        before = content_key(f"{version}:{stage}", before, *[F.col(n) for n in names])
        columns[stage] = before
    made = F.array(*[F.struct(F.lit(s).alias("stage"), c.alias("key")) for s, c in columns.items()])
    return rows.select(*keys, F.inline(made))


def work_list(planned: DataFrame, present: DataFrame, force: Sequence[str] = ()) -> DataFrame:
    """Planned (stage, key) rows that aren't present, and those of the stages in ``force``."""
    missing = planned.join(present.select("stage", "key").distinct(), ["stage", "key"], "left_anti").select(planned.columns)
    if not force:
        return missing
    return missing.unionByName(planned.where(F.col("stage").isin(*force))).distinct()


def steps(planned: DataFrame, present: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Planned rows with the status of their step: skipped if not wanted, completed from the cache if present, else pending."""
    have = present.select("stage", "key", F.lit(True).alias("_have")).distinct()
    joined = planned.join(have, ["stage", "key"], "left")
    status = F.when(~F.col("stage").isin(*wanted), "SKIPPED").when(F.col("_have"), "COMPLETED").otherwise("PENDING")
    return joined.select(*planned.columns, status.alias("status"), (F.coalesce("_have", F.lit(False)) & F.col("stage").isin(*wanted)).alias("cached"))


def step_order(stage: Column, chapter: Column) -> Column:
    """A number that sorts steps by stage, then by chapter."""
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage) - 1
    return place * 10_000 + F.coalesce(chapter, F.lit(0))


def stale(made: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Things whose recorded key isn't that of their current inputs."""
    return made.alias("m").join(current.alias("c"), list(keys)).where("m.key <> c.key").select(*keys)


def artifact_path(root: str, stage: Column, key: Column) -> Column:
    """root/stage/first two digits/key: spread so that no folder grows too large."""
    return F.concat_ws("/", F.lit(root), F.lower(stage), F.substring(key, 1, 2), key)
