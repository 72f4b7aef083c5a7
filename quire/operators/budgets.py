"""Texts of ordered rows, joined up to a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.stages import settled


def _beside(left: DataFrame, right: DataFrame, on: list[str], own: list[Column]) -> DataFrame:
    """``left`` with columns of ``right`` where ``on`` are equal, nulls included."""
    other = right.select(*[F.col(c).alias(f"_other_{c}") for c in on], *own)
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in on]).drop(*[f"_other_{c}" for c in on])


def excerpts(rows: DataFrame, keys: list[str], order: list[str], text: str, budget: int, *, part: int = 0, parts: int = 1, most: int = 600, passes: Column | None = None) -> DataFrame:
    """keys, n_texts, text: of each key the texts from one place on, in order, joined by a space, as long as they fit.

    The place is ``part`` of ``parts`` equal shares of the key's rows. The ``most`` rows from there are looked at; those for
    which ``passes`` is false take a place but give no text. The first text that would exceed ``budget`` characters ends the
    excerpt (one character is kept free behind the first text). Rows with an empty or null text don't count, nor do those
    with a null in ``order``; ``order`` must tell the rows of a key apart. A key without any text that fits has no row.

    Only keys and lengths are ordered: Spark sorts them into ranges, each range gives one row with its count, and places
    follow from running sums over those and inside the ranges that an excerpt can reach. So a key with a third of all rows
    is many ranges, and texts are read for chosen rows only.
    """
    whole = rows.where(F.length(text) > 0).dropna(subset=order)
    sizes = whole.select(*keys, *order, F.length(text).alias("_size"), (F.lit(True) if passes is None else F.coalesce(passes, F.lit(False))).alias("_passes"))
    ranged = settled(sizes.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))

    counts = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    by_range = Window.partitionBy(*keys).orderBy("_range")
    before = F.coalesce(F.sum("_n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.floor(F.sum("_n").over(Window.partitionBy(*keys)) * part / parts)
    reached = counts.select(*keys, "_range", "_n", before.alias("_before"), first.alias("_first")).where((F.col("_before") + F.col("_n") > F.col("_first")) & (F.col("_before") < F.col("_first") + most))

    near = _beside(ranged, reached, [*keys, "_range"], [F.col("_before"), F.col("_first")])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    looked_at = near.withColumn("_place", place).where((F.col("_place") >= F.col("_first")) & (F.col("_place") < F.col("_first") + most) & F.col("_passes"))

    running = Window.partitionBy(*keys).orderBy("_place")  # at most ``most`` rows a key
    joined = F.sum(F.col("_size") + 1).over(running) - 1
    free = F.when(F.row_number().over(running) == 1, 1).otherwise(0)
    chosen = looked_at.withColumn("_length", joined + free).where(F.col("_length") <= budget)
    found = _beside(chosen, whole, [*keys, *order], [F.col(text).alias("_text")])
    listed = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_texts"), F.sort_array(F.collect_list(F.struct("_place", "_text"))).alias("_all"))
    return listed.select(*keys, "n_texts", F.array_join(F.transform("_all", lambda x: x["_text"]), " ").alias("text"))
