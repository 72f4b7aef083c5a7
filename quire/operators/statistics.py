"""Aggregates with exact tie rules: modes, percentiles, word and pair counts, vocabularies, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as t


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, percents: dict[str, float]) -> DataFrame:
    """keys and a column for each percentile by nearest rank: the value at place round(p / 100 * (n - 1)), from 0.

    Values are counted first, so a key's work is that of its distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_run", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    found = [F.min(F.when(F.col("_run") > F.floor((F.col("_all") - 1) * (p / 100) + 0.5), F.col("_v"))).alias(name) for name, p in percents.items()]
    return counts.groupBy(*keys).agg(*found)


def median(x: Column) -> Column:
    """The mean of the middle two."""
    return F.percentile(x, F.lit(0.5))


def weighted_mode(rows: DataFrame, keys: list[str], value: str, weight: str, order: str) -> DataFrame:
    """The value of most weight for each key; of equals the one with the least ``order``."""
    sums = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.min(order).alias("_o"))
    ranked = Window.partitionBy(*keys).orderBy(F.desc("_w"), "_o")
    return sums.withColumn("_r", F.row_number().over(ranked)).where("_r = 1").select(*keys, value, F.col("_w").alias("weight"))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The least value at which half of the weight is reached."""
    sums = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    running = Window.partitionBy(*keys).orderBy(value)
    sums = sums.withColumn("_run", F.sum("_w").over(running.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    return sums.where("2 * _run >= _all").groupBy(*keys).agg(F.min(value).alias("median"))


def form_key(word: Column) -> Column:
    """A word's form: lower case, without what stands before letters and marks after; a final full stop stays."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+", ""), r"""[,;:!?"'”’)\]]+$""", "")


def word_pairs(docs: DataFrame, key: str) -> DataFrame:
    """key, pair, n: counts of neighbouring word forms; chains break at sentence ends and at tokens without a form.

    The form of a token is made once, for both pairs that it is in, and what is shuffled are counts of pairs of forms.
    """
    ends = lambda w: w.rlike(r"""[.!?]["'”’)]*$""") & ~w.rlike(r"^\p{Lu}\p{Ll}?\.$")
    made = F.transform(t.tokens(F.col("text")), lambda w: t.let(form_key(w), lambda x: F.struct(x.alias("form"), F.when(~ends(w), F.regexp_replace(x, r"\.$", "")).alias("head"))))
    pairs = t.let(made, lambda w: F.arrays_zip(F.slice(w, F.lit(1), F.greatest(F.lit(0), F.size(w) - 1)).alias("a"), F.slice(w, 2, F.size(w)).alias("b")))
    rows = docs.select(key, F.inline(pairs)).where("a.form <> '' AND b.form <> '' AND a.head IS NOT NULL")
    return rows.groupBy(key, F.concat_ws(" ", "a.head", "b.form").alias("pair")).agg(F.count(F.lit(1)).alias("n"))


def word_counts(docs: DataFrame, key: str) -> DataFrame:
    """key, word, n, n_lower: occurrences of each form, and those printed in lower case. Printed words are counted first."""
    printed = docs.select(key, F.explode(t.tokens(F.col("text"))).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"))
    rows = printed.select(key, form_key(F.col("w")).alias("word"), F.when(F.col("w").rlike(r"^[^\p{L}]*\p{Ll}"), F.col("n")).otherwise(0).alias("low"), "n")
    # Asked of a group's aggregate, for Spark moves a condition on the word itself before the count, to each printed word.
    counts = rows.groupBy(key, "word").agg(F.sum("n").alias("n"), F.sum("low").alias("n_lower"), F.max(F.length("word")).alias("_chars"))
    return counts.where("_chars > 0").drop("_chars")


def name_candidates(docs: DataFrame, key: str, order: str, least: int = 2, most: int = 150) -> DataFrame:
    """Capitalised words inside sentences that occur ``least`` times, the ``most`` frequent of each key; of equals the first seen."""
    docs = docs.select(key, order, t.tokens(F.col("text")).alias("_tok"))
    tok = F.col("_tok")
    inner = F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(tok))), lambda i: F.struct(F.try_element_at(tok, i - 1).alias("a"), F.try_element_at(tok, i).alias("b"))), lambda p: p["b"].rlike(r"^\p{Lu}\p{Ll}+") & ~p["a"].rlike(t.TERMINAL))
    rows = docs.select(key, order, F.posexplode(inner).alias("i", "p")).select(key, F.struct(order, "i").alias("at"), F.regexp_extract("p.b", r"^(\p{Lu}\p{Ll}+)", 1).alias("name"))
    counts = rows.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).where(F.col("n") >= least)
    ranked = Window.partitionBy(key).orderBy(F.desc("n"), "at")
    return counts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most).select(key, "name", "n", "rank")


def exact_sum(x: Column) -> Column:
    """The sum of doubles, whatever their order: added as decimals of twelve places, so no tie hangs on how rows were dealt out.

    A group with a value that doesn't fit (from 1e16 on, or not finite) is added as doubles.
    """
    d = x.try_cast("decimal(28,12)")
    return F.when(F.count_if(x.isNotNull() & d.isNull()) > 0, F.sum(x)).otherwise(F.sum(d).cast("double"))


def _summed(rows: DataFrame, keys: list[str], x: Column, order: str | None) -> tuple[DataFrame, Column]:
    """Rows, and the aggregate over ``keys`` that adds ``x``: exactly, or one double after the other in ``order``, as a scan of a table does."""
    if order is None:
        return rows, exact_sum(x)
    # A running sum, not a list of the group's values: a group of any size is one sorted pass.
    so_far = Window.partitionBy(*keys).orderBy(order, x).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_run", F.sum(x).over(so_far)), F.max_by("_run", F.struct(order, x.alias("x")))


def progress(steps: DataFrame, keys: list[str], weights: dict[str, float], order: str | None = None) -> DataFrame:
    """Weighted progress over the stages of ``weights`` (others count nothing), to one place, 100 at most.

    Whether a mean just at a rounding tie goes up hangs on how its doubles are added: see ``_summed``.
    """
    w = F.coalesce(*[F.when(F.col("stage") == k, F.lit(v)) for k, v in weights.items()], F.lit(0.0))
    rows, added = _summed(steps, keys, w * F.col("progress"), order)
    total = added / F.nullif(F.sum(w), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.least(F.lit(100.0), F.floor(F.coalesce(total, F.lit(0.0)) * 10 + 0.5) / 10).alias("progress"))


def stage_rollup(steps: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """State, mean progress and counts of each stage from its steps (stage, status, progress, cached, ts, message); ``order`` as in ``progress``."""
    done = F.col("status").isin("COMPLETED", "SKIPPED")
    shown = F.when(done, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col("progress"), F.lit(0.0)))))
    steps, added = _summed(steps, [*keys, "stage"], shown, order)
    rows = steps.groupBy(*keys, "stage").agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(done).alias("done"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status") == "RUNNING").alias("running"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"),
        F.count_if((F.col("status") == "COMPLETED") & F.col("cached")).alias("cached"), (added / F.count(shown)).alias("mean"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    state = F.when(F.col("failed") > 0, "failed").when(F.col("skipped") == F.col("steps"), "skipped").when(F.col("done") == F.col("steps"), "done").when(F.col("running") > 0, "running").when(F.col("done") > 0, "partial").otherwise("pending")
    return rows.select(*keys, "stage", "steps", "done", "cached", state.alias("state"), F.when(state.isin("done", "skipped"), 100.0).otherwise(F.floor(F.col("mean") + 0.5).cast("double")).alias("progress"), "first_ts", "last_ts")
