"""Hooks for what this engine doesn't do itself: speech engines that give timings, and text helpers whose answers are guarded.

An engine is a function of columns, a helper a function of a pandas Series; both are registered by name. The registry holds
functions only: nothing is loaded or called before a plan runs.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as t

#: (narration, pause in seconds) -> duration in seconds.
Engine = Callable[[Column, Column], Column]
#: (task, inputs) -> answers.
Helper = Callable[[str, pd.Series], pd.Series]
_ENGINES: dict[str, Engine] = {}
_HELPERS: dict[str, Helper] = {}


def register_engine(name: str, engine: Engine) -> None:
    _ENGINES[name] = engine


def register_helper(name: str, helper: Helper) -> None:
    _HELPERS[name] = helper


def engine(name: str) -> Engine:
    """The speech engine of that name; an error names those there are."""
    if name not in _ENGINES:
        raise KeyError(f"no speech engine {name!r}; there are {sorted(_ENGINES)}")
    return _ENGINES[name]


def even_pace(seconds_a_word: float = 0.08) -> Engine:
    """An engine that takes as long for every word: for tests, and where no timings are given."""
    return lambda narration, pause: F.size(t.tokens(narration)) * seconds_a_word + pause


register_engine("even", even_pace())


def asked(rows: DataFrame, task: str, source: str, helper: str, known: DataFrame | None = None) -> DataFrame:
    """key, answer for the distinct texts in column ``source``: from ``known`` (key, answer) where they have been asked before.

    The key is a hash of helper, task and text, so answers can be kept and used again.
    """
    key = F.sha2(F.concat_ws("\n", F.lit(helper), F.lit(task), F.col(source)), 256)
    texts = rows.where(F.col(source).isNotNull()).select(key.alias("key"), F.col(source).alias("_text")).distinct()
    new = texts if known is None else texts.join(known.select("key"), "key", "left_anti")
    ask = _HELPERS[helper]

    @F.pandas_udf(T.StringType())
    def answers(inputs: pd.Series) -> pd.Series:
        return ask(task, inputs)

    fresh = new.select("key", answers("_text").alias("answer"))
    return fresh if known is None else fresh.unionByName(texts.join(known, "key").select("key", "answer"))


def guarded(original: Column, answer: Column, least: float = 0.8) -> Column:
    """An answer that repairs a text, if it is like it (0.8 of its letters); else the text as it was."""
    like = t.letter_similarity(original, answer) >= least
    return F.when(answer.isNotNull() & (F.trim(answer) != "") & like, answer).otherwise(original)


def checked(answers: DataFrame, schema: T.StructType, rules: dict[str, Callable[[Column], Column]], fallback: Column, answer: str = "answer") -> DataFrame:
    """``answers`` with value, a struct of ``schema``, and reason: why the answer was refused, null if it wasn't.

    An answer is a JSON object, perhaps in a code fence. It is refused for being missing ("none"), no object of that shape ("form"),
    without a field ("field: name"), or against the field's rule ("rule: name"), in the order of the fields. A refused row keeps its
    answer and has the value of ``fallback``, which gives a struct of the same fields.
    """
    bare = F.trim(F.regexp_replace(answer, r"^\s*```(?:json)?\s*|\s*```\s*$", ""))
    read = F.from_json(bare, T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())]), {"mode": "PERMISSIVE"})

    def reason(x: Column) -> Column:
        found = F.when(F.col(answer).isNull() | (F.trim(answer) == ""), "none").when(x.isNull() | x["_corrupt_record"].isNotNull() | ~bare.startswith("{"), "form")
        for f in schema.fields:
            found = found.when(x[f.name].isNull(), f"field: {f.name}")
            if f.name in rules:
                found = found.when(~F.coalesce(rules[f.name](x[f.name]), F.lit(False)), f"rule: {f.name}")
        return found

    both = t.let(read, lambda x: F.struct(reason(x).alias("reason"), F.struct(*[x[f.name].alias(f.name) for f in schema.fields]).alias("value")))
    judged = answers.withColumn("_judged", both)
    return judged.select(*answers.columns, F.when(F.col("_judged.reason").isNull(), F.col("_judged.value")).otherwise(fallback).alias("value"), F.col("_judged.reason").alias("reason"))
