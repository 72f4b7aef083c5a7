"""A camera over a page that keeps what is being read in the picture: its moves, and where it is at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import smootherstep
from quire.operators.marks import DEAD_ZONE, LEAD, MOVE
from quire.operators.timeline import as_of

# Seconds of the fastest move; share of the visible height that stays free at its edges; share of the page that
# may show beyond its ends; share of the visible height from which on a block counts as tall, and where its top then stands;
# seconds between two moves; points that the picture may be off.
FASTEST, EDGE, BEYOND, TALL, TALL_TOP, APART, SLACK = 0.40, 0.04, 0.04, 0.6, 0.3, 0.05, 0.5
# End of the fixed values.


def _ease(u: float) -> float:
    u = min(max(u, 0.0), 1.0)
    return u * u * u * (u * (6 * u - 15) + 10)


def _time_of(share: float) -> float:
    """When, in shares of a move's time, it has gone ``share`` of its way."""
    low, high = 0.0, 1.0
    for _ in range(30):
        middle = (low + high) / 2
        if _ease(middle) < share:
            low = middle
        else:
            high = middle
    return high


def targets(parts: DataFrame, visible: float, height: float) -> DataFrame:
    """``parts`` with goal, and low and high: where the camera's middle should stand for each, and between which places it sees it.

    ``rects`` is a list of boxes in reading order. A tall block stands near the top; one that doesn't fit at all is seen if
    its first line is.
    """
    top, bottom = F.array_min(F.transform("rects", lambda r: r["y0"])), F.array_max(F.transform("rects", lambda r: r["y1"]))
    goal = F.when(bottom - top < TALL * visible, (top + bottom) / 2).otherwise(top + (0.5 - TALL_TOP) * visible)
    margin = BEYOND * height
    inside = F.least(F.greatest(goal, F.lit(visible / 2 - margin)), F.lit(height - visible / 2 + margin))
    centred = F.lit(height / 2) if height + 2 * margin <= visible else F.coalesce(inside, F.lit(height / 2))
    fits = bottom - top <= (1 - 2 * EDGE) * visible
    seen_top, seen_bottom = F.when(fits, top).otherwise(F.col("rects")[0]["y0"]), F.when(fits, bottom).otherwise(F.col("rects")[0]["y1"])
    reach = (0.5 - EDGE) * visible
    return parts.select("*", centred.alias("goal"), (F.coalesce(seen_bottom, F.lit(0.0)) - reach).alias("low"), (F.coalesce(seen_top, F.lit(0.0)) + reach).alias("high"))


def _timed(way: tuple[float, float], now: tuple[float, float], old: tuple[float, float], ends: float, starts: float, free_from: float) -> tuple[float, float]:
    """When a move begins and how long it takes: the next words must be in the picture when they are said.

    If the usual lead doesn't do, it begins early, though not while words still to be said would leave the picture; if the
    pause is too short for that, it is faster and lies in the middle of the pause.
    """
    a, b = way
    up = b < a

    def share(y: float, still: float) -> float:
        return still if abs(b - a) < 1e-9 else _time_of(min(max((y - a) / (b - a), 0.0), 1.0))

    comes = share(now[1] if up else now[0], 0.0)
    begin = max(starts - LEAD, free_from)
    if begin + comes * MOVE <= starts:
        return begin, MOVE
    leaves = share(old[0] if up else old[1], 1.0)
    begin = max(starts - comes * MOVE, ends - leaves * MOVE, free_from)
    if begin + comes * MOVE <= starts:
        return begin, MOVE
    needed = comes - leaves
    seconds = min(MOVE, max(FASTEST, (starts - ends) / needed)) if needed > 1e-6 else MOVE
    return max((ends + starts) / 2 - (comes + leaves) / 2 * seconds, free_from), seconds


def _moves(rows: pd.DataFrame, visible: float) -> Iterator[tuple[float, float, float, float]]:
    """t0, y_from, y_to, seconds of the moves over the parts of one run, in order."""
    last: tuple[float, float, float, float] | None = None
    ended, old = 0.0, (0.0, 0.0)
    for starts, ends, goal, low, high in zip(rows["start"], rows["end"], rows["goal"], rows["low"], rows["high"], strict=True):
        if last is None:
            last = (float(starts), goal, goal, 0.0)
            yield last
        else:
            stands = last[2]
            unseen = not low - SLACK <= stands <= high + SLACK and low <= goal <= high
            if abs(goal - stands) > DEAD_ZONE * visible or unseen:
                begin, seconds = _timed((stands, goal), (low, high), old, ended, starts, last[0] + APART)
                done = _ease((begin - last[0]) / last[3]) if last[3] > 0 else 1.0
                last = (begin, last[1] + (last[2] - last[1]) * done, goal, seconds)
                yield last
        ended, old = ends, (low, high)


def path(parts: DataFrame, keys: list[str], visible: float, height: float) -> DataFrame:
    """keys, k, t0, y_from, y_to, seconds: the camera's moves over the parts (start, end, rects) of a run of pages.

    Move 0 is where it stands when the first part begins. It moves when the next goal is outside the dead zone, or the words
    wouldn't be in the picture. Where it stands depends on its last move: a run of pages, a few minutes long, is one group.
    Parts without a start, an end or boxes are left out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    columns = ["t0", "y_from", "y_to", "seconds"]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "k int", *[f"{c} double" for c in columns]])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = list(_moves(rows.sort_values(["start", "end", "goal"], ignore_index=True), visible))
        return pd.DataFrame({c: rows[c].iloc[0] for c in keys} | {"k": range(len(found))} | {c: [m[i] for m in found] for i, c in enumerate(columns)})

    whole = parts.where(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.size("rects") > 0))
    return targets(whole, visible, height).select(*keys, "start", "end", "goal", "low", "high").groupBy(*keys).applyInPandas(run, schema)


def at(moves: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, k, y: the move that has begun last at each time t, and where the camera is in it.

    Before the first move it stands where that begins. An as-of join and the eased share of the move's way; times of keys
    without moves give nulls. Moves of one key that begin together: the one with the greatest k counts.
    """
    last = moves.groupBy(*keys, "t0").agg(F.max_by(F.struct("k", "y_from", "y_to", "seconds"), "k").alias("_m")).select(*keys, F.col("t0").alias("t"), F.col("t0").alias("_a"), "_m")
    first = moves.groupBy(*keys).agg(F.min_by("y_from", F.struct("t0", "k")).alias("_y"))
    found = as_of(last, times.select(*keys, "t", F.lit(0).alias("_p")), keys, "t", ["_a", "_m"], ["_p"])
    same = [found[c].eqNullSafe(first[c]) for c in keys]
    return found.join(first, same, "left").select(*[found[c] for c in keys], "t", F.col("_m.k").alias("k"), F.coalesce(place(F.col("t") - F.col("_a"), F.col("_m.y_from"), F.col("_m.y_to"), F.col("_m.seconds")), "_y").alias("y"))


def place(since: Column, y_from: Column, y_to: Column, seconds: Column) -> Column:
    """Where a move is ``since`` seconds after its beginning."""
    return F.when((seconds <= 0) | (since >= seconds), y_to).otherwise(y_from + (y_to - y_from) * smootherstep(since / seconds))


def joined_moves(moves: DataFrame, keys: list[str]) -> DataFrame:
    """``moves`` (k, y_to) with y_from: each begins where the one before ends, the first where it is."""
    return moves.withColumn("y_from", F.coalesce(F.lag("y_to").over(Window.partitionBy(*keys).orderBy("k")), "y_to"))
