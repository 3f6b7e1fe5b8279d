"""Rates, quantiles, offsets and alerts over metric samples ``(ts, metric, instance, value)``.

A series is ``(metric, instance)``. Per-sample work runs in time chunks; rules run on an
evaluation grid, which bounds the rows per series by the time range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import ratio
from .scale import chunked_previous, exact_quantiles, volume_segments

SERIES = ["metric", "instance"]


def _epoch(c: str = "ts") -> Column:
    return F.unix_timestamp(c)


def _slot(seconds: int, c: str = "ts") -> Column:
    return F.floor(_epoch(c) / seconds).cast("bigint")


def counter_rate(
    samples: DataFrame, window_seconds: int, series: Sequence[str] = SERIES, chunk_seconds: int = 3600, segment_rows: int = 100_000,
) -> DataFrame:
    """Reset-aware increase and per-second rate per series and tumbling window.

    A drop counts from 0 again. Nothing is extrapolated to window borders. Samples without a time
    have no place in a series and are left out.

    A segment's summary (first value, last value, increase inside) merges with the next one's, so
    only summaries cross between tasks. Segments are bounded by volume, not by time: one holds at
    most ``segment_rows`` samples and those of one more second.
    """
    cut = samples.filter(F.col("ts").isNotNull()).withColumns({"slot": _slot(window_seconds), "_chunk": _slot(chunk_seconds)})
    cut = volume_segments(cut, [*series, "slot", "_chunk"], _epoch(), segment_rows, "_segment")
    key = [*series, "slot", "_chunk", "_segment"]
    inside = W.partitionBy(*key).orderBy("ts", "event_id")
    at = F.struct("ts", "event_id")
    step = F.when(F.row_number().over(inside) > 1, _rise(F.lag("value").over(inside), F.col("value")))
    summaries = cut.withColumn("_step", step).groupBy(*key).agg(
        F.min(at).alias("_at"), F.min_by("value", at).alias("_first"), F.max_by("value", at).alias("_last"), F.sum("_step").alias("_inner"),
    )
    # the steps between segments: a scan over summaries, days of them at a time
    met = chunked_previous(summaries.withColumn("_day", _slot(86400, "_at.ts")), series, ["_at"], "_day", ["_last"])
    joint = _rise(F.col("prev__last"), F.col("_first"))
    either = F.coalesce(joint + F.col("_inner"), joint, F.col("_inner"))
    out = met.groupBy(*series, "slot").agg(F.sum(either).alias("increase"))
    return out.withColumn("rate", F.col("increase") / window_seconds)


def _rise(before: Column, now: Column) -> Column:
    """The first sample of a series, and one after a null, rises by 0; a null has no rise."""
    return F.when(before.isNull(), 0.0).when(now < before, now).otherwise(now - before)


def cumulative_buckets(samples: DataFrame, bounds: Sequence[float], series: Sequence[str]) -> DataFrame:
    """Histogram rows ``(series, le, count)`` with cumulative counts; the last bound is infinite."""
    totals = samples.groupBy(*series).agg(
        *[F.count_if(F.col("value") <= b).alias(f"_b{i}") for i, b in enumerate(bounds)], F.count("value").alias("_all")
    )
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("count")) for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("count")))
    return totals.select(*series, F.inline(F.array(*cells)))


def histogram_quantile(buckets: DataFrame, q: float, series: Sequence[str]) -> DataFrame:
    """Quantile by linear interpolation inside the first bucket that reaches the rank.

    A rank in the infinite bucket gives the highest finite bound. A series has as many rows
    as buckets, so the window stays small.
    """
    w = W.partitionBy(*series).orderBy("le")
    rows = buckets.select(
        *series, "le", "count",
        F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("low"),
        F.coalesce(F.lag("count").over(w), F.lit(0)).alias("below"),
        F.max("count").over(W.partitionBy(*series)).alias("total"),
    )
    rank = F.col("total") * q
    inside = F.col("low") + (F.col("le") - F.col("low")) * F.try_divide(rank - F.col("below"), (F.col("count") - F.col("below")).cast("double"))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside)
    hit = (F.col("count") >= rank) & ((F.col("below") < rank) | (F.col("below") == 0))
    return rows.filter(hit & (F.col("total") > 0)).groupBy(*series).agg(F.min_by(value, "le").alias("quantile"))


def ratio_of_rates(samples: DataFrame, part: Column, window_seconds: int) -> DataFrame:
    """Share of the events matching ``part`` per window, both sides in one pass."""
    return samples.groupBy(_slot(window_seconds).alias("slot")).agg(
        F.count_if(part).alias("part"), F.count(F.lit(1)).alias("total")
    ).withColumn("ratio", ratio("part", "total"))


def avg_over_time(samples: DataFrame, window_seconds: int, series: Sequence[str] = SERIES, chunk_seconds: int = 86400) -> DataFrame:
    """Trailing mean per sample over ``window_seconds``, both ends included.

    Samples shrink to a sum and a count per second first, so the rows of a task are bounded by
    seconds. The timeline is cut into blocks as long as the frame: a frame is then the end of one
    block and the start of the next, and both come from running totals inside a block. Nothing is
    subtracted, so nothing cancels. Nulls take no part; samples without a time are left out.
    ``chunk_seconds`` is the most that a block may cover; a longer window is refused.
    """
    if chunk_seconds < window_seconds:
        raise ValueError("a chunk must cover at least one window")
    length = window_seconds + 1
    timed = samples.filter(F.col("ts").isNotNull()).withColumn("_t", _epoch())
    seconds = timed.groupBy(*series, "_t").agg(F.sum("value").alias("_s"), F.count("value").alias("_n"))
    block = F.floor(F.col("_at") / length).cast("bigint")
    real = seconds.withColumns({"_at": F.col("_t"), "_ask": F.lit(False)})
    # where the frame of a second opens, unless that is the start of the second's own block
    asks = seconds.select(*series, "_t", F.lit(0.0).alias("_s"), F.lit(0).cast("bigint").alias("_n"), (F.col("_t") - window_seconds).alias("_at"), F.lit(True).alias("_ask"))
    asks = asks.filter(F.pmod("_t", F.lit(length)) != length - 1)
    rows = real.unionByName(asks).withColumn("_block", block)
    upto = W.partitionBy(*series, "_block").orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    onward = W.partitionBy(*series, "_block").orderBy(F.desc("_at")).rangeBetween(W.unboundedPreceding, 0)
    parts = rows.select(
        *series, "_t",
        *[F.when(F.col("_ask"), F.sum(c).over(onward)).otherwise(F.sum(c).over(upto)).alias(c) for c in ("_s", "_n")],
    )
    means = parts.groupBy(*series, "_t").agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias("avg_value"))
    means = means.select("avg_value", *[F.col(c).alias(f"_m{i}") for i, c in enumerate([*series, "_t"])])
    same = [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate([*series, "_t"])]
    return timed.join(means, reduce(lambda a, b: a & b, same)).select(*samples.columns, "avg_value")


def delta_over_window(samples: DataFrame, window_seconds: int, series: Sequence[str] = SERIES) -> DataFrame:
    """Last minus first value per series and tumbling window."""
    at = F.struct("ts", "event_id")
    return samples.groupBy(*series, _slot(window_seconds).alias("slot")).agg(
        (F.max_by("value", at) - F.min_by("value", at)).alias("delta")
    )


def grid(samples: DataFrame, step_seconds: int, series: Sequence[str] = SERIES) -> DataFrame:
    """Mean per series on an evaluation grid: ``t`` is the start of a step in epoch seconds."""
    return samples.groupBy(*series, (_slot(step_seconds) * step_seconds).alias("t")).agg(F.avg("value").alias("value"))


def change_against_offset(points: DataFrame, offset_seconds: int, series: Sequence[str] = SERIES) -> DataFrame:
    """Relative change against the latest grid point at or before ``t - offset``."""
    earlier = W.partitionBy(*series).orderBy("t").rangeBetween(W.unboundedPreceding, -offset_seconds)
    before = F.last("value").over(earlier)
    return points.withColumn("before", before).withColumn("change", F.try_divide(F.col("value") - F.col("before"), F.col("before")))


def held_alerts(points: DataFrame, breach: Column, step_seconds: int, hold_seconds: int, series: Sequence[str] = SERIES, max_gap_steps: int = 2) -> DataFrame:
    """Episodes in which ``breach`` held for at least ``hold_seconds``.

    Consecutive breaching grid points form an island; a calm point or a gap of more than
    ``max_gap_steps`` steps ends it.
    """
    w = W.partitionBy(*series).orderBy("t")
    marked = points.withColumn("_b", F.coalesce(breach, F.lit(False)))
    prev_b, prev_t = F.lag("_b").over(w), F.lag("t").over(w)
    starts = F.col("_b") & (F.coalesce(~prev_b, F.lit(True)) | (F.col("t") - prev_t > max_gap_steps * step_seconds))
    islands = marked.withColumn("_s", starts.cast("int")).withColumn("_island", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = islands.filter("_b").groupBy(*series, "_island").agg(
        F.min("t").alias("started"), F.max("t").alias("last_seen"), F.max("value").alias("peak")
    )
    return out.filter(F.col("last_seen") - F.col("started") >= hold_seconds).drop("_island")


def missing_percent(df: DataFrame, column: str, by: str) -> DataFrame:
    return df.groupBy(by).agg((ratio(F.count_if(F.col(column).isNull()), F.count(F.lit(1))) * 100).alias("missing_percent"))


def outlier_percent(samples: DataFrame, by: str, value: str = "value", spread: float = 1.5) -> DataFrame:
    """Share of values beyond 1.5 interquartile ranges, per group."""
    quartiles = exact_quantiles(samples, [by], value, {"q1": 0.25, "q3": 0.75}, few_keys=True)
    iqr = F.col("q3") - F.col("q1")
    outside = (F.col(value) < F.col("q1") - spread * iqr) | (F.col(value) > F.col("q3") + spread * iqr)
    # one row per metric name
    return samples.join(F.broadcast(quartiles), by).groupBy(by).agg(
        (ratio(F.count_if(outside), F.count(value)) * 100).alias("outlier_percent")
    )


def band(value: Column, yellow: float, red: float) -> Column:
    return F.when(value >= red, "red").when(value >= yellow, "yellow").otherwise("green")
