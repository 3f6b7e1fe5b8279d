"""Event intake: validation, routing, enrichment, deduplication, windowed rates.

Every function here is ``DataFrame -> DataFrame`` and works on a batch and on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import ratio

# The accepted event and feedback types.
EVENT_TYPES = ["impression", "click", "watch", "feedback"]
FEEDBACK_TYPES = ["like", "dislike", "not_interested", "rating"]


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def intake_rules() -> dict[str, Column]:
    """Name of each rule and the condition that breaks it; NULL counts as not broken."""
    need_item = F.col("event_type").isin("click", "watch", "feedback")
    return {
        "unknown_type": F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES),
        "user_missing": F.col("user_id").isNull(),
        "item_missing": need_item & F.col("item_id").isNull(),
        "items_empty": _is("impression") & (F.coalesce(F.size("item_ids"), F.lit(0)) < 1),
        "recommendation_missing": _is("impression") & F.col("recommendation_id").isNull(),
        "model_missing": _is("impression") & (F.col("model_name").isNull() | F.col("model_version").isNull()),
        "position_invalid": _is("click") & (F.col("position").isNull() | (F.col("position") < 0)),
        "duration_invalid": _is("watch") & (F.col("watch_duration_seconds").isNull() | (F.col("watch_duration_seconds") < 0)),
        "total_invalid": _is("watch") & (F.col("total_duration_seconds").isNull() | (F.col("total_duration_seconds") <= 0)),
        "feedback_unknown": _is("feedback") & (F.col("feedback_type").isNull() | ~F.col("feedback_type").isin(*FEEDBACK_TYPES)),
        "rating_out_of_range": _is("feedback") & ((F.col("rating") < 0) | (F.col("rating") > 5)),
    }


def checked(events: DataFrame) -> DataFrame:
    """Add ``reasons``: the broken rules, empty for a valid event."""
    hits = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in intake_rules().items()]
    return events.withColumn("reasons", F.array_compact(F.array(*hits)))


def routed(events: DataFrame) -> DataFrame:
    """Add ``route``: quarantine, impressions, or events."""
    route = F.when(F.size("reasons") > 0, "quarantine").when(_is("impression"), "impressions").otherwise("events")
    return checked(events).withColumn("route", route)


def enriched(events: DataFrame) -> DataFrame:
    """Defaults per type, the completion rate of a watch, and a flag for watching longer than the total."""
    watched = F.coalesce(F.col("watch_duration_seconds"), F.lit(0))
    total = F.coalesce(F.col("total_duration_seconds"), F.lit(1))
    completion = F.when(total > 0, watched.cast("double") / total).otherwise(0.0)
    return events.withColumns({
        "is_synthetic": F.coalesce("is_synthetic", F.lit(False)),
        "watch_duration_seconds": F.when(_is("watch"), watched),
        "total_duration_seconds": F.when(_is("watch"), total),
        "completion_rate": F.when(_is("watch"), completion),
        "watched_over_total": F.coalesce(_is("watch") & (watched > total), F.lit(False)),
    })


def counts_per_window(events: DataFrame, window: str = "1 minute", delay: str = "1 hour") -> DataFrame:
    """Events by type and synthetic flag in tumbling windows."""
    timed = events.withWatermark("timestamp", delay)
    return timed.groupBy(F.window("timestamp", window), "event_type", "is_synthetic").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("window_start"), "event_type", "is_synthetic", "n"
    )


def sliding_ctr(events: DataFrame, window: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """Event count, clicks, impressions and their ratio in sliding windows."""
    timed = events.withWatermark("timestamp", delay)
    return timed.groupBy(F.window("timestamp", window, slide)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(_is("click")).alias("clicks"), F.count_if(_is("impression")).alias("impressions")
    ).select(
        F.col("window.start").alias("window_start"), "n", "clicks", "impressions", ratio("clicks", "impressions").alias("ctr"),
    )
