"""Feedback events to training labels, retraining triggers, funnels and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import clamp, hash_bucket, percent, ratio
from .relational import since
from .scale import keep_first

# Label weights, completion bands and trigger thresholds.
CLICK_WEIGHT = 1.0
COMPLETION_BANDS = [(0.75, 3.0), (0.25, 1.5), (0.0, 0.5)]
LIKE_WEIGHT = 2.0
DISLIKE_WEIGHT = -1.0
NOT_INTERESTED_WEIGHT = -1.5
MIN_NEW_EVENTS = 10_000
CTR_DROP_THRESHOLD = 0.10

KEYS = ["user_id", "item_id", "recommendation_id"]


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def kind(name: str) -> Column:
    return F.col("event_type") == name


def feedback(name: str) -> Column:
    return kind("feedback") & (F.col("feedback_type") == name)


def signals() -> dict[str, Column]:
    """What one event says of its (user, item, recommendation); the interaction holds the maximum of each."""
    return {
        "has_click": _flag(kind("click")),
        "max_completion": F.when(kind("watch"), F.col("completion_rate")).otherwise(0.0),
        "has_like": _flag(feedback("like")),
        "has_dislike": _flag(feedback("dislike")),
        "has_not_interested": _flag(feedback("not_interested")),
        "explicit_rating": F.when(feedback("rating"), F.col("rating")),
        "is_synthetic": F.col("is_synthetic").cast("int"),
        "last_interaction": F.col("created_at"),
    }


def interactions(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One row per (user, item, recommendation) with a click in the last ``days`` days."""
    rolled = since(events, "created_at", as_of, days).groupBy(*KEYS).agg(*[F.max(c).alias(n) for n, c in signals().items()])
    return rolled.filter(F.col("has_click") == 1)


def engagement_label() -> Column:
    """Explicit rating, else the weighted sum of signals clipped to 0..5."""
    watched = F.lit(0.0)
    for bound, weight in reversed(COMPLETION_BANDS):
        watched = F.when(F.col("max_completion") > bound, weight).otherwise(watched)
    total = (
        F.col("has_click") * CLICK_WEIGHT
        + watched
        + F.col("has_like") * LIKE_WEIGHT
        + F.col("has_dislike") * DISLIKE_WEIGHT
        + F.col("has_not_interested") * NOT_INTERESTED_WEIGHT
    )
    return F.coalesce(F.col("explicit_rating"), clamp(total, 0.0, 5.0))


def with_label(rolled: DataFrame) -> DataFrame:
    return rolled.withColumn("label", engagement_label())


def label_rows(labelled: DataFrame, label_date: str) -> DataFrame:
    """One label per (user, item): the latest interaction, then the larger recommendation id."""
    one = keep_first(labelled, ["user_id", "item_id"], [F.desc("last_interaction"), F.desc("recommendation_id")])
    return one.withColumn("label_date", F.lit(label_date).cast("date"))


def build_labels(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return label_rows(with_label(interactions(events, as_of, days)), as_of)


# --- rates and funnels


def clicked_recommendations(logs: DataFrame, events: DataFrame, keep: list[str]) -> DataFrame:
    """The log with ``has_click``.

    Clicks shrink to one row per recommendation before the join: no fan-out, and later
    distinct counts become plain counts.
    """
    clicks = events.filter(kind("click")).groupBy("recommendation_id").agg(F.lit(1).alias("has_click"))
    return logs.select("recommendation_id", *keep).join(clicks, "recommendation_id", "left")


def ctr_by_version_day(logs: DataFrame, events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    recent = since(logs, "created_at", as_of, days)
    joined = clicked_recommendations(recent, events, ["model_version", "created_at"])
    out = joined.groupBy("model_version", F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("impressions"), F.count("has_click").alias("clicks")
    )
    return out.withColumn("ctr_percent", percent("clicks", "impressions"))


def engagement_funnel(logs: DataFrame, events: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Daily funnel; impressions come from the recommendation log."""
    shown = since(logs, "created_at", as_of, days).groupBy(F.to_date("created_at").alias("date")).agg(
        F.count(F.lit(1)).alias("impressions")
    )
    acts = since(events, "created_at", as_of, days).groupBy(F.to_date("created_at").alias("date")).agg(
        F.count_if(kind("click")).alias("clicks"),
        F.count_if(kind("watch")).alias("watches"),
        F.count_if(feedback("like")).alias("likes"),
    )
    both = acts.join(shown, "date", "full").na.fill(0)
    return both.select(
        "date", "impressions", "clicks", "watches", "likes",
        percent("clicks", "impressions").alias("ctr"), percent("watches", "clicks").alias("watch_rate"),
    )


def events_per_recommendation(events: DataFrame) -> DataFrame:
    return events.groupBy("recommendation_id").agg(
        F.count_if(kind("click")).alias("clicks"),
        F.count_if(kind("watch")).alias("watches"),
        F.count_if(feedback("like") | feedback("rating")).alias("positive_feedback"),
        F.count_if(kind("feedback")).alias("feedback"),
        F.sum(F.when(kind("watch"), F.col("completion_rate"))).alias("completion_sum"),
        F.count(F.when(kind("watch"), F.col("completion_rate"))).alias("completion_n"),
    )


def business_metrics(logs: DataFrame, events: DataFrame, as_of: str | None = None, days: int = 7) -> DataFrame:
    """Per version: recommendations, clicks, watches, positive feedback, completion, CTR and watch rate."""
    if as_of:
        logs = since(logs, "created_at", as_of, days)
    per = logs.select("recommendation_id", "model_version").join(events_per_recommendation(events), "recommendation_id", "left")
    mean_completion = ratio("completion_sum", "completion_n")
    out = per.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("total_recommendations"),
        F.count_if(F.col("clicks") > 0).alias("clicked_recommendations"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("total_clicks"),
        F.coalesce(F.sum("watches"), F.lit(0)).alias("total_watches"),
        F.coalesce(F.sum("positive_feedback"), F.lit(0)).alias("total_positive_feedback"),
        F.round(F.avg(mean_completion), 4).alias("avg_watch_completion"),
    )
    return out.select(
        "*",
        percent("clicked_recommendations", "total_recommendations").alias("ctr_percent"),
        percent("total_watches", "total_clicks").alias("watch_rate_percent"),
    )


def version_metrics(logs: DataFrame, events: DataFrame, labels: DataFrame) -> DataFrame:
    """Per version: click and watch rates by event count, completion, and the mean label of the touched pairs.

    Labels reduce to one row per pair, and events to one row per (recommendation, pair),
    so neither join repeats a label.
    """
    per = logs.select("recommendation_id", "model_version").join(events_per_recommendation(events), "recommendation_id", "left")
    counts = per.groupBy("model_version").agg(
        F.count(F.lit(1)).alias("impressions"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"),
        F.coalesce(F.sum("watches"), F.lit(0)).alias("watches"),
        F.coalesce(F.sum("feedback"), F.lit(0)).alias("feedback"),
        ratio(F.sum("completion_sum"), F.sum("completion_n")).alias("avg_watch_completion"),
    )
    pairs = events.select("recommendation_id", "user_id", "item_id").distinct()
    pair_labels = labels.groupBy("user_id", "item_id").agg(F.avg("label").alias("label"))
    scores = (
        logs.select("recommendation_id", "model_version")
        .join(pairs, "recommendation_id")
        .join(pair_labels, ["user_id", "item_id"])
        .groupBy("model_version")
        .agg(F.avg("label").alias("avg_engagement_score"))
    )
    return counts.join(scores, "model_version", "left").select(
        "model_version", "impressions", "clicks", "watches", "feedback",
        F.coalesce(ratio("clicks", "impressions") * 100, F.lit(0.0)).alias("ctr"),
        F.coalesce(ratio("watches", "clicks") * 100, F.lit(0.0)).alias("watch_rate"),
        (F.col("avg_watch_completion") * 100).alias("avg_watch_completion_pct"),
        "avg_engagement_score",
    )


# --- retraining triggers


def new_events_trigger(events: DataFrame, triggers: DataFrame, fallback: str, threshold: int = MIN_NEW_EVENTS) -> DataFrame:
    last = triggers.filter(F.col("training_status") == "success").agg(
        F.coalesce(F.max("created_at"), F.lit(fallback).cast("timestamp_ntz"))
    ).scalar()
    return events.filter(F.col("created_at") > last).agg(F.count(F.lit(1)).alias("new_events")).withColumn(
        "fired", F.col("new_events") >= threshold
    )


def ctr_drop_trigger(daily_ctr: DataFrame, as_of: str, threshold: float = CTR_DROP_THRESHOLD) -> DataFrame:
    """Mean of the last 7 days up to ``as_of`` against the 7 days before."""
    day, now = F.col("date"), F.lit(as_of).cast("date")
    recent = F.avg(F.when(day >= F.date_sub(now, 7), F.col("ctr_percent")))
    before = F.avg(F.when((day < F.date_sub(now, 7)) & (day >= F.date_sub(now, 14)), F.col("ctr_percent")))
    one = daily_ctr.filter((day >= F.date_sub(now, 14)) & (day <= now)).agg(recent.alias("recent_ctr"), before.alias("baseline_ctr"))
    drop = F.try_divide(F.col("baseline_ctr") - F.col("recent_ctr"), F.col("baseline_ctr"))
    return one.withColumn("ctr_drop", drop).withColumn("fired", F.coalesce(drop >= threshold, F.lit(False)))


def manual_trigger(triggers: DataFrame, as_of: str) -> DataFrame:
    pending = (F.col("trigger_type") == "manual") & (F.col("training_status") == "pending")
    return since(triggers.filter(pending), "created_at", as_of, 0).agg(F.count(F.lit(1)).alias("manual_requests")).withColumn(
        "fired", F.col("manual_requests") > 0
    )


def retraining_decision(new_events: DataFrame, ctr_drop: DataFrame, manual: DataFrame) -> DataFrame:
    """The first rule that fires decides; all three are evaluated in one job."""
    flags = new_events.select(
        F.col("fired").alias("by_events"),
        ctr_drop.select("fired").scalar().alias("by_ctr"),
        manual.select("fired").scalar().alias("by_request"),
    )
    reason = (
        F.when(F.col("by_events"), "new_events").when(F.col("by_ctr"), "ctr_drop").when(F.col("by_request"), "manual")
        .otherwise("none")
    )
    return flags.withColumn("reason", reason).withColumn(
        "decision", F.when(F.col("reason") == "none", "skip_training").otherwise("train_model")
    )


# --- synthetic data and audit


def cap_synthetic_share(df: DataFrame, keys: list[str], max_share: float = 0.8) -> DataFrame:
    """Keep real rows; thin synthetic rows by a key hash when their share exceeds ``max_share``."""
    stats = df.agg(F.count_if("is_synthetic").alias("s"), F.count_if(~F.col("is_synthetic")).alias("r"))
    allowed = F.when(
        F.col("s") > F.lit(max_share) * (F.col("s") + F.col("r")),
        F.floor(F.lit(1000.0) * F.col("r") * (max_share / (1 - max_share)) / F.col("s")),
    ).otherwise(1000)
    keep = stats.select(allowed.cast("bigint")).scalar()
    return df.filter(~F.col("is_synthetic") | (hash_bucket(keys, 1000) < keep))


def trigger_state(log: DataFrame, key: str = "run_id") -> DataFrame:
    """Current state per run out of an append-only log of status rows."""
    return keep_first(log, [key], [F.desc("created_at"), F.desc("trigger_id")])
