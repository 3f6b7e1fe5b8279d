"""Streaming queries: the events table drained as a stream into exactly-once tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..session import scratch
from ..sources import keyed_log, snapshots
from ..streaming import intake as it
from ..streaming import jobs
from ..tables import AS_OF, bind_events, bind_raw_events
from .registry import query


def source(t):
    # a glob matches the table both as one file and as a folder of parts
    return jobs.parquet_stream(t.spark, f"{t.path}/{{events}}.parquet", t.raw("events").schema)


def raw_stream(t):
    return bind_raw_events(source(t))


@query("x01_typed_intake", "SELECT event_id, reasons FROM checked_events")
def typed_intake(t):
    out = it.checked(raw_stream(t)).select("event_id", F.concat_ws(",", "reasons").alias("reasons"))
    return jobs.run_to_table(out, scratch(t.spark, "intake"))


@query("x02_route_by_type", """
SELECT event_id, CASE WHEN reasons <> '' THEN 'quarantine' WHEN event_type = 'impression' THEN 'impressions' ELSE 'events' END AS route FROM checked_events""")
def route(t):
    return jobs.run_to_table(it.routed(raw_stream(t)).select("event_id", "route"), scratch(t.spark, "routed"), ["route"])


@query("x03_idempotent_impressions", "SELECT DISTINCT recommendation_id FROM raw_events WHERE event_type = 'impression' AND NOT is_synthetic")
def impressions(t):
    """The stored log holds the synthetic impressions already; an id that comes again, at any time, is not inserted."""
    log = scratch(t.spark, "impressions")
    keyed_log.insert(t.spark, log, t.recommendation_logs.filter("is_synthetic").select("recommendation_id", "is_synthetic"), ["recommendation_id"])
    shown = raw_stream(t).filter("event_type = 'impression' AND recommendation_id IS NOT NULL").select("recommendation_id", "is_synthetic")
    table = jobs.run_to_inserts(shown, log, ["recommendation_id"])
    return table.filter("NOT is_synthetic").select("recommendation_id")


@query("x04_enrichment", """
SELECT event_id, round(CASE WHEN event_type = 'watch' THEN CASE WHEN total_duration_seconds > 0 THEN CAST(watch_duration_seconds AS DOUBLE) / total_duration_seconds ELSE 0 END END, 6) AS completion_rate
FROM raw_events""")
def enrichment(t):
    out = it.enriched(raw_stream(t)).select("event_id", r6("completion_rate").alias("completion_rate"))
    return jobs.run_to_table(out, scratch(t.spark, "enriched"))


@query("x05_watched_over_total", "SELECT event_id, watch_duration_seconds, total_duration_seconds FROM raw_events WHERE event_type = 'watch' AND watch_duration_seconds > total_duration_seconds")
def over_total(t):
    out = it.enriched(raw_stream(t)).filter("watched_over_total").select("event_id", "watch_duration_seconds", "total_duration_seconds")
    return jobs.run_to_table(out, scratch(t.spark, "over_total"))


@query("x06_windowed_counts", """
SELECT date_trunc('minute', "timestamp") AS window_start, event_type, is_synthetic, count(*) AS n FROM raw_events GROUP BY 1, 2, 3""")
def windowed(t):
    counts = it.counts_per_window(raw_stream(t)).withColumn("window_date", F.to_date("window_start"))
    return jobs.run_to_upserts(counts, scratch(t.spark, "windowed"), ["window_start", "event_type", "is_synthetic", "window_date"], "window_date").drop("window_date")


@query("x07_sliding_rates", """
WITH w AS (SELECT epoch_ms(CAST((floor(epoch("timestamp") / 900) - unnest([0, 1, 2, 3])) * 900000 AS BIGINT)) AS window_start, event_type FROM raw_events)
SELECT window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'impression') AS impressions,
    round(count(*) FILTER (WHERE event_type = 'click') / nullif(CAST(count(*) FILTER (WHERE event_type = 'impression') AS DOUBLE), 0), 6) AS ctr
FROM w GROUP BY 1""")
def sliding(t):
    rates = it.sliding_ctr(raw_stream(t)).withColumns({"ctr": r6("ctr"), "window_date": F.to_date("window_start")})
    return jobs.run_to_upserts(rates, scratch(t.spark, "sliding"), ["window_start", "window_date"], "window_date").drop("window_date")


@query("x08_incremental_labels", "SELECT user_id, item_id, label, recommendation_id, label_date FROM training_labels")
def labels(t):
    base = scratch(t.spark, "labels")
    jobs.refresh_labels(bind_events(source(t)), f"{base}/labels", AS_OF)
    return snapshots.read(t.spark, f"{base}/labels").select("user_id", "item_id", "label", "recommendation_id", "label_date")
