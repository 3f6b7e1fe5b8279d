"""Monitoring queries over the bound metric samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import monitoring as mo
from .registry import query

HOUR, DAY = 3600, 86400
# Means of two-decimal values are compared at 9 digits: at 6, sums taken in another order
# can fall on either side of an exact half.
BOUNDS = [5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0]


@query("m01_counter_rate", f"""
SELECT metric, instance, CAST(floor(epoch(ts) / {DAY}) AS BIGINT) AS slot, round(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END), 6) AS increase,
    round(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) / {DAY}, 9) AS rate FROM (
    SELECT *, lag(value) OVER (PARTITION BY metric, instance ORDER BY ts, event_id) AS prev FROM metric_samples) GROUP BY 1, 2, 3""")
def rate(t):
    out = mo.counter_rate(t.metric_samples, DAY)
    return out.withColumn("increase", r6("increase")).withColumn("rate", F.round("rate", 9))


@query("m02_histogram_quantile", f"""
WITH b AS (SELECT metric, unnest([{', '.join(f'CAST({b} AS DOUBLE)' for b in BOUNDS)}, CAST('inf' AS DOUBLE)]) AS le, unnest([{', '.join(f'count(*) FILTER (WHERE value <= {b})' for b in BOUNDS)}, count(*)]) AS n
    FROM metric_samples GROUP BY metric),
w AS (SELECT *, coalesce(lag(le) OVER o, 0) AS low, coalesce(lag(n) OVER o, 0) AS below, max(n) OVER (PARTITION BY metric) AS total FROM b WINDOW o AS (PARTITION BY metric ORDER BY le))
SELECT metric, round(arg_min(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * ((total * CAST(0.95 AS DOUBLE) - below) / (n - below)) END, le), 6) AS quantile
FROM w WHERE n >= total * CAST(0.95 AS DOUBLE) GROUP BY 1""")
def histogram(t):
    buckets = mo.cumulative_buckets(t.metric_samples, BOUNDS, ["metric"])
    return mo.histogram_quantile(buckets, 0.95, ["metric"]).withColumn("quantile", r6("quantile"))


@query("m03_ratio_of_rates", f"""
SELECT CAST(floor(epoch(ts) / {HOUR}) AS BIGINT) AS slot, count(*) FILTER (WHERE metric = 'error') AS part, count(*) AS total,
    round(count(*) FILTER (WHERE metric = 'error') / CAST(count(*) AS DOUBLE), 6) AS ratio FROM metric_samples GROUP BY 1""")
def ratios(t):
    return mo.ratio_of_rates(t.metric_samples, F.col("metric") == "error", HOUR).withColumn("ratio", r6("ratio"))


@query("m04_avg_over_time", f"""
SELECT event_id, metric, instance, round(avg(value) OVER (PARTITION BY metric, instance ORDER BY CAST(floor(epoch(ts)) AS BIGINT)
    RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW), 9) AS avg_value FROM metric_samples""")
def avg_over_time(t):
    return mo.avg_over_time(t.metric_samples, 6 * HOUR).select("event_id", "metric", "instance", F.round("avg_value", 9).alias("avg_value"))


@query("m04_delta", f"""
SELECT metric, instance, CAST(floor(epoch(ts) / {DAY}) AS BIGINT) AS slot, round(last(value ORDER BY ts, event_id) - first(value ORDER BY ts, event_id), 6) AS delta
FROM metric_samples GROUP BY 1, 2, 3""")
def delta(t):
    return mo.delta_over_window(t.metric_samples, DAY).withColumn("delta", r6("delta"))


GRID = f"""g AS (SELECT metric, instance, CAST(floor(epoch(ts) / {HOUR}) AS BIGINT) * {HOUR} AS t, avg(value) AS value FROM metric_samples GROUP BY 1, 2, 3)"""


@query("m05_change_against_24h", f"""
WITH {GRID}, o AS (SELECT *, last(value) OVER (PARTITION BY metric, instance ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {DAY} PRECEDING) AS before FROM g)
SELECT metric, instance, t, round(value, 9) AS value, round(before, 9) AS before, round((value - before) / before, 9) AS change,
    coalesce((value - before) / before > 0.1, false) AS degraded FROM o""")
def change(t):
    out = mo.change_against_offset(mo.grid(t.metric_samples, HOUR), DAY)
    return out.withColumn("degraded", F.coalesce(F.col("change") > 0.1, F.lit(False))).withColumns({c: F.round(c, 9) for c in ("value", "before", "change")})


@query("m06_held_alerts", f"""
WITH {GRID}, s AS (SELECT *, value > 40 AS b, lag(value > 40) OVER o AS pb, lag(t) OVER o AS pt FROM g WINDOW o AS (PARTITION BY metric, instance ORDER BY t)),
i AS (SELECT *, sum(CASE WHEN b AND (pb IS NULL OR NOT pb OR t - pt > {2 * HOUR}) THEN 1 ELSE 0 END) OVER (PARTITION BY metric, instance ORDER BY t) AS island FROM s)
SELECT metric, instance, min(t) AS started, max(t) AS last_seen, round(max(value), 9) AS peak, 'warning' AS severity FROM i WHERE b GROUP BY metric, instance, island
HAVING max(t) - min(t) >= {2 * HOUR}""")
def alerts(t):
    out = mo.held_alerts(mo.grid(t.metric_samples, HOUR), F.col("value") > 40, HOUR, 2 * HOUR)
    return out.withColumn("peak", F.round("peak", 9)).withColumn("severity", F.lit("warning"))


@query("m07_missing_percent", """
SELECT event_type, round(count(*) FILTER (WHERE rating IS NULL) / CAST(count(*) AS DOUBLE) * 100, 6) AS missing_percent,
    count(*) FILTER (WHERE rating IS NULL) / CAST(count(*) AS DOUBLE) * 100 > 10 AS alert FROM user_events GROUP BY 1""")
def missing(t):
    out = mo.missing_percent(t.user_events, "rating", "event_type")
    return out.withColumn("alert", F.col("missing_percent") > 10).withColumn("missing_percent", r6("missing_percent"))


@query("m07_outlier_percent", """
WITH q AS (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM metric_samples GROUP BY 1)
SELECT metric, round(count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / CAST(count(*) AS DOUBLE) * 100, 6) AS outlier_percent
FROM metric_samples JOIN q USING (metric) GROUP BY 1""")
def outliers(t):
    return mo.outlier_percent(t.metric_samples, "metric").withColumn("outlier_percent", r6("outlier_percent"))


@query("m09_threshold_bands", f"""
SELECT slot, round(r, 6) AS ratio, CASE WHEN r >= 0.3 THEN 'red' WHEN r >= 0.2 THEN 'yellow' ELSE 'green' END AS band FROM (
    SELECT CAST(floor(epoch(ts) / {HOUR}) AS BIGINT) AS slot, count(*) FILTER (WHERE metric = 'error') / CAST(count(*) AS DOUBLE) AS r FROM metric_samples GROUP BY 1)""")
def bands(t):
    out = mo.ratio_of_rates(t.metric_samples, F.col("metric") == "error", HOUR)
    return out.select("slot", r6("ratio").alias("ratio"), mo.band(F.col("ratio"), 0.2, 0.3).alias("band"))
