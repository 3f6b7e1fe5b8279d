"""Feedback-loop queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import percent, r6
from ..operators import feedback as fb
from ..operators import relational as rel
from ..tables import AS_OF
from .registry import query


def training_labels(t):
    return fb.build_labels(t.user_events, AS_OF)


@query("l01_event_rollup", "SELECT * FROM interactions")
def rollup(t):
    return fb.interactions(t.user_events, AS_OF)


@query("l02_engagement_label", "SELECT user_id, item_id, recommendation_id, label FROM labelled")
def label(t):
    return fb.with_label(fb.interactions(t.user_events, AS_OF)).select("user_id", "item_id", "recommendation_id", "label")


@query("l03_label_upsert", """
WITH old AS (SELECT user_id, item_id, label, last_interaction, recommendation_id FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY last_interaction DESC, recommendation_id DESC) AS rn
        FROM labelled WHERE last_interaction < TIMESTAMP '2024-01-20') WHERE rn = 1),
new AS (SELECT user_id, item_id, label, last_interaction, recommendation_id FROM training_labels)
SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.item_id, o.item_id) AS item_id, coalesce(n.label, o.label) AS label,
    coalesce(n.recommendation_id, o.recommendation_id) AS recommendation_id, o.user_id IS NOT NULL AND n.user_id IS NOT NULL AS updated
FROM new n FULL JOIN old o ON n.user_id = o.user_id AND n.item_id = o.item_id""")
def label_upsert(t):
    from ..sources.sinks import merge_rows

    labelled = fb.with_label(fb.interactions(t.user_events, AS_OF))
    cols = ["user_id", "item_id", "label", "recommendation_id"]
    before = F.col("last_interaction") < F.lit("2024-01-20").cast("timestamp_ntz")
    old = fb.label_rows(labelled.filter(before), AS_OF).select(*cols)
    return merge_rows(old, fb.label_rows(labelled, AS_OF).select(*cols), ["user_id", "item_id"])


LABEL_BUCKET = """CAST('0x' || substr(md5('42|' || CAST(user_id AS VARCHAR) || '|' || CAST(item_id AS VARCHAR)), 1, 8) AS BIGINT) % 100"""


@query("l04_label_split_stats", f"""
SELECT CASE WHEN {LABEL_BUCKET} < 20 THEN 'test' ELSE 'train' END AS split, count(*) AS n,
    round(avg(is_synthetic), 6) AS synthetic_ratio, round(avg(label), 6) AS mean_label FROM training_labels GROUP BY 1""")
def label_stats(t):
    parts = rel.train_test_split(training_labels(t), ["user_id", "item_id"])
    return parts.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("is_synthetic")).alias("synthetic_ratio"), r6(F.avg("label")).alias("mean_label")
    )


NEW_EVENTS = """SELECT count(*) AS new_events, count(*) >= 10000 AS fired FROM user_events WHERE created_at > (
    SELECT coalesce(max(created_at), TIMESTAMP '2024-01-01') FROM retraining_triggers WHERE training_status = 'success')"""


def new_events(t):
    return fb.new_events_trigger(t.user_events, t.retraining_triggers, "2024-01-01")


query("l05_new_events_trigger", NEW_EVENTS)(new_events)

# the log holds one row per recommendation, so a click is a membership test
SHOWN = """(SELECT model_version, CAST(created_at AS DATE) AS "date",
    recommendation_id IN (SELECT recommendation_id FROM user_events WHERE event_type = 'click') AS clicked
    FROM recommendation_logs WHERE created_at >= DATE '2024-01-31' - INTERVAL {days} DAY)"""
CTR_COLUMNS = """count(*) AS impressions, count(*) FILTER (WHERE clicked) AS clicks,
    round(count(*) FILTER (WHERE clicked) / CAST(count(*) AS DOUBLE) * 100, 2) AS ctr_percent"""
DAILY = f"""SELECT model_version, "date", {CTR_COLUMNS} FROM {SHOWN.format(days=30)} GROUP BY 1, 2"""

CTR_DROP = f"""SELECT round(recent_ctr, 6) AS recent_ctr, round(baseline_ctr, 6) AS baseline_ctr,
    round((baseline_ctr - recent_ctr) / baseline_ctr, 6) AS ctr_drop, coalesce((baseline_ctr - recent_ctr) / baseline_ctr >= 0.1, false) AS fired
    FROM (SELECT avg(CASE WHEN "date" >= DATE '2024-01-24' THEN ctr_percent END) AS recent_ctr,
        avg(CASE WHEN "date" < DATE '2024-01-24' AND "date" >= DATE '2024-01-17' THEN ctr_percent END) AS baseline_ctr
        FROM ({DAILY}) WHERE "date" >= DATE '2024-01-17')"""


def daily_ctr(t):
    return fb.ctr_by_version_day(t.recommendation_logs, t.user_events, AS_OF)


def ctr_drop(t):
    return fb.ctr_drop_trigger(daily_ctr(t), AS_OF)


@query("l06_ctr_drop_trigger", CTR_DROP)
def ctr_drop_query(t):
    return ctr_drop(t).withColumns({c: r6(c) for c in ("recent_ctr", "baseline_ctr", "ctr_drop")})


MANUAL_DAY = "2024-01-30"
MANUAL = """SELECT count(*) AS manual_requests, count(*) > 0 AS fired FROM retraining_triggers
    WHERE trigger_type = 'manual' AND training_status = 'pending' AND created_at >= DATE '2024-01-30'"""


@query("l07_retraining_decision", f"""
SELECT e.fired AS by_events, c.fired AS by_ctr, m.fired AS by_request,
    CASE WHEN e.fired THEN 'new_events' WHEN c.fired THEN 'ctr_drop' WHEN m.fired THEN 'manual' ELSE 'none' END AS reason,
    CASE WHEN e.fired OR c.fired OR m.fired THEN 'train_model' ELSE 'skip_training' END AS decision
FROM ({NEW_EVENTS}) e, ({CTR_DROP}) c, ({MANUAL}) m""")
def decision(t):
    return fb.retraining_decision(new_events(t), ctr_drop(t), fb.manual_trigger(t.retraining_triggers, MANUAL_DAY))


query("l10_ctr_by_version_day", DAILY)(daily_ctr)


@query("l11_engagement_funnel", """
WITH i AS (SELECT CAST(created_at AS DATE) AS "date", count(*) AS impressions FROM recommendation_logs
    WHERE created_at >= DATE '2024-01-31' - INTERVAL 7 DAY GROUP BY 1),
a AS (SELECT CAST(created_at AS DATE) AS "date", count(*) FILTER (WHERE event_type = 'click') AS clicks,
    count(*) FILTER (WHERE event_type = 'watch') AS watches, count(*) FILTER (WHERE feedback_type = 'like') AS likes
    FROM user_events WHERE created_at >= DATE '2024-01-31' - INTERVAL 7 DAY GROUP BY 1)
SELECT "date", coalesce(impressions, 0) AS impressions, clicks, watches, likes,
    round(CAST(clicks AS DOUBLE) / nullif(coalesce(impressions, 0), 0) * 100, 2) AS ctr,
    round(CAST(watches AS DOUBLE) / nullif(clicks, 0) * 100, 2) AS watch_rate FROM a FULL JOIN i USING ("date")""")
def funnel(t):
    return fb.engagement_funnel(t.recommendation_logs, t.user_events, AS_OF)


METRICS = """WITH acts AS (SELECT recommendation_id, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'watch') AS w,
    count(*) FILTER (WHERE feedback_type IN ('like', 'rating')) AS f, avg(completion_rate) AS done FROM user_events GROUP BY 1),
metrics AS (SELECT model_version, count(*) AS total_recommendations, count(*) FILTER (WHERE c > 0) AS clicked_recommendations,
    CAST(sum(c) AS BIGINT) AS total_clicks, CAST(sum(w) AS BIGINT) AS total_watches, CAST(sum(f) AS BIGINT) AS total_positive_feedback,
    round(avg(done), 4) AS avg_watch_completion, round(count(*) FILTER (WHERE c > 0) / CAST(count(*) AS DOUBLE) * 100, 2) AS ctr_percent,
    round(CAST(sum(w) AS DOUBLE) / nullif(sum(c), 0) * 100, 2) AS watch_rate_percent
    FROM recommendation_logs LEFT JOIN acts USING (recommendation_id) WHERE created_at >= DATE '2024-01-31' - INTERVAL 7 DAY GROUP BY 1)
"""


@query("l12_business_metrics", METRICS + "SELECT * FROM metrics")
def business(t):
    return fb.business_metrics(t.recommendation_logs, t.user_events, AS_OF, 7)


VERSION_METRICS = """WITH acts AS (SELECT recommendation_id, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'watch') AS w,
    count(*) FILTER (WHERE event_type = 'feedback') AS f, sum(completion_rate) AS total, count(completion_rate) AS n FROM user_events GROUP BY 1),
c AS (SELECT model_version, count(*) AS impressions, CAST(sum(c) AS BIGINT) AS clicks, CAST(sum(w) AS BIGINT) AS watches, CAST(sum(f) AS BIGINT) AS feedback,
    sum(total) / sum(n) AS completion FROM recommendation_logs LEFT JOIN acts USING (recommendation_id) GROUP BY 1),
l AS (SELECT model_version, avg(label) AS score FROM (SELECT DISTINCT r.model_version, r.recommendation_id, e.user_id, e.item_id
    FROM recommendation_logs r JOIN user_events e USING (recommendation_id)) JOIN training_labels USING (user_id, item_id) GROUP BY 1)
"""


@query("l13_version_metrics", VERSION_METRICS + """
SELECT model_version, impressions, clicks, watches, feedback, round(CAST(clicks AS DOUBLE) / impressions * 100, 6) AS ctr,
    round(CAST(watches AS DOUBLE) / clicks * 100, 6) AS watch_rate, round(completion * 100, 6) AS avg_watch_completion_pct,
    round(score, 6) AS avg_engagement_score FROM c LEFT JOIN l USING (model_version)""")
def version_metrics(t):
    out = fb.version_metrics(t.recommendation_logs, t.user_events, training_labels(t))
    return out.withColumns({c: r6(c) for c in ("ctr", "watch_rate", "avg_watch_completion_pct", "avg_engagement_score")})


@query("l20_synthetic_policy", """
SELECT is_synthetic, count(*) AS n FROM user_events WHERE NOT is_synthetic
    OR CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000 < (
        SELECT CASE WHEN s > 0.1 * (s + r) THEN CAST(floor(CAST(1000 AS DOUBLE) * r * (CAST(0.1 AS DOUBLE) / (1 - CAST(0.1 AS DOUBLE))) / s) AS BIGINT) ELSE 1000 END
        FROM (SELECT count(*) FILTER (WHERE is_synthetic) AS s, count(*) FILTER (WHERE NOT is_synthetic) AS r FROM user_events))
GROUP BY 1""")
def synthetic(t):
    kept = fb.cap_synthetic_share(t.user_events, ["event_id"], max_share=0.1)
    return kept.groupBy("is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("l21_trigger_audit", """
SELECT run_id, trigger_id, training_status, created_at FROM (SELECT trigger_reason AS run_id, *, row_number() OVER (
    PARTITION BY trigger_reason ORDER BY created_at DESC, trigger_id DESC) AS rn FROM retraining_triggers) WHERE rn = 1""")
def audit(t):
    log = t.retraining_triggers.select(F.col("trigger_reason").alias("run_id"), "trigger_id", "training_status", "created_at")
    return fb.trigger_state(log)


@query("l22_ctr_by_day", f"""SELECT "date", {CTR_COLUMNS} FROM {SHOWN.format(days=7)} GROUP BY 1""")
def ctr_by_day(t):
    recent = rel.since(t.recommendation_logs, "created_at", AS_OF, 7)
    joined = fb.clicked_recommendations(recent, t.user_events, ["created_at"])
    out = joined.groupBy(F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("impressions"), F.count("has_click").alias("clicks"))
    return out.withColumn("ctr_percent", percent("clicks", "impressions"))


@query("l22_watch_rate_by_event", """
SELECT clicks, watches, round(CAST(watches AS DOUBLE) / clicks * 100, 2) AS watch_rate FROM (
    SELECT count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'watch') AS watches
    FROM (SELECT DISTINCT event_id, event_type FROM user_events WHERE created_at >= DATE '2024-01-31' - INTERVAL 7 DAY))""")
def watch_rate(t):
    # event_id is the key of the table, so its distinct count is the row count
    one = rel.since(t.user_events, "created_at", AS_OF, 7).agg(
        F.count_if(fb.kind("click")).alias("clicks"), F.count_if(fb.kind("watch")).alias("watches")
    )
    return one.withColumn("watch_rate", percent("watches", "clicks"))


@query("l22_ctr_event_log", """
SELECT "date", round(CAST(count(*) FILTER (WHERE c) AS DOUBLE) / nullif(count(*) FILTER (WHERE i), 0) * 100, 2) AS ctr FROM (
    SELECT CAST(created_at AS DATE) AS "date", bool_or(event_type = 'click') AS c, bool_or(event_type = 'impression') AS i
    FROM user_events WHERE created_at >= DATE '2024-01-31' - INTERVAL 7 DAY GROUP BY 1, recommendation_id) GROUP BY 1""")
def ctr_event_log(t):
    per = rel.since(t.user_events, "created_at", AS_OF, 7).groupBy(F.to_date("created_at").alias("date"), "recommendation_id").agg(
        F.max(F.when(fb.kind("click"), 1)).alias("c"), F.max(F.when(fb.kind("impression"), 1)).alias("i")
    )
    return per.groupBy("date").agg(percent(F.count("c"), F.count("i")).alias("ctr"))


@query("l22_rates_over_all_events", """
SELECT round(100 * CAST(count(*) FILTER (WHERE c) AS DOUBLE) / count(*), 2) AS ctr,
    round(100 * CAST(count(*) FILTER (WHERE w) AS DOUBLE) / nullif(count(*) FILTER (WHERE c), 0), 2) AS watch_rate FROM (
    SELECT bool_or(event_type = 'click') AS c, bool_or(event_type = 'watch') AS w FROM user_events GROUP BY recommendation_id)""")
def rates(t):
    per = t.user_events.filter(F.col("recommendation_id").isNotNull()).groupBy("recommendation_id").agg(
        F.max(F.when(fb.kind("click"), 1)).alias("c"), F.max(F.when(fb.kind("watch"), 1)).alias("w")
    )
    return per.agg(
        F.round(100 * F.try_divide(F.count("c").cast("double"), F.count(F.lit(1)).cast("double")), 2).alias("ctr"),
        F.round(100 * F.try_divide(F.count("w").cast("double"), F.count("c").cast("double")), 2).alias("watch_rate"),
    )


@query("l22_last_hour_by_type", """
SELECT event_type, count(*) AS last_hour_count FROM user_events WHERE created_at > (SELECT max(created_at) FROM user_events) - INTERVAL 1 HOUR GROUP BY 1""")
def last_hour(t):
    newest = t.user_events.agg(F.max("created_at")).scalar()
    return t.user_events.filter(F.col("created_at") > newest - F.expr("INTERVAL 1 HOUR")).groupBy("event_type").agg(F.count(F.lit(1)).alias("last_hour_count"))


@query("l22_events_by_type", "SELECT event_type, count(*) AS n FROM user_events GROUP BY 1")
def by_type(t):
    return t.user_events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("l22_active_versions", "SELECT model_version, count(*) AS recommendation_count FROM recommendation_logs GROUP BY 1")
def active_versions(t):
    return t.recommendation_logs.groupBy("model_version").agg(F.count(F.lit(1)).alias("recommendation_count"))
