"""Experiment, gate and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import percent, r6
from ..operators import experiments as ex
from ..operators import feedback as fb
from ..operators.scale import exact_quantiles, keep_first, stored
from ..session import scratch
from ..sources import keyed_log, sinks as sk
from ..tables import AS_OF
from .feedback import METRICS, VERSION_METRICS, business, training_labels
from .registry import query

ARM_SQL = """CASE WHEN CAST('0x' || substr(md5('rank-v2|' || CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 30
    THEN 'treatment' ELSE 'control' END"""


def tail_sql(density, x, steps=4000):
    """Two-sided tail by Simpson's rule over [0, |x|]; ``density`` is SQL in ``u``."""
    h = f"(abs({x}) / {steps})"
    terms = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('u', f'(i * {h})')}))"
    return f"greatest(0, 1 - 2 * {h} / 3 * {terms})"


NORMAL_DENSITY = "(0.3989422804014327 * pow(2.718281828459045, -CAST(0.5 AS DOUBLE) * u * u))"


def arm():
    return ex.assign_arm("user_id", "rank-v2", 30)


@query("r17_traffic_split", f"SELECT event_id, user_id, {ARM_SQL} AS arm FROM user_events")
def traffic_split(t):
    return t.user_events.select("event_id", "user_id", arm().alias("arm"))


Z_SQL = """CASE WHEN p * (1 - p) > 0 THEN (CAST(xb AS DOUBLE) / nb - CAST(xa AS DOUBLE) / na)
    / sqrt(p * (1 - p) * (CAST(1 AS DOUBLE) / na + CAST(1 AS DOUBLE) / nb)) ELSE 0 END"""


Z_ROWS = """WITH c AS (SELECT count(*) FILTER (WHERE model_version = 'v1') AS na, count(*) FILTER (WHERE model_version = 'v2') AS nb,
    count(*) FILTER (WHERE model_version = 'v1' AND clicked) AS xa, count(*) FILTER (WHERE model_version = 'v2' AND clicked) AS xb
    FROM (SELECT model_version, recommendation_id IN (SELECT recommendation_id FROM user_events WHERE event_type = 'click') AS clicked FROM recommendation_logs)),
z AS (SELECT *, CAST(xa + xb AS DOUBLE) / (na + nb) AS p FROM c)
"""


@query("d10_two_proportion_z", Z_ROWS + f"""
SELECT na AS n_a, nb AS n_b, round(CAST(xa AS DOUBLE) / na, 6) AS ctr_a, round(CAST(xb AS DOUBLE) / nb, 6) AS ctr_b,
    round({Z_SQL}, 6) AS z, abs({Z_SQL}) > 1.96 AS is_significant FROM z""")
def z_test(t):
    counts = ex.ctr_counts(t.recommendation_logs, t.user_events, F.col("model_version"))
    return ex.ctr_z_test(counts, "v1", "v2").withColumns({c: r6(c) for c in ("ctr_a", "ctr_b", "z")})


@query("d10_two_proportion_p_value", Z_ROWS + f""", t AS (SELECT {Z_SQL} AS z FROM z)
SELECT round(z, 6) AS z, round({tail_sql(NORMAL_DENSITY, 'z')}, 6) AS p_value FROM t""")
def z_p_value(t):
    counts = ex.ctr_counts(t.recommendation_logs, t.user_events, F.col("model_version"))
    return ex.ctr_z_test(counts, "v1", "v2").select(r6("z").alias("z"), r6(ex.normal_two_sided("z")).alias("p_value"))


def paired(t):
    """Item mean as the candidate against the user mean as the baseline, on all ratings."""
    means_i = t.ratings.groupBy("MovieID").agg(F.avg("Rating").alias("pi"))
    means_u = t.ratings.groupBy("UserID").agg(F.avg("Rating").alias("pu"))
    rows = t.ratings.join(means_i, "MovieID").join(means_u, "UserID")
    return ex.paired_t(rows, F.col("Rating") - F.col("pi"), F.col("Rating") - F.col("pu"))


PAIRED = """SELECT count(d) AS n, avg(d) AS mean_diff, stddev_samp(d) AS sd, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS t FROM (
    SELECT (Rating - m.AvgRating) * (Rating - m.AvgRating) - (Rating - u.AvgRating) * (Rating - u.AvgRating) AS d
    FROM ratings JOIN movie_stats m USING (MovieID) JOIN user_stats u USING (UserID))"""


@query("d09_paired_t_test", f"SELECT n, round(mean_diff, 6) AS mean_diff, round(sd, 6) AS sd, round(t, 4) AS t FROM ({PAIRED})")
def paired_t(t):
    return paired(t).select("n", r6("mean_diff").alias("mean_diff"), r6("sd").alias("sd"), F.round("t", 4).alias("t"))


T_DENSITY = "(k * pow(1 + u * u / (n - 1), -CAST(n AS DOUBLE) / 2))"


@query("d09_paired_t_p_value", f"""WITH p AS ({PAIRED}),
q AS (SELECT *, pow(2.718281828459045, lgamma(n / CAST(2 AS DOUBLE)) - lgamma((n - 1) / CAST(2 AS DOUBLE))) / sqrt((n - 1) * pi()) AS k FROM p),
v AS (SELECT n, t, {tail_sql(T_DENSITY, 't')} AS p_value FROM q)
SELECT n, round(t, 4) AS t, round(p_value, 6) AS p_value, p_value < 0.05 AND t < 0 AS passed FROM v""")
def paired_p(t):
    passed = (F.col("p_value") < 0.05) & (F.col("t") < 0)
    return ex.with_p_value(paired(t)).select("n", F.round("t", 4).alias("t"), r6("p_value").alias("p_value"), passed.alias("passed"))


def performance(t):
    """One quality row per version."""
    errors = ex.error_profile(t.user_events, t.recommendation_logs, ["model_version"])
    logs = t.recommendation_logs.select("recommendation_id", "model_version")
    key = F.col("user_id") * 1000 + F.get_json_object("props", "$.k").cast("bigint")
    served = t.raw("events").select(key.cast("string").alias("recommendation_id"), "value")
    p95 = exact_quantiles(served.join(logs, "recommendation_id"), ["model_version"], "value", {"p95_latency_ms": 0.95})
    rates = fb.business_metrics(t.recommendation_logs, t.user_events).select(
        "model_version", F.col("ctr_percent").alias("ctr"), F.col("watch_rate_percent").alias("watch_rate")
    )
    return errors.join(p95, "model_version").join(rates, "model_version")


PERF = """perf AS (SELECT model_version, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(completion_rate) AS r2_score,
    avg(CASE WHEN feedback_type IN ('dislike', 'not_interested') THEN 1 ELSE 0 END) AS error_rate, quantile_cont(value, 0.95) AS p95
    FROM (SELECT r.model_version, e.*, completion_rate - 0.5 AS e, v.value FROM user_events e JOIN recommendation_logs r USING (recommendation_id)
          JOIN events v ON v.event_id = e.event_id) GROUP BY 1),
rates AS (SELECT model_version, round(CAST(count(*) FILTER (WHERE c > 0) AS DOUBLE) / count(*) * 100, 2) AS ctr,
    round(CAST(sum(w) AS DOUBLE) / sum(c) * 100, 2) AS watch_rate FROM (SELECT r.model_version, r.recommendation_id,
    count(*) FILTER (WHERE e.event_type = 'click') AS c, count(*) FILTER (WHERE e.event_type = 'watch') AS w
    FROM recommendation_logs r LEFT JOIN user_events e USING (recommendation_id) GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT * FROM perf JOIN rates USING (model_version) WHERE model_version = 'v2'),
b AS (SELECT * FROM perf JOIN rates USING (model_version) WHERE model_version = 'v1'),"""

GATES_SQL = f"""WITH {PERF}
n AS (SELECT count(*) AS n FROM user_events), t AS ({PAIRED}),
gates AS (
SELECT 'rmse_degradation' AS gate, a.rmse AS candidate_value, b.rmse AS baseline_value, (a.rmse - b.rmse) / b.rmse AS change, 0.1 AS threshold,
    (a.rmse - b.rmse) / b.rmse <= 0.1 AS ok FROM a, b
UNION ALL SELECT 'mae_degradation', a.mae, b.mae, (a.mae - b.mae) / b.mae, 0.1, (a.mae - b.mae) / b.mae <= 0.1 FROM a, b
UNION ALL SELECT 'r2_score', a.r2_score, NULL, NULL, 0.5, a.r2_score >= 0.5 FROM a
UNION ALL SELECT 'ctr_ratio', a.ctr, b.ctr, a.ctr / b.ctr, 0.95, a.ctr / b.ctr >= 0.95 FROM a, b
UNION ALL SELECT 'watch_rate_ratio', a.watch_rate, b.watch_rate, a.watch_rate / b.watch_rate, 0.95, a.watch_rate / b.watch_rate >= 0.95 FROM a, b
UNION ALL SELECT 'p95_latency', a.p95, NULL, NULL, 200, a.p95 <= 200 FROM a
UNION ALL SELECT 'error_rate', a.error_rate, NULL, NULL, 0.01, a.error_rate <= 0.01 FROM a
UNION ALL SELECT 'sample_size', n.n, NULL, NULL, 1000, n.n >= 1000 FROM n)
SELECT gate, round(CAST(candidate_value AS DOUBLE), 4) AS candidate_value, round(CAST(baseline_value AS DOUBLE), 4) AS baseline_value,
    round(CAST(change AS DOUBLE), 4) AS change, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN ok THEN 'passed' ELSE 'failed' END AS status FROM gates
UNION ALL SELECT 'statistical_significance', round(t, 4), NULL, round(mean_diff, 4), CAST(0.05 AS DOUBLE),
    CASE WHEN t < -1.96 THEN 'passed' WHEN t > 1.96 THEN 'failed' ELSE 'inconclusive' END FROM t"""


def gates(t):
    n = t.user_events.agg(F.count(F.lit(1))).scalar()
    return ex.release_gates(performance(t), "v2", "v1", n, paired(t))


@query("l08_release_gates", GATES_SQL)
def release_gates(t):
    return gates(t).withColumns({c: F.round(c, 4) for c in ("candidate_value", "baseline_value", "change")})


@query("l08_gate_decision", f"""SELECT count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status = 'inconclusive') AS inconclusive, count(*) FILTER (WHERE status = 'failed') = 0 AS overall_passed
    FROM ({GATES_SQL})""")
def gate_decision(t):
    return ex.gate_decision(gates(t))


@query("l09_coverage_gates", """
WITH slots AS (SELECT user_id, unnest(item_ids) AS item_id FROM recommendation_logs),
one AS (SELECT (SELECT count(DISTINCT user_id) FROM slots) / CAST((SELECT count(DISTINCT user_id) FROM user_events) AS DOUBLE) AS user_coverage,
    (SELECT count(DISTINCT item_id) FROM slots WHERE item_id IN (SELECT MovieID FROM movies)) / CAST((SELECT count(*) FROM movies) AS DOUBLE) AS item_coverage,
    (SELECT count(DISTINCT item_id) FROM slots) / CAST((SELECT count(*) FROM slots) AS DOUBLE) AS prediction_diversity,
    (SELECT avg(label) FROM training_labels) AS avg_engagement)
SELECT 'user_coverage' AS gate, round(user_coverage, 6) AS value, CAST(0.9 AS DOUBLE) AS threshold, CASE WHEN user_coverage >= 0.9 THEN 'passed' ELSE 'failed' END AS status FROM one
UNION ALL SELECT 'item_coverage', round(item_coverage, 6), 0.8, CASE WHEN item_coverage >= 0.8 THEN 'passed' ELSE 'failed' END FROM one
UNION ALL SELECT 'prediction_diversity', round(prediction_diversity, 6), 0.3, CASE WHEN prediction_diversity >= 0.3 THEN 'passed' ELSE 'failed' END FROM one
UNION ALL SELECT 'avg_engagement', round(avg_engagement, 6), 2, CASE WHEN avg_engagement >= 2 THEN 'passed' ELSE 'failed' END FROM one""")
def coverage(t):
    slots = t.recommendation_logs.select("user_id", F.explode("item_ids").alias("item_id"))
    mean = training_labels(t).agg(F.avg("label")).scalar()
    out = ex.coverage_gates(slots, t.user_events.select("user_id"), t.movies.select(F.col("MovieID").alias("item_id")), mean)
    return out.withColumn("value", r6("value"))


COMPARE = METRICS + """, ab AS (SELECT unnest(['total_recommendations', 'ctr_percent', 'watch_rate_percent', 'avg_watch_completion', 'total_positive_feedback']) AS metric,
    coalesce(unnest([CAST(a.total_recommendations AS DOUBLE), a.ctr_percent, a.watch_rate_percent, a.avg_watch_completion, CAST(a.total_positive_feedback AS DOUBLE)]), 0) AS value_a,
    coalesce(unnest([CAST(b.total_recommendations AS DOUBLE), b.ctr_percent, b.watch_rate_percent, b.avg_watch_completion, CAST(b.total_positive_feedback AS DOUBLE)]), 0) AS value_b
    FROM metrics a, metrics b WHERE a.model_version = 'v1' AND b.model_version = 'v2'),
cmp AS (SELECT metric, value_a, value_b, round(CASE WHEN value_a = 0 THEN 0 ELSE (value_b - value_a) / value_a * 100 END, 6) AS pct_change,
    CASE WHEN value_b > value_a THEN 'v2' ELSE 'v1' END AS winner FROM ab)
"""


@query("l14_version_comparison", COMPARE + "SELECT * FROM cmp")
def comparison(t):
    return ex.compare_versions(business(t), "v1", "v2").withColumn("pct_change", r6("pct_change"))


@query("l14_winner", COMPARE + """
SELECT max(winner) FILTER (WHERE metric = 'ctr_percent') AS ctr_winner, max(winner) FILTER (WHERE metric = 'watch_rate_percent') AS watch_winner,
    CASE WHEN max(winner) FILTER (WHERE metric = 'ctr_percent') = max(winner) FILTER (WHERE metric = 'watch_rate_percent') THEN 'clear' ELSE 'mixed' END AS verdict FROM cmp""")
def winner(t):
    return ex.winner(ex.compare_versions(business(t), "v1", "v2"))


@query("l15_ctr_per_version", """
SELECT model_version, count(*) AS recommendations, count(*) FILTER (WHERE clicked) AS clicks,
    round(count(*) FILTER (WHERE clicked) / CAST(count(*) AS DOUBLE) * 100, 2) AS ctr_percent FROM (SELECT model_version,
    recommendation_id IN (SELECT recommendation_id FROM user_events WHERE event_type = 'click') AS clicked FROM recommendation_logs) GROUP BY 1""")
def ctr_per_version(t):
    counts = ex.ctr_counts(t.recommendation_logs, t.user_events, F.col("model_version"))
    return counts.select(
        F.col("arm").alias("model_version"), F.col("n").alias("recommendations"), F.col("x").alias("clicks"), percent("x", "n").alias("ctr_percent")
    )


def overall_funnel(t):
    per_rec = t.user_events.groupBy("recommendation_id").agg(
        F.max(F.when(fb.kind("click"), 1)).alias("c"), F.max(F.when(fb.kind("watch"), 1)).alias("w")
    ).agg(F.count("recommendation_id").alias("impressions"), F.count("c").alias("clicks"), F.count("w").alias("watches"))
    users = t.user_events.filter(fb.kind("feedback")).select("user_id").distinct().agg(F.count(F.lit(1))).scalar()
    one = per_rec.withColumn("feedbacks", users)
    return one.select(
        "*", percent("clicks", "impressions", 1).alias("ctr"), percent("watches", "clicks", 1).alias("watch_rate"),
        percent("feedbacks", "watches", 1).alias("feedback_rate"),
    )


@query("l15_funnel", """
WITH r AS (SELECT bool_or(event_type = 'click') AS c, bool_or(event_type = 'watch') AS w FROM user_events GROUP BY recommendation_id),
n AS (SELECT count(*) AS impressions, count(*) FILTER (WHERE c) AS clicks, count(*) FILTER (WHERE w) AS watches,
    (SELECT count(DISTINCT user_id) FROM user_events WHERE event_type = 'feedback') AS feedbacks FROM r)
SELECT *, round(CAST(clicks AS DOUBLE) / impressions * 100, 1) AS ctr, round(CAST(watches AS DOUBLE) / clicks * 100, 1) AS watch_rate,
    round(CAST(feedbacks AS DOUBLE) / watches * 100, 1) AS feedback_rate FROM n""")
def funnel(t):
    return overall_funnel(t)


@query("l15_label_profile", """
SELECT count(*) AS total_labels, min(label) AS min_label, max(label) AS max_label, round(avg(label), 2) AS avg_label,
    round(stddev_samp(label), 2) AS std_label, count(DISTINCT user_id) AS unique_users, count(DISTINCT item_id) AS unique_items FROM training_labels""")
def label_profile(t):
    return training_labels(t).agg(
        F.count(F.lit(1)).alias("total_labels"), F.min("label").alias("min_label"), F.max("label").alias("max_label"),
        F.round(F.avg("label"), 2).alias("avg_label"), F.round(F.stddev_samp("label"), 2).alias("std_label"),
        F.countDistinct("user_id").alias("unique_users"), F.countDistinct("item_id").alias("unique_items"),
    )


@query("l16_deployment_history", """
WITH s AS (SELECT model_version, min(created_at) AS first_seen, max(created_at) AS last_seen, count(*) AS recommendations FROM recommendation_logs GROUP BY 1)
SELECT *, model_version = (SELECT model_version FROM s ORDER BY first_seen DESC, model_version DESC LIMIT 1) AS is_current FROM s""")
def history(t):
    return ex.deployment_history(t.recommendation_logs)


L17 = VERSION_METRICS.rstrip() + """, q AS (SELECT model_version, CAST(e.created_at AS DATE) AS evaluation_date, sqrt(avg((completion_rate - 0.5) * (completion_rate - 0.5))) AS rmse,
    avg((completion_rate - 0.5) * (completion_rate - 0.5)) AS mse, 1 - avg((completion_rate - 0.5) * (completion_rate - 0.5)) / nullif(var_pop(completion_rate), 0) AS r2,
    avg(abs(completion_rate - 0.5)) AS mae, count(*) AS sample_count FROM user_events e JOIN (SELECT recommendation_id, model_version FROM recommendation_logs) USING (recommendation_id) GROUP BY 1, 2),
m AS (SELECT model_version, round(CAST(count(*) FILTER (WHERE c > 0) AS DOUBLE) / count(*) * 100, 2) AS ctr FROM (SELECT r.model_version, r.recommendation_id,
    count(*) FILTER (WHERE e.event_type = 'click') AS c FROM recommendation_logs r LEFT JOIN user_events e USING (recommendation_id) GROUP BY 1, 2) GROUP BY 1),
cur AS (SELECT arg_max(model_version, row(f, model_version)) AS v FROM (SELECT model_version, min(created_at) AS f FROM recommendation_logs GROUP BY 1)),
perf AS (SELECT evaluation_date, model_version, 'ranker' AS model_name, 'run-' || model_version AS model_run_id,
    CASE WHEN model_version = (SELECT v FROM cur) THEN 'production' ELSE 'archived' END AS stage, model_version = (SELECT v FROM cur) AS is_production,
    round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(mse, 6) AS mse, round(r2, 6) AS r2_score, sample_count, ctr,
    round(CAST(watches AS DOUBLE) / clicks * 100, 6) AS watch_rate, round(completion * 100, 6) AS avg_watch_completion, round(score, 6) AS avg_engagement_score
    FROM q LEFT JOIN m USING (model_version) LEFT JOIN c USING (model_version) LEFT JOIN l USING (model_version))
"""


def daily_performance(t):
    quality = ex.error_profile(
        t.user_events.withColumn("evaluation_date", F.to_date("created_at")), t.recommendation_logs, ["model_version", "evaluation_date"]
    )
    clicked = fb.business_metrics(t.recommendation_logs, t.user_events).select("model_version", F.col("ctr_percent").alias("ctr"))
    engaged = fb.version_metrics(t.recommendation_logs, t.user_events, training_labels(t)).select(
        "model_version", "watch_rate", F.col("avg_watch_completion_pct").alias("avg_watch_completion"), "avg_engagement_score")
    rounded = ("rmse", "mae", "mse", "r2_score", "watch_rate", "avg_watch_completion", "avg_engagement_score")
    return ex.performance_rows(quality, clicked.join(engaged, "model_version"), t.recommendation_logs).select(
        "evaluation_date", "model_version", "model_name", "model_run_id", "stage", "is_production", "sample_count", "ctr",
        *[r6(c).alias(c) for c in rounded],
    )


@query("l17_performance_rows", L17 + "SELECT * FROM perf")
def performance_rows(t):
    """The rows as a log that takes each (version, day) once; the second load is a no-op."""
    path = scratch(t.spark, "model_performance")
    rows = stored(daily_performance(t), "performance")
    for _ in range(2):
        sk.insert_if_absent(t.spark, path, rows, ["model_version", "evaluation_date"])
    return keyed_log.read(t.spark, path)


@query("l17_latest_ten", L17 + "SELECT * FROM perf ORDER BY evaluation_date DESC, model_version LIMIT 10")
def latest_ten(t):
    return daily_performance(t).orderBy(F.desc("evaluation_date"), "model_version").limit(10)


@query("l17_champion", L17 + """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY model_version ORDER BY evaluation_date DESC) AS rn FROM perf) WHERE rn = 1""")
def champion(t):
    return keep_first(daily_performance(t), ["model_version"], [F.desc("evaluation_date")])


def arms(t):
    logs = t.recommendation_logs.withColumn("arm", arm())
    per = logs.select("recommendation_id", "arm").join(fb.events_per_recommendation(t.user_events), "recommendation_id", "left")
    return per.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("clicks") > 0).alias("x"),
        F.coalesce(F.sum("clicks"), F.lit(0)).alias("clicks"), F.coalesce(F.sum("watches"), F.lit(0)).alias("watches"),
    )


AB_ROWS = f"""WITH per AS (SELECT r.recommendation_id, {ARM_SQL.replace('user_id', 'r.user_id')} AS arm, count(*) FILTER (WHERE e.event_type = 'click') AS c,
    count(*) FILTER (WHERE e.event_type = 'watch') AS w FROM recommendation_logs r LEFT JOIN user_events e USING (recommendation_id) GROUP BY 1, 2),
s AS (SELECT count(*) FILTER (WHERE arm = 'control') AS na, count(*) FILTER (WHERE arm = 'treatment') AS nb,
    count(*) FILTER (WHERE arm = 'control' AND c > 0) AS xa, count(*) FILTER (WHERE arm = 'treatment' AND c > 0) AS xb,
    sum(c) FILTER (WHERE arm = 'control') AS ca, sum(c) FILTER (WHERE arm = 'treatment') AS cb,
    sum(w) FILTER (WHERE arm = 'control') AS wa, sum(w) FILTER (WHERE arm = 'treatment') AS wb FROM per),
z AS (SELECT *, CAST(xa + xb AS DOUBLE) / (na + nb) AS p, round(CAST(xa AS DOUBLE) / na * 100, 2) AS ctr_a, round(CAST(xb AS DOUBLE) / nb * 100, 2) AS ctr_b,
    round(CAST(wa AS DOUBLE) / ca * 100, 2) AS watch_a, round(CAST(wb AS DOUBLE) / cb * 100, 2) AS watch_b FROM s),
o AS (SELECT *, {Z_SQL} AS z, round((ctr_b - ctr_a) / ctr_a * 100, 2) AS lift FROM z)
"""


@query("l18_ab_result", AB_ROWS + """
SELECT 'rank-v2' AS experiment_name, 30 AS traffic_percentage_treatment, ctr_a AS control_ctr, ctr_b AS treatment_ctr, watch_a AS control_watch_rate,
    watch_b AS treatment_watch_rate, na + nb AS sample_size, round(z, 6) AS z, lift AS ctr_lift_percent, abs(z) > 1.96 AS is_significant,
    CASE WHEN lift > 5 AND watch_b > watch_a AND abs(z) > 1.96 THEN 'promote' WHEN lift < 0 AND abs(z) > 1.96 THEN 'rollback' ELSE 'continue' END AS decision FROM o""")
def ab_result(t):
    return ex.ab_result(arms(t), "rank-v2", 30).withColumn("z", r6("z"))


@query("l18_ab_p_value", AB_ROWS + f"SELECT round(z, 6) AS z, round({tail_sql(NORMAL_DENSITY, 'z')}, 6) AS p_value FROM o")
def ab_p_value(t):
    return ex.with_ab_p_value(ex.ab_result(arms(t), "rank-v2", 30)).select(r6("z").alias("z"), r6("p_value").alias("p_value"))


@query("l19_health_bands", """
WITH f AS (SELECT count(DISTINCT recommendation_id) AS i, count(DISTINCT CASE WHEN event_type = 'click' THEN recommendation_id END) AS c,
    count(DISTINCT CASE WHEN event_type = 'watch' THEN recommendation_id END) AS w, max(created_at) AS last FROM user_events),
v AS (SELECT round(CAST(c AS DOUBLE) / i * 100, 1) AS ctr, round(CAST(w AS DOUBLE) / c * 100, 1) AS watch_rate,
    CAST((SELECT count(*) FROM training_labels) AS DOUBLE) AS n, floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(last))) / 3600) AS age FROM f)
SELECT 'ctr' AS indicator, ctr AS value, CASE WHEN ctr > 50 THEN 'healthy' WHEN ctr < 30 THEN 'needs_attention' ELSE 'watch' END AS status FROM v
UNION ALL SELECT 'watch_rate', watch_rate, CASE WHEN watch_rate > 40 THEN 'healthy' WHEN watch_rate < 20 THEN 'needs_attention' ELSE 'watch' END FROM v
UNION ALL SELECT 'labels', n, CASE WHEN n > 100 THEN 'healthy' WHEN n < 50 THEN 'needs_attention' ELSE 'watch' END FROM v
UNION ALL SELECT 'last_event_age_hours', age, CASE WHEN age <= 1 THEN 'healthy' ELSE 'needs_attention' END FROM v""")
def health(t):
    report = overall_funnel(t).select("ctr", "watch_rate").withColumn("labels", training_labels(t).agg(F.count(F.lit(1))).scalar())
    now = F.unix_timestamp(F.lit(AS_OF).cast("timestamp_ntz"))
    age = F.floor((now - t.user_events.agg(F.unix_timestamp(F.max("created_at"))).scalar()) / 3600)
    return ex.health_bands(report, age)
