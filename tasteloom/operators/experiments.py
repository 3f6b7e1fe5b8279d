"""Traffic split, version comparison, significance tests, release gates and health bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import hash_bucket, percent, ratio
from ..functions.tails import normal_two_sided, t_two_sided
from .feedback import clicked_recommendations, kind

# Release gates, health bands and the A/B promotion rule.
GATES = {
    "max_rmse_degradation": 0.10,
    "max_mae_degradation": 0.10,
    "min_r2_score": 0.50,
    "min_ctr_ratio": 0.95,
    "min_watch_rate_ratio": 0.95,
    "min_avg_engagement": 2.0,
    "max_p95_latency_ms": 200.0,
    "max_error_rate": 0.01,
    "min_user_coverage": 0.90,
    "min_item_coverage": 0.80,
    "min_prediction_diversity": 0.30,
    "min_sample_size": 1000,
    "max_pvalue": 0.05,
}
Z_CRITICAL = 1.96
HEALTH = {"ctr": (50.0, 30.0), "watch_rate": (40.0, 20.0), "labels": (100.0, 50.0)}
MIN_LIFT_PERCENT = 5.0


def assign_arm(user: Column | str, experiment: str, treatment_percent: int) -> Column:
    """Sticky assignment: the same user always lands in the same arm of an experiment."""
    return F.when(hash_bucket([F.lit(experiment), user], 100) < treatment_percent, "treatment").otherwise("control")


def two_row_pivot(df: DataFrame, key: str, a: str, b: str, columns: Sequence[str]) -> DataFrame:
    """Rows ``a`` and ``b`` of a keyed metric table side by side: ``<column>_a``, ``<column>_b``."""
    pick = [
        F.max(F.when(F.col(key) == value, F.col(c))).alias(f"{c}_{side}")
        for c in columns
        for side, value in (("a", a), ("b", b))
    ]
    return df.filter(F.col(key).isin(a, b)).agg(*pick)


def z_score(n1: Column, x1: Column, n2: Column, x2: Column) -> Column:
    """Two-proportion z with the pooled variance; 0 when the variance is 0."""
    n1, x1, n2, x2 = (c.cast("double") for c in (n1, x1, n2, x2))
    p1, p2 = F.try_divide(x1, n1), F.try_divide(x2, n2)
    pooled = F.try_divide(x1 + x2, n1 + n2)
    se = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return F.when(se > 0, (p2 - p1) / se).otherwise(0.0)


def ctr_counts(logs: DataFrame, events: DataFrame, group: Column) -> DataFrame:
    joined = clicked_recommendations(logs.withColumn("_g", group), events, ["_g"])
    return joined.groupBy(F.col("_g").alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.count("has_click").alias("x"))


def ctr_z_test(counts: DataFrame, a: str, b: str) -> DataFrame:
    """z-test of arm ``b`` against arm ``a``, picked by name."""
    one = two_row_pivot(counts, "arm", a, b, ["n", "x"])
    z = z_score(F.col("n_a"), F.col("x_a"), F.col("n_b"), F.col("x_b"))
    return one.select(
        F.col("n_a"), F.col("n_b"), ratio("x_a", "n_a").alias("ctr_a"), ratio("x_b", "n_b").alias("ctr_b"), z.alias("z")
    ).withColumn("is_significant", F.abs("z") > Z_CRITICAL)


def paired_t(rows: DataFrame, candidate_error: Column, baseline_error: Column) -> DataFrame:
    """Paired t-test of squared errors: one pass over the rows."""
    d = candidate_error * candidate_error - baseline_error * baseline_error
    one = rows.agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"))
    return one.withColumn("t", F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt(F.col("n").cast("double"))))


def with_p_value(t_row: DataFrame) -> DataFrame:
    return t_row.withColumn("p_value", t_two_sided(F.col("t"), (F.col("n") - 1).cast("double")))


GATE_METRICS = ["rmse", "mae", "r2_score", "ctr", "watch_rate", "p95_latency_ms", "error_rate"]


def release_gates(
    performance: DataFrame, candidate: str, baseline: str, sample_size: Column, t_row: DataFrame | None = None,
    gates: dict[str, float] = GATES,
) -> DataFrame:
    """One row per evaluated gate; a gate whose metric is missing is absent.

    ``performance`` has one row per ``model_version`` with the columns of ``GATE_METRICS``.
    Status is ``passed``, ``failed`` or ``inconclusive`` (no significant difference).
    """
    one = two_row_pivot(performance, "model_version", candidate, baseline, GATE_METRICS)
    one = one.withColumn("sample_size_a", sample_size.cast("double"))

    def row(name: str, value: Column, other: Column, change: Column, threshold: float, ok: Column) -> Column:
        return F.struct(
            F.lit(name).alias("gate"),
            value.cast("double").alias("candidate_value"),
            other.cast("double").alias("baseline_value"),
            change.cast("double").alias("change"),
            F.lit(float(threshold)).alias("threshold"),
            F.when(ok, "passed").when(~ok, "failed").alias("status"),
        )

    none = F.lit(None).cast("double")
    rows = []
    for metric in ("rmse", "mae"):
        a, b = F.col(f"{metric}_a"), F.col(f"{metric}_b")
        worse = F.try_divide(a - b, b)
        limit = gates[f"max_{metric}_degradation"]
        rows.append(row(f"{metric}_degradation", a, b, worse, limit, worse <= limit))
    rows.append(row("r2_score", F.col("r2_score_a"), none, none, gates["min_r2_score"], F.col("r2_score_a") >= gates["min_r2_score"]))
    for metric in ("ctr", "watch_rate"):
        a, b = F.col(f"{metric}_a"), F.col(f"{metric}_b")
        share = F.try_divide(a, b)
        limit = gates[f"min_{metric}_ratio"]
        rows.append(row(f"{metric}_ratio", a, b, share, limit, share >= limit))
    for name, metric, limit in (("p95_latency", "p95_latency_ms", gates["max_p95_latency_ms"]), ("error_rate", "error_rate", gates["max_error_rate"])):
        a = F.col(f"{metric}_a")
        rows.append(row(name, a, none, none, limit, a <= limit))
    size = F.col("sample_size_a")
    rows.append(row("sample_size", size, none, none, gates["min_sample_size"], size >= gates["min_sample_size"]))
    out = one.select(F.inline(F.array(*rows))).filter(F.col("status").isNotNull())
    if t_row is None:
        return out
    p, t = F.col("p_value"), F.col("t")
    significant = with_p_value(t_row).select(
        F.lit("statistical_significance").alias("gate"),
        t.alias("candidate_value"),
        none.alias("baseline_value"),
        F.col("mean_diff").alias("change"),
        F.lit(float(gates["max_pvalue"])).alias("threshold"),
        F.when((p < gates["max_pvalue"]) & (t < 0), "passed").when(p < gates["max_pvalue"], "failed")
        .otherwise("inconclusive").alias("status"),
    )
    return out.unionByName(significant)


def gate_decision(gates: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    return gates.agg(
        F.count_if(F.col("status") == "passed").alias("passed"),
        failed.alias("failed"),
        F.count_if(F.col("status") == "inconclusive").alias("inconclusive"),
    ).withColumn("overall_passed", F.col("failed") == 0)


def coverage_gates(
    recommended: DataFrame, active_users: DataFrame, catalog: DataFrame, avg_engagement: Column, gates: dict[str, float] = GATES
) -> DataFrame:
    """User coverage, item coverage, diversity (distinct items per slot) and mean engagement.

    ``recommended`` holds one row per recommended slot: ``user_id, item_id``.
    """
    users = recommended.select("user_id").distinct().join(active_users.select("user_id").distinct(), "user_id", "left_semi")
    covered = recommended.select("item_id").distinct()
    one = active_users.agg(F.countDistinct("user_id").alias("users")).select(
        ratio(users.agg(F.count(F.lit(1))).scalar(), "users").alias("user_coverage"),
        ratio(
            covered.join(catalog.select("item_id").distinct(), "item_id", "left_semi").agg(F.count(F.lit(1))).scalar(),
            catalog.agg(F.countDistinct("item_id")).scalar(),
        ).alias("item_coverage"),
        ratio(covered.agg(F.count(F.lit(1))).scalar(), recommended.agg(F.count(F.lit(1))).scalar()).alias("prediction_diversity"),
        avg_engagement.alias("avg_engagement"),
    )
    rows = [
        F.struct(
            F.lit(n).alias("gate"), F.col(n).alias("value"), F.lit(float(gates[f"min_{n}"])).alias("threshold"),
            F.when(F.col(n) >= gates[f"min_{n}"], "passed").otherwise("failed").alias("status"),
        )
        for n in ("user_coverage", "item_coverage", "prediction_diversity", "avg_engagement")
    ]
    return one.select(F.inline(F.array(*rows)))


COMPARED = ["total_recommendations", "ctr_percent", "watch_rate_percent", "avg_watch_completion", "total_positive_feedback"]


def compare_versions(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """Per metric: both values, percent change and the better version; a metric without a value counts as 0."""
    one = two_row_pivot(metrics, "model_version", a, b, COMPARED)
    rows = []
    for c in COMPARED:
        va, vb = F.coalesce(F.col(f"{c}_a").cast("double"), F.lit(0.0)), F.coalesce(F.col(f"{c}_b").cast("double"), F.lit(0.0))
        change = F.when(va == 0, 0.0).otherwise(F.try_divide(vb - va, va) * 100)
        rows.append(F.struct(
            F.lit(c).alias("metric"), va.alias("value_a"), vb.alias("value_b"), change.alias("pct_change"),
            F.when(vb > va, b).otherwise(a).alias("winner"),
        ))
    return one.select(F.inline(F.array(*rows)))


def winner(comparison: DataFrame) -> DataFrame:
    """One row: the better version by CTR and by watch rate, and whether they agree."""
    best = {m: F.max(F.when(F.col("metric") == m, F.col("winner"))) for m in ("ctr_percent", "watch_rate_percent")}
    out = comparison.agg(best["ctr_percent"].alias("ctr_winner"), best["watch_rate_percent"].alias("watch_winner"))
    return out.withColumn("verdict", F.when(F.col("ctr_winner") == F.col("watch_winner"), "clear").otherwise("mixed"))


def ab_result(per_arm: DataFrame, experiment: str, treatment_percent: int) -> DataFrame:
    """A/B outcome out of one row per arm: ``arm, n, x (clicked), clicks, watches``."""
    one = two_row_pivot(per_arm, "arm", "control", "treatment", ["n", "x", "clicks", "watches"])
    z = z_score(F.col("n_a"), F.col("x_a"), F.col("n_b"), F.col("x_b"))
    out = one.select(
        F.lit(experiment).alias("experiment_name"),
        F.lit(treatment_percent).alias("traffic_percentage_treatment"),
        percent("x_a", "n_a").alias("control_ctr"),
        percent("x_b", "n_b").alias("treatment_ctr"),
        percent("watches_a", "clicks_a").alias("control_watch_rate"),
        percent("watches_b", "clicks_b").alias("treatment_watch_rate"),
        (F.col("n_a") + F.col("n_b")).alias("sample_size"),
        z.alias("z"),
    )
    lift = F.round(F.try_divide(F.col("treatment_ctr") - F.col("control_ctr"), F.col("control_ctr")) * 100, 2)
    out = out.withColumn("ctr_lift_percent", lift).withColumn("is_significant", F.abs("z") > Z_CRITICAL)
    better_watch = F.col("treatment_watch_rate") > F.col("control_watch_rate")
    promote = (F.col("ctr_lift_percent") > MIN_LIFT_PERCENT) & better_watch & F.col("is_significant")
    worse = (F.col("ctr_lift_percent") < 0) & F.col("is_significant")
    return out.withColumn("decision", F.when(promote, "promote").when(worse, "rollback").otherwise("continue"))


def with_ab_p_value(result: DataFrame) -> DataFrame:
    return result.withColumn("p_value", normal_two_sided("z"))


def health_bands(report: DataFrame, last_event_age_hours: Column) -> DataFrame:
    """``indicator, value, status`` for CTR, watch rate, label count and event freshness."""

    def band(name: str, value: Column) -> Column:
        good, bad = HEALTH[name]
        status = F.when(value > good, "healthy").when(value < bad, "needs_attention").otherwise("watch")
        return F.struct(F.lit(name).alias("indicator"), value.cast("double").alias("value"), status.alias("status"))

    fresh = F.struct(
        F.lit("last_event_age_hours").alias("indicator"),
        last_event_age_hours.cast("double").alias("value"),
        F.when(last_event_age_hours <= 1, "healthy").otherwise("needs_attention").alias("status"),
    )
    return report.select(F.inline(F.array(*[band(n, F.col(n)) for n in HEALTH], fresh)))


def deployment_history(logs: DataFrame) -> DataFrame:
    """First and last use per version, the version first seen last marked as current."""
    seen = logs.groupBy("model_version").agg(
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.count(F.lit(1)).alias("recommendations")
    )
    current = seen.agg(F.max_by("model_version", F.struct("first_seen", "model_version"))).scalar()
    return seen.withColumn("is_current", F.col("model_version") == current)


def performance_rows(quality: DataFrame, metrics: DataFrame, logs: DataFrame) -> DataFrame:
    """Evaluation rows (``model_version``, ``evaluation_date``, errors) with the name, run, stage and business metrics of the version.

    The version in use is in production, others are archived. Versions without metrics keep nulls.
    """
    runs = logs.groupBy("model_version").agg(F.max("model_name").alias("model_name"), F.max("model_run_id").alias("model_run_id"))
    stage = deployment_history(logs).select(
        "model_version", F.when(F.col("is_current"), "production").otherwise("archived").alias("stage"), F.col("is_current").alias("is_production"))
    return quality.join(runs.join(stage, "model_version").join(metrics, "model_version", "left"), "model_version", "left")


def error_profile(events: DataFrame, logs: DataFrame, group: list[str]) -> DataFrame:
    """Watch-completion error of the constant 0.5 per group, as a stand-in quality record.

    ``mse``, ``rmse``, ``mae``, ``r2_score`` and ``error_rate`` (share of negative feedback) in one aggregation.
    """
    joined = events.join(logs.select("recommendation_id", "model_version"), "recommendation_id")
    e = F.when(kind("watch"), F.col("completion_rate") - 0.5)
    out = joined.groupBy(*group).agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.var_pop(F.when(kind("watch"), F.col("completion_rate"))).alias("_var"),
        F.avg(F.when(F.col("feedback_type").isin("dislike", "not_interested"), 1.0).otherwise(0.0)).alias("error_rate"),
        F.count(F.lit(1)).alias("sample_count"),
    )
    return out.withColumn("rmse", F.sqrt("mse")).withColumn("r2_score", 1 - F.try_divide(F.col("mse"), F.col("_var"))).drop("_var")
