"""Distribution drift between a baseline and a current sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import clamp, ratio
from ..functions.tails import chi_square_p, ks_p_value
from .scale import quantile_columns, running_totals, value_counts

# Thresholds of the drift configuration.
WARNING, CRITICAL = 0.15, 0.25
ALPHA = 0.05
PSI_THRESHOLD = 0.25
DRIFT_SHARE = 0.30
EPSILON = 1e-6
MIN_VALUES = 10
PERFORMANCE_DRIFT = 0.15


def sample_counts(baseline: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, value, nb, nc)``: occurrences per distinct value in both samples."""

    def long(df: DataFrame, b: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
        return df.select(F.inline(cells)).filter(F.col("value").isNotNull()).withColumn("b", F.lit(b))

    both = long(baseline, 1).unionByName(long(current, 0))
    return value_counts(both, ["feature"], "value", {"nb": F.sum("b"), "nc": F.sum(1 - F.col("b"))})


def distributions(counts: DataFrame) -> DataFrame:
    """Sample counts with both running totals: the base of PSI break points and KS alike."""
    return running_totals(counts, ["feature"], "value", ["nb", "nc"], few_keys=True)


def _ks_columns() -> list[Column]:
    gap = F.abs(F.try_divide(F.col("nb_upto"), F.col("nb_all")) - F.try_divide(F.col("nc_upto"), F.col("nc_all")))
    return [F.max(gap).alias("statistic"), F.max("nb_all").alias("n_baseline"), F.max("nc_all").alias("n_current")]


def _enough(minimum: int) -> Column:
    """A feature counts only where both samples hold enough values of it."""
    return F.least("n_baseline", "n_current") >= minimum


def ks(counts: DataFrame, minimum: int = MIN_VALUES) -> DataFrame:
    """Two-sample KS statistic and asymptotic p-value per feature with at least ``minimum`` values in each sample."""
    out = distributions(counts).groupBy("feature").agg(*_ks_columns()).filter(_enough(max(minimum, 1)))
    return out.withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n_baseline"), F.col("n_current")))


def feature_drift(counts: DataFrame, bins: int = 10, minimum: int = MIN_VALUES) -> DataFrame:
    """PSI and KS per feature: ``feature, psi, statistic, n_baseline, n_current, p_value``.

    PSI bins are baseline quantiles with repeats removed; the last bin is closed and values
    outside all bins drop. The ordered pass runs once and yields one row per feature, which
    goes back to the plain counts as a broadcast bounded by the number of columns. Features with
    fewer than ``minimum`` values in either sample are left out.
    """
    probs = [i / bins for i in range(bins + 1)]
    profile = distributions(counts).groupBy("feature").agg(
        F.array(*quantile_columns("value", "nb", probs)).alias("p"), *_ks_columns()
    ).filter(_enough(minimum)).withColumn("p", F.array_sort(F.array_distinct(F.array_compact("p"))))
    placed = counts.join(F.broadcast(profile), "feature")
    value, points = F.col("value"), F.col("p")
    passed = F.expr(" + ".join(f"coalesce(int(value >= get(p, {i})), 0)" for i in range(1, bins + 1)))
    k = F.size(points) - 1
    inside = (value >= F.get(points, F.lit(0))) & (value <= F.element_at(points, -1)) & (k > 0)
    carried = ["feature", "statistic", "n_baseline", "n_current"]
    per_bin = placed.groupBy(*carried, k.alias("k"), F.when(inside, F.least(passed, k - 1)).alias("bin")).agg(
        F.sum("nb").alias("nb"), F.sum("nc").alias("nc")
    )
    kept = F.col("bin").isNotNull()
    cells = per_bin.groupBy(*carried, "k").agg(
        F.map_from_entries(F.collect_list(F.when(kept, F.struct("bin", F.struct("nb", "nc"))))).alias("m"),
        F.sum(F.when(kept, F.col("nb"))).alias("tb"), F.sum(F.when(kept, F.col("nc"))).alias("tc"),
    )

    def share(side: str, total: str, i: Column) -> Column:
        n = F.coalesce(F.try_element_at("m", i).getField(side), F.lit(0))
        return (n + EPSILON) / (F.coalesce(F.col(total), F.lit(0)) + EPSILON * F.col("k"))

    def term(acc: Column, i: Column) -> Column:
        b, c = share("nb", "tb", i), share("nc", "tc", i)
        return acc + (c - b) * F.log(c / b)

    slots = F.when(F.col("k") > 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array().cast("array<int>"))
    return cells.select(
        "feature", F.aggregate(slots, F.lit(0.0), term).alias("psi"), "statistic", "n_baseline", "n_current",
        ks_p_value(F.col("statistic"), F.col("n_baseline"), F.col("n_current")).alias("p_value"),
    )


def feature_summary(df: DataFrame, sample: str, columns: Sequence[str], minimum: int = MIN_VALUES) -> DataFrame:
    """Count, mean, population std, min and max per column in one pass, columns with too few values left out."""
    parts = {"n": F.count, "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    one = df.agg(*[fn(c).alias(f"_{i}_{p}") for i, c in enumerate(columns) for p, fn in parts.items()])
    cells = [
        F.struct(
            F.lit(c).alias("feature"), F.lit(sample).alias("sample"), F.col(f"_{i}_n").alias("n"),
            *[F.col(f"_{i}_{p}").cast("double").alias(p) for p in list(parts)[1:]],
        )
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*cells))).filter(F.col("n") >= minimum)


def summary_pair(baseline: DataFrame, current: DataFrame, columns: Sequence[str], minimum: int = MIN_VALUES) -> DataFrame:
    """``feature_summary`` of both samples; a feature with too few values in either is left out of both."""
    rows = feature_summary(baseline, "baseline", columns, 0).unionByName(feature_summary(current, "current", columns, 0))
    enough = rows.groupBy("feature").agg(F.min("n").alias("_least")).filter(F.col("_least") >= minimum).select("feature")
    return rows.join(enough, "feature", "left_semi")


def _share_columns(alpha: float = ALPHA) -> list[Column]:
    return [F.count_if(F.col("p_value") < alpha).alias("n_drifted"), F.count(F.lit(1)).alias("n_columns")]


def drift_share(ks_rows: DataFrame, alpha: float = ALPHA, limit: float = DRIFT_SHARE) -> DataFrame:
    """Share of drifted columns; the dataset drifts above ``limit``."""
    one = ks_rows.agg(*_share_columns(alpha))
    share = F.coalesce(ratio("n_drifted", "n_columns"), F.lit(0.0))
    return one.withColumn("share_drifted", share).withColumn("dataset_drift", F.col("share_drifted") > limit)


def severity(score: Column) -> Column:
    return F.when(score >= CRITICAL, "critical").when(score >= WARNING, "warning").otherwise("none")


def _with_overall(one: DataFrame) -> DataFrame:
    out = one.withColumn("share_drifted", F.coalesce(ratio("n_drifted", "n_columns"), F.lit(0.0)))
    return out.withColumn("score", F.greatest("max_psi", "share_drifted")).withColumn("severity", severity(F.col("score")))


def overall(drift_rows: DataFrame) -> DataFrame:
    """The worst PSI against the share of drifted columns, with its severity."""
    one = drift_rows.agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"), *_share_columns())
    return _with_overall(one).select(
        "max_psi", "share_drifted", "score", "severity", (F.col("severity") != "none").alias("drift_detected")
    )


def chi_square(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Chi-square of a category's counts in two samples: ``statistic, dof``."""
    side = baseline.select(F.col(column).alias("v")).withColumn("b", F.lit(1)).unionByName(
        current.select(F.col(column).alias("v")).withColumn("b", F.lit(0))
    )
    cells = side.filter(F.col("v").isNotNull()).groupBy("v").agg(F.sum("b").alias("nb"), F.sum(1 - F.col("b")).alias("nc"))
    totals = cells.agg(F.struct(F.sum("nb").alias("tb"), F.sum("nc").alias("tc"))).scalar()
    both = cells.withColumn("_t", totals)
    tb, tc = F.col("_t.tb").cast("double"), F.col("_t.tc").cast("double")
    row = (F.col("nb") + F.col("nc")).cast("double")
    eb, ec = row * tb / (tb + tc), row * tc / (tb + tc)
    term = (F.col("nb") - eb) * (F.col("nb") - eb) / eb + (F.col("nc") - ec) * (F.col("nc") - ec) / ec
    return both.agg(F.sum(term).alias("statistic"), (F.count(F.lit(1)) - 1).alias("dof")).select(F.lit(column).alias("feature"), "statistic", "dof")


def with_chi_p(rows: DataFrame) -> DataFrame:
    return rows.withColumn("p_value", chi_square_p(F.col("statistic"), F.col("dof").cast("double")))


def report(baseline: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per feature and one ``overall`` row: ``feature, psi, ks_statistic, p_value, score, severity``.

    The feature rows (as many as columns) travel in one array beside their roll-up, so the
    samples are read once.
    """
    per = feature_drift(sample_counts(baseline, current, columns))
    row = F.struct(
        "feature", "psi", F.col("statistic").alias("ks_statistic"), "p_value", F.col("psi").alias("score"), severity(F.col("psi")).alias("severity")
    )
    one = _with_overall(per.agg(
        F.collect_list(row).alias("rows"), F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"), *_share_columns()
    ))
    none = F.lit(None).cast("double")
    total = F.struct(
        F.lit("overall").alias("feature"), F.col("max_psi").alias("psi"), none.alias("ks_statistic"), none.alias("p_value"), "score", "severity"
    )
    return one.select(F.inline(F.concat("rows", F.array(total))))


def gauges(report_rows: DataFrame) -> DataFrame:
    """The report as metric samples ``(metric, feature, value)``."""
    level = F.when(F.col("severity") == "critical", 2.0).when(F.col("severity") == "warning", 1.0).otherwise(0.0)
    cells = F.array(
        F.struct(F.lit("drift_score").alias("metric"), F.col("score").alias("value")),
        F.struct(F.lit("drift_severity").alias("metric"), level.alias("value")),
        F.struct(F.lit("drift_detected").alias("metric"), F.when(level > 0, 1.0).otherwise(0.0).alias("value")),
    )
    return report_rows.select("feature", F.inline(cells)).select("metric", "feature", "value")


def performance_drift(baseline_rmse: Column, current_rmse: Column) -> list[Column]:
    score = clamp(F.try_divide(current_rmse - baseline_rmse, baseline_rmse), 0.0, 1.0)
    return [score.alias("score"), (score > PERFORMANCE_DRIFT).alias("drift_detected")]
