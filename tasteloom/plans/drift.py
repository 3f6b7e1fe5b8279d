"""Drift queries: line items before and after mid-1998 as the two samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import drift as dr
from .registry import query

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SPLIT = "1998-07-01"


def samples(t):
    lines = t.raw("lineitem").select("l_shipdate", "l_returnflag", *COLUMNS)
    at = F.lit(SPLIT).cast("timestamp_ntz")
    return lines.filter(F.col("l_shipdate") < at), lines.filter(F.col("l_shipdate") >= at)


def event_samples(t):
    """Two clearly different samples: event values before the split, halved and shifted values after it."""
    e = t.raw("events").select("ts", "value", (F.col("value") * 0.5 + 20).alias("shifted"))
    at = F.lit("2024-01-16").cast("timestamp_ntz")
    return e.filter(F.col("ts") < at).select("value", F.col("value").alias("shifted")), e.filter(F.col("ts") >= at).select("value", "shifted")


def long_sql():
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} + CAST(0 AS DOUBLE) AS value, l_shipdate < DATE '{SPLIT}' AS b FROM lineitem" for c in COLUMNS
    )


EVENTS_LONG = """SELECT 'value' AS feature, value, ts < DATE '2024-01-16' AS b FROM events UNION ALL
    SELECT 'shifted', CASE WHEN ts < DATE '2024-01-16' THEN value ELSE value * 0.5 + 20 END, ts < DATE '2024-01-16' FROM events"""


def psi_sql(long, name):
    return f"""{name}_pts AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS p
        FROM {long} WHERE b GROUP BY feature),
    {name}_bins AS (SELECT feature, p, unnest(range(1, len(p))) AS i FROM {name}_pts WHERE len(p) > 1),
    {name}_n AS (SELECT x.feature, x.i, count(*) FILTER (WHERE l.b) AS nb, count(*) FILTER (WHERE NOT l.b) AS nc FROM {name}_bins x
        LEFT JOIN {long} l ON l.feature = x.feature AND l.value >= x.p[x.i] AND (l.value < x.p[x.i + 1] OR (x.i = len(x.p) - 1 AND l.value = x.p[x.i + 1])) GROUP BY 1, 2),
    {name}_s AS (SELECT *, (nb + 1e-6) / (sum(nb) OVER w + 1e-6 * count(*) OVER w) AS sb, (nc + 1e-6) / (sum(nc) OVER w + 1e-6 * count(*) OVER w) AS sc
        FROM {name}_n WINDOW w AS (PARTITION BY feature)),
    {name} AS (SELECT feature, coalesce(sum((sc - sb) * ln(sc / sb)), 0) AS psi FROM {name}_pts LEFT JOIN {name}_s USING (feature) GROUP BY 1)"""


def ks_sql(long, name):
    return f"""{name}_c AS (SELECT feature, value, count(*) FILTER (WHERE b) AS nb, count(*) FILTER (WHERE NOT b) AS nc FROM {long} GROUP BY 1, 2),
    {name}_r AS (SELECT feature, CAST(sum(nb) OVER o AS DOUBLE) / sum(nb) OVER p AS f1, CAST(sum(nc) OVER o AS DOUBLE) / sum(nc) OVER p AS f2,
        CAST(sum(nb) OVER p AS BIGINT) AS n1, CAST(sum(nc) OVER p AS BIGINT) AS n2 FROM {name}_c
        WINDOW o AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature)),
    {name}_d AS (SELECT feature, max(abs(f1 - f2)) AS statistic, max(n1) AS n_baseline, max(n2) AS n_current FROM {name}_r GROUP BY 1),
    {name}_l AS (SELECT *, CAST(n_baseline AS DOUBLE) * n_current / (n_baseline + n_current) * statistic * statistic AS lam2 FROM {name}_d),
    {name} AS (SELECT feature, statistic, n_baseline, n_current, CASE WHEN lam2 < 0.04 THEN 1.0 ELSE greatest(0, least(1, 2 * list_sum(list_transform(
        range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(CAST(-2.0 * j * j AS DOUBLE) * lam2))))) END AS p_value FROM {name}_l)"""


BASE = f"WITH long AS ({long_sql()}), {psi_sql('long', 'psi')}, {ks_sql('long', 'ks')}"
BASE_E = f"WITH long AS ({EVENTS_LONG}), {psi_sql('long', 'psi')}, {ks_sql('long', 'ks')}"
SEVERITY = "CASE WHEN {0} >= 0.25 THEN 'critical' WHEN {0} >= 0.15 THEN 'warning' ELSE 'none' END"


@query("d02_psi", BASE + " SELECT feature, round(psi, 6) AS psi FROM psi")
def psi(t):
    return dr.feature_drift(dr.sample_counts(*samples(t), COLUMNS)).select("feature", r6("psi").alias("psi"))


@query("d02_psi_shifted", BASE_E + " SELECT feature, round(psi, 6) AS psi FROM psi")
def psi_shifted(t):
    return dr.feature_drift(dr.sample_counts(*event_samples(t), ["value", "shifted"])).select("feature", r6("psi").alias("psi"))


@query("d03_two_sample_ks", BASE + " SELECT feature, round(statistic, 6) AS statistic, n_baseline, n_current, round(p_value, 6) AS p_value FROM ks")
def ks(t):
    return dr.ks(dr.sample_counts(*samples(t), COLUMNS)).withColumns({c: r6(c) for c in ("statistic", "p_value")})


def summary_sql(c, sample, cond):
    return f"""SELECT '{c}' AS feature, '{sample}' AS sample, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std,
        round(min({c}) + 0, 6) AS "min", round(max({c}) + 0, 6) AS "max" FROM lineitem WHERE l_shipdate {cond} DATE '{SPLIT}'"""


@query("d04_feature_summary", " UNION ALL ".join(summary_sql(c, s, o) for c in COLUMNS for s, o in (("baseline", "<"), ("current", ">="))))
def summary(t):
    b, c = samples(t)
    out = dr.summary_pair(b, c, COLUMNS)
    return out.withColumns({x: F.round(F.col(x) + 0.0, 6) for x in ("mean", "std", "min", "max")})


SHARE = """SELECT count(*) FILTER (WHERE p_value < 0.05) AS n_drifted, count(*) AS n_columns,
    round(count(*) FILTER (WHERE p_value < 0.05) / CAST(count(*) AS DOUBLE), 6) AS share_drifted,
    count(*) FILTER (WHERE p_value < 0.05) / CAST(count(*) AS DOUBLE) > 0.3 AS dataset_drift FROM ks"""


@query("d05_drift_share", BASE_E + SHARE)
def share(t):
    return dr.drift_share(dr.ks(dr.sample_counts(*event_samples(t), ["value", "shifted"])))


@query("d06_overall_severity", BASE_E + f""", o AS (SELECT (SELECT max(psi) FROM psi) AS max_psi,
    (SELECT count(*) FILTER (WHERE p_value < 0.05) / CAST(count(*) AS DOUBLE) FROM ks) AS share)
SELECT round(max_psi, 6) AS max_psi, share AS share_drifted, round(greatest(max_psi, share), 6) AS score,
    {SEVERITY.format('greatest(max_psi, share)')} AS severity, greatest(max_psi, share) >= 0.15 AS drift_detected FROM o""")
def overall(t):
    rows = dr.feature_drift(dr.sample_counts(*event_samples(t), ["value", "shifted"]))
    return dr.overall(rows).withColumns({c: r6(c) for c in ("max_psi", "score")})


CHI = f"""WITH c AS (SELECT l_returnflag AS v, CAST(count(*) FILTER (WHERE l_shipdate < DATE '{SPLIT}') AS DOUBLE) AS nb, CAST(count(*) FILTER (WHERE l_shipdate >= DATE '{SPLIT}') AS DOUBLE) AS nc FROM lineitem GROUP BY 1),
t AS (SELECT *, sum(nb) OVER () AS tb, sum(nc) OVER () AS tc FROM c), e AS (SELECT *, (nb + nc) * tb / (tb + tc) AS eb, (nb + nc) * tc / (tb + tc) AS ec FROM t),
s AS (SELECT sum((nb - eb) * (nb - eb) / eb + (nc - ec) * (nc - ec) / ec) AS x, count(*) - 1 AS dof FROM e)
"""


@query("d07_chi_square", CHI + """
SELECT 'l_returnflag' AS feature, round(x, 6) AS statistic, dof FROM s""")
def chi(t):
    return dr.chi_square(*samples(t), "l_returnflag").withColumn("statistic", r6("statistic"))


# two degrees of freedom (three flags): the upper tail is exp(-x / 2)
@query("d07_chi_square_p_value", CHI + "SELECT round(x, 6) AS statistic, dof, round(exp(-x / 2), 6) AS p_value FROM s")
def chi_p(t):
    out = dr.with_chi_p(dr.chi_square(*samples(t), "l_returnflag"))
    return out.select(r6("statistic").alias("statistic"), "dof", r6("p_value").alias("p_value"))


@query("d08_dataset_summary", BASE + SHARE)
def dataset(t):
    return dr.drift_share(dr.ks(dr.sample_counts(*samples(t), COLUMNS)))


REPORT = f"""r AS (SELECT feature, psi, statistic AS ks_statistic, p_value, psi AS score, {SEVERITY.format('psi')} AS severity FROM psi JOIN ks USING (feature)),
o AS (SELECT (SELECT max(psi) FROM psi) AS m, (SELECT count(*) FILTER (WHERE p_value < 0.05) / CAST(count(*) AS DOUBLE) FROM ks) AS s),
report AS (SELECT * FROM r UNION ALL SELECT 'overall', m, NULL, NULL, greatest(m, s), {SEVERITY.format('greatest(m, s)')} FROM o)"""


@query("d11_drift_report", BASE_E + f""", {REPORT}
SELECT feature, round(psi, 6) AS psi, round(ks_statistic, 6) AS ks_statistic, round(p_value, 6) AS p_value, round(score, 6) AS score, severity FROM report""")
def report(t):
    return dr.report(*event_samples(t), ["value", "shifted"]).withColumns({c: r6(c) for c in ("psi", "ks_statistic", "p_value", "score")})


@query("m08_drift_gauges", BASE_E + f""", {REPORT}
SELECT 'drift_score' AS metric, feature, round(score, 6) AS value FROM report
UNION ALL SELECT 'drift_severity', feature, CAST(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS DOUBLE) FROM report
UNION ALL SELECT 'drift_detected', feature, CAST(CASE severity WHEN 'none' THEN 0 ELSE 1 END AS DOUBLE) FROM report""")
def gauges(t):
    return dr.gauges(dr.report(*event_samples(t), ["value", "shifted"])).withColumn("value", r6("value"))


@query("r18_performance_drift", f"""
WITH e AS (SELECT sqrt(avg(CASE WHEN "Timestamp" < epoch(TIMESTAMP '{SPLIT}') THEN (Rating - 3) * (Rating - 3) END)) AS b,
    sqrt(avg(CASE WHEN "Timestamp" >= epoch(TIMESTAMP '{SPLIT}') THEN (Rating - 3) * (Rating - 3) END)) AS c FROM ratings)
SELECT round(b, 6) AS baseline_rmse, round(c, 6) AS current_rmse, round(greatest(0, least(1, (c - b) / b)), 6) AS score,
    (c - b) / b > 0.15 AS drift_detected FROM e""")
def performance(t):
    e = F.col("Rating") - 3.0
    early = F.col("Timestamp") < F.unix_timestamp(F.lit(SPLIT).cast("timestamp_ntz"))
    one = t.ratings.agg(
        F.sqrt(F.avg(F.when(early, e * e))).alias("baseline_rmse"), F.sqrt(F.avg(F.when(~early, e * e))).alias("current_rmse")
    )
    out = one.select("*", *dr.performance_drift(F.col("baseline_rmse"), F.col("current_rmse")))
    return out.withColumns({c: r6(c) for c in ("baseline_rmse", "current_rmse", "score")})
