import datetime as dt

import pytest
from pyspark.sql import functions as F

from tasteloom.operators import experiments as ex
from tasteloom.operators import feedback as fb
from tasteloom.operators import features as fe
from tasteloom.functions.expr import clamp, percent, right_closed_bin

AS_OF = "2024-01-31"
EVENT = ("event_id long, event_type string, user_id long, item_id long, recommendation_id string, completion_rate double, "
         "feedback_type string, rating double, is_synthetic boolean, created_at timestamp_ntz")


def events(spark, rows):
    """rows: (type, user, item, rec, completion, feedback, rating[, minute])"""
    full = []
    for i, r in enumerate(rows):
        minute = r[7] if len(r) > 7 else i
        full.append((i, r[0], r[1], r[2], r[3], r[4], r[5], r[6], False, dt.datetime(2024, 1, 30, 0, 0) + dt.timedelta(minutes=minute)))
    return spark.createDataFrame(full, EVENT)


def test_bins(spark):
    df = spark.createDataFrame([(1,), (18,), (19,), (56,), (57,), (None,), (0,)], "Age int")
    assert [r.g for r in df.select(fe.age_group("Age").alias("g")).collect()] == ["<18", "<18", "18-25", "50+", None, None, None]
    pop = spark.createDataFrame([(0,), (10,), (11,), (50,), (500,), (501,)], "p long")
    assert [r.g for r in pop.select(fe.popularity_category("p").alias("g")).collect()] == ["Very Low", "Very Low", "Low", "Low", "High", "Very High"]


def test_days_to_last_rating(spark):
    last = 1_000_000_000
    rows = [(1, 1, 5.0, last), (1, 2, 4.0, last - 86400 + 60), (1, 3, 3.0, last - 86400)]
    out = fe.interaction_features(spark.createDataFrame(rows, "UserID long, MovieID long, Rating double, Timestamp long"))
    assert {r.MovieID: r.days_to_last_rating for r in out.collect()} == {1: 0, 2: 0, 3: 1}
    assert {r.MovieID: r.days_since_first_rating for r in out.collect()} == {1: 1, 2: 0, 3: 0}


def test_user_without_ratings_gets_defaults(spark):
    users = spark.createDataFrame([(1, "M", 30, 2, "11111"), (2, "F", 60, None, "22222")], "UserID long, Gender string, Age int, Occupation int, ZipCode string")
    ratings = spark.createDataFrame([(1, 1, 4.0, 10)], "UserID long, MovieID long, Rating double, Timestamp long")
    rows = {r.UserID: r for r in fe.user_features(users, ratings, [1, 2]).collect()}
    assert (rows[2].RatingCount, rows[2].AvgRating, rows[2].Occupation_2, rows[2].AgeGroup) == (0, 0.0, 0, None)
    assert (rows[1].StdRating, rows[1].GenderMale, rows[1].Occupation_2) == (0.0, 1, 1)


def test_vocabulary_is_sorted_and_bounded(spark):
    df = spark.createDataFrame([("b|a",), ("c",)], "g string")
    assert fe.learn_vocabulary(df, "g", "|") == ["a", "b", "c"]
    with pytest.raises(ValueError):
        fe.learn_vocabulary(df, "g", "|", limit=2)


@pytest.mark.parametrize("rows,label", [
    ([("click", 1, 1, "r", None, None, None)], 1.0),
    ([("click", 1, 1, "r", None, None, None), ("watch", 1, 1, "r", 0.10, None, None)], 1.5),
    ([("click", 1, 1, "r", None, None, None), ("watch", 1, 1, "r", 0.25, None, None)], 1.5),
    ([("click", 1, 1, "r", None, None, None), ("watch", 1, 1, "r", 0.26, None, None)], 2.5),
    ([("click", 1, 1, "r", None, None, None), ("watch", 1, 1, "r", 0.75, None, None)], 2.5),
    ([("click", 1, 1, "r", None, None, None), ("watch", 1, 1, "r", 0.76, None, None)], 4.0),
    ([("click", 1, 1, "r", None, None, None), ("watch", 1, 1, "r", 0.9, None, None), ("feedback", 1, 1, "r", None, "like", None)], 5.0),
    ([("click", 1, 1, "r", None, None, None), ("feedback", 1, 1, "r", None, "dislike", None), ("feedback", 1, 1, "r", None, "not_interested", None)], 0.0),
    ([("click", 1, 1, "r", None, None, None), ("feedback", 1, 1, "r", None, "like", None), ("feedback", 1, 1, "r", None, "rating", 2.0)], 2.0),
])
def test_labels(spark, rows, label):
    assert [r.label for r in fb.build_labels(events(spark, rows), AS_OF).collect()] == [label]


def test_no_click_no_label_and_later_recommendation_wins(spark):
    assert fb.build_labels(events(spark, [("watch", 1, 1, "r", 0.9, None, None)]), AS_OF).count() == 0
    two = events(spark, [("click", 1, 1, "r1", None, None, None, 5), ("click", 1, 1, "r2", None, None, None, 1), ("watch", 1, 1, "r2", 0.9, None, None, 2)])
    assert [(r.label, r.recommendation_id) for r in fb.build_labels(two, AS_OF).collect()] == [(1.0, "r1")]


def logs(spark, rows):
    return spark.createDataFrame([(r, 1, v, dt.datetime(2024, 1, 30, 1)) for r, v in rows], "recommendation_id string, user_id long, model_version string, created_at timestamp_ntz")


def test_ctr_counts_recommendations_not_clicks(spark):
    log = logs(spark, [("a", "v1"), ("b", "v1"), ("c", "v1"), ("d", "v1"), ("e", "v2")])
    ev = events(spark, [("click", 1, 1, "a", None, None, None)] * 2 + [("click", 1, 1, "b", None, None, None)])
    rows = {r.model_version: r for r in fb.ctr_by_version_day(log, ev, AS_OF).collect()}
    assert (rows["v1"].impressions, rows["v1"].clicks, rows["v1"].ctr_percent) == (4, 2, 50.0)
    assert (rows["v2"].clicks, rows["v2"].ctr_percent) == (0, 0.0)


def test_funnel_without_impressions(spark):
    row = fb.engagement_funnel(logs(spark, []), events(spark, [("click", 1, 1, "a", None, None, None)]), AS_OF).first()
    assert (row.impressions, row.clicks, row.ctr) == (0, 1, None)


def test_labels_do_not_fan_out(spark):
    log = logs(spark, [("a", "v1")])
    ev = events(spark, [("click", 1, 1, "a", None, None, None)] * 3 + [("click", 1, 2, "a", None, None, None)])
    labels = spark.createDataFrame([(1, 1, 5.0), (1, 2, 1.0)], "user_id long, item_id long, label double")
    assert fb.version_metrics(log, ev, labels).first().avg_engagement_score == 3.0


def performance(spark, **over):
    base = {"rmse": 1.0, "mae": 1.0, "r2_score": 0.6, "ctr": 20.0, "watch_rate": 40.0, "p95_latency_ms": 100.0, "error_rate": 0.005}
    cand = {**base, **over}
    cols = list(base)
    return spark.createDataFrame([("b", *[base[c] for c in cols]), ("c", *[cand[c] for c in cols])], "model_version string, " + ", ".join(f"{c} double" for c in cols))


@pytest.mark.parametrize("over,gate,status", [
    ({"rmse": 1.09}, "rmse_degradation", "passed"), ({"rmse": 1.11}, "rmse_degradation", "failed"),
    ({"mae": 1.2}, "mae_degradation", "failed"), ({"r2_score": 0.5}, "r2_score", "passed"), ({"r2_score": 0.49}, "r2_score", "failed"),
    ({"ctr": 19.0}, "ctr_ratio", "passed"), ({"ctr": 18.9}, "ctr_ratio", "failed"), ({"watch_rate": 30.0}, "watch_rate_ratio", "failed"),
    ({"p95_latency_ms": 200.0}, "p95_latency", "passed"), ({"p95_latency_ms": 200.1}, "p95_latency", "failed"), ({"error_rate": 0.02}, "error_rate", "failed"),
])
def test_gates(spark, over, gate, status):
    rows = {r.gate: r.status for r in ex.release_gates(performance(spark, **over), "c", "b", F.lit(1000)).collect()}
    assert rows[gate] == status and len(rows) == 8
    assert ex.gate_decision(ex.release_gates(performance(spark, **over), "c", "b", F.lit(1000))).first().overall_passed == (status == "passed")


def test_missing_metric_leaves_the_gate_out_and_weak_difference_is_inconclusive(spark):
    perf = performance(spark).withColumn("ctr", F.when(F.col("model_version") == "b", F.col("ctr")))
    flat = spark.createDataFrame([(0.1, 0.2), (0.2, 0.1), (0.15, 0.16)], "c double, b double")
    t_row = ex.paired_t(flat, F.col("c"), F.col("b"))
    rows = {r.gate: r.status for r in ex.release_gates(perf, "c", "b", F.lit(10), t_row).collect()}
    assert "ctr_ratio" not in rows and rows["sample_size"] == "failed" and rows["statistical_significance"] == "inconclusive"


def test_ab_decisions(spark):
    def decide(xb, watches_b):
        rows = [("control", 1000, 200, 250, 100), ("treatment", 1000, xb, 250, watches_b)]
        return ex.ab_result(spark.createDataFrame(rows, "arm string, n long, x long, clicks long, watches long"), "e", 50).first().decision

    assert (decide(260, 120), decide(260, 90), decide(205, 120), decide(140, 90)) == ("promote", "continue", "continue", "rollback")


def test_trigger_order(spark):
    def fired(n, c, m):
        one = lambda v: spark.createDataFrame([(v,)], "fired boolean")
        return fb.retraining_decision(one(n), one(c), one(m)).first()

    assert (fired(True, True, True).reason, fired(False, True, True).reason, fired(False, False, True).reason) == ("new_events", "ctr_drop", "manual")
    assert fired(False, False, False).decision == "skip_training"


def test_expressions(spark):
    row = spark.range(1).select(
        percent(F.lit(1), F.lit(0)).alias("z"), clamp(F.lit(7.0), 0.0, 5.0).alias("c"), right_closed_bin(F.lit(10), [0, 10, 20], ["a", "b"]).alias("b")
    ).first()
    assert (row.z, row.c, row.b) == (None, 5.0, "a")


def test_sticky_arm(spark):
    df = spark.range(1000).select("id", ex.assign_arm("id", "e1", 30).alias("a"), ex.assign_arm("id", "e2", 30).alias("b"))
    rows = df.collect()
    assert rows == df.repartition(7).orderBy("id").collect()
    assert 240 < sum(r.a == "treatment" for r in rows) < 360 and any(r.a != r.b for r in rows)
