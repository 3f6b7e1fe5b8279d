"""Recommendation model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import hash_bucket, r6
from ..operators import factorize as fz
from ..operators import recommend as rc
from ..operators import relational as rel
from ..operators.features import movie_stats
from ..operators.scale import stored
from ..session import scratch
from .registry import query
from .relational import BUCKET, CELLS, cells_by_split

RANK = 20
ITERATIONS = 200
_fitted: dict[tuple[str, str, str], fz.Factors] = {}


def fitted(t, part: str, cells) -> fz.Factors:
    """One fit per session, data folder and training part; the queries share its written tables."""
    key = (t.spark.sparkContext.applicationId, t.path, part)
    if key not in _fitted:
        _fitted[key] = fz.fit_nmf(t.spark, cells, RANK, ITERATIONS)
    return _fitted[key]


def forget() -> None:
    _fitted.clear()


@query("r01_mean_baseline", """
SELECT round(max(m), 6) AS baseline_value, round(sqrt(avg((Rating - m) * (Rating - m))), 6) AS rmse, round(avg(abs(Rating - m)), 6) AS mae
FROM ratings, (SELECT avg(Rating) AS m FROM ratings)""")
def mean_baseline(t):
    return rc.mean_baseline(t.ratings).withColumns({c: r6(c) for c in ("baseline_value", "rmse", "mae")})


@query("r02_nmf_factors")
def nmf(t):
    """User factors of the train split; compared by error, not by value."""
    return fitted(t, "train", cells_by_split(t)[0]).users


@query("r02_nmf_reconstruction")
def nmf_error(t):
    train = cells_by_split(t)[0]
    model = fitted(t, "train", train)
    return fz.reconstruction_error(train, model.users, model.items, RANK)


def small_factors(t, ratings=None):
    """Two-column factors straight from the ratings, so that SQL can state the dense result."""
    ratings = t.ratings if ratings is None else ratings
    users = ratings.groupBy("UserID").agg((F.avg("Rating") * 0.2713).alias("f0"), (F.count(F.lit(1)) * 0.01137).alias("f1"))
    items = ratings.groupBy("MovieID").agg((F.avg("Rating") * 0.01931).alias("f0"), (F.count(F.lit(1)) * 0.002719).alias("f1"))
    return users, items


SMALL = """WITH wu AS (SELECT UserID, avg(Rating) * CAST(0.2713 AS DOUBLE) AS f0, CAST(count(*) AS DOUBLE) * CAST(0.01137 AS DOUBLE) AS f1 FROM ratings GROUP BY 1),
wi AS (SELECT MovieID, avg(Rating) * CAST(0.01931 AS DOUBLE) AS f0, CAST(count(*) AS DOUBLE) * CAST(0.002719 AS DOUBLE) AS f1 FROM ratings GROUP BY 1),
cells AS (SELECT UserID, MovieID, avg(Rating) AS value FROM ratings GROUP BY 1, 2),
dense AS (SELECT wu.UserID, wi.MovieID, wu.f0 * wi.f0 + wu.f1 * wi.f1 AS p FROM wu, wi)
"""


@query("r03_reconstruction_error", SMALL + """
SELECT round(sqrt(avg((coalesce(value, 0) - p) * (coalesce(value, 0) - p))), 6) AS reconstruction_rmse, round(avg(abs(coalesce(value, 0) - p)), 6) AS reconstruction_mae,
    round(1 - count(value) / CAST(count(*) AS DOUBLE), 6) AS sparsity, (SELECT count(*) FROM wu) AS n_users, (SELECT count(*) FROM wi) AS n_items
FROM dense LEFT JOIN cells USING (UserID, MovieID)""")
def reconstruction(t):
    users, items = small_factors(t)
    out = fz.reconstruction_error(rel.user_item_matrix(t.ratings), users, items, 2)
    return out.withColumns({c: r6(c) for c in ("reconstruction_rmse", "reconstruction_mae", "sparsity")})


#: Two-factor least squares with w >= 0 in closed form: both free, or one of them zero.
NON_NEGATIVE = """g AS (SELECT sum(f0 * f0) AS a, sum(f0 * f1) AS b, sum(f1 * f1) AS c FROM wi),
solved AS (SELECT UserID, CASE WHEN x > 0 AND y > 0 THEN x WHEN y <= 0 THEN greatest(n0 / a, 0) ELSE 0 END AS f0,
    CASE WHEN x > 0 AND y > 0 THEN y WHEN y <= 0 THEN 0 ELSE greatest(n1 / c, 0) END AS f1 FROM (
        SELECT UserID, n0, n1, a, c, (c * n0 - b * n1) / (a * c - b * b) AS x, (a * n1 - b * n0) / (a * c - b * b) AS y FROM (
            SELECT UserID, sum(value * f0) AS n0, sum(value * f1) AS n1 FROM {cells} JOIN wi USING (MovieID) GROUP BY 1), g))
"""
#: Sweeps of coordinate descent after which two nearly parallel factors have settled.
SETTLED = 4000


@query("r02_half_step", SMALL.rstrip() + ", " + NON_NEGATIVE.format(cells="cells") + "SELECT UserID, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM solved")
def half_step(t):
    """One half-step of the block fit at two factors, from fixed item factors."""
    model = fz.fit_nmf(t.spark, rel.user_item_matrix(t.ratings), 2, 1, start=small_factors(t)[1], sweeps=SETTLED)
    return model.users.select("UserID", r6("f0").alias("f0"), r6("f1").alias("f1"))


@query("r04_holdout_fixed_factors", CELLS + "," + SMALL.removeprefix("WITH").split("cells AS")[0] + """e AS (
SELECT wu.f0 * wi.f0 + wu.f1 * wi.f1 - value AS d FROM cells JOIN wu USING (UserID) JOIN wi USING (MovieID) WHERE is_test)
SELECT round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, count(*) AS pairs FROM e""")
def holdout_fixed(t):
    users, items = small_factors(t)
    scored = fz.score_pairs(cells_by_split(t)[1], users, items, 2)
    return scored.agg(*[r6(c).alias(n) for c, n in zip(rel.error_metrics(F.col("prediction"), F.col("value")), ("rmse", "mae"))], F.count(F.lit(1)).alias("pairs"))


@query("r04_holdout_evaluation")
def holdout(t):
    train, test = cells_by_split(t)
    model = fitted(t, "train", train)
    scored = fz.score_pairs(test, model.users, model.items, RANK)
    return scored.agg(*rel.error_metrics(F.col("prediction"), F.col("value")), F.count(F.lit(1)).alias("pairs"))


@query("r05_masked_evaluation")
def masked(t):
    """Train on 80 % of the users, fold in the others."""
    cells = rel.user_item_matrix(t.ratings).withColumn("b", hash_bucket([F.lit(42), F.col("UserID")], 100))
    train, test = cells.filter("b >= 20").drop("b"), cells.filter("b < 20").drop("b")
    model = fitted(t, "users", train)
    return fz.masked_evaluation(test, fz.fold_in(test, model), model.items, RANK)


@query("r05_masked_fixed_factors", SMALL.rstrip() + ", folded AS (SELECT * FROM cells WHERE " + BUCKET.format("'42|' || CAST(UserID AS VARCHAR)") + " < 20), "
       + NON_NEGATIVE.format(cells="folded") + """, e AS (SELECT value, greatest(0, least(5, s.f0 * wi.f0 + s.f1 * wi.f1)) AS p FROM folded JOIN solved s USING (UserID) JOIN wi USING (MovieID))
SELECT round(sqrt(avg((p - value) * (p - value))), 6) AS rmse, round(avg(abs(p - value)), 6) AS mae, round(avg(CASE WHEN p > 0.000000001 THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS cells FROM e""")
def masked_fixed(t):
    """Unseen users folded in against fixed item factors, then the masked evaluation."""
    cells = rel.user_item_matrix(t.ratings).withColumn("b", hash_bucket([F.lit(42), F.col("UserID")], 100)).filter("b < 20").drop("b")
    cells, items = stored(cells, "cells"), stored(small_factors(t)[1], "items")
    model = fz.Factors(None, items, fz.gram_matrix(items, 2), 2, [])
    out = fz.masked_evaluation(cells, fz.fold_in(cells, model, sweeps=SETTLED), items, 2)
    return out.withColumns({c: r6(c) for c in ("rmse", "mae", "coverage")})


@query("r06_fallback_predictor", """
SELECT UserID, MovieID, "Timestamp", round(greatest(CAST(0.5 AS DOUBLE), least(CAST(5 AS DOUBLE), m.AvgRating + (u.AvgRating - 3) * CAST(0.5 AS DOUBLE))), 6) AS prediction
FROM ratings JOIN user_stats u USING (UserID) JOIN movie_stats m USING (MovieID)""")
def fallback(t):
    u = t.ratings.groupBy("UserID").agg(F.avg("Rating").alias("u"))
    m = t.ratings.groupBy("MovieID").agg(F.avg("Rating").alias("m"))
    return t.ratings.join(u, "UserID").join(m, "MovieID").select("UserID", "MovieID", "Timestamp", r6(rc.fallback_score("u", "m")).alias("prediction"))


@query("r07_batch_scoring", """
SELECT p.UserID, p.MovieID, Title, round(greatest(CAST(0.5 AS DOUBLE), least(CAST(5 AS DOUBLE), coalesce(m.AvgRating, 3) + (coalesce(u.AvgRating, 3) - 3) * CAST(0.5 AS DOUBLE))), 6) AS score
FROM (SELECT DISTINCT user_id AS UserID, item_id AS MovieID FROM user_events) p LEFT JOIN user_stats u USING (UserID) LEFT JOIN movie_stats m USING (MovieID) LEFT JOIN movies USING (MovieID)""")
def batch(t):
    pairs = t.user_events.select(F.col("user_id").alias("UserID"), F.col("item_id").alias("MovieID")).distinct()
    return rc.batch_score(pairs, t.ratings, t.movies).withColumn("score", r6("score"))


@query("r07_campaign_totals", """
WITH chosen AS (SELECT MovieID, AvgRating AS m FROM movie_stats WHERE Popularity >= 10 ORDER BY AvgRating DESC, MovieID LIMIT 10),
s AS (SELECT MovieID, greatest(CAST(0.5 AS DOUBLE), least(CAST(5 AS DOUBLE), m + (AvgRating - 3) * CAST(0.5 AS DOUBLE))) AS score FROM chosen, user_stats)
SELECT MovieID, count(*) AS users, round(avg(score), 6) AS avg_score, count(*) FILTER (WHERE score >= 4) AS likely_viewers FROM s GROUP BY 1""")
def campaign(t):
    chosen = movie_stats(t.ratings).filter("Popularity >= 10").orderBy(F.desc("AvgRating"), "MovieID").limit(10)
    return rc.campaign(t.ratings, chosen.select("MovieID", F.col("AvgRating").alias("movie_avg"))).withColumn("avg_score", r6("avg_score"))


@query("r08_top_k", SMALL + """
SELECT UserID, MovieID, score, CAST(rn AS INTEGER) AS rank, sha256('run-1|' || CAST(UserID AS VARCHAR)) AS recommendation_id FROM (
    SELECT *, row_number() OVER (PARTITION BY UserID ORDER BY score DESC, MovieID) AS rn FROM (
        SELECT UserID, MovieID, round(p, 6) AS score FROM dense ANTI JOIN cells USING (UserID, MovieID))) WHERE rn <= 10""")
def top_k(t):
    # lines and orders meet once for both sides' factors and the seen pairs
    ratings = stored(t.ratings.select("UserID", "MovieID", "Rating"), "ratings")
    users, items = small_factors(t, ratings)
    top = rc.top_k_items(users, items, ["f0", "f1"], 10, seen=ratings.select("UserID", "MovieID"))
    return rc.with_recommendation_id(top, "run-1")


@query("r09_cold_start", """
SELECT MovieID, Title, Genres, Popularity, avg_rating FROM (SELECT MovieID, Popularity, round(AvgRating, 2) AS avg_rating FROM movie_stats WHERE Popularity >= 25
    ORDER BY avg_rating DESC, Popularity DESC, MovieID LIMIT 10) JOIN movies USING (MovieID)""")
def cold_start(t):
    return rc.cold_start(t.ratings, t.movies, min_ratings=25)


@query("r10_user_history", """
SELECT UserID, MovieID, Rating, "Timestamp", CAST(rn AS INTEGER) AS rank, Title, Genres FROM (SELECT *, row_number() OVER (PARTITION BY UserID
    ORDER BY "Timestamp" DESC, MovieID, Rating) AS rn FROM ratings) JOIN movies USING (MovieID) WHERE rn <= 10""")
def history(t):
    return rc.history(t.ratings, t.movies, 10)


@query("r10_favourite_genres", """
WITH g AS (SELECT UserID, genre, count(*) AS n FROM ratings JOIN (SELECT MovieID, unnest(string_split(Genres, '|')) AS genre FROM movies) USING (MovieID) GROUP BY 1, 2)
SELECT UserID, genre, n, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY UserID ORDER BY n DESC, genre) AS rn FROM g) WHERE rn <= 3""")
def favourites(t):
    return rc.favourite_genres(t.ratings, t.movies)


@query("r11_offline_quality", """
WITH s AS (SELECT Rating AS a, round(AvgRating, 6) AS p FROM ratings JOIN movie_stats USING (MovieID))
SELECT round(sqrt(avg((p - a) * (p - a))), 6) AS rmse, round(avg(abs(p - a)), 6) AS mae, CAST(1 AS DOUBLE) AS coverage,
    round(avg(CASE WHEN p - a >= -1 THEN 1 ELSE 0 END), 6) AS hit_within_1_star, round(quantile_cont(abs(p - a), 0.95), 6) AS p95_abs_error FROM s""")
def offline(t):
    means = t.ratings.groupBy("MovieID").agg(r6(F.avg("Rating")).alias("prediction"))
    scored = t.ratings.join(means, "MovieID", "left").select("prediction", F.col("Rating").alias("actual"))
    return rc.offline_quality(scored).withColumns({c: r6(c) for c in ("rmse", "mae", "hit_within_1_star", "p95_abs_error")})


SCORED = """WITH s AS (SELECT run_id, experiment, coalesce(CASE WHEN NOT isnan(rmse) THEN rmse END, baseline_rmse) AS rmse,
    coalesce(CASE WHEN NOT isnan(mae) THEN mae END, baseline_mae) AS mae FROM runs), scored AS (SELECT *, (rmse + mae) / 2 AS score FROM s)
"""


@query("r12_run_comparison", SCORED + """
SELECT experiment, round(min(score), 6) AS best_score, round(max(score), 6) AS worst_score, round(avg(score), 6) AS avg_score,
    first(run_id ORDER BY score, run_id) FILTER (WHERE score IS NOT NULL) AS best_run, count(*) FILTER (WHERE score IS NULL) AS unscored FROM scored GROUP BY 1""")
def compare_runs(t):
    return rc.compare_runs(t.runs).withColumns({c: r6(c) for c in ("best_score", "worst_score", "avg_score")})


@query("r13_model_selection", SCORED + """
, k AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY score, run_id) AS rn FROM scored WHERE score IS NOT NULL)
SELECT experiment, run_id, rmse, mae, round(score, 6) AS score, CAST(rn AS INTEGER) AS rank, CASE WHEN rn = 1 THEN 'selected' ELSE 'runner_up' END AS role, version
FROM k LEFT JOIN (SELECT run_id, max(version) AS version FROM model_versions GROUP BY 1) USING (run_id) WHERE rn <= 3""")
def selection(t):
    return rc.select_best(t.runs, t.model_versions).withColumn("score", r6("score"))


@query("r14_rollback_target", """
SELECT model_name, max(version) FILTER (WHERE stage = 'Production') AS production_version,
    max(version) FILTER (WHERE stage IN ('Staging', 'Archived')) AS rollback_version FROM model_versions GROUP BY 1""")
def rollback(t):
    return rc.rollback_targets(t.model_versions)


@query("r15_audit_history", """
SELECT trigger_id, trigger_type, training_status, CAST(created_at AS VARCHAR)[:19] AS created_at FROM retraining_triggers ORDER BY created_at DESC, trigger_id DESC LIMIT 50""")
def audit(t):
    """The audit log as JSON lines on shared storage, read back newest first."""
    path = scratch(t.spark, "audit")
    log = t.retraining_triggers.select("trigger_id", "trigger_type", "training_status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
    log.write.json(path)
    back = t.spark.read.schema("trigger_id bigint, trigger_type string, training_status string, at string").json(path)
    return rc.newest_first(back, ["at", "trigger_id"], 50).select(
        "trigger_id", "trigger_type", "training_status", F.substring("at", 1, 19).alias("created_at")
    )


@query("r16_forest_split", "SELECT CASE WHEN " + BUCKET.format("'42|' || CAST(vec_id AS VARCHAR)") + """ < 20 THEN 'test' ELSE 'train' END AS split, CAST(label AS DOUBLE) AS label, count(*) AS n
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL GROUP BY ALL""")
def forest_split(t):
    return rc.forest_rows(t.raw("embeddings"), "vec_id", "embedding", "label").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("r16_random_forest")
def forest(t):
    return rc.forest_accuracy(t.raw("embeddings"), "vec_id", "embedding", "label")
