"""Projections, joins, aggregations, windows, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import clamp, off_step, percent, r6, ratio, split_list, stable_id
from ..operators import features as fe
from ..operators import relational as rel
from ..operators.scale import exact_quantiles, keep_first, running_totals, top_k_per_key, value_counts
from ..tables import AS_OF
from .registry import query

BUCKET = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) % 100"
SPLIT_SQL = BUCKET.format("'42|' || CAST(UserID AS VARCHAR) || '|' || CAST(MovieID AS VARCHAR)")


def flag(kind):
    return F.when(F.col("event_type") == kind, 1).otherwise(0)


def is_kind(kind):
    return F.col("event_type") == kind


# --- projections, filters, sampling


@query("p01_project_rename", "SELECT UserID AS user_id, MovieID AS item_id, Rating AS rating FROM ratings")
def project(t):
    return t.ratings.select(F.col("UserID").alias("user_id"), F.col("MovieID").alias("item_id"), F.col("Rating").alias("rating"))


@query("p02_constant_column", "SELECT *, '2024-01-31' AS processing_timestamp FROM movies")
def constant(t):
    return t.movies.withColumn("processing_timestamp", F.lit(AS_OF))


@query("p03_range_filter", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 40""")
def range_filter(t):
    return rel.between(t.raw("lineitem"), "l_quantity", 10.0, 40.0).select("l_orderkey", "l_linenumber", "l_quantity")


@query("p04_dedup_keep_first", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def dedup(t):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]
    lines = t.raw("lineitem").select("l_orderkey", "l_linenumber", *order)
    return keep_first(lines, ["l_orderkey", "l_linenumber"], order)


USER_STATS = "SELECT UserID, Gender, RatingCount, round(AvgRating, 6) AS AvgRating, round(StdRating, 6) AS StdRating FROM users LEFT JOIN user_stats USING (UserID)"


def users_with_stats(t):
    s = fe.user_stats(t.ratings)
    return t.users.join(s, "UserID", "left").select("UserID", "Gender", "RatingCount", r6("AvgRating").alias("AvgRating"), r6("StdRating").alias("StdRating"))


@query("p05_drop_null_rows", f"SELECT * FROM ({USER_STATS}) WHERE RatingCount IS NOT NULL AND AvgRating IS NOT NULL AND StdRating IS NOT NULL")
def drop_nulls(t):
    return users_with_stats(t).na.drop("any")


@query("p06_default_fill", f"""
SELECT UserID, Gender, coalesce(RatingCount, 0) AS RatingCount, coalesce(AvgRating, 0) AS AvgRating,
    coalesce(StdRating, 0) AS StdRating FROM ({USER_STATS})""")
def fill(t):
    return users_with_stats(t).na.fill({"RatingCount": 0, "AvgRating": 0.0, "StdRating": 0.0})


@query("p07_drop_columns", "SELECT UserID, Gender, Age FROM users")
def drop_columns(t):
    return t.users.drop("Occupation", "ZipCode")


@query("p09_relative_date_window", """
SELECT event_id, event_type, created_at FROM user_events WHERE created_at >= DATE '2024-01-31' - INTERVAL 7 DAY""")
def date_window(t):
    return rel.since(t.user_events, "created_at", AS_OF, 7).select("event_id", "event_type", "created_at")


@query("p10_case_flags", """
SELECT event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS is_click,
    CASE WHEN event_type = 'watch' THEN completion_rate ELSE 0 END AS completion,
    CASE WHEN feedback_type = 'like' THEN 1 ELSE 0 END AS is_like FROM user_events""")
def case_flags(t):
    return t.user_events.select(
        "event_id",
        flag("click").alias("is_click"),
        F.when(is_kind("watch"), F.col("completion_rate")).otherwise(0.0).alias("completion"),
        F.when(F.col("feedback_type") == "like", 1).otherwise(0).alias("is_like"),
    )


@query("p11_real_events", "SELECT event_id, user_id FROM user_events WHERE NOT is_synthetic")
def real_events(t):
    return t.user_events.filter(~F.col("is_synthetic")).select("event_id", "user_id")


@query("p12_retention", """
SELECT event_id, CASE WHEN created_at < DATE '2024-01-31' - INTERVAL 14 DAY THEN 'archive' ELSE 'hot' END AS tier FROM user_events""")
def retention(t):
    old, hot = rel.retention(t.user_events.select("event_id", "created_at"), "created_at", AS_OF, 14)
    return old.select("event_id", F.lit("archive").alias("tier")).unionByName(hot.select("event_id", F.lit("hot").alias("tier")))


@query("p13_entity_filter", "SELECT * FROM ratings WHERE UserID = 42")
def entity(t):
    return t.ratings.filter(F.col("UserID") == 42)


@query("p14_page_slice", "SELECT * FROM movies ORDER BY MovieID LIMIT 20 OFFSET 40")
def page(t):
    return rel.page(t.movies, ["MovieID"], number=3, size=20)


@query("p16_sample_fraction", f"SELECT event_id, event_type FROM events WHERE {BUCKET.format('CAST(event_id AS VARCHAR)')} < 80")
def sample_fraction(t):
    return rel.sample_fraction(t.raw("events"), ["event_id"], 80).select("event_id", "event_type")


@query("p16_sample_exact", "SELECT event_id, event_type FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 1000")
def sample_exact(t):
    return rel.sample_exact(t.raw("events").select("event_id", "event_type"), ["event_id"], 1000)


@query("p17_train_test_split", f"SELECT UserID, MovieID, Rating, CASE WHEN {SPLIT_SQL} < 20 THEN 'test' ELSE 'train' END AS split FROM ratings")
def split(t):
    return rel.train_test_split(t.ratings.select("UserID", "MovieID", "Rating"), ["UserID", "MovieID"])


@query("p18_entity_sample", """
WITH chosen AS (SELECT DISTINCT UserID FROM ratings ORDER BY md5(CAST(UserID AS VARCHAR)), UserID LIMIT 50),
d AS (SELECT *, md5(concat_ws('|', UserID, MovieID, CAST("Timestamp" AS VARCHAR), CAST(CAST(Rating AS INTEGER) AS VARCHAR))) AS h FROM ratings WHERE UserID IN (FROM chosen))
SELECT UserID, MovieID, Rating, "Timestamp" FROM (
    SELECT *, row_number() OVER (PARTITION BY UserID ORDER BY h) AS rn FROM d) WHERE rn <= 5""")
def entity_sample(t):
    rated = t.ratings.withColumn("_r", F.col("Rating").cast("int"))
    keys = ["UserID", "MovieID", "Timestamp", "_r"]
    return rel.sample_entities(rated, "UserID", 50, 5, keys).drop("_r")


# --- joins


@query("j01_left_outer", """
SELECT UserID, Gender, RatingCount FROM users LEFT JOIN (SELECT UserID, count(*) AS RatingCount FROM ratings GROUP BY 1) USING (UserID)""")
def left_outer(t):
    counts = t.ratings.groupBy("UserID").agg(F.count(F.lit(1)).alias("RatingCount"))
    return t.users.join(counts, "UserID", "left").select("UserID", "Gender", "RatingCount")


@query("j02_star_join_suffixes", """
SELECT MovieID, UserID, Rating, "Timestamp", Gender, Age, u.RatingCount AS n, Title, m.Popularity AS n_movie
FROM ratings LEFT JOIN users USING (UserID) LEFT JOIN user_stats u USING (UserID)
LEFT JOIN movies USING (MovieID) LEFT JOIN movie_stats m USING (MovieID)""")
def star(t):
    users = t.users.join(t.ratings.groupBy("UserID").agg(F.count(F.lit(1)).alias("n")), "UserID", "left")
    movies = t.movies.join(t.ratings.groupBy("MovieID").agg(F.count(F.lit(1)).alias("n")), "MovieID", "left")
    return rel.star_join(
        t.ratings, [(users.select("UserID", "Gender", "Age", "n"), "UserID", "_user"), (movies.select("MovieID", "Title", "n"), "MovieID", "_movie")]
    )


@query("j03_left_join_on_predicate", """
SELECT r.recommendation_id, r.model_version, e.event_id FROM recommendation_logs r
LEFT JOIN user_events e ON r.recommendation_id = e.recommendation_id AND e.event_type = 'click'""")
def on_predicate(t):
    clicks = t.user_events.filter(is_kind("click")).select("recommendation_id", "event_id")
    logs = t.recommendation_logs.select("recommendation_id", "model_version")
    return rel.left_join_many(logs, clicks, "recommendation_id")


@query("j04_anti_join", """
SELECT event_id, recommendation_id FROM user_events e WHERE NOT EXISTS (
    SELECT 1 FROM recommendation_logs r WHERE r.recommendation_id = e.recommendation_id)""")
def anti(t):
    return rel.orphan_rows(
        t.user_events.select("event_id", "recommendation_id"), "recommendation_id", t.recommendation_logs, "recommendation_id"
    ).select("event_id", "recommendation_id")


@query("j05_two_hop_join", """
WITH pair_labels AS (SELECT user_id, item_id, avg(label) AS label FROM training_labels GROUP BY 1, 2)
SELECT model_version, count(*) AS joined_rows, round(avg(label), 6) AS avg_label FROM recommendation_logs r
LEFT JOIN user_events e ON e.recommendation_id = r.recommendation_id
LEFT JOIN pair_labels l ON l.user_id = e.user_id AND l.item_id = e.item_id GROUP BY 1""")
def two_hop(t):
    from .feedback import training_labels

    pair = training_labels(t).groupBy("user_id", "item_id").agg(F.avg("label").alias("label"))
    # repeated events of a pair travel as one row with a count
    events = t.user_events.groupBy("recommendation_id", "user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    joined = t.recommendation_logs.select("recommendation_id", "model_version").join(events, "recommendation_id", "left")
    labelled = joined.withColumn("n", F.coalesce("n", F.lit(1))).join(pair, ["user_id", "item_id"], "left")
    mean = ratio(F.sum(F.col("n") * F.col("label")), F.sum(F.when(F.col("label").isNotNull(), F.col("n"))))
    return labelled.groupBy("model_version").agg(F.sum("n").alias("joined_rows"), r6(mean).alias("avg_label"))


@query("j06_dimension_enrichment", "SELECT UserID, MovieID, Rating, Title, Genres FROM ratings LEFT JOIN movies USING (MovieID)")
def enrich(t):
    return t.ratings.join(t.movies, "MovieID", "left").select("UserID", "MovieID", "Rating", "Title", "Genres")


def cells_by_split(t):
    cells = rel.user_item_matrix(t.ratings)
    parts = rel.train_test_split(cells, ["UserID", "MovieID"])
    return parts.filter(F.col("split") == "train").drop("split"), parts.filter(F.col("split") == "test").drop("split")


CELLS = f"WITH cells AS (SELECT UserID, MovieID, avg(Rating) AS value, {SPLIT_SQL} < 20 AS is_test FROM ratings GROUP BY 1, 2)"


@query("j07_align_to_vocabulary", CELLS + """
SELECT UserID, MovieID, round(value, 6) AS value FROM cells WHERE is_test
    AND UserID IN (SELECT UserID FROM cells WHERE NOT is_test) AND MovieID IN (SELECT MovieID FROM cells WHERE NOT is_test)""")
def align(t):
    train, test = cells_by_split(t)
    users, items = train.select("UserID").distinct(), train.select("MovieID").distinct()
    return test.join(users, "UserID").join(items, "MovieID").select("UserID", "MovieID", r6("value").alias("value"))


@query("j08_known_pairs", """
SELECT event_id, user_id, item_id FROM user_events WHERE user_id IN (SELECT UserID FROM ratings)
    AND item_id IN (SELECT MovieID FROM ratings)""")
def known(t):
    return rel.known_pairs(
        t.user_events.select("event_id", "user_id", "item_id"),
        {"user_id": t.ratings.select(F.col("UserID").alias("user_id")), "item_id": t.ratings.select(F.col("MovieID").alias("item_id"))},
    ).select("event_id", "user_id", "item_id")


@query("j09_scalar_subquery", """
SELECT event_id, created_at FROM user_events WHERE created_at > (
    SELECT coalesce(max(created_at), TIMESTAMP '2024-01-01') FROM retraining_triggers WHERE training_status = 'success')""")
def scalar(t):
    last = t.retraining_triggers.filter(F.col("training_status") == "success").agg(
        F.coalesce(F.max("created_at"), F.lit("2024-01-01").cast("timestamp_ntz"))
    )
    return t.user_events.filter(F.col("created_at") > last.scalar()).select("event_id", "created_at")


@query("j10_compare_two_rows", """
SELECT count(*) FILTER (WHERE model_version = 'v1') AS recs_a, count(*) FILTER (WHERE model_version = 'v2') AS recs_b,
    count(*) FILTER (WHERE model_version = 'v2') - count(*) FILTER (WHERE model_version = 'v1') AS diff
FROM recommendation_logs""")
def compare(t):
    a, b = F.count_if(F.col("model_version") == "v1"), F.count_if(F.col("model_version") == "v2")
    return t.recommendation_logs.agg(a.alias("recs_a"), b.alias("recs_b"), (b - a).alias("diff"))


@query("j11_predictions_to_actuals", CELLS + """
, p AS (SELECT UserID, avg(value) AS prediction FROM cells WHERE NOT is_test GROUP BY 1)
SELECT UserID, MovieID, round(value, 6) AS actual, round(prediction, 6) AS prediction FROM cells JOIN p USING (UserID) WHERE is_test""")
def predictions(t):
    train, test = cells_by_split(t)
    p = train.groupBy("UserID").agg(r6(F.avg("value")).alias("prediction"))
    return test.join(p, "UserID").select("UserID", "MovieID", r6("value").alias("actual"), "prediction")


# --- aggregations


@query("a01_count_per_key", "SELECT UserID, count(*) AS n FROM ratings GROUP BY 1")
def count_per_key(t):
    return t.ratings.groupBy("UserID").agg(F.count(F.lit(1)).alias("n"))


@query("a02_mean_per_key", "SELECT MovieID, round(avg(Rating), 6) AS avg_rating FROM ratings GROUP BY 1")
def mean_per_key(t):
    return t.ratings.groupBy("MovieID").agg(r6(F.avg("Rating")).alias("avg_rating"))


@query("a03_std_per_key", "SELECT UserID, round(stddev_samp(Rating), 6) AS std_rating FROM ratings GROUP BY 1")
def std_per_key(t):
    return t.ratings.groupBy("UserID").agg(r6(F.stddev_samp("Rating")).alias("std_rating"))


@query("a04_range_per_key", "SELECT UserID, max(Rating) - min(Rating) AS rating_range FROM ratings GROUP BY 1")
def range_per_key(t):
    return t.ratings.groupBy("UserID").agg((F.max("Rating") - F.min("Rating")).alias("rating_range"))


@query("a05_one_pass_profile", """
SELECT MovieID, round(avg(Rating), 6) AS avg_rating, round(stddev_samp(Rating), 6) AS std_rating, count(Rating) AS n FROM ratings GROUP BY 1""")
def one_pass(t):
    return t.ratings.groupBy("MovieID").agg(
        r6(F.avg("Rating")).alias("avg_rating"), r6(F.stddev_samp("Rating")).alias("std_rating"), F.count("Rating").alias("n")
    )


@query("a06_conditional_distinct", """
SELECT "date", count(*) AS recommendations, count(*) FILTER (WHERE c) AS clicked FROM (
    SELECT CAST(created_at AS DATE) AS "date", bool_or(event_type = 'click') AS c FROM user_events GROUP BY 1, recommendation_id) GROUP BY 1""")
def conditional_distinct(t):
    # one row per (day, recommendation) first: a single shuffle instead of one row copy per distinct count
    per = t.user_events.groupBy(F.to_date("created_at").alias("date"), "recommendation_id").agg(F.max(flag("click")).alias("c"))
    return per.groupBy("date").agg(
        F.count("recommendation_id").alias("recommendations"), F.count_if(F.col("c") == 1).alias("clicked")
    )


@query("a07_conditional_sum", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'watch') AS watches
FROM user_events GROUP BY 1""")
def conditional_sum(t):
    return t.user_events.groupBy("user_id").agg(
        F.sum(flag("click")).alias("clicks"), F.sum(flag("watch")).alias("watches")
    )


@query("a08_conditional_average", """
SELECT item_id, round(avg(CASE WHEN event_type = 'watch' THEN completion_rate END), 6) AS avg_completion FROM user_events GROUP BY 1""")
def conditional_average(t):
    return t.user_events.groupBy("item_id").agg(
        r6(F.avg(F.when(is_kind("watch"), F.col("completion_rate")))).alias("avg_completion")
    )


@query("a09_flag_max", """
SELECT recommendation_id, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS has_click,
    max(CAST(is_synthetic AS INTEGER)) AS is_synthetic FROM user_events GROUP BY 1""")
def flag_max(t):
    return t.user_events.groupBy("recommendation_id").agg(
        F.max(flag("click")).alias("has_click"), F.max(F.col("is_synthetic").cast("int")).alias("is_synthetic")
    )


@query("a10_two_level", """
SELECT user_id, count(*) AS recommendations, CAST(sum(c) AS BIGINT) AS clicks, max(c) AS most_clicks FROM (
    SELECT user_id, recommendation_id, count(*) FILTER (WHERE event_type = 'click') AS c FROM user_events GROUP BY 1, 2) GROUP BY 1""")
def two_level(t):
    per = t.user_events.groupBy("user_id", "recommendation_id").agg(F.sum(flag("click")).alias("c"))
    return per.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("recommendations"), F.sum("c").alias("clicks"), F.max("c").alias("most_clicks")
    )


@query("a11_global_profile", """
SELECT count(*) AS n, min(Rating) AS min_rating, max(Rating) AS max_rating, round(avg(Rating), 6) AS avg_rating,
    round(stddev_samp(Rating), 6) AS std_rating, count(DISTINCT UserID) AS users, count(DISTINCT MovieID) AS items FROM ratings""")
def global_profile(t):
    r = t.ratings
    return r.agg(
        F.count(F.lit(1)).alias("n"), F.min("Rating").alias("min_rating"), F.max("Rating").alias("max_rating"),
        r6(F.avg("Rating")).alias("avg_rating"), r6(F.stddev_samp("Rating")).alias("std_rating"),
        F.countDistinct("UserID").alias("users"), F.countDistinct("MovieID").alias("items"),
    )


@query("a12_null_counts", "UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls,
    round(count(*) FILTER (WHERE {c} IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_rate FROM user_events """
    for c in ("position", "completion_rate", "feedback_type", "rating", "context")))
def null_counts(t):
    return fe.null_profile(t.user_events, ["position", "completion_rate", "feedback_type", "rating", "context"]).select("column", "nulls", "null_rate")


@query("a13_shape_inventory", "UNION ALL ".join(f"""
SELECT '{c}' AS "column", '{d}' AS dtype, count(*) AS "rows" FROM movies """ for c, d in (("MovieID", "bigint"), ("Title", "string"), ("Genres", "string"))))
def shape(t):
    return fe.null_profile(t.movies).select("column", "dtype", "rows")


@query("a14_counts_by_type_today", """
SELECT event_type, count(*) AS total, count(*) FILTER (WHERE is_synthetic) AS synthetic, count(*) FILTER (WHERE NOT is_synthetic) AS "real"
FROM user_events WHERE created_at >= DATE '2024-01-31' - INTERVAL 1 DAY GROUP BY 1""")
def counts_today(t):
    return rel.since(t.user_events, "created_at", AS_OF, 1).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_synthetic").alias("synthetic"), F.count_if(~F.col("is_synthetic")).alias("real")
    )


@query("a15_most_common_of_list", """
SELECT value, count(*) AS n FROM (SELECT unnest(string_split(Genres, '|')) AS value FROM ratings JOIN movies USING (MovieID))
GROUP BY 1 ORDER BY n DESC, value LIMIT 3""")
def most_common(t):
    return rel.top_values(t.ratings.join(t.movies, "MovieID"), "Genres", 3, sep="|")


@query("a16_rounded_histogram", "SELECT round(label, 1) AS score, count(*) AS n FROM training_labels GROUP BY 1")
def histogram(t):
    from .feedback import training_labels

    return training_labels(t).groupBy(F.round("label", 1).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("a17_first_last_seen", """
SELECT model_version, min(created_at) AS first_seen, max(created_at) AS last_seen, count(*) AS n FROM recommendation_logs GROUP BY 1""")
def first_last(t):
    return t.recommendation_logs.groupBy("model_version").agg(
        F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.count(F.lit(1)).alias("n")
    )


@query("a18_distinct_entities", """
SELECT (SELECT count(DISTINCT UserID) FROM ratings) AS users, (SELECT count(DISTINCT MovieID) FROM ratings) AS items,
    (SELECT count(DISTINCT g) FROM (SELECT unnest(string_split(Genres, '|')) AS g FROM movies)) AS genres""")
def distinct_entities(t):
    genres = t.movies.select(F.explode(split_list("Genres")).alias("g")).agg(F.countDistinct("g")).scalar()
    return t.ratings.agg(F.countDistinct("UserID").alias("users"), F.countDistinct("MovieID").alias("items")).select(
        "users", "items", genres.alias("genres")
    )


@query("a19_user_item_matrix", "SELECT UserID, MovieID, round(avg(Rating), 6) AS value FROM ratings GROUP BY 1, 2")
def matrix(t):
    return rel.user_item_matrix(t.ratings).withColumn("value", r6("value"))


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a20_pairwise_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, abs(corr({a}, {b})) > 0.95 AS is_high FROM lineitem"
    for i, a in enumerate(CORR) for b in CORR[i + 1:]))
def correlation(t):
    pairs = rel.pairwise_correlation(t.raw("lineitem").select(*CORR), CORR)
    return pairs.select("a", "b", r6("r").alias("r"), (F.abs("r") > 0.95).alias("is_high"))


@query("a21_exact_quantiles", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
    round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def quantiles(t):
    out = exact_quantiles(t.raw("events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, few_keys=True)
    return out.select("event_type", *[r6(c).alias(c) for c in ("p50", "p95", "p99")])


@query("a21_index_rule_quantiles", """
SELECT event_type, max(value) FILTER (WHERE rn = CAST(floor(n * 0.5) AS BIGINT)) AS p50, max(value) FILTER (WHERE rn = CAST(floor(n * 0.95) AS BIGINT)) AS p95,
    max(value) FILTER (WHERE rn = CAST(floor(n * 0.99) AS BIGINT)) AS p99 FROM (
    SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn,
        count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""")
def index_quantiles(t):
    """``sorted[int(n * p)]``: the element at a rank, without interpolation."""
    rt = running_totals(value_counts(t.raw("events"), ["event_type"], "value", {"n": F.count(F.lit(1))}), ["event_type"], "value", ["n"], few_keys=True)

    def at(p):
        rank = F.floor(F.col("n_all") * p)
        return F.max(F.when((F.col("n_upto") > rank) & (F.col("n_upto") - F.col("n") <= rank), F.col("value")))

    return rt.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("a22_duplicate_rows", """
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_keys, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def duplicates(t):
    return rel.duplicate_profile(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("a23_rmse_mae", """
SELECT round(sqrt(avg((Rating - AvgRating) * (Rating - AvgRating))), 6) AS rmse, round(avg(abs(Rating - AvgRating)), 6) AS mae
FROM ratings JOIN movie_stats USING (MovieID)""")
def rmse_mae(t):
    means = t.ratings.groupBy("MovieID").agg(F.avg("Rating").alias("p"))
    scored = t.ratings.join(means, "MovieID")
    return scored.agg(*rel.error_metrics(F.col("p"), F.col("Rating"))).select(r6("rmse").alias("rmse"), r6("mae").alias("mae"))


# --- windows


@query("w01_group_max", """
SELECT UserID, MovieID, "Timestamp", max("Timestamp") OVER (PARTITION BY UserID) AS last_ts FROM ratings""")
def group_max(t):
    # an aggregate joined back, so that one very active user is no single window
    last = t.ratings.groupBy("UserID").agg(F.max("Timestamp").alias("last_ts"))
    return t.ratings.select("UserID", "MovieID", "Timestamp").join(last, "UserID")


@query("w02_share_of_total", """
SELECT is_synthetic, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100, 2) AS pct FROM user_events GROUP BY 1""")
def share(t):
    return rel.share_of_total(t.user_events.groupBy("is_synthetic").agg(F.count(F.lit(1)).alias("n")), "n", "pct")


@query("w03_scaled_to_largest", """
SELECT event_type, count(*) AS n, CAST(floor(count(*) * 50 / CAST(max(count(*)) OVER () AS DOUBLE)) AS INTEGER) AS bar FROM user_events GROUP BY 1""")
def scaled(t):
    return rel.scaled_to_largest(t.user_events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "n", "bar")


@query("w04_latest_per_key", """
SELECT user_id, event_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS rn
    FROM user_events) WHERE rn = 1""")
def latest(t):
    return keep_first(t.user_events.select("user_id", "event_id", "created_at"), ["user_id"], [F.desc("created_at"), F.desc("event_id")])


@query("w05_numbered_results", """
SELECT recommendation_id, item, score, CAST(row_number() OVER (PARTITION BY recommendation_id ORDER BY score DESC, item) AS INTEGER) AS rank
FROM (SELECT recommendation_id, unnest(item_ids) AS item, unnest(scores) AS score FROM recommendation_logs)""")
def numbered(t):
    # a recommendation is one row, so its slots are sorted and numbered inside that row
    slots = F.array_sort(F.transform(
        F.arrays_zip(F.col("item_ids").alias("item"), F.col("scores").alias("score")),
        lambda z: F.struct((-z["score"]).alias("neg"), z["item"].alias("item")),
    ))
    return t.recommendation_logs.select("recommendation_id", F.posexplode(slots).alias("pos", "z")).select(
        "recommendation_id", "z.item", (-F.col("z.neg")).alias("score"), (F.col("pos") + 1).alias("rank")
    )


# --- sorts, limits, top-k


@query("t01_multi_key_sort", """
SELECT CAST(created_at AS DATE) AS "date", model_version, count(*) AS n FROM recommendation_logs GROUP BY 1, 2 ORDER BY 1 DESC, 2""")
def multi_sort(t):
    return t.recommendation_logs.groupBy(F.to_date("created_at").alias("date"), "model_version").agg(
        F.count(F.lit(1)).alias("n")
    ).orderBy(F.desc("date"), "model_version")


@query("t02_most_recent", "SELECT event_id, user_id, event_type, created_at FROM user_events ORDER BY created_at DESC, event_id LIMIT 20")
def most_recent(t):
    return t.user_events.select("event_id", "user_id", "event_type", "created_at").orderBy(F.desc("created_at"), "event_id").limit(20)


@query("t03_top_with_support", """
SELECT MovieID, Popularity, round(AvgRating, 6) AS avg_rating FROM movie_stats WHERE Popularity >= 25 ORDER BY avg_rating DESC, MovieID LIMIT 10""")
def top_with_support(t):
    s = fe.movie_stats(t.ratings).filter(F.col("Popularity") >= 25)
    return s.select("MovieID", "Popularity", r6("AvgRating").alias("avg_rating")).orderBy(F.desc("avg_rating"), "MovieID").limit(10)


@query("t04_recent_history", """
SELECT UserID, MovieID, Rating, "Timestamp", CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY UserID
    ORDER BY "Timestamp" DESC, MovieID, Rating) AS rn FROM ratings) WHERE rn <= 5""")
def recent_history(t):
    return top_k_per_key(t.ratings, ["UserID"], [F.desc("Timestamp"), "MovieID", "Rating"], 5)


@query("t05_best_and_next_two", """
SELECT experiment, run_id, rmse, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY rmse, run_id) AS rn
    FROM runs WHERE rmse IS NOT NULL AND NOT isnan(rmse)) WHERE rn <= 3""")
def best_three(t):
    ok = t.runs.filter(F.col("rmse").isNotNull() & ~F.isnan("rmse")).select("experiment", "run_id", "rmse")
    return top_k_per_key(ok, ["experiment"], ["rmse", "run_id"], 3)


@query("t06_unknowns_last", """
SELECT run_id, CASE WHEN isnan(rmse) THEN NULL ELSE rmse END AS rmse FROM runs ORDER BY 2 ASC NULLS LAST, run_id""")
def unknowns_last(t):
    known = t.runs.select("run_id", F.when(~F.isnan("rmse"), F.col("rmse")).alias("rmse"))
    return known.orderBy(F.asc_nulls_last("rmse"), "run_id")


# --- set operations


@query("o01_union_all", """
SELECT 'events' AS source, count(*) AS n FROM user_events UNION ALL SELECT 'logs', count(*) FROM recommendation_logs
UNION ALL SELECT 'ratings', count(*) FROM ratings""")
def union_all(t):
    def total(name, df):
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "n")

    return total("events", t.user_events).unionByName(total("logs", t.recommendation_logs)).unionByName(total("ratings", t.ratings))


@query("o02_key_difference", "SELECT UserID FROM users EXCEPT SELECT UserID FROM ratings")
def key_difference(t):
    return t.users.select("UserID").subtract(t.ratings.select("UserID"))


@query("o03_append_partitions", """
SELECT event_id, event_type, position FROM user_events WHERE event_type = 'click'
UNION ALL SELECT event_id, event_type, NULL FROM user_events WHERE event_type = 'watch'""")
def append(t):
    clicks = t.user_events.filter(is_kind("click")).select("event_id", "event_type", "position")
    watches = t.user_events.filter(is_kind("watch")).select("event_id", "event_type")
    return clicks.unionByName(watches, allowMissingColumns=True)


# --- scalar functions


@query("f09_clamp", "SELECT event_id, greatest(CAST(10 AS DOUBLE), least(CAST(90 AS DOUBLE), value)) AS clamped FROM events")
def clamped(t):
    return t.raw("events").select("event_id", clamp("value", 10.0, 90.0).alias("clamped"))


@query("f10_safe_percent", """
SELECT item_id, round(CAST(w AS DOUBLE) / nullif(c, 0) * 100, 2) AS watch_rate FROM (SELECT item_id, count(*) FILTER (WHERE event_type = 'watch') AS w,
    count(*) FILTER (WHERE event_type = 'click') AS c FROM user_events GROUP BY 1)""")
def safe_percent(t):
    per = t.user_events.groupBy("item_id").agg(F.sum(flag("watch")).alias("w"), F.sum(flag("click")).alias("c"))
    return per.select("item_id", percent("w", "c").alias("watch_rate"))


@query("f11_date_of_timestamp", "SELECT event_id, CAST(ts AS DATE) AS \"date\" FROM events")
def date_of(t):
    return t.raw("events").select("event_id", F.to_date("ts").alias("date"))


@query("f12_coalesce", "SELECT event_id, coalesce(rating, completion_rate, CAST(0 AS DOUBLE)) AS score FROM user_events")
def coalesce(t):
    return t.user_events.select("event_id", F.coalesce("rating", "completion_rate", F.lit(0.0)).alias("score"))


@query("f13_text_bar", """
SELECT score, 'n=' || CAST(n AS VARCHAR) AS note, repeat('#', CAST(floor(n * 50 / CAST(max(n) OVER () AS DOUBLE)) AS INTEGER)) AS bar
FROM (SELECT round(label, 1) AS score, count(*) AS n FROM training_labels GROUP BY 1)""")
def text_bar(t):
    from .feedback import training_labels

    counts = training_labels(t).groupBy(F.round("label", 1).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    wide = rel.scaled_to_largest(counts, "n", "w")
    return wide.select("score", F.concat(F.lit("n="), F.col("n").cast("string")).alias("note"), F.expr("repeat('#', w)").alias("bar"))


@query("f14_json_access", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_access(t):
    return t.raw("events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("f15_parallel_arrays", """
SELECT recommendation_id, CAST(unnest([0, 1, 2]) AS INTEGER) AS position, unnest(item_ids) AS item_id, unnest(scores) AS score FROM recommendation_logs""")
def parallel_arrays(t):
    zipped = F.arrays_zip(F.col("item_ids").alias("item_id"), F.col("scores").alias("score"))
    return t.recommendation_logs.select("recommendation_id", F.posexplode(zipped).alias("position", "z")).select(
        "recommendation_id", "position", "z.item_id", "z.score"
    )


@query("f16_content_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_hash(t):
    return t.raw("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("f17_stable_identifier", "SELECT event_id, sha256(CAST(event_id AS VARCHAR) || '|' || CAST(user_id AS VARCHAR)) AS id FROM events")
def identifier(t):
    return t.raw("events").select("event_id", stable_id("event_id", "user_id").alias("id"))


@query("f18_step_check", """
SELECT label_step, count(*) AS n FROM (SELECT abs(label / 0.5 - round(label / 0.5)) >= 1e-6 AS label_step FROM training_labels) GROUP BY 1""")
def step_check(t):
    from .feedback import training_labels

    return training_labels(t).groupBy(off_step("label", 0.5).alias("label_step")).agg(F.count(F.lit(1)).alias("n"))


@query("f19_regex_min_length", """
SELECT UserID, regexp_matches(ZipCode, '^[0-9]{5}$') AS zip_ok, length(ZipCode) >= 5 AS long_enough FROM users""")
def regex(t):
    return t.users.select("UserID", F.col("ZipCode").rlike("^[0-9]{5}$").alias("zip_ok"), (F.length("ZipCode") >= 5).alias("long_enough"))
