"""Feature queries over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import one_hot, r6, right_closed_bin, split_list, multi_hot, whole_days
from ..operators import features as fe
from ..tables import GENRES, OCCUPATIONS
from .registry import query

OCC_SQL = ", ".join(f'CASE WHEN Occupation = {o} THEN 1 ELSE 0 END AS "Occupation_{o}"' for o in OCCUPATIONS)
GENRE_SQL = ", ".join(
    f"CASE WHEN list_contains(string_split(Genres, '|'), '{g}') THEN 1 ELSE 0 END AS \"Genre_{g}\"" for g in GENRES
)
AGE_SQL = """CASE WHEN Age > 0 AND Age <= 18 THEN '<18' WHEN Age > 18 AND Age <= 25 THEN '18-25'
    WHEN Age > 25 AND Age <= 35 THEN '25-35' WHEN Age > 35 AND Age <= 45 THEN '35-45'
    WHEN Age > 45 AND Age <= 50 THEN '45-50' WHEN Age > 50 AND Age <= 56 THEN '50+' END"""
POP_SQL = """CASE WHEN {p} > 500 THEN 'Very High' WHEN {p} > 100 THEN 'High' WHEN {p} > 50 THEN 'Medium'
    WHEN {p} > 10 THEN 'Low' ELSE 'Very Low' END"""


def rounded(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


@query("e01_user_features", f"""
SELECT UserID, Gender, Age, Occupation, ZipCode, coalesce(RatingCount, 0) AS RatingCount,
    round(coalesce(AvgRating, 0), 6) AS AvgRating, round(coalesce(StdRating, 0), 6) AS StdRating,
    round(coalesce(RatingRange, 0), 6) AS RatingRange, {AGE_SQL} AS AgeGroup, {OCC_SQL},
    CASE WHEN Gender = 'M' THEN 1 ELSE 0 END AS GenderMale
FROM users LEFT JOIN user_stats USING (UserID)""")
def user_features(t):
    return rounded(fe.user_features(t.users, t.ratings, OCCUPATIONS), "AvgRating", "StdRating", "RatingRange")


MOVIE_SQL = f"""
SELECT MovieID, Title, Genres, coalesce(Popularity, 0) AS Popularity, round(coalesce(AvgRating, 0), 6) AS AvgRating,
    {POP_SQL.format(p='coalesce(Popularity, 0)')} AS PopularityCategory, {GENRE_SQL},
    CAST(len(string_split(Genres, '|')) AS INTEGER) AS GenreCount
FROM movies LEFT JOIN movie_stats USING (MovieID)"""


@query("e02_movie_features", MOVIE_SQL)
def movie_features(t):
    return rounded(fe.movie_features(t.movies, t.ratings, GENRES), "AvgRating")


INTERACTION_SQL = """
SELECT UserID, MovieID, Rating, r."Timestamp", round(u.AvgRating, 6) AS UserAvgRating, u.RatingCount AS UserRatingCount,
    round(m.AvgRating, 6) AS MovieAvgRating, m.Popularity AS MoviePopularity,
    CAST(isodow(epoch_ms(r."Timestamp" * 1000)) - 1 AS INTEGER) AS DayOfWeek,
    CAST(month(epoch_ms(r."Timestamp" * 1000)) AS INTEGER) AS "Month",
    CAST(year(epoch_ms(r."Timestamp" * 1000)) AS INTEGER) AS "Year",
    CAST(hour(epoch_ms(r."Timestamp" * 1000)) AS INTEGER) AS "Hour",
    (u.LastTs - r."Timestamp") // 86400 AS days_to_last_rating,
    (r."Timestamp" - u.FirstTs) // 86400 AS days_since_first_rating,
    round(Rating - u.AvgRating, 6) AS RatingDeviation, round(Rating - m.AvgRating, 6) AS RatingDevFromMovie,
    round(u.AvgRating - m.AvgRating, 6) AS UserMovieDiff
FROM ratings r LEFT JOIN user_stats u USING (UserID) LEFT JOIN movie_stats m USING (MovieID)"""


@query("e03_interaction_features", INTERACTION_SQL)
def interaction_features(t):
    return rounded(
        fe.interaction_features(t.ratings),
        "UserAvgRating", "MovieAvgRating", "RatingDeviation", "RatingDevFromMovie", "UserMovieDiff",
    )


@query("e04_light_user_features", """
SELECT UserID, round(avg(Rating), 6) AS user_avg_rating, round(coalesce(stddev_samp(Rating), 0), 6) AS user_std_rating,
    count(Rating) AS user_rating_count FROM ratings GROUP BY UserID""")
def light_users(t):
    return rounded(fe.light_entity_features(t.ratings, "UserID", "user"), "user_avg_rating", "user_std_rating")


@query("e04_light_interactions", """
SELECT UserID, MovieID, Rating, "Timestamp", Gender, Age, Title, Genres
FROM ratings LEFT JOIN users USING (UserID) LEFT JOIN movies USING (MovieID)""")
def light_interactions(t):
    return fe.light_interactions(t.ratings, t.users, t.movies)


@query("e05_feature_statistics", "UNION ALL ".join(f"""
SELECT '{c}' AS "column", '{d}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
    round(count(*) FILTER (WHERE {c} IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_rate, count(*) AS "rows"
FROM (SELECT * FROM users LEFT JOIN user_stats USING (UserID)) """ for c, d in [
    ("UserID", "bigint"), ("Gender", "string"), ("Age", "int"), ("Occupation", "int"), ("ZipCode", "string"),
    ("RatingCount", "bigint"), ("AvgRating", "double"), ("StdRating", "double")]))
def feature_statistics(t):
    stats = fe.user_stats(t.ratings).select("UserID", "RatingCount", "AvgRating", "StdRating")
    return fe.null_profile(t.users.join(stats, "UserID", "left"))


@query("e06_training_frame", """
SELECT UserID, MovieID, Rating AS target, "Timestamp", Gender, Age, Occupation, RatingCount, round(u.AvgRating, 6) AS AvgRating,
    Popularity, round(m.AvgRating, 6) AS AvgRating_movie
FROM ratings JOIN users USING (UserID) JOIN movies USING (MovieID) JOIN user_stats u USING (UserID)
    JOIN movie_stats m USING (MovieID) WHERE u.StdRating IS NOT NULL""")
def training_frame(t):
    us = fe.user_stats(t.ratings).select("UserID", "RatingCount", "AvgRating", "StdRating")
    ms = fe.movie_stats(t.ratings).select("MovieID", "Popularity", "AvgRating")
    frame = fe.training_frame(
        t.users.join(us, "UserID", "left"), t.movies.join(ms, "MovieID", "left"), t.ratings,
        drop=("Title", "Genres", "ZipCode", "StdRating"),
    )
    return rounded(frame, "AvgRating", "AvgRating_movie")


# Scalar building blocks, one small query each.


@query("f01_split_explode", """
SELECT MovieID, CAST(len(string_split(Genres, '|')) AS INTEGER) AS GenreCount, unnest(string_split(Genres, '|')) AS Genre FROM movies""")
def split_explode(t):
    parts = split_list("Genres")
    return t.movies.select("MovieID", F.size(parts).alias("GenreCount"), F.explode(parts).alias("Genre"))


@query("f02_multi_hot", f"SELECT MovieID, {GENRE_SQL} FROM movies")
def multi_hot_genres(t):
    return t.movies.select("MovieID", *multi_hot("Genres", GENRES, "Genre"))


@query("f03_one_hot", f"SELECT UserID, {OCC_SQL} FROM users")
def one_hot_occupation(t):
    return t.users.select("UserID", *one_hot("Occupation", OCCUPATIONS, "Occupation"))


@query("f04_binary_encode", "SELECT UserID, CASE WHEN Gender = 'M' THEN 1 ELSE 0 END AS GenderMale FROM users")
def binary_encode(t):
    return t.users.select("UserID", (F.col("Gender") == "M").cast("int").alias("GenderMale"))


@query("f05_right_closed_bins", f"SELECT UserID, Age, {AGE_SQL} AS AgeGroup FROM users")
def bins(t):
    return t.users.select("UserID", "Age", right_closed_bin("Age", fe.AGE_EDGES, fe.AGE_NAMES).alias("AgeGroup"))


@query("f06_date_parts", """
SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS "month",
    CAST(year(ts) AS INTEGER) AS "year", CAST(hour(ts) AS INTEGER) AS "hour" FROM events""")
def date_parts(t):
    moment = F.timestamp_seconds(F.unix_timestamp("ts"))
    return t.raw("events").select(
        "event_id", F.weekday(moment).alias("day_of_week"), F.month(moment).alias("month"),
        F.year(moment).alias("year"), F.hour(moment).alias("hour"),
    )


@query("f07_whole_days", """
SELECT event_id, CAST(floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 86400) AS BIGINT) AS age_days FROM events""")
def age_days(t):
    now = F.unix_timestamp(F.lit("2024-01-31").cast("timestamp_ntz"))
    return t.raw("events").select("event_id", whole_days(now, F.unix_timestamp("ts")).alias("age_days"))


@query("f08_deviations", """
SELECT UserID, MovieID, "Timestamp", Rating, round(Rating - g.m, 6) AS deviation FROM ratings, (SELECT avg(Rating) AS m FROM ratings) g""")
def deviations(t):
    mean = t.ratings.agg(F.avg("Rating")).scalar()
    return t.ratings.select("UserID", "MovieID", "Timestamp", "Rating", r6(F.col("Rating") - mean).alias("deviation"))
