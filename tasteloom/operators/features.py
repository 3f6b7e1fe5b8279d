"""User, item and interaction features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import multi_hot, one_hot, right_closed_bin, split_list, whole_days

# Bin edges and labels of the feature definitions.
AGE_EDGES = [0, 18, 25, 35, 45, 50, 56]
AGE_NAMES = ["<18", "18-25", "25-35", "35-45", "45-50", "50+"]
POPULARITY_EDGES = [0, 10, 50, 100, 500, float("inf")]
POPULARITY_NAMES = ["Very Low", "Low", "Medium", "High", "Very High"]


def user_stats(ratings: DataFrame) -> DataFrame:
    """Every per-user aggregate in one pass over the ratings."""
    return ratings.groupBy("UserID").agg(
        F.count(F.lit(1)).alias("RatingCount"),
        F.avg("Rating").alias("AvgRating"),
        F.stddev_samp("Rating").alias("StdRating"),
        (F.max("Rating") - F.min("Rating")).alias("RatingRange"),
        F.max("Timestamp").alias("LastTs"),
        F.min("Timestamp").alias("FirstTs"),
    )


def movie_stats(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("MovieID").agg(
        F.count(F.lit(1)).alias("Popularity"),
        F.avg("Rating").alias("AvgRating"),
        F.stddev_samp("Rating").alias("StdRating"),
    )


def age_group(age: Column | str) -> Column:
    return right_closed_bin(age, AGE_EDGES, AGE_NAMES)


def popularity_category(popularity: Column | str) -> Column:
    return F.coalesce(right_closed_bin(popularity, POPULARITY_EDGES, POPULARITY_NAMES), F.lit("Very Low"))


def user_features(users: DataFrame, ratings: DataFrame, occupations: Sequence[int]) -> DataFrame:
    stats = user_stats(ratings).drop("LastTs", "FirstTs")
    filled = users.join(stats, "UserID", "left").na.fill(
        {"RatingCount": 0, "AvgRating": 0.0, "StdRating": 0.0, "RatingRange": 0.0}
    )
    return filled.select(
        "*",
        age_group("Age").alias("AgeGroup"),
        *one_hot("Occupation", occupations, "Occupation"),
        (F.col("Gender") == "M").cast("int").alias("GenderMale"),
    )


def movie_features(movies: DataFrame, ratings: DataFrame, genres: Sequence[str]) -> DataFrame:
    stats = movie_stats(ratings).drop("StdRating")
    filled = movies.join(stats, "MovieID", "left").na.fill({"Popularity": 0, "AvgRating": 0.0})
    return filled.select(
        "*",
        popularity_category("Popularity").alias("PopularityCategory"),
        *multi_hot("Genres", genres, "Genre"),
        F.size(split_list("Genres")).alias("GenreCount"),
    )


def interaction_features(ratings: DataFrame) -> DataFrame:
    """Ratings with user and item context.

    The last rating of a user comes from the user aggregate, not from a window over the
    user's rows: a user with a large share of the rows then costs one joined row, and the
    runtime may split that user's side of the join.
    """
    users = user_stats(ratings).select(
        "UserID", F.col("AvgRating").alias("UserAvgRating"), F.col("RatingCount").alias("UserRatingCount"), "LastTs", "FirstTs"
    )
    movies = movie_stats(ratings).select(
        "MovieID", F.col("AvgRating").alias("MovieAvgRating"), F.col("Popularity").alias("MoviePopularity")
    )
    joined = ratings.join(users, "UserID", "left").join(movies, "MovieID", "left")
    moment = F.timestamp_seconds("Timestamp")
    return joined.select(
        "UserID",
        "MovieID",
        "Rating",
        "Timestamp",
        "UserAvgRating",
        "UserRatingCount",
        "MovieAvgRating",
        "MoviePopularity",
        F.weekday(moment).alias("DayOfWeek"),
        F.month(moment).alias("Month"),
        F.year(moment).alias("Year"),
        F.hour(moment).alias("Hour"),
        whole_days("LastTs", "Timestamp").alias("days_to_last_rating"),
        whole_days("Timestamp", "FirstTs").alias("days_since_first_rating"),
        (F.col("Rating") - F.col("UserAvgRating")).alias("RatingDeviation"),
        (F.col("Rating") - F.col("MovieAvgRating")).alias("RatingDevFromMovie"),
        (F.col("UserAvgRating") - F.col("MovieAvgRating")).alias("UserMovieDiff"),
    )


def light_entity_features(ratings: DataFrame, key: str, prefix: str) -> DataFrame:
    return ratings.groupBy(key).agg(
        F.avg("Rating").alias(f"{prefix}_avg_rating"),
        F.stddev_samp("Rating").alias(f"{prefix}_std_rating"),
        F.count("Rating").alias(f"{prefix}_rating_count"),
    ).na.fill({f"{prefix}_std_rating": 0.0})


def light_interactions(ratings: DataFrame, users: DataFrame, movies: DataFrame) -> DataFrame:
    return ratings.join(users.select("UserID", "Gender", "Age"), "UserID", "left").join(
        movies.select("MovieID", "Title", "Genres"), "MovieID", "left"
    )


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, dtype, nulls, null_rate, rows)`` for every column, in one pass."""
    names = list(columns or df.columns)
    types = dict(df.dtypes)
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(names)],
    )
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(f"_n{i}").alias("nulls"))
        for i, c in enumerate(names)
    ])
    return one.select("_rows", F.inline(cells)).select(
        "column",
        "dtype",
        "nulls",
        F.round(F.try_divide(F.col("nulls").cast("double"), F.col("_rows").cast("double")), 6).alias("null_rate"),
        F.col("_rows").alias("rows"),
    )


def training_frame(users: DataFrame, movies: DataFrame, ratings: DataFrame, drop: Sequence[str] = ("Title", "Genres", "ZipCode")) -> DataFrame:
    """Star join of ratings with user and item features, rows with a null dropped, target kept apart as ``target``."""
    clash = (set(movies.columns) & set(users.columns)) - {"UserID", "MovieID"}
    movies = movies.select(*[F.col(c).alias(f"{c}_movie") if c in clash else F.col(c) for c in movies.columns])
    joined = ratings.join(users, "UserID", "left").join(movies, "MovieID", "left")
    return joined.na.drop("any").withColumnRenamed("Rating", "target").drop(*drop)


def learn_vocabulary(df: DataFrame, column: str, sep: str | None = None, limit: int = 10000) -> list[str]:
    """Sorted distinct values for a one-hot encoding; refuses a vocabulary too wide to be columns."""
    values = df.select(F.explode(split_list(column, sep)).alias("v")) if sep else df.select(F.col(column).alias("v"))
    rows = values.filter(F.col("v").isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values: too many for one column each")
    return sorted(r.v for r in rows)
