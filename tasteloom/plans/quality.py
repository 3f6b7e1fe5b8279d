"""Data-quality queries. Some bounds are set so that the bound tables violate them."""

from __future__ import annotations

from copy import copy
from functools import reduce

from ..operators import features as fe
from ..operators import quality as q
from ..operators.quality import ColumnRule, TableRules
from ..operators.scale import stored
from ..tables import GENRES, OCCUPATIONS
from .features import INTERACTION_SQL, MOVIE_SQL
from .registry import query

USERS = TableRules(
    columns={
        "UserID": ColumnRule("integer", nullable=False),
        "Gender": ColumnRule("string", nullable=False, valid_values=["M", "F"]),
        "Age": ColumnRule("integer", nullable=False, min=1, max=50),
        "Occupation": ColumnRule("integer", min=0, max=20),
        "ZipCode": ColumnRule("string", nullable=False, regex="^[0-9]{5}$", min_length=5),
    },
    primary_key=["UserID"],
    null_rate=0.02,
)
MOVIES = TableRules(
    columns={
        "MovieID": ColumnRule("integer", nullable=False, min=1, max=1500),
        "Title": ColumnRule("string", nullable=False, min_length=1),
        "Genres": ColumnRule("string", nullable=False, valid_values=GENRES[:-1], split="|"),
    },
    primary_key=["MovieID"],
)
RATINGS = TableRules(
    columns={
        "UserID": ColumnRule("integer", nullable=False, min=1),
        "MovieID": ColumnRule("integer", nullable=False, min=1),
        "Rating": ColumnRule("float", nullable=False, min=0.5, max=5.0, step=2.0),
        "Timestamp": ColumnRule("long", nullable=False, min_date="1995-06-01", max_date="2001-06-30"),
    },
    primary_key=["UserID", "MovieID", "Timestamp"],
    duplicate_rate=0.001,
    foreign_keys={"UserID": ("users", "UserID"), "MovieID": ("movies", "MovieID")},
    integrity_rate=0.9999,
    min_rows_per={"UserID": 20},
    unique=[["UserID", "MovieID"]],
)


def row_sql(dataset, check, column, table, bad, expected, observed="NULL", on_fail="FAILED", gate=None):
    """One oracle row: ``bad`` counts violations over ``table``; ``gate`` overrides when they fail."""
    gate = gate or f"{bad} > 0"
    return f"""SELECT '{dataset}' AS dataset, '{check}' AS "check", '{column}' AS "column",
        CASE WHEN {gate} THEN '{on_fail}' ELSE 'PASSED' END AS status, round(CAST({observed} AS DOUBLE), 6) AS observed,
        '{expected}' AS expected, CAST({bad} AS BIGINT) AS violations FROM {table}"""


def where(cond):
    return f"count(*) FILTER (WHERE {cond})"


def union(*rows):
    return "\nUNION ALL ".join(rows)


ALL = [("users", USERS), ("movies", MOVIES), ("ratings", RATINGS)]


def over_all(t, checks):
    frames = {"users": t.users, "movies": t.movies, "ratings": t.ratings}
    parts = [q.run_checks(frames[n], n, checks(frames[n], r)) for n, r in ALL if checks(frames[n], r)]
    return reduce(lambda a, b: a.unionByName(b), parts)


V01 = []
for _name, _rules in ALL:
    for _c, _r in _rules.columns.items():
        V01.append(row_sql(_name, "column_present", _c, _name, "0", "present", "count(*)", gate="false"))
        V01.append(row_sql(_name, "column_type", _c, _name, "0", _r.type, "count(*)", gate="false"))
    V01.append(row_sql(_name, "unexpected_columns", "", _name, "0", "0", "count(*)", gate="false"))


@query("v01_schema", union(*V01))
def schema(t):
    return over_all(t, q.schema_checks)


@query("v02_nullability", union(*[
    row_sql(n, "nullability", c, n, where(f'"{c}" IS NULL'), "not null") for n, r in ALL for c, k in r.columns.items() if not k.nullable]))
def nullability(t):
    return over_all(t, lambda df, r: q.null_checks(r))


@query("v03_numeric_range", union(
    row_sql("users", "min", "Age", "users", where("Age < 1"), ">= 1", "min(Age)"),
    row_sql("users", "max", "Age", "users", where("Age > 50"), "<= 50", "max(Age)"),
    row_sql("users", "min", "Occupation", "users", where("Occupation < 0"), ">= 0", "min(Occupation)"),
    row_sql("users", "max", "Occupation", "users", where("Occupation > 20"), "<= 20", "max(Occupation)"),
    row_sql("movies", "min", "MovieID", "movies", where("MovieID < 1"), ">= 1", "min(MovieID)"),
    row_sql("movies", "max", "MovieID", "movies", where("MovieID > 1500"), "<= 1500", "max(MovieID)"),
    row_sql("ratings", "min", "UserID", "ratings", where("UserID < 1"), ">= 1", "min(UserID)"),
    row_sql("ratings", "min", "MovieID", "ratings", where("MovieID < 1"), ">= 1", "min(MovieID)"),
    row_sql("ratings", "min", "Rating", "ratings", where("Rating < 0.5"), ">= 0.5", "min(Rating)"),
    row_sql("ratings", "max", "Rating", "ratings", where("Rating > 5"), "<= 5", "max(Rating)")))
def numeric_range(t):
    return over_all(t, lambda df, r: q.range_checks(r))


@query("v04_step", row_sql("ratings", "step", "Rating", "ratings", where("CAST(Rating AS INTEGER) % 2 <> 0"), "multiple of 2", on_fail="PASSED_WITH_WARNINGS"))
def step(t):
    return over_all(t, lambda df, r: q.step_checks(r))


@query("v05_allowed_values", union(
    row_sql("users", "allowed_values", "Gender", "users", where("Gender NOT IN ('M', 'F')"), "2 values"),
    row_sql("movies", "allowed_values", "Genres", "movies", where("Genres LIKE '%widget%'"), "13 values")))
def allowed(t):
    return over_all(t, lambda df, r: q.value_checks(r))


def fk_sql(dataset, child, key, parents, threshold):
    per = f"(SELECT {key} AS k, count(*) AS n, {key} IN ({parents}) AS known FROM {child} WHERE {key} IS NOT NULL GROUP BY 1)"
    keys = where("NOT known")
    rows = "coalesce(sum(n) FILTER (WHERE NOT known), 0)"
    key_rate, row_rate = f"(1 - {keys} / CAST(count(*) AS DOUBLE))", f"(1 - {rows} / CAST(sum(n) AS DOUBLE))"
    return union(
        row_sql(dataset, "foreign_key_keys", key, per, keys, f"key rate >= {threshold:g}", key_rate, gate=f"{key_rate} < {threshold}"),
        row_sql(dataset, "foreign_key_rows", key, per, rows, f"row rate >= {threshold:g}", row_rate, gate=f"{row_rate} < {threshold}"),
    )


ADULTS = "SELECT UserID FROM users WHERE Age > 10"


@query("v06_foreign_keys", union(
    fk_sql("ratings", "ratings", "UserID", ADULTS, 0.9999), fk_sql("ratings", "ratings", "MovieID", "SELECT MovieID FROM movies", 0.9999)))
def foreign_keys(t):
    adults = t.users.filter("Age > 10")
    return q.foreign_key_check("ratings", t.ratings, "UserID", adults, "UserID", 0.9999).unionByName(
        q.foreign_key_check("ratings", t.ratings, "MovieID", t.movies, "MovieID", 0.9999)
    )


def unique_sql(dataset, check, table, keys, threshold):
    per = f"(SELECT count(*) AS n FROM {table} GROUP BY {', '.join(keys)})"
    dup = "sum(CASE WHEN n > 1 THEN n ELSE 0 END)"
    return row_sql(dataset, check, ",".join(k.strip('"') for k in keys), per, dup, f"duplicate rate <= {threshold:g}", "count(*)", gate=f"{dup} / CAST(sum(n) AS DOUBLE) > {threshold}")


@query("v07_uniqueness", union(
    unique_sql("users", "primary_key", "users", ["UserID"], 0), unique_sql("movies", "primary_key", "movies", ["MovieID"], 0),
    unique_sql("ratings", "primary_key", "ratings", ["UserID", "MovieID", '"Timestamp"'], 0.001)))
def uniqueness(t):
    return (
        q.uniqueness_check("users", t.users, USERS.primary_key)
        .unionByName(q.uniqueness_check("movies", t.movies, MOVIES.primary_key))
        .unionByName(q.uniqueness_check("ratings", t.ratings, RATINGS.primary_key, RATINGS.duplicate_rate))
    )


EVENT_RULES = TableRules(columns={c: ColumnRule() for c in (
    "event_id", "event_type", "user_id", "item_id", "recommendation_id", "position", "watch_duration_seconds", "total_duration_seconds",
    "completion_rate", "feedback_type", "rating", "is_synthetic", "device_type", "context", "created_at")}, null_rate=0.7)


def complete_sql(dataset, rules):
    """One oracle row per column: nulls count as violations where their share passes the table's bound."""
    for c in rules.columns:
        n = where(f'"{c}" IS NULL')
        rate = f"{n} / CAST(count(*) AS DOUBLE)"
        yield row_sql(dataset, "completeness", c, dataset, f"CASE WHEN {rate} > {rules.null_rate:g} THEN {n} ELSE 0 END", f"null rate <= {rules.null_rate:g}", rate)


@query("v08_completeness", union(*complete_sql("user_events", EVENT_RULES), *[s for n, r in ALL for s in complete_sql(n, r)]))
def completeness(t):
    events = q.run_checks(t.user_events, "user_events", q.completeness_checks(EVENT_RULES))
    return events.unionByName(over_all(t, lambda df, r: q.completeness_checks(r)))


@query("v09_report_roll_up", f"""
SELECT status, count(*) AS checks FROM ({union(
    row_sql("ratings", "min", "Rating", "ratings", where("Rating < 0.5"), ""), row_sql("ratings", "max", "Rating", "ratings", where("Rating > 5"), ""),
    row_sql("ratings", "min", "UserID", "ratings", where("UserID < 1"), ""), row_sql("ratings", "min", "MovieID", "ratings", where("MovieID < 1"), ""),
    row_sql("ratings", "step", "Rating", "ratings", where("CAST(Rating AS INTEGER) % 2 <> 0"), "", on_fail="PASSED_WITH_WARNINGS"),
    fk_sql("ratings", "ratings", "UserID", "SELECT UserID FROM users", 0.9999))}) GROUP BY 1""")
def roll_up(t):
    rules = q.range_checks(RATINGS) + q.step_checks(RATINGS)
    report = q.run_checks(t.ratings, "ratings", rules).unionByName(
        q.foreign_key_check("ratings", t.ratings, "UserID", t.users, "UserID", 0.9999)
    )
    return q.roll_up(report)


# the ordered columns that each stage promises, by dataset
STAGES = {
    "raw": {
        "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
        "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    },
    "validated": {
        "movies": ["MovieID", "Title", "Genres"], "ratings": ["UserID", "MovieID", "Rating", "Timestamp"],
        "users": ["UserID", "Gender", "Age", "Occupation", "ZipCode"],
    },
    "features": {
        "user_features": ["UserID", "Gender", "Age", "Occupation", "ZipCode", "RatingCount", "AvgRating", "StdRating", "RatingRange", "AgeGroup",
                          *[f"Occupation_{o}" for o in OCCUPATIONS], "GenderMale"],
        "movie_features": ["MovieID", "Title", "Genres", "Popularity", "AvgRating", "PopularityCategory", *[f"Genre_{g}" for g in GENRES], "GenreCount"],
        "interaction_features": ["UserID", "MovieID", "Rating", "Timestamp", "UserAvgRating", "UserRatingCount", "MovieAvgRating", "MoviePopularity",
                                 "DayOfWeek", "Month", "Year", "Hour", "days_to_last_rating", "days_since_first_rating",
                                 "RatingDeviation", "RatingDevFromMovie", "UserMovieDiff"],
    },
    "training": {},
    "inference": {},
}
STAGE_TABLES = {"user_features": "users", "movie_features": "movies", "interaction_features": "ratings"}


@query("v10_expectation_suite", union(*[union(
    row_sql(f"{s}.{n}", "ordered_columns", ",".join(c), STAGE_TABLES.get(n, n), "0", str(len(c)), str(len(c)), gate="count(*) < 0"),
    row_sql(f"{s}.{n}", "row_count", "*", STAGE_TABLES.get(n, n), "CASE WHEN count(*) < 1 THEN 1 ELSE 0 END", ">= 1", "count(*)"))
    for s, datasets in STAGES.items() for n, c in datasets.items()]))
def suites(t):
    return q.stage_suites(STAGES, {
        "raw": {"part": t.raw("part"), "customer": t.raw("customer")},
        "validated": {"movies": t.movies, "ratings": t.ratings, "users": t.users},
        "features": {
            "user_features": fe.user_features(t.users, t.ratings, OCCUPATIONS), "movie_features": movie_frame(t),
            "interaction_features": fe.interaction_features(t.ratings),
        },
    })


@query("v11_pipeline_checks", """
SELECT 'movies_no_null_ids' AS "check", count(*) FILTER (WHERE MovieID IS NULL) = 0 AS passed FROM movies
UNION ALL SELECT 'movies_unique_ids', count(DISTINCT MovieID) = count(*) FROM movies
UNION ALL SELECT 'ratings_no_null_ids', count(*) FILTER (WHERE UserID IS NULL OR MovieID IS NULL) = 0 FROM ratings
UNION ALL SELECT 'ratings_valid_range', count(*) FILTER (WHERE Rating NOT BETWEEN 1 AND 5) = 0 FROM ratings
UNION ALL SELECT 'users_no_null_ids', count(*) FILTER (WHERE UserID IS NULL) = 0 FROM users
UNION ALL SELECT 'users_unique_ids', count(DISTINCT UserID) = count(*) FROM users""")
def pipeline(t):
    return q.pipeline_checks(t.movies, t.ratings, t.users)


# --- features


def user_frame(t):
    return t.users.join(fe.user_stats(t.ratings).drop("LastTs", "FirstTs"), "UserID", "left")


def movie_frame(t):
    return fe.movie_features(t.movies, t.ratings, GENRES)


USER_FRAME = "(SELECT UserID, Gender, Age, Occupation, ZipCode, RatingCount, AvgRating, StdRating, RatingRange FROM users LEFT JOIN user_stats USING (UserID))"
MOVIE_FRAME = "(SELECT MovieID, coalesce(Popularity, 0) AS Popularity, coalesce(AvgRating, 0) AS AvgRating FROM movies LEFT JOIN movie_stats USING (MovieID))"


def parts(*frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


V12 = union(
    *[row_sql("users", "required_column", c, USER_FRAME, "0", "present", "count(*)", gate="count(*) < 0") for c in ("UserID", "AvgRating", "RatingCount")],
    row_sql("users", "integer_id", "UserID", USER_FRAME, "0", "integer", "count(*)", gate="count(*) < 0"),
    *[row_sql("interactions", "required_column", c, "ratings", "0" if c != "Title" else "1", "present", "count(*)", gate="count(*) < 0" if c != "Title" else "count(*) >= 0")
      for c in ("UserID", "MovieID", "Title")],
    *[row_sql("interactions", "integer_id", c, "ratings", "0", "integer", "count(*)", gate="count(*) < 0") for c in ("UserID", "MovieID")])


@query("v12_feature_schema", V12)
def feature_schema(t):
    return parts(
        q.feature_schema("users", user_frame(t), ["UserID", "AvgRating", "RatingCount"], ["UserID"]),
        q.feature_schema("interactions", t.ratings, ["UserID", "MovieID", "Title"], ["UserID", "MovieID"]),
    )


def nulls_sql(dataset, c, frame, low, warn):
    n = where(f'"{c}" IS NULL')
    rate = f"{n} / CAST(count(*) AS DOUBLE)"
    below = f"WHEN {rate} > 0 THEN 'PASSED_WITH_WARNINGS'" if warn else ""
    return f"""SELECT '{dataset}' AS dataset, 'feature_nulls' AS "check", '{c}' AS "column", CASE WHEN {rate} > {low} THEN 'FAILED' {below} ELSE 'PASSED' END AS status,
    round({rate}, 6) AS observed, '<= {low}' AS expected, {n} AS violations FROM {frame}"""


V13 = union(
    *[nulls_sql("users", c, USER_FRAME, 0.1, True) for c in ("UserID", "Gender", "Age", "Occupation", "ZipCode", "RatingCount", "AvgRating", "StdRating", "RatingRange")],
    *[nulls_sql("movies", c, f"({MOVIE_SQL})", 0.1, False) for c in STAGES["features"]["movie_features"]],
    *[nulls_sql("interactions", c, f"({INTERACTION_SQL})", 0.1, False) for c in STAGES["features"]["interaction_features"]])


@query("v13_feature_nulls", V13)
def feature_nulls(t):
    return parts(
        q.feature_nulls("users", user_frame(t), warn_below=True),
        q.feature_nulls("movies", movie_frame(t)),
        q.feature_nulls("interactions", fe.interaction_features(t.ratings)),
    )


V14 = union(
    row_sql("users", "feature_range", "AvgRating", USER_FRAME, where("AvgRating < 0 OR AvgRating > 5"), "[0, 5]"),
    row_sql("movies", "feature_range", "AvgRating", MOVIE_FRAME, where("AvgRating < 0 OR AvgRating > 5"), "[0, 5]"),
    row_sql("movies", "feature_range", "Popularity", MOVIE_FRAME, where("Popularity < 0"), "[0, inf]"),
    row_sql("interactions", "feature_range", "Rating", "ratings", where("Rating < 0.5 OR Rating > 5"), "[0.5, 5]"))


@query("v14_feature_ranges", V14)
def feature_ranges(t):
    return parts(
        q.feature_ranges("users", user_frame(t), q.FEATURE_RANGES["users"]),
        q.feature_ranges("movies", movie_frame(t), q.FEATURE_RANGES["movies"]),
        q.feature_ranges("interactions", t.ratings, q.FEATURE_RANGES["interactions"]),
    )


def consistency_sql(key, table):
    missing = f"(SELECT count(DISTINCT {key}) FROM ratings WHERE {key} NOT IN (SELECT {key} FROM {table}))"
    one = f"(SELECT (SELECT count(*) FROM {table}) AS n, {missing} AS missing)"
    return union(
        row_sql("features", "ids_missing", key, one, "missing", "0", "missing", "PASSED_WITH_WARNINGS"),
        row_sql("features", "cardinality", key, one, "CASE WHEN n < 100 THEN 1 ELSE 0 END", ">= 100", "n", "PASSED_WITH_WARNINGS"))


@query("v15_feature_consistency", union(consistency_sql("UserID", "(SELECT UserID FROM users WHERE Age > 3)"), consistency_sql("MovieID", "movies")))
def feature_consistency(t):
    return parts(q.feature_consistency(t.ratings, t.users.filter("Age > 3"), "UserID"), q.feature_consistency(t.ratings, t.movies, "MovieID"))


STAT_USER = ["UserID", "Age", "Occupation", "RatingCount", "AvgRating"]
STAT_INTER = ["UserID", "MovieID", "Rating", "Timestamp"]
STAT_SQL = union(*[f"""SELECT 'users' AS dataset, 'feature_spread' AS "check", '{c}' AS "column",
    CASE WHEN stddev_samp({c}) = 0 THEN 'FAILED' WHEN stddev_samp({c}) > 1000 THEN 'PASSED_WITH_WARNINGS' ELSE 'PASSED' END AS status,
    round(stddev_samp({c}), 6) AS observed, '0 < std <= 1000' AS expected, CAST(CASE WHEN stddev_samp({c}) = 0 OR stddev_samp({c}) > 1000 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM {USER_FRAME}""" for c in STAT_USER])
PAIRS_SQL = " + ".join(f'CASE WHEN abs(corr("{a}", "{b}")) > 0.95 THEN 1 ELSE 0 END' for i, a in enumerate(STAT_INTER) for b in STAT_INTER[i + 1:])
COLLINEAR_SQL = row_sql("interactions", "collinear_pairs", "*", "ratings", f"({PAIRS_SQL})", "<= 5 pairs", f"({PAIRS_SQL})", "PASSED_WITH_WARNINGS", gate=f"({PAIRS_SQL}) > 5")


@query("v16_feature_statistics", STAT_SQL + " UNION ALL " + COLLINEAR_SQL)
def feature_statistics(t):
    return q.feature_statistics(user_frame(t), t.ratings, STAT_USER, STAT_INTER)


@query("v17_feature_report", f"""
SELECT "check", CASE max(CASE status WHEN 'FAILED' THEN 2 WHEN 'PASSED_WITH_WARNINGS' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAILED' WHEN 1 THEN 'PASSED_WITH_WARNINGS' ELSE 'PASSED' END AS status,
    count(*) AS checks FROM ({union(V12, V13, V14, consistency_sql("UserID", "users"), consistency_sql("MovieID", "movies"), STAT_SQL, COLLINEAR_SQL)}) GROUP BY 1""")
def feature_report(t):
    """Every check of every feature set, rolled up by check; the checks share ratings that are joined and written once."""
    t = copy(t)
    t.ratings = stored(t.ratings, "ratings")
    report = parts(
        feature_schema(t), feature_nulls(t), feature_ranges(t),
        q.feature_consistency(t.ratings, t.users, "UserID"), q.feature_consistency(t.ratings, t.movies, "MovieID"),
        q.feature_statistics(user_frame(t), t.ratings, STAT_USER, STAT_INTER),
    )
    return q.overall_status(report, ["check"])


DAY = 'CAST(epoch_ms("Timestamp" * 1000) AS DATE)'
PER_USER = "(SELECT count(*) AS n FROM ratings GROUP BY UserID)"


@query("v18_declared_rules", union(
    row_sql("users", "regex", "ZipCode", "users", where("NOT regexp_matches(ZipCode, '^[0-9]{5}$')"), "^[0-9]{5}$"),
    row_sql("users", "min_length", "ZipCode", "users", where("length(ZipCode) < 5"), ">= 5", "min(length(ZipCode))"),
    row_sql("ratings", "min_date", "Timestamp", "ratings", where(f"{DAY} < DATE '1995-06-01'"), "1995-06-01"),
    row_sql("ratings", "max_date", "Timestamp", "ratings", where(f"{DAY} > DATE '2001-06-30'"), "2001-06-30"),
    row_sql("ratings", "min_rows_per_key", "UserID", PER_USER, where("n < 20"), ">= 20", "min(n)"),
    unique_sql("ratings", "unique", "ratings", ["UserID", "MovieID"], 0)))
def declared(t):
    return parts(
        q.run_checks(t.users, "users", q.text_checks(USERS)),
        q.run_checks(t.ratings, "ratings", q.date_checks(RATINGS)),
        q.min_rows_per_key_check("ratings", t.ratings, "UserID", RATINGS.min_rows_per["UserID"]),
        q.uniqueness_check("ratings", t.ratings, RATINGS.unique[0], check="unique"),
    )


@query("v18_full_validation", union(
    *V01,
    *[row_sql(n, "nullability", c, n, where(f'"{c}" IS NULL'), "not null") for n, r in ALL[:2] for c, k in r.columns.items() if not k.nullable],
    row_sql("users", "min", "Age", "users", where("Age < 1"), ">= 1", "min(Age)"),
    row_sql("users", "max", "Age", "users", where("Age > 50"), "<= 50", "max(Age)"),
    row_sql("users", "min", "Occupation", "users", where("Occupation < 0"), ">= 0", "min(Occupation)"),
    row_sql("users", "max", "Occupation", "users", where("Occupation > 20"), "<= 20", "max(Occupation)"),
    row_sql("users", "allowed_values", "Gender", "users", where("Gender NOT IN ('M', 'F')"), "2 values"),
    row_sql("users", "regex", "ZipCode", "users", where("NOT regexp_matches(ZipCode, '^[0-9]{5}$')"), "^[0-9]{5}$"),
    row_sql("users", "min_length", "ZipCode", "users", where("length(ZipCode) < 5"), ">= 5", "min(length(ZipCode))"),
    row_sql("movies", "min", "MovieID", "movies", where("MovieID < 1"), ">= 1", "min(MovieID)"),
    row_sql("movies", "max", "MovieID", "movies", where("MovieID > 1500"), "<= 1500", "max(MovieID)"),
    row_sql("movies", "allowed_values", "Genres", "movies", where("Genres LIKE '%widget%'"), "13 values"),
    row_sql("movies", "min_length", "Title", "movies", where("length(Title) < 1"), ">= 1", "min(length(Title))"),
    *[s for n, r in ALL[:2] for s in complete_sql(n, r)],
    unique_sql("users", "primary_key", "users", ["UserID"], 0), unique_sql("movies", "primary_key", "movies", ["MovieID"], 0),
    *[row_sql("ratings", "nullability", c, "ratings", where(f'"{c}" IS NULL'), "not null") for c in RATINGS.columns],
    row_sql("ratings", "min", "UserID", "ratings", where("UserID < 1"), ">= 1", "min(UserID)"),
    row_sql("ratings", "min", "MovieID", "ratings", where("MovieID < 1"), ">= 1", "min(MovieID)"),
    row_sql("ratings", "min", "Rating", "ratings", where("Rating < 0.5"), ">= 0.5", "min(Rating)"),
    row_sql("ratings", "max", "Rating", "ratings", where("Rating > 5"), "<= 5", "max(Rating)"),
    row_sql("ratings", "step", "Rating", "ratings", where("CAST(Rating AS INTEGER) % 2 <> 0"), "multiple of 2", on_fail="PASSED_WITH_WARNINGS"),
    row_sql("ratings", "min_date", "Timestamp", "ratings", where(f"{DAY} < DATE '1995-06-01'"), "1995-06-01"),
    row_sql("ratings", "max_date", "Timestamp", "ratings", where(f"{DAY} > DATE '2001-06-30'"), "2001-06-30"),
    *[row_sql("ratings", "completeness", c, "ratings", where(f'"{c}" IS NULL'), "null rate <= 0", where(f'"{c}" IS NULL') + " / CAST(count(*) AS DOUBLE)")
      for c in RATINGS.columns],
    unique_sql("ratings", "primary_key", "ratings", ["UserID", "MovieID", '"Timestamp"'], 0.001),
    unique_sql("ratings", "unique", "ratings", ["UserID", "MovieID"], 0),
    fk_sql("ratings", "ratings", "UserID", "SELECT UserID FROM users", 0.9999), fk_sql("ratings", "ratings", "MovieID", "SELECT MovieID FROM movies", 0.9999),
    row_sql("ratings", "min_rows_per_key", "UserID", PER_USER, where("n < 20"), ">= 20", "min(n)")))
def full(t):
    """Every rule of every table."""
    return parts(
        q.validate("users", t.users, USERS), q.validate("movies", t.movies, MOVIES),
        q.validate("ratings", t.ratings, RATINGS, {"users": t.users, "movies": t.movies}),
    )


@query("v19_orphaned_events", fk_sql("user_events", "user_events", "recommendation_id", "SELECT recommendation_id FROM recommendation_logs", 1.0))
def orphans(t):
    return q.orphaned_events(t.user_events, t.recommendation_logs)


@query("v20_layer_reconciliation", """
SELECT 'ratings' AS dataset, 'raw' AS layer, count(*) AS "rows", CAST(0 AS BIGINT) AS diff_to_first FROM lineitem
UNION ALL SELECT 'ratings', 'processed', count(*), count(*) - (SELECT count(*) FROM lineitem) FROM ratings
UNION ALL SELECT 'ratings', 'features', count(*), count(*) - (SELECT count(*) FROM lineitem) FROM (SELECT DISTINCT UserID, MovieID FROM ratings)
UNION ALL SELECT 'users', 'raw', count(*), 0 FROM customer
UNION ALL SELECT 'users', 'features', count(*), count(*) - (SELECT count(*) FROM customer) FROM (SELECT DISTINCT UserID FROM ratings)""")
def layers(t):
    return q.reconcile_layers({
        "ratings": {"raw": t.raw("lineitem"), "processed": t.ratings, "features": t.ratings.select("UserID", "MovieID").distinct()},
        "users": {"raw": t.raw("customer"), "features": t.ratings.select("UserID").distinct()},
    })


