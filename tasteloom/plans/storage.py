"""Source and sink queries: each writes the given tables through a sink and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import features as fe
from ..operators import relational as rel
from ..session import scratch
from ..sources import keyed_log, snapshots
from ..sources import readers as rd
from ..sources import sinks as sk
from ..tables import AS_OF, MOVIES, USERS
from .feedback import METRICS, business, training_labels
from .registry import query

OLD, NEW = "20240130_000000", "20240131_000000"
TABLES = ["customer", "events", "lineitem", "orders", "part"]


def as_lines(df):
    return df.select(F.concat_ws("::", *[F.col(c).cast("string") for c in df.columns]).alias("value"))


@query("s01_delimited_scan", "SELECT CAST(MovieID AS INTEGER) AS MovieID, Title, Genres FROM movies")
def delimited(t):
    path = scratch(t.spark, "movies.dat")
    as_lines(t.movies).write.text(path)
    scan = rd.read_delimited(t.spark, path, MOVIES)
    return scan.filter(F.col(rd.CORRUPT).isNull()).drop(rd.CORRUPT)


@query("s02_raw_fallback", "SELECT CAST(UserID AS INTEGER) AS UserID, Gender, Age, Occupation, ZipCode FROM users")
def fallback(t):
    base = scratch(t.spark, "users")
    as_lines(t.users).write.text(f"{base}/raw")
    return rd.read_or_raw(t.spark, f"{base}/versions", f"{base}/raw", USERS)


@query("s03_parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < DATE '1996-01-01'")
def parquet(t):
    return t.raw("lineitem").filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_quantity")


def two_versions(t):
    base = scratch(t.spark, "movies")
    sk.write_version(t.movies.select("MovieID", F.lit(None).cast("string").alias("Title"), "Genres"), base, OLD)
    sk.write_version(t.movies, base, NEW)
    return base


@query("s04_latest_version", f"SELECT '{NEW}' AS by_name, '{NEW}' AS by_bytes, '{NEW}' AS by_modified, count(*) AS \"rows\" FROM movies")
def latest(t):
    base = two_versions(t)
    picks = {p: rd.latest_version(t.spark, base, p) for p in ("name", "bytes", "modified")}
    return rd.read_version(t.spark, base).agg(F.count(F.lit(1)).alias("rows")).select(
        *[F.lit(v).alias(f"by_{p}") for p, v in picks.items()], "rows"
    )


@query("s05_versioned_sink", f"""
SELECT '{OLD}' AS data_version, count(*) AS n, CAST(0 AS BIGINT) AS titles FROM movies UNION ALL SELECT '{NEW}', count(*), count(Title) FROM movies""")
def versioned(t):
    return rd.read_all_versions(t.spark, two_versions(t)).groupBy("data_version").agg(
        F.count(F.lit(1)).alias("n"), F.count("Title").alias("titles")
    )


@query("s06_feature_sink", "SELECT UserID, round(AvgRating, 6) AS AvgRating, RatingCount FROM user_stats")
def feature_sink(t):
    base = scratch(t.spark, "features")
    stats = fe.user_stats(t.ratings).select("UserID", r6("AvgRating").alias("AvgRating"), "RatingCount")
    sk.write_features(stats, base, "user_features", NEW)
    return sk.latest_features(t.spark, base, "user_features")


@query("s07_multi_part_read", "SELECT UserID, MovieID, Rating FROM ratings")
def multi_part(t):
    path = scratch(t.spark, "parts")
    t.ratings.select("UserID", "MovieID", "Rating").repartition(4).write.parquet(path)
    return t.spark.read.parquet(path)


@query("s09_file_manifest")
def manifest(t):
    return rd.list_files(t.spark, t.path, "*.parquet")


@query("s09_missing_files", "SELECT 'ratings.dat' AS name")
def missing(t):
    files = rd.list_files(t.spark, t.path, "*.parquet", recursive=True)
    tables = files.select(F.regexp_extract("path", r"([a-z]+)\.parquet(/|$)", 1).alias("name"))
    return rd.missing_files(tables, [*TABLES, "ratings.dat"])


@query("s10_sql_table_read", "SELECT event_type, count(*) AS n FROM user_events WHERE is_synthetic GROUP BY 1")
def sql_table(t):
    return rd.read_sql(t.spark, {"user_events": t.user_events}, "SELECT event_type, count(*) AS n FROM {user_events} WHERE is_synthetic GROUP BY event_type")


@query("s11_upsert", """SELECT user_id, item_id, label, label_date FROM training_labels
UNION ALL SELECT user_id, item_id, CAST(-1 AS DOUBLE), DATE '2024-01-20' FROM training_labels""")
def upsert(t):
    """Two loads of one day and one load of another day; the second load of a day is a no-op."""
    path = scratch(t.spark, "training_labels")
    labels = training_labels(t).select("user_id", "item_id", "label", "label_date")
    keys = ["user_id", "item_id", "label_date"]
    other_day = labels.withColumn("label", F.lit(-1.0)).withColumn("label_date", F.lit("2024-01-20").cast("date"))
    sk.upsert_partitions(t.spark, path, other_day, keys, "label_date")
    stale = labels.withColumn("label", F.lit(0.0))
    for batch in (stale, labels, labels):
        sk.upsert_partitions(t.spark, path, batch, keys, "label_date")
    return snapshots.read(t.spark, path)


@query("s12_insert_if_absent", "SELECT recommendation_id, user_id, model_version FROM recommendation_logs")
def insert(t):
    path = scratch(t.spark, "recommendation_logs")
    logs = t.recommendation_logs.select("recommendation_id", "user_id", "model_version", "is_synthetic")
    sk.insert_if_absent(t.spark, path, logs.filter("is_synthetic").drop("is_synthetic"), ["recommendation_id"])
    both = logs.drop("is_synthetic")
    sk.insert_if_absent(t.spark, path, both.unionByName(both), ["recommendation_id"])
    return keyed_log.read(t.spark, path)


@query("s13_json_report", METRICS + "SELECT * FROM metrics")
def report(t):
    base = scratch(t.spark, "reports")
    sk.write_report(business(t), base, "business", NEW)
    return t.spark.read.schema(business(t).schema).json(f"{base}/business/{rd.VERSION}={NEW}")


@query("s14_ingestion_manifest", f"""SELECT 'movies' AS dataset, count(*) AS "rows", 'MovieID,Title,Genres' AS "columns", '{NEW}' AS version FROM movies
UNION ALL SELECT 'ratings', count(*), 'UserID,MovieID,Rating,Timestamp', '{NEW}' FROM ratings
UNION ALL SELECT 'users', count(*), 'UserID,Gender,Age,Occupation,ZipCode', '{NEW}' FROM users""")
def ingestion(t):
    base = scratch(t.spark, "ingest")
    out = None
    for name, df in (("movies", t.movies), ("ratings", t.ratings), ("users", t.users)):
        row = sk.observed_write(df, f"{t.path}:{name}", f"{base}/{name}", NEW)
        out = row if out is None else out.unionByName(row)
    return out.select(F.element_at(F.split("source", ":"), -1).alias("dataset"), "rows", "columns", "version")


@query("d01_baseline_snapshot", """SELECT "column", nulls, "rows" FROM (SELECT 'UserID' AS "column", count(*) FILTER (WHERE UserID IS NULL) AS nulls, count(*) AS "rows" FROM ratings
UNION ALL SELECT 'MovieID', count(*) FILTER (WHERE MovieID IS NULL), count(*) FROM ratings UNION ALL SELECT 'Rating', count(*) FILTER (WHERE Rating IS NULL), count(*) FROM ratings
UNION ALL SELECT 'Timestamp', count(*) FILTER (WHERE "Timestamp" IS NULL), count(*) FROM ratings)""")
def baseline(t):
    base = scratch(t.spark, "baseline")
    sk.save_baseline(t.ratings, base, NEW)
    back = rd.read_version(t.spark, f"{base}/data")
    return fe.null_profile(back).select("column", "nulls", "rows")


@query("p12_retention_sink", """SELECT 'archive' AS tier, count(*) AS n FROM user_events WHERE created_at < DATE '2024-01-31' - INTERVAL 14 DAY
UNION ALL SELECT 'hot', count(*) FROM user_events WHERE created_at >= DATE '2024-01-31' - INTERVAL 14 DAY""")
def retention(t):
    base = scratch(t.spark, "retention")
    snapshots.replace(t.user_events, base, "hot")
    for _ in range(2):  # the second run finds nothing to move
        sk.archive(t.spark, base, lambda hot: rel.retention(hot, "created_at", AS_OF, 14))

    def total(tier):
        return snapshots.read(t.spark, base, [tier]).agg(F.count(F.lit(1)).alias("n")).select(F.lit(tier).alias("tier"), "n")

    return total("archive").unionByName(total("hot"))
