"""Schemas of the recommender model and its bindings to the benchmark tables.

``Tables`` derives every model table lazily from the parquet tables of one folder.
``BINDING_SQL`` states the same derivations in SQL for the oracle.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .functions.expr import hash_bucket
from .session import configure

AS_OF = "2024-01-31"
DRIFT_SPLIT = "2024-01-16"

# The genre vocabulary of the bound tables.
GENRES = [
    "ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD",
    "anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget",
]
OCCUPATIONS = list(range(21))


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


I, L, S, D, B, TS = T.IntegerType(), T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

MOVIES = _struct(("MovieID", I), ("Title", S), ("Genres", S))
RATINGS = _struct(("UserID", I), ("MovieID", I), ("Rating", D), ("Timestamp", L))
USERS = _struct(("UserID", I), ("Gender", S), ("Age", I), ("Occupation", I), ("ZipCode", S))
RECOMMENDATION_LOGS = _struct(
    ("recommendation_id", S), ("user_id", L), ("item_ids", T.ArrayType(L)), ("scores", T.ArrayType(D)),
    ("model_name", S), ("model_version", S), ("model_run_id", S), ("is_synthetic", B), ("context", S), ("created_at", TS),
)
USER_EVENTS = _struct(
    ("event_id", S), ("event_type", S), ("user_id", L), ("item_id", L), ("recommendation_id", S), ("position", I),
    ("watch_duration_seconds", I), ("total_duration_seconds", I), ("completion_rate", D), ("feedback_type", S),
    ("rating", D), ("is_synthetic", B), ("session_id", S), ("device_type", S), ("context", S), ("created_at", TS),
)
TRAINING_LABELS = _struct(
    ("user_id", L), ("item_id", L), ("label", D), ("click_count", I), ("watch_count", I), ("like_count", I),
    ("dislike_count", I), ("avg_completion_rate", D), ("recommendation_id", S), ("model_version", S),
    ("is_synthetic", B), ("label_date", T.DateType()), ("created_at", TS), ("updated_at", TS),
)
MODEL_PERFORMANCE = _struct(
    ("model_name", S), ("model_version", S), ("stage", S), ("rmse", D), ("mae", D), ("mse", D), ("r2_score", D),
    ("ctr", D), ("watch_rate", D), ("avg_watch_completion", D), ("avg_engagement_score", D), ("p50_latency_ms", D),
    ("p95_latency_ms", D), ("p99_latency_ms", D), ("error_rate", D), ("sample_count", L), ("synthetic_ratio", D),
    ("evaluation_date", TS), ("is_production", B),
)
RETRAINING_TRIGGERS = _struct(
    ("trigger_id", L), ("trigger_type", S), ("trigger_reason", S), ("training_status", S), ("created_at", TS),
)
AB_TEST_RESULTS = _struct(
    ("experiment_name", S), ("control_model_version", S), ("treatment_model_version", S),
    ("traffic_percentage_treatment", I), ("control_ctr", D), ("treatment_ctr", D), ("ctr_lift_percent", D),
    ("control_watch_rate", D), ("treatment_watch_rate", D), ("sample_size", L), ("p_value", D),
    ("is_significant", B), ("decision", S), ("decision_reason", S), ("test_start_date", TS), ("test_end_date", TS),
)

# Intake fields of a raw feedback event as collected.
RAW_EVENT = _struct(
    ("event_id", S), ("event_type", S), ("user_id", L), ("item_id", L), ("item_ids", T.ArrayType(L)),
    ("scores", T.ArrayType(D)), ("model_name", S), ("model_version", S), ("recommendation_id", S), ("position", I),
    ("watch_duration_seconds", I), ("total_duration_seconds", I), ("feedback_type", S), ("rating", D),
    ("is_synthetic", B), ("session_id", S), ("context", S), ("timestamp", TS),
)


def bind_events(events: DataFrame) -> DataFrame:
    """Feedback events out of the ``events`` table; works on batch and stream alike."""
    kind, eid, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    item = F.get_json_object("props", "$.k").cast("bigint")
    watch = kind == "purchase"
    return events.select(
        eid,
        F.when(kind == "view", "impression").when(kind == "click", "click").when(watch, "watch")
        .otherwise("feedback").alias("event_type"),
        user,
        item.alias("item_id"),
        (user * 1000 + item).cast("string").alias("recommendation_id"),
        F.when(kind == "click", (eid % 10).cast("int")).alias("position"),
        F.when(watch, F.floor(F.col("value") * 60).cast("int")).alias("watch_duration_seconds"),
        F.when(watch, F.lit(6000)).alias("total_duration_seconds"),
        F.when(watch, F.least(F.col("value") / 100, F.lit(1.0))).alias("completion_rate"),
        F.when((kind == "signup") & (eid % 5 == 0), "rating").when(kind == "signup", "like")
        .when((kind == "error") & (eid % 2 == 0), "dislike").when(kind == "error", "not_interested")
        .alias("feedback_type"),
        F.when((kind == "signup") & (eid % 5 == 0), 1.0 + (F.floor(eid / 5) % 9) * 0.5).alias("rating"),
        (user % 5 == 0).alias("is_synthetic"),
        F.when(user % 3 == 0, "mobile").when(user % 3 == 1, "desktop").otherwise("tv").alias("device_type"),
        F.col("props").alias("context"),
        F.col("ts").alias("created_at"),
    )


def bind_raw_events(events: DataFrame) -> DataFrame:
    """Raw intake events out of the ``events`` table, a few of them broken; works on batch and stream alike."""
    kind, eid, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    item = F.get_json_object("props", "$.k").cast("bigint")
    view, click, watch = kind == "view", kind == "click", kind == "purchase"
    rated = (kind == "signup") & (eid % 5 == 0)
    empty = F.array().cast("array<bigint>")
    return events.select(
        eid,
        F.when(view, "impression").when(click, "click").when(watch, "watch").when(eid % 19 == 0, "hover")
        .otherwise("feedback").alias("event_type"),
        user,
        item.alias("item_id"),
        F.when(view, F.when(eid % 23 == 0, empty).otherwise(F.array(item, item + 1))).alias("item_ids"),
        F.lit("ranker").alias("model_name"),
        F.when(hash_bucket(["user_id"], 100) < 50, "v1").otherwise("v2").alias("model_version"),
        (user * 1000 + item).cast("string").alias("recommendation_id"),
        F.when(click, (eid % 12 - 1).cast("int")).alias("position"),
        F.when(watch, F.floor(F.col("value") * 60).cast("int")).alias("watch_duration_seconds"),
        F.when(watch, F.when(eid % 29 == 0, 0).otherwise(6000)).alias("total_duration_seconds"),
        F.when(rated, "rating").when(kind == "signup", "like").when(eid % 2 == 0, "dislike").otherwise("not_interested")
        .alias("feedback_type"),
        F.when(rated, (F.floor(eid / 5) % 13) * 0.5).alias("rating"),
        (user % 5 == 0).alias("is_synthetic"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


class Tables:
    """The model tables over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = configure(spark)
        self.path = path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            key.alias("UserID"),
            F.when(key % 2 == 0, "M").otherwise("F").alias("Gender"),
            (1 + key % 60).cast("int").alias("Age"),
            (F.col("c_nationkey") % 21).cast("int").alias("Occupation"),
            F.lpad(key.cast("string"), 5, "0").alias("ZipCode"),
        )

    @cached_property
    def movies(self) -> DataFrame:
        second = F.split_part("p_name", F.lit(" "), F.lit(2))
        return self.raw("part").select(
            F.col("p_partkey").alias("MovieID"),
            F.col("p_name").alias("Title"),
            F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit("|"), second))
            .otherwise(F.col("p_type")).alias("Genres"),
        )

    @cached_property
    def ratings(self) -> DataFrame:
        lines = self.raw("lineitem").select(
            "l_orderkey",
            F.col("l_partkey").alias("MovieID"),
            F.ceil(F.col("l_quantity") / 10).cast("double").alias("Rating"),
            F.unix_timestamp("l_shipdate").alias("Timestamp"),
        )
        buyers = self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("UserID"))
        joined = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select("UserID", "MovieID", "Rating", "Timestamp")

    @cached_property
    def user_events(self) -> DataFrame:
        return bind_events(self.raw("events"))

    @cached_property
    def raw_events(self) -> DataFrame:
        return bind_raw_events(self.raw("events"))

    @cached_property
    def recommendation_logs(self) -> DataFrame:
        shown = self.user_events.filter(F.col("event_type") == "impression")
        first = shown.groupBy("recommendation_id", "user_id", "item_id").agg(F.min("created_at").alias("created_at"))
        item = F.col("item_id")
        version = F.when(hash_bucket(["user_id"], 100) < 50, "v1").otherwise("v2")
        return first.select(
            "recommendation_id",
            "user_id",
            F.array(item, (item + 1) % 100, (item + 2) % 100).alias("item_ids"),
            F.array(*[F.round(1.0 - s * 0.25 - (item % 5) * 0.01, 2) for s in range(3)]).alias("scores"),
            F.lit("ranker").alias("model_name"),
            version.alias("model_version"),
            F.concat(F.lit("run-"), version).alias("model_run_id"),
            (F.col("user_id") % 5 == 0).alias("is_synthetic"),
            F.concat(F.lit('{"k": '), item.cast("string"), F.lit("}")).alias("context"),
            "created_at",
        )

    @cached_property
    def retraining_triggers(self) -> DataFrame:
        eid = F.col("event_id")
        return self.raw("events").filter(F.col("event_type") == "error").select(
            eid.alias("trigger_id"),
            F.when(eid % 3 == 0, "manual").when(eid % 3 == 1, "drift").otherwise("schedule").alias("trigger_type"),
            F.concat(F.lit("reason "), (eid % 7).cast("string")).alias("trigger_reason"),
            F.when((eid % 97 == 0) & (F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz")), "success")
            .when(eid % 4 == 0, "pending").otherwise("failed").alias("training_status"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """One evaluated run per supplier: the error of the constant 3 on that supplier's ratings."""
        rating = F.ceil(F.col("l_quantity") / 10).cast("double")
        scored = self.raw("lineitem").groupBy("l_suppkey").agg(
            F.round(F.sqrt(F.avg((rating - 3) * (rating - 3))), 6).alias("r"),
            F.round(F.avg(F.abs(rating - 3)), 6).alias("m"),
        )
        key = F.col("l_suppkey")
        kind = F.when(key % 11 == 0, "none").when(key % 7 == 0, "base").otherwise("nmf")
        return scored.select(
            F.concat(F.lit("run_"), key.cast("string")).alias("run_id"),
            (key % 10).alias("experiment"),
            F.when(kind == "nmf", F.col("r")).when(kind == "none", F.lit(float("nan"))).alias("rmse"),
            F.when(kind == "nmf", F.col("m")).when(kind == "none", F.lit(float("nan"))).alias("mae"),
            F.when(kind == "base", F.col("r")).alias("baseline_rmse"),
            F.when(kind == "base", F.col("m")).alias("baseline_mae"),
        )

    @cached_property
    def model_versions(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.raw("customer").select(
            F.concat(F.lit("model_"), F.col("c_nationkey").cast("string")).alias("model_name"),
            key.alias("version"),
            F.when(key % 7 == 0, "Production").when(key % 7 == 1, "Archived").when(key % 7 == 2, "Staging")
            .otherwise("None").alias("stage"),
            F.concat(F.lit("run_"), (key % 100 + 1).cast("string")).alias("run_id"),
            F.round(F.col("c_acctbal") / 1000, 4).alias("rmse"),
        )

    @cached_property
    def metric_samples(self) -> DataFrame:
        return self.raw("events").select(
            "event_id",
            "ts",
            F.col("event_type").alias("metric"),
            (F.col("user_id") % 4).alias("instance"),
            "value",
        )

    @cached_property
    def lineage_edges(self) -> DataFrame:
        """order <- customer <- nation <- region, one edge per recorded derivation."""

        def edge(df, source, source_col, target, target_col, kind):
            return df.select(
                F.concat(F.lit(f"{source}:"), F.col(source_col).cast("string")).alias("source"),
                F.concat(F.lit(f"{target}:"), F.col(target_col).cast("string")).alias("target"),
                F.lit(kind).alias("transform_type"),
            )

        return (
            edge(self.raw("orders"), "customer", "o_custkey", "order", "o_orderkey", "feature_engineering")
            .unionByName(edge(self.raw("customer"), "nation", "c_nationkey", "customer", "c_custkey", "validation"))
            .unionByName(edge(self.raw("nation"), "region", "n_regionkey", "nation", "n_nationkey", "ingestion"))
        )


# The same bindings for the oracle, in dependency order.
BINDING_SQL = {
    "users": """SELECT c_custkey AS UserID, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS Gender,
        CAST(1 + c_custkey % 60 AS INTEGER) AS Age, CAST(c_nationkey % 21 AS INTEGER) AS Occupation,
        lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS ZipCode FROM customer""",
    "movies": """SELECT p_partkey AS MovieID, p_name AS Title,
        CASE WHEN p_partkey % 2 = 0 THEN p_type || '|' || split_part(p_name, ' ', 2) ELSE p_type END AS Genres
        FROM part""",
    "ratings": """SELECT o_custkey AS UserID, l_partkey AS MovieID, CAST(ceil(l_quantity / 10) AS DOUBLE) AS Rating,
        CAST(epoch(l_shipdate) AS BIGINT) AS "Timestamp"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "user_events": """SELECT event_id,
        CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'watch'
             ELSE 'feedback' END AS event_type,
        user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
        CAST(user_id * 1000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS recommendation_id,
        CASE WHEN event_type = 'click' THEN CAST(event_id % 10 AS INTEGER) END AS position,
        CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 60) AS INTEGER) END AS watch_duration_seconds,
        CASE WHEN event_type = 'purchase' THEN 6000 END AS total_duration_seconds,
        CASE WHEN event_type = 'purchase' THEN least(value / 100, CAST(1 AS DOUBLE)) END AS completion_rate,
        CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'rating' WHEN event_type = 'signup' THEN 'like'
             WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'dislike'
             WHEN event_type = 'error' THEN 'not_interested' END AS feedback_type,
        CASE WHEN event_type = 'signup' AND event_id % 5 = 0
             THEN CAST(1 + ((event_id // 5) % 9) * 0.5 AS DOUBLE) END AS rating,
        user_id % 5 = 0 AS is_synthetic,
        CASE user_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' ELSE 'tv' END AS device_type,
        props AS context, ts AS created_at FROM events""",
    "raw_events": """SELECT event_id, CASE WHEN event_type = 'view' THEN 'impression' WHEN event_type = 'click' THEN 'click'
        WHEN event_type = 'purchase' THEN 'watch' WHEN event_id % 19 = 0 THEN 'hover' ELSE 'feedback' END AS event_type, user_id,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
        CASE WHEN event_type = 'view' AND event_id % 23 = 0 THEN 0 WHEN event_type = 'view' THEN 2 END AS n_items,
        CASE WHEN CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 50 THEN 'v1' ELSE 'v2' END AS model_version,
        CAST(user_id * 1000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS recommendation_id,
        CASE WHEN event_type = 'click' THEN CAST(event_id % 12 - 1 AS INTEGER) END AS position,
        CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 60) AS INTEGER) END AS watch_duration_seconds,
        CASE WHEN event_type = 'purchase' AND event_id % 29 = 0 THEN 0 WHEN event_type = 'purchase' THEN 6000 END AS total_duration_seconds,
        CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN CAST(((event_id // 5) % 13) * 0.5 AS DOUBLE) END AS rating,
        user_id % 5 = 0 AS is_synthetic, ts AS "timestamp" FROM events""",
    "checked_events": """SELECT *, concat_ws(',', CASE WHEN event_type = 'hover' THEN 'unknown_type' END,
        CASE WHEN n_items < 1 THEN 'items_empty' END, CASE WHEN position < 0 THEN 'position_invalid' END,
        CASE WHEN event_type = 'watch' AND total_duration_seconds <= 0 THEN 'total_invalid' END,
        CASE WHEN event_type = 'feedback' AND rating > 5 THEN 'rating_out_of_range' END) AS reasons FROM raw_events""",
    "recommendation_logs": """SELECT recommendation_id, user_id,
        [item_id, (item_id + 1) % 100, (item_id + 2) % 100] AS item_ids,
        [CAST(round(1.0 - 0 * 0.25 - (item_id % 5) * 0.01, 2) AS DOUBLE),
         CAST(round(1.0 - 1 * 0.25 - (item_id % 5) * 0.01, 2) AS DOUBLE),
         CAST(round(1.0 - 2 * 0.25 - (item_id % 5) * 0.01, 2) AS DOUBLE)] AS scores,
        'ranker' AS model_name,
        CASE WHEN CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 50
             THEN 'v1' ELSE 'v2' END AS model_version,
        'run-' || CASE WHEN CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 50
             THEN 'v1' ELSE 'v2' END AS model_run_id,
        user_id % 5 = 0 AS is_synthetic, '{"k": ' || CAST(item_id AS VARCHAR) || '}' AS context,
        min(created_at) AS created_at
        FROM user_events WHERE event_type = 'impression' GROUP BY recommendation_id, user_id, item_id""",
    "interactions": """SELECT user_id, item_id, recommendation_id, 1 AS has_click,
        coalesce(max(completion_rate) FILTER (WHERE event_type = 'watch'), CAST(0 AS DOUBLE)) AS max_completion,
        CAST(coalesce(bool_or(feedback_type = 'like'), false) AS INTEGER) AS has_like,
        CAST(coalesce(bool_or(feedback_type = 'dislike'), false) AS INTEGER) AS has_dislike,
        CAST(coalesce(bool_or(feedback_type = 'not_interested'), false) AS INTEGER) AS has_not_interested,
        max(rating) FILTER (WHERE feedback_type = 'rating') AS explicit_rating,
        CAST(bool_or(is_synthetic) AS INTEGER) AS is_synthetic, max(created_at) AS last_interaction
        FROM user_events WHERE created_at >= DATE '2024-01-31' - INTERVAL 30 DAY
        GROUP BY ALL HAVING bool_or(event_type = 'click')""",
    "labelled": """SELECT *, CASE WHEN explicit_rating IS NOT NULL THEN explicit_rating ELSE
        CAST(greatest(0, least(5, 1.0 + CASE WHEN max_completion > 0.75 THEN 3.0 WHEN max_completion > 0.25 THEN 1.5
             WHEN max_completion > 0 THEN 0.5 ELSE 0.0 END
             + 2.0 * has_like - 1.0 * has_dislike - 1.5 * has_not_interested)) AS DOUBLE) END AS label
        FROM interactions""",
    "training_labels": """SELECT user_id, item_id, label, recommendation_id, is_synthetic, last_interaction,
        DATE '2024-01-31' AS label_date FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id
            ORDER BY last_interaction DESC, recommendation_id DESC) AS rn FROM labelled) WHERE rn = 1""",
    "retraining_triggers": """SELECT event_id AS trigger_id,
        CASE event_id % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'drift' ELSE 'schedule' END AS trigger_type,
        'reason ' || CAST(event_id % 7 AS VARCHAR) AS trigger_reason,
        CASE WHEN event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-11' THEN 'success'
             WHEN event_id % 4 = 0 THEN 'pending' ELSE 'failed' END AS training_status,
        ts AS created_at FROM events WHERE event_type = 'error'""",
    "runs": """SELECT 'run_' || CAST(l_suppkey AS VARCHAR) AS run_id, l_suppkey % 10 AS experiment,
        CASE WHEN l_suppkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_suppkey % 7 = 0 THEN NULL ELSE r END AS rmse,
        CASE WHEN l_suppkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_suppkey % 7 = 0 THEN NULL ELSE m END AS mae,
        CASE WHEN l_suppkey % 11 <> 0 AND l_suppkey % 7 = 0 THEN r END AS baseline_rmse,
        CASE WHEN l_suppkey % 11 <> 0 AND l_suppkey % 7 = 0 THEN m END AS baseline_mae
        FROM (SELECT l_suppkey, round(sqrt(avg((ceil(l_quantity / 10) - 3) * (ceil(l_quantity / 10) - 3))), 6) AS r,
              round(avg(abs(ceil(l_quantity / 10) - 3)), 6) AS m FROM lineitem GROUP BY 1)""",
    "model_versions": """SELECT 'model_' || CAST(c_nationkey AS VARCHAR) AS model_name, c_custkey AS version,
        CASE c_custkey % 7 WHEN 0 THEN 'Production' WHEN 1 THEN 'Archived' WHEN 2 THEN 'Staging' ELSE 'None' END AS stage,
        'run_' || CAST(c_custkey % 100 + 1 AS VARCHAR) AS run_id, round(c_acctbal / 1000, 4) AS rmse FROM customer""",
    "metric_samples": "SELECT event_id, ts, event_type AS metric, user_id % 4 AS instance, value FROM events",
    "lineage_edges": """SELECT 'customer:' || CAST(o_custkey AS VARCHAR) AS source, 'order:' || CAST(o_orderkey AS VARCHAR) AS target,
        'feature_engineering' AS transform_type FROM orders
        UNION ALL SELECT 'nation:' || CAST(c_nationkey AS VARCHAR), 'customer:' || CAST(c_custkey AS VARCHAR), 'validation' FROM customer
        UNION ALL SELECT 'region:' || CAST(n_regionkey AS VARCHAR), 'nation:' || CAST(n_nationkey AS VARCHAR), 'ingestion' FROM nation""",
    "user_stats": """SELECT UserID, count(*) AS RatingCount, avg(Rating) AS AvgRating, stddev_samp(Rating) AS StdRating,
        max(Rating) - min(Rating) AS RatingRange, max("Timestamp") AS LastTs, min("Timestamp") AS FirstTs
        FROM ratings GROUP BY UserID""",
    "movie_stats": """SELECT MovieID, count(*) AS Popularity, avg(Rating) AS AvgRating, stddev_samp(Rating) AS StdRating
        FROM ratings GROUP BY MovieID""",
}


def bind_sql(body: str) -> str:
    """Prefix ``body`` with the bindings it uses, directly or through another binding."""
    needed, text = [], body
    for name in reversed(BINDING_SQL):
        if re.search(rf"\b{name}\b", text):
            needed.insert(0, name)
            text += " " + BINDING_SQL[name]
    body = body.strip()
    if not needed:
        return body
    ctes = ", ".join(f"{n} AS ({BINDING_SQL[n]})" for n in needed)
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    recursive = "RECURSIVE " if match and match.group(1) else ""
    rest = ", " + body[match.end():] if match else " " + body
    return f"WITH {recursive}{ctes}{rest}"
