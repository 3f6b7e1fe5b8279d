"""Declarative data-quality rules compiled to one aggregation per table.

Every operator returns rows ``(dataset, check, column, status, observed, expected, violations)``.
All column rules of a table share a single pass; key rules add one grouped pass each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.expr import off_step, split_list
from .relational import duplicate_profile, pairwise_correlation

PASSED, WARNED, FAILED = "PASSED", "PASSED_WITH_WARNINGS", "FAILED"
REPORT = ["dataset", "check", "column", "status", "observed", "expected", "violations"]


@dataclass(frozen=True)
class ColumnRule:
    """Rules of one column; every field left at None is not checked."""

    type: str | None = None
    nullable: bool = True
    min: float | None = None
    max: float | None = None
    step: float | None = None
    valid_values: Sequence | None = None
    split: str | None = None
    regex: str | None = None
    min_length: int | None = None
    min_date: str | None = None
    max_date: str | None = None


@dataclass(frozen=True)
class TableRules:
    columns: dict[str, ColumnRule]
    strict: bool = True
    primary_key: Sequence[str] = ()
    null_rate: float = 0.0
    duplicate_rate: float = 0.0
    foreign_keys: dict[str, tuple[str, str]] = field(default_factory=dict)
    integrity_rate: float = 1.0
    min_rows_per: dict[str, int] = field(default_factory=dict)
    unique: Sequence[Sequence[str]] = ()


@dataclass(frozen=True)
class Check:
    """``violations`` is an aggregate; more than 0 of them give ``on_fail``."""

    check: str
    column: str
    violations: Column
    expected: str = ""
    observed: Column | None = None
    on_fail: str = FAILED


def run_checks(df: DataFrame, dataset: str, checks: Sequence[Check]) -> DataFrame:
    """All checks of a table in one pass."""
    none = F.lit(None).cast("double")
    aggregates = []
    for i, c in enumerate(checks):
        aggregates.append(c.violations.cast("bigint").alias(f"_v{i}"))
        aggregates.append((none if c.observed is None else c.observed.cast("double")).alias(f"_o{i}"))
    cells = [
        F.struct(
            F.lit(dataset).alias("dataset"),
            F.lit(c.check).alias("check"),
            F.lit(c.column).alias("column"),
            F.when(F.col(f"_v{i}") > 0, c.on_fail).otherwise(PASSED).alias("status"),
            F.round(f"_o{i}", 6).alias("observed"),
            F.lit(c.expected).alias("expected"),
            F.col(f"_v{i}").alias("violations"),
        )
        for i, c in enumerate(checks)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*cells)))


# --- column rules


def null_checks(rules: TableRules) -> list[Check]:
    return [
        Check("nullability", name, F.count_if(F.col(name).isNull()), "not null")
        for name, r in rules.columns.items() if not r.nullable
    ]


def range_checks(rules: TableRules) -> list[Check]:
    out = []
    for name, r in rules.columns.items():
        c = F.col(name)
        if r.min is not None:
            out.append(Check("min", name, F.count_if(c < r.min), f">= {r.min:g}", F.min(c)))
        if r.max is not None:
            out.append(Check("max", name, F.count_if(c > r.max), f"<= {r.max:g}", F.max(c)))
    return out


def step_checks(rules: TableRules) -> list[Check]:
    return [
        Check("step", name, F.count_if(off_step(name, r.step)), f"multiple of {r.step:g}", on_fail=WARNED)
        for name, r in rules.columns.items() if r.step is not None
    ]


def value_checks(rules: TableRules) -> list[Check]:
    out = []
    for name, r in rules.columns.items():
        if r.valid_values is None:
            continue
        if r.split:
            bad = F.exists(split_list(name, r.split), lambda x: ~x.isin(*r.valid_values))
        else:
            bad = ~F.col(name).isin(*r.valid_values)
        out.append(Check("allowed_values", name, F.count_if(F.coalesce(bad, F.lit(False))), f"{len(r.valid_values)} values"))
    return out


def text_checks(rules: TableRules) -> list[Check]:
    out = []
    for name, r in rules.columns.items():
        c = F.col(name)
        if r.regex:
            out.append(Check("regex", name, F.count_if(~c.rlike(r.regex)), r.regex))
        if r.min_length is not None:
            out.append(Check("min_length", name, F.count_if(F.length(c) < r.min_length), f">= {r.min_length}", F.min(F.length(c))))
    return out


def date_checks(rules: TableRules) -> list[Check]:
    """Date bounds of an epoch-second column; both bounds are inclusive days."""
    out = []
    for name, r in rules.columns.items():
        day = F.to_date(F.timestamp_seconds(name))
        if r.min_date:
            out.append(Check("min_date", name, F.count_if(day < F.lit(r.min_date).cast("date")), r.min_date))
        if r.max_date:
            out.append(Check("max_date", name, F.count_if(day > F.lit(r.max_date).cast("date")), r.max_date))
    return out


def completeness_checks(rules: TableRules) -> list[Check]:
    out = []
    for name in rules.columns:
        rate = F.coalesce(F.try_divide(F.count_if(F.col(name).isNull()).cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0))
        out.append(Check("completeness", name, F.when(rate > rules.null_rate, F.count_if(F.col(name).isNull())).otherwise(0), f"null rate <= {rules.null_rate:g}", rate))
    return out


def column_checks(rules: TableRules) -> list[Check]:
    return (
        null_checks(rules) + range_checks(rules) + step_checks(rules) + value_checks(rules)
        + text_checks(rules) + date_checks(rules) + completeness_checks(rules)
    )


# Rule type names and the Spark types they accept.
TYPE_NAMES = {
    "integer": ("int", "bigint", "smallint", "tinyint"),
    "long": ("bigint", "int"),
    "float": ("float", "double"),
    "string": ("string",),
    "boolean": ("boolean",),
    "timestamp": ("timestamp", "timestamp_ntz"),
    "date": ("date",),
}


def schema_checks(df: DataFrame, rules: TableRules) -> list[Check]:
    """Missing column: error. Other type: warning. Unexpected column in strict mode: warning."""
    actual = dict(df.dtypes)
    rows = F.count(F.lit(1))
    out = []
    for name, r in rules.columns.items():
        missing = name not in actual
        wrong = not missing and r.type is not None and actual[name] not in TYPE_NAMES[r.type]
        out.append(Check("column_present", name, F.lit(int(missing)), "present", rows))
        out.append(Check("column_type", name, F.lit(int(wrong)), r.type or "any", rows, on_fail=WARNED))
    extra = sorted(set(actual) - set(rules.columns)) if rules.strict else []
    out.append(Check("unexpected_columns", ",".join(extra), F.lit(len(extra)), "0", rows, on_fail=WARNED))
    return out


# --- key rules


def foreign_key_check(
    dataset: str, child: DataFrame, key: str, parent: DataFrame, parent_key: str, threshold: float = 1.0
) -> DataFrame:
    """Orphan keys and orphan rows, each against its own total.

    The child shrinks to one row per key before it meets the parent, so a hot key costs one row.
    """
    per_key = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    parents = parent.select(F.col(parent_key).alias(key)).distinct().withColumn("_known", F.lit(True))
    known = F.col("_known").isNotNull()
    one = per_key.join(parents, key, "left").agg(
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count_if(~known).alias("orphan_keys"),
        F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).alias("orphan_rows"),
    )
    rows = []
    for unit in ("key", "row"):
        orphans, total = F.col(f"orphan_{unit}s"), F.col(f"{unit}s")
        rate = F.coalesce(1 - F.try_divide(orphans.cast("double"), total.cast("double")), F.lit(1.0))
        rows.append(_row(dataset, f"foreign_key_{unit}s", key, rate < threshold, rate, f"{unit} rate >= {threshold:g}", orphans))
    return one.select(F.inline(F.array(*rows)))


def _row(dataset: str, check: str, column: str, bad: Column, observed: Column, expected: str, violations: Column, on_fail: str = FAILED) -> Column:
    return F.struct(
        F.lit(dataset).alias("dataset"), F.lit(check).alias("check"), F.lit(column).alias("column"),
        F.when(bad, on_fail).otherwise(PASSED).alias("status"), F.round(observed.cast("double"), 6).alias("observed"),
        F.lit(expected).alias("expected"), violations.cast("bigint").alias("violations"),
    )


def uniqueness_check(dataset: str, df: DataFrame, keys: Sequence[str], max_rate: float = 0.0, check: str = "primary_key") -> DataFrame:
    """Rows that share their key, all members counted."""
    one = duplicate_profile(df, keys)
    rate = F.coalesce(F.try_divide(F.col("duplicate_rows").cast("double"), F.col("total_rows").cast("double")), F.lit(0.0))
    return one.select(F.inline(F.array(
        _row(dataset, check, ",".join(keys), rate > max_rate, F.col("distinct_keys"), f"duplicate rate <= {max_rate:g}", F.col("duplicate_rows"))
    )))


def min_rows_per_key_check(dataset: str, df: DataFrame, key: str, minimum: int) -> DataFrame:
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    one = per_key.agg(F.count_if(F.col("_n") < minimum).alias("short"), F.min("_n").alias("least"))
    return one.select(F.inline(F.array(
        _row(dataset, "min_rows_per_key", key, F.col("short") > 0, F.col("least"), f">= {minimum}", F.col("short"))
    )))


def validate(dataset: str, df: DataFrame, rules: TableRules, others: dict[str, DataFrame] | None = None) -> DataFrame:
    """Every rule of a table: one pass for all column rules, one grouped pass per key rule."""
    out = run_checks(df, dataset, schema_checks(df, rules) + column_checks(rules))
    if rules.primary_key:
        out = out.unionByName(uniqueness_check(dataset, df, rules.primary_key, rules.duplicate_rate))
    for keys in rules.unique:
        out = out.unionByName(uniqueness_check(dataset, df, keys, check="unique"))
    for key, (parent, parent_key) in rules.foreign_keys.items():
        out = out.unionByName(foreign_key_check(dataset, df, key, others[parent], parent_key, rules.integrity_rate))
    for key, minimum in rules.min_rows_per.items():
        out = out.unionByName(min_rows_per_key_check(dataset, df, key, minimum))
    return out


def roll_up(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("checks"))


def overall_status(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Errors win over warnings, warnings over passes."""
    rank = F.max(F.when(F.col("status") == FAILED, 2).when(F.col("status") == WARNED, 1).otherwise(0))
    out = report.groupBy(*by).agg(rank.alias("_r"), F.count(F.lit(1)).alias("checks"))
    status = F.when(F.col("_r") == 2, FAILED).when(F.col("_r") == 1, WARNED).otherwise(PASSED)
    return out.select(*by, status.alias("status"), "checks")


# --- stage suites


def stage_suite(stage: str, dataset: str, df: DataFrame, ordered_columns: Sequence[str]) -> DataFrame:
    """The ordered column list, and at least one row."""
    matches = list(df.columns) == list(ordered_columns)
    rows = F.count(F.lit(1))
    checks = [
        Check("ordered_columns", ",".join(ordered_columns), F.lit(int(not matches)), str(len(ordered_columns)), F.lit(len(df.columns))),
        Check("row_count", "*", F.when(rows < 1, 1).otherwise(0), ">= 1", rows),
    ]
    return run_checks(df, f"{stage}.{dataset}", checks)


def stage_suites(config: dict[str, dict[str, Sequence[str]]], frames: dict[str, dict[str, DataFrame]]) -> DataFrame | None:
    """The suites of every stage and dataset that ``config`` lists (stage -> dataset -> ordered columns).

    A dataset without a frame fails both of its expectations; a stage without datasets gives no
    rows, and a config without any gives None.
    """
    out = None
    for stage, datasets in config.items():
        for name, columns in datasets.items():
            df = frames.get(stage, {}).get(name)
            if df is None:
                df = next(f for by in frames.values() for f in by.values()).limit(0).select()
            rows = stage_suite(stage, name, df, columns)
            out = rows if out is None else out.unionByName(rows)
    return out


def pipeline_checks(movies: DataFrame, ratings: DataFrame, users: DataFrame) -> DataFrame:
    """The six booleans of the pipeline's own validation stage, one aggregation per table."""

    def one(df: DataFrame, dataset: str, named: dict[str, Column]) -> DataFrame:
        cells = [F.struct(F.lit(n).alias("check"), F.col(n).alias("passed")) for n in named]
        return df.agg(*[c.alias(n) for n, c in named.items()]).select(F.inline(F.array(*cells)))

    m = one(movies, "movies", {
        "movies_no_null_ids": F.count_if(F.col("MovieID").isNull()) == 0,
        "movies_unique_ids": F.countDistinct("MovieID") == F.count(F.lit(1)),
    })
    r = one(ratings, "ratings", {
        "ratings_no_null_ids": F.count_if(F.col("UserID").isNull() | F.col("MovieID").isNull()) == 0,
        "ratings_valid_range": F.count_if(~F.col("Rating").between(1, 5)) == 0,
    })
    u = one(users, "users", {
        "users_no_null_ids": F.count_if(F.col("UserID").isNull()) == 0,
        "users_unique_ids": F.countDistinct("UserID") == F.count(F.lit(1)),
    })
    return m.unionByName(r).unionByName(u)


# --- feature checks


def feature_schema(dataset: str, df: DataFrame, required: Sequence[str], integer_ids: Sequence[str]) -> DataFrame:
    types = dict(df.dtypes)
    rows = F.count(F.lit(1))
    checks = [Check("required_column", c, F.lit(int(c not in types)), "present", rows) for c in required]
    checks += [
        Check("integer_id", c, F.lit(int(types.get(c) not in TYPE_NAMES["integer"])), "integer", rows, on_fail=WARNED)
        for c in integer_ids if c in types
    ]
    return run_checks(df, dataset, checks)


def feature_nulls(dataset: str, df: DataFrame, threshold: float = 0.10, warn_below: bool = False) -> DataFrame:
    """Null rate above the threshold fails; a smaller one warns where ``warn_below`` is set."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    cells = []
    for i, c in enumerate(df.columns):
        n = F.col(f"_n{i}")
        rate = F.coalesce(F.try_divide(n.cast("double"), F.col("_rows").cast("double")), F.lit(0.0))
        status = F.when(rate > threshold, FAILED)
        if warn_below:
            status = status.when(rate > 0, WARNED)
        cells.append(F.struct(
            F.lit(dataset).alias("dataset"), F.lit("feature_nulls").alias("check"), F.lit(c).alias("column"),
            status.otherwise(PASSED).alias("status"), F.round(rate, 6).alias("observed"), F.lit(f"<= {threshold:g}").alias("expected"), n.alias("violations"),
        ))
    return one.select(F.inline(F.array(*cells)))


# Feature bounds.
FEATURE_RANGES = {
    "users": {"AvgRating": (0.0, 5.0)},
    "movies": {"AvgRating": (0.0, 5.0), "Popularity": (0.0, None)},
    "interactions": {"Rating": (0.5, 5.0)},
}


def feature_ranges(dataset: str, df: DataFrame, ranges: dict[str, tuple[float, float | None]]) -> DataFrame:
    checks = []
    for c, (low, high) in ranges.items():
        if c not in df.columns:
            continue
        bad = F.col(c) < low if high is None else (F.col(c) < low) | (F.col(c) > high)
        checks.append(Check("feature_range", c, F.count_if(bad), f"[{low:g}, {'inf' if high is None else f'{high:g}'}]"))
    return run_checks(df, dataset, checks)


def feature_consistency(interactions: DataFrame, entities: DataFrame, key: str, min_cardinality: int = 100) -> DataFrame:
    """Ids used in interactions but missing in the features, and low cardinality: both warnings."""
    keys = interactions.select(key).distinct()
    missing = keys.join(entities.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1))).scalar()
    one = entities.agg(F.count(F.lit(1)).alias("n")).withColumn("missing", missing)
    low = F.col("n") < min_cardinality
    return one.select(F.inline(F.array(
        _row("features", "ids_missing", key, F.col("missing") > 0, F.col("missing"), "0", F.col("missing"), WARNED),
        _row("features", "cardinality", key, low, F.col("n"), f">= {min_cardinality}", F.when(low, 1).otherwise(0), WARNED),
    )))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def feature_statistics(
    users: DataFrame, interactions: DataFrame, user_columns: Sequence[str], interaction_columns: Sequence[str],
    max_std: float = 1000.0, max_r: float = 0.95, max_pairs: int = 5,
) -> DataFrame:
    """std above ``max_std`` warns, std 0 fails, more than ``max_pairs`` distinct pairs with abs r above ``max_r`` warn."""
    one = users.agg(*[F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(user_columns)])
    cells = []
    for i, c in enumerate(user_columns):
        s = F.col(f"_s{i}")
        cells.append(F.struct(
            F.lit("users").alias("dataset"), F.lit("feature_spread").alias("check"), F.lit(c).alias("column"),
            F.when(s == 0, FAILED).when(s > max_std, WARNED).otherwise(PASSED).alias("status"), F.round(s, 6).alias("observed"),
            F.lit(f"0 < std <= {max_std:g}").alias("expected"), F.when((s == 0) | (s > max_std), 1).otherwise(0).cast("bigint").alias("violations"),
        ))
    spread = one.select(F.inline(F.array(*cells)))
    pairs = pairwise_correlation(interactions.select(*interaction_columns), interaction_columns).agg(
        F.count_if(F.abs("r") > max_r).alias("high")
    )
    collinear = pairs.select(F.inline(F.array(
        _row("interactions", "collinear_pairs", "*", F.col("high") > max_pairs, F.col("high"), f"<= {max_pairs} pairs", F.col("high"), WARNED)
    )))
    return spread.unionByName(collinear)


# --- cross-layer checks


def orphaned_events(events: DataFrame, logs: DataFrame, key: str = "recommendation_id") -> DataFrame:
    return foreign_key_check("user_events", events, key, logs, key)


def reconcile_layers(layers: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """``(dataset, layer, rows)`` with the difference to the first layer of each dataset."""
    out = None
    for dataset, by_layer in layers.items():
        first = None
        for layer, df in by_layer.items():
            n = df.agg(F.count(F.lit(1)).alias("rows"))
            first = n if first is None else first
            row = n.select(
                F.lit(dataset).alias("dataset"), F.lit(layer).alias("layer"), "rows",
                (F.col("rows") - first.select("rows").scalar()).alias("diff_to_first"),
            )
            out = row if out is None else out.unionByName(row)
    return out
