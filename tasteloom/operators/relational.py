"""General table operators: sampling, splits, profiles, matrices, windows over groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import digest_order, hash_bucket, percent, split_list
from .scale import gram_sums, top_k_per_key


def between(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def since(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Rows from ``days`` days before the date ``as_of`` to its end; both bounds are constants, so they reach the scan."""
    at = F.col(column)
    return df.filter((at >= F.expr(f"timestamp_ntz '{as_of}' - INTERVAL {days} DAYS")) & (at < F.expr(f"timestamp_ntz '{as_of}' + INTERVAL 1 DAY")))


def retention(df: DataFrame, column: str, as_of: str, days: int) -> tuple[DataFrame, DataFrame]:
    """(rows to archive, rows to keep), two disjoint filters that hold every row; a row without a time is kept."""
    bound = F.expr(f"timestamp_ntz '{as_of}' - INTERVAL {days} DAYS")
    return df.filter(F.col(column) < bound), df.filter((F.col(column) >= bound) | F.col(column).isNull())


def page(df: DataFrame, order: Sequence[str], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def sample_fraction(df: DataFrame, keys: Sequence[str], percent_kept: int) -> DataFrame:
    return df.filter(hash_bucket(keys, 100) < percent_kept)


def sample_exact(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """At most ``n`` rows, the same ones on every run: each task keeps its own ``n`` before the merge."""
    return df.withColumn("_d", digest_order(keys)).orderBy("_d", *keys).limit(n).drop("_d")


def train_test_split(df: DataFrame, keys: Sequence[str], test_percent: int = 20, seed: int = 42) -> DataFrame:
    """Add ``split``. The bucket depends on the keys only, not on the partitioning."""
    bucket = hash_bucket([F.lit(seed), *[F.col(k) for k in keys]], 100)
    return df.withColumn("split", F.when(bucket < test_percent, "test").otherwise("train"))


def sample_entities(df: DataFrame, entity: str, n: int, per_entity: int, row_keys: Sequence[str]) -> DataFrame:
    """``n`` entities in digest order, then at most ``per_entity`` of their rows in digest order."""
    chosen = sample_exact(df.select(entity).distinct(), [entity], n)
    rows = df.join(chosen, entity, "left_semi").withColumn("_d", digest_order(row_keys))
    return top_k_per_key(rows, [entity], ["_d", *row_keys], per_entity).drop("_d", "rank")


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins of dimensions; a clashing dimension column takes its suffix."""
    out = fact
    for dim, key, suffix in dims:
        renamed = dim.select(
            *[F.col(c).alias(c + suffix) if c != key and c in out.columns else F.col(c) for c in dim.columns]
        )
        out = out.join(renamed, key, "left")
    return out


def orphan_rows(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose non-null key is missing in the parent."""
    keys = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def left_join_many(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join against a right side with many rows per key, of which one key may be hot.

    The runtime splits a hot right side of an inner join, but not of a left join, so this is
    an inner join plus the left rows without a partner.
    """
    alone = left.join(right.select(key).distinct(), key, "left_anti")
    return left.join(right, key).unionByName(alone, allowMissingColumns=True)


def known_pairs(pairs: DataFrame, vocabularies: dict[str, DataFrame]) -> DataFrame:
    out = pairs
    for key, vocabulary in vocabularies.items():
        out = out.join(vocabulary, key, "left_semi")
    return out


def user_item_matrix(ratings: DataFrame) -> DataFrame:
    """The user x item matrix as coordinates: duplicates averaged, zeros implicit."""
    return ratings.groupBy("UserID", "MovieID").agg(F.avg("Rating").alias("value"))


def pairwise_correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, r)`` for every unordered pair of columns, over the rows that hold both; r is null where one side is constant.

    One matrix of sums of products, of the values, their squares and their presence, gives all pairs:
    one aggregate whatever the number of columns. Values are taken from a mean of some first rows, so that
    large values far from zero lose no digits.
    """
    k = len(columns)
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
    means = df.limit(1000).agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in clean]).first()
    x = df.select(*[(c - float(m)).alias(f"x{i}") for i, (c, m) in enumerate(zip(clean, means))])
    parts = [c for i in range(k) for c in (F.col(f"x{i}").isNotNull().cast("double").alias(f"m{i}"), F.coalesce(f"x{i}", F.lit(0.0)).alias(f"v{i}"),
                                           F.coalesce(F.col(f"x{i}") * F.col(f"x{i}"), F.lit(0.0)).alias(f"q{i}"))]
    g = gram_sums(x.select(*parts), [f"{p}{i}" for p in "mvq" for i in range(k)])[1:, 1:]
    m, v, q = slice(0, k), slice(k, 2 * k), slice(2 * k, 3 * k)
    n, s, ss, products = g[m, m], g[v, m], g[q, m], g[v, v]
    spread = n * ss - s * s  # of the first column of a pair, over the rows of the pair
    spread[spread <= 1e-12 * n * ss] = 0
    rows = [(a, b, float((n[i, j] * products[i, j] - s[i, j] * s[j, i]) / (spread[i, j] * spread[j, i]) ** 0.5) if spread[i, j] * spread[j, i] > 0 else None)
            for i, a in enumerate(columns) for j, b in enumerate(columns) if j > i]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def duplicate_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, and rows that share their key with another row."""
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
            F.count(F.lit(1)).alias("distinct_keys"),
            F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)), F.lit(0)).alias("duplicate_rows"),
        )
    )


def error_metrics(predicted: Column, actual: Column) -> list[Column]:
    e = predicted - actual
    return [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")]


def share_of_total(counts: DataFrame, n: str, alias: str) -> DataFrame:
    """Percent of the total over grouped counts; the total is a scalar subquery, not one window."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.withColumn(alias, percent(F.col(n), total))


def scaled_to_largest(counts: DataFrame, n: str, alias: str, width: int = 50) -> DataFrame:
    top = counts.agg(F.max(n)).scalar()
    return counts.withColumn(alias, F.floor(F.col(n) * width / top).cast("int"))


def top_values(df: DataFrame, column: str, k: int, sep: str | None = None) -> DataFrame:
    values = df.select(F.explode(split_list(column, sep)).alias("value")) if sep else df.select(F.col(column).alias("value"))
    return values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)
