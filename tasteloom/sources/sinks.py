"""Sinks: versioned tables, feature and report files, upserts, inserts and retention on snapshot tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..session import scratch
from . import keyed_log, snapshots
from .readers import VERSION


def write_version(df: DataFrame, base: str, version: str) -> str:
    """One entry of a snapshot table per version; writing a version again replaces it, at once. Returns the folder of its files."""
    if not snapshots.KEY_PATTERN.fullmatch(version):
        raise ValueError(f"not the name of a version: {version!r}")
    done = snapshots.replace(df, base, version)
    return f"{base}/{done.of([version])[0].path}"


def observed_write(df: DataFrame, source: str, target: str, version: str) -> DataFrame:
    """Write and return the ingestion manifest row; rows are counted while they are written."""
    seen = Observation()
    start = time.time()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(target)
    row = (source, target, int(seen.get["rows"]), ",".join(df.columns), int((time.time() - start) * 1000), version)
    return df.sparkSession.createDataFrame([row], "source string, target string, rows bigint, columns string, millis bigint, version string")


def write_features(df: DataFrame, base: str, name: str, version: str) -> DataFrame:
    """Parquet and CSV under a version, and a manifest row that makes it the latest."""
    df.write.mode("overwrite").parquet(f"{base}/{name}/{VERSION}={version}")
    df.write.mode("overwrite").option("header", "true").csv(f"{base}/{name}_csv/{VERSION}={version}")
    manifest = df.sparkSession.createDataFrame([(name, version)], f"name string, {VERSION} string")
    manifest.write.mode("append").json(f"{base}/manifest")
    return manifest


def latest_features(spark: SparkSession, base: str, name: str) -> DataFrame:
    rows = spark.read.schema(f"name string, {VERSION} string").json(f"{base}/manifest")
    version = rows.filter(F.col("name") == name).agg(F.max(VERSION)).first()[0]
    return spark.read.parquet(f"{base}/{name}/{VERSION}={version}")


def write_report(report: DataFrame, base: str, name: str, version: str) -> str:
    """A report as JSON lines under its version; ``latest`` is the largest version."""
    path = f"{base}/{name}/{VERSION}={version}"
    report.write.mode("overwrite").json(path)
    return path


def save_baseline(df: DataFrame, base: str, version: str) -> DataFrame:
    """Baseline snapshot with its profile beside it."""
    from ..operators.features import null_profile

    write_version(df, f"{base}/data", version)
    profile = null_profile(df).withColumn(VERSION, F.lit(version))
    profile.write.mode("overwrite").json(f"{base}/profile/{version}")
    return profile


def merge_rows(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows replaced by the update of the same key, new keys added; ``updated`` marks a replacement.

    Both sides hold one row per key; a null in a key equals a null.
    """
    rest = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.struct(*rest).alias("_old"))
    new = updates.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*rest).alias("_new"))
    merged = old.join(new, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "full")
    pick = F.coalesce("_new", "_old")
    return merged.select(
        *[F.coalesce(k, f"_{k}").alias(k) for k in keys], *[pick.getField(c).alias(c) for c in rest], (F.col("_old").isNotNull() & F.col("_new").isNotNull()).alias("updated")
    )


def upsert_partitions(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], partition: str) -> None:
    """Upsert into a snapshot table with one entry for each value of ``partition``, rebuilding only the touched ones.

    The merged partitions are new folders, which one manifest swaps in: a job that stops leaves the
    table as it was, and a repeated batch changes nothing. The partition column is part of the key,
    its values name folders (dates, numbers, plain words), and a batch touches few of them.
    """
    staged = scratch(spark, "updates")
    updates.write.parquet(staged)
    updates = spark.read.schema(updates.schema).parquet(staged)
    was = snapshots.current(spark, path)
    key = snapshots.key_text(partition)
    touched = [r[0] for r in updates.select(key).distinct().collect()]
    merged = updates
    if was.of(touched):
        merged = merge_rows(snapshots.rows_of(spark, was, touched).select(*updates.columns), updates, keys).drop("updated")
    if touched or not was.exists:
        new = snapshots.staged_by(merged, path, key) if touched else []
        snapshots.commit(spark, was, [*was.but(touched), *new], updates.schema)


def insert_if_absent(spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> None:
    """Add the rows whose key the log does not hold yet: of the rows with one key the first by ``order``, then by its digest."""
    keyed_log.insert(spark, path, rows, keys, order)


def archive(spark: SparkSession, path: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], hot: str = "hot", cold: str = "archive") -> None:
    """Move the old rows of a snapshot table from tier ``hot`` to tier ``cold``; ``split`` gives the old rows and the rows to keep.

    Every row is moved or kept, repeated rows and rows that share a key or have none included. Both
    tiers change by one manifest: a run that stops anywhere has moved nothing or all, and a
    run that is repeated finds nothing left to move.
    """
    snapshots.moved(spark, path, split, hot, cold)
