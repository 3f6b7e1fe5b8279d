"""Dataset versions and lineage."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch
from .experiments import two_row_pivot
from .scale import stored

MAX_DEPTH = 5
#: Distinct edges for each task of a closure, so that its tasks grow in number and not in size.
EDGES_A_TASK = 100_000


def fingerprint(df: DataFrame) -> Column:
    """An order-independent 64-digit hash of a table's rows, as an aggregate."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    h = F.xxhash64(*cols, *[c.isNull() for c in cols])  # the row hash skips nulls, so their places are hashed too
    low, high = F.sum((h % 1_000_000_007).cast("decimal(20,0)")), F.bit_xor(h)
    return F.sha2(F.concat_ws("|", low.cast("string"), high.cast("string"), F.count(F.lit(1)).cast("string")), 256)


def snapshot(df: DataFrame, dataset: str, version: str, tags: dict[str, str] | None = None) -> DataFrame:
    """One version row: rows, columns, schema, null cells by column and in all, and content hash, in one pass."""
    counts = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count(F.lit(1)).alias("row_count"), fingerprint(df).alias("content_hash"), *counts)
    nulls = [F.col(f"_n{i}") for i in range(len(df.columns))]
    return one.select(
        F.lit(dataset).alias("dataset"), F.lit(version).alias("version"), "row_count", F.lit(len(df.columns)).alias("column_count"),
        F.lit(",".join(f"{n}:{t}" for n, t in df.dtypes)).alias("dtypes"), reduce(lambda x, y: x + y, nulls).alias("null_cells"), "content_hash",
        F.concat_ws(",", *[F.concat(F.lit(f"{c}:"), n.cast("string")) for c, n in zip(df.columns, nulls)]).alias("null_counts"),
        F.lit(",".join(f"{k}={v}" for k, v in sorted((tags or {}).items()))).alias("tags"),
    )


def stored_size(df: DataFrame, dataset: str) -> DataFrame:
    """Files and bytes behind a frame that was read from files, by the scan's own file metadata."""
    files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")).distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("byte_size")).select(
        F.lit(dataset).alias("dataset"), "files", "byte_size")


def history(versions: DataFrame, dataset: str) -> DataFrame:
    return versions.filter(F.col("dataset") == dataset).orderBy(F.desc("version"))


def compare(versions: DataFrame, dataset: str, a: str, b: str, metrics: Sequence[str]) -> DataFrame:
    """``metric, value_a, value_b, changed`` for two versions of a dataset."""
    one = two_row_pivot(versions.filter(F.col("dataset") == dataset), "version", a, b, metrics)
    cells = [
        F.struct(
            F.lit(m).alias("metric"), F.col(f"{m}_a").cast("string").alias("value_a"), F.col(f"{m}_b").cast("string").alias("value_b"),
            (~F.col(f"{m}_a").eqNullSafe(F.col(f"{m}_b"))).alias("changed"),
        )
        for m in metrics
    ]
    return one.select(F.inline(F.array(*cells)))


EDGE = "source string, target string, transform_type string, operation string, metadata map<string,string>, recorded_at timestamp"


def record(edges: DataFrame, path: str, operation: str, metadata: dict[str, str] | None = None, at: str | None = None) -> None:
    """Append edges (source, target, transform_type) to the lineage log at ``path``.

    ``operation`` and ``metadata`` describe the run, ``at`` is its time (now by default). An edge
    that a run records twice is logged twice, as each entry is one event.
    """
    moment = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    pairs = [F.lit(x) for kv in sorted((metadata or {}).items()) for x in kv]
    tags = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    edges.select(
        "source", "target", "transform_type", F.lit(operation).alias("operation"), tags.alias("metadata"), moment.alias("recorded_at"),
    ).write.mode("append").parquet(path)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGE).parquet(path)


def direct_lineage(edges: DataFrame, target: str) -> DataFrame:
    return edges.filter(F.col("target") == target)


def distances(steps: DataFrame, limit: int | None) -> DataFrame:
    """``node, above, d``: every node above another and the least number of steps, up to ``limit``.

    Path doubling: a round joins the paths known so far with themselves, so paths of length n are
    complete after log2(n) rounds. A cycle only offers longer paths, which the minimum drops, and
    the loop ends when a round changes nothing. Each round is written to shared storage.
    """
    base = scratch(steps.sparkSession, "distances")
    schema = "node string, above string, d int"
    known = steps.select(F.col("target").alias("node"), F.col("source").alias("above"), F.lit(1).alias("d")).distinct()
    seen, turn = None, 0
    while limit is None or 2**turn < limit:
        path = f"{base}/{turn}"
        known.write.parquet(path)
        known = steps.sparkSession.read.schema(schema).parquet(path)
        now = known.agg(F.count(F.lit(1)), F.sum("d")).first()
        if now == seen:
            break
        seen, turn = now, turn + 1
        far = known.select(F.col("node").alias("above"), F.col("above").alias("top"), F.col("d").alias("e"))
        longer = known.join(far, "above").select("node", F.col("top").alias("above"), (F.col("d") + F.col("e")).alias("d"))
        if limit is not None:
            longer = longer.filter(F.col("d") <= limit)
        known = known.unionByName(longer).groupBy("node", "above").agg(F.min("d").alias("d"))
    return known


def upstream(edges: DataFrame, roots: DataFrame, max_depth: int | None = MAX_DEPTH) -> DataFrame:
    """Every edge upstream of each root: ``root, source, target, depth, truncated``.

    ``max_depth`` bounds the steps from the root, None for none. ``truncated`` is true for a root
    that has edges beyond the bound, so a cut closure is never taken for a whole one. Only nodes
    that lie above a root take part in the doubling.
    """
    steps = stored(edges.select("source", "target").filter("source IS NOT NULL AND target IS NOT NULL").distinct(), "edges")
    tasks = max(1, math.ceil(steps.count() / EDGES_A_TASK))
    names = roots.select(F.col("name").alias("root")).filter("root IS NOT NULL").distinct()
    # a root that nothing is derived from is the start of paths only: it takes over, once, the edges above what it is derived from
    sources = stored(steps.select(F.col("source").alias("node")).distinct(), "sources")
    inner = distances(steps.join(sources, steps.target == sources.node, "left_semi"), max_depth)
    reach = sources.select("node", F.col("node").alias("above"), F.lit(0).alias("d")).unionByName(inner)
    # many nodes lie below one: its edges are joined to the nodes, never to the many roots
    above = reach.join(steps, reach.above == steps.target).groupBy("node", "source", "target").agg((F.min("d") + 1).alias("depth"))
    first = names.join(steps, names.root == steps.target).select("root", "source", "target", F.lit(1).alias("depth"))
    ups = above.select(F.col("node"), F.col("source").alias("s"), F.col("target").alias("t"), F.col("depth").alias("e"))
    later = first.join(ups, first.source == ups.node).select("root", F.col("s").alias("source"), F.col("t").alias("target"), (F.col("depth") + F.col("e")).alias("depth"))
    found = first.unionByName(later).repartition(tasks, "root", "source", "target").groupBy("root", "source", "target").agg(F.min("depth").alias("depth"))
    if max_depth is not None:
        found = found.filter(F.col("depth") <= max_depth + 1)
    if max_depth is None:
        return found.withColumn("truncated", F.lit(False))
    found = stored(found, "closure")
    cut = found.filter(F.col("depth") > max_depth).select("root").distinct().withColumn("_cut", F.lit(True))
    return found.filter(F.col("depth") <= max_depth).join(cut, "root", "left").select(
        "root", "source", "target", "depth", F.coalesce("_cut", F.lit(False)).alias("truncated")).repartition(tasks, "root", "source")


def upstream_summary(closure: DataFrame) -> DataFrame:
    """Edges, distinct sources and depth per root, and whether the depth bound cut its closure."""
    per = closure.groupBy("root", "source").agg(F.count(F.lit(1)).alias("e"), F.max("depth").alias("d"), F.max("truncated").alias("t"))
    return per.groupBy("root").agg(
        F.sum("e").alias("edges"), F.count(F.lit(1)).alias("sources"), F.max("d").alias("depth"), F.max("t").alias("truncated"))


def data_report(versions: DataFrame, edges: DataFrame) -> DataFrame:
    return versions.agg(F.countDistinct("dataset").alias("datasets"), F.count(F.lit(1)).alias("versions")).withColumn(
        "lineage_entries", edges.agg(F.count(F.lit(1))).scalar()
    )
