"""Version and lineage queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import lineage as ln
from ..session import scratch
from .registry import query

SHAPES = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}


def snapshots(t):
    return reduce(lambda a, b: a.unionByName(b), [ln.snapshot(t.raw(n), n, "20240131_000000", {"source": "parquet"}) for n in SHAPES])


@query("y01_version_snapshot", " UNION ALL ".join(
    f"SELECT '{n}' AS dataset, count(*) AS row_count, {len(c)} AS column_count, {' + '.join(f'count(*) FILTER (WHERE {x} IS NULL)' for x in c)} AS null_cells, "
    + f"concat_ws(',', {', '.join(f"'{x}:' || CAST(count(*) FILTER (WHERE {x} IS NULL) AS VARCHAR)" for x in c)}) AS null_counts FROM {n}"
    for n, c in SHAPES.items()))
def snapshot(t):
    return snapshots(t).select("dataset", "row_count", "column_count", "null_cells", "null_counts")


@query("y01_content_hash")
def content_hash(t):
    sizes = reduce(lambda a, b: a.unionByName(b), [ln.stored_size(t.raw(n), n) for n in SHAPES])
    return snapshots(t).join(sizes, "dataset").select("dataset", "version", "dtypes", "content_hash", "tags", "files", "byte_size")


def order_versions(t):
    """A dataset per priority with one version per order month."""
    o = t.raw("orders")
    return o.groupBy(F.col("o_orderpriority").alias("dataset"), F.date_format("o_orderdate", "yyyyMM").alias("version")).agg(
        F.count(F.lit(1)).alias("row_count"), F.max("o_custkey").alias("max_key"),
        F.round(F.sum("o_totalprice"), 2).alias("size"), F.md5(F.sum("o_orderkey").cast("string")).alias("file_hash"),
    )


VERSIONS = """v AS (SELECT o_orderpriority AS dataset, strftime(o_orderdate, '%Y%m') AS version, count(*) AS row_count, max(o_custkey) AS max_key,
    round(sum(o_totalprice), 2) AS size, md5(CAST(sum(o_orderkey) AS VARCHAR)) AS file_hash FROM orders GROUP BY 1, 2)"""


@query("y02_version_history", f"WITH {VERSIONS} SELECT dataset, version, row_count, file_hash FROM v WHERE dataset = '1-URGENT' ORDER BY version DESC")
def history(t):
    return ln.history(order_versions(t), "1-URGENT").select("dataset", "version", "row_count", "file_hash")


@query("y03_compare_versions", f"""
WITH {VERSIONS}, a AS (SELECT * FROM v WHERE dataset = '1-URGENT' AND version = '199601'), b AS (SELECT * FROM v WHERE dataset = '1-URGENT' AND version = '199602'),
m AS (SELECT 'row_count' AS metric, CAST(a.row_count AS VARCHAR) AS value_a, CAST(b.row_count AS VARCHAR) AS value_b FROM a, b
UNION ALL SELECT 'max_key', CAST(a.max_key AS VARCHAR), CAST(b.max_key AS VARCHAR) FROM a, b
UNION ALL SELECT 'file_hash', a.file_hash, b.file_hash FROM a, b)
SELECT metric, value_a, value_b, value_a IS DISTINCT FROM value_b AS changed FROM m""")
def compare(t):
    return ln.compare(order_versions(t), "1-URGENT", "199601", "199602", ["row_count", "max_key", "file_hash"])


@query("y04_direct_lineage", "SELECT source, target, transform_type FROM lineage_edges WHERE target = 'customer:42'")
def direct(t):
    return ln.direct_lineage(t.lineage_edges, "customer:42")


@query("y04_recorded_lineage", """SELECT source, target, transform_type, CASE transform_type WHEN 'ingestion' THEN 'load' ELSE 'derive' END AS operation, 'SILVER' AS layer,
    count(*) AS entries FROM lineage_edges WHERE transform_type <> 'feature_engineering' GROUP BY ALL""")
def recorded(t):
    """Two runs append to the log; the log is read back."""
    path = scratch(t.spark, "lineage_log")
    for kind, operation in (("ingestion", "load"), ("validation", "derive")):
        ln.record(t.lineage_edges.filter(F.col("transform_type") == kind), path, operation, {"layer": "SILVER"}, "2024-01-31 00:00:00")
    return ln.recorded(t.spark, path).groupBy("source", "target", "transform_type", "operation", F.col("metadata")["layer"].alias("layer")).agg(
        F.count(F.lit(1)).alias("entries"))


@query("y05_upstream_closure", """
WITH RECURSIVE c AS (SELECT target AS root, source, target, 1 AS depth FROM lineage_edges WHERE target LIKE 'order:%'
    UNION SELECT c.root, e.source, e.target, c.depth + 1 FROM c JOIN lineage_edges e ON e.target = c.source WHERE c.depth < 6)
SELECT root, count(*) FILTER (WHERE depth <= 5) AS edges, count(DISTINCT source) FILTER (WHERE depth <= 5) AS sources,
    max(depth) FILTER (WHERE depth <= 5) AS depth, bool_or(depth > 5) AS truncated FROM (
    SELECT root, source, target, min(depth) AS depth FROM c GROUP BY 1, 2, 3) GROUP BY 1""")
def closure(t):
    """The closure of every order in one job."""
    roots = t.lineage_edges.filter(F.col("target").startswith("order:")).select(F.col("target").alias("name")).distinct()
    return ln.upstream_summary(ln.upstream(t.lineage_edges, roots))


@query("y05_truncated_closure", """
WITH RECURSIVE c AS (SELECT target AS root, source, target, 1 AS depth FROM lineage_edges WHERE target LIKE 'order:%'
    UNION SELECT c.root, e.source, e.target, c.depth + 1 FROM c JOIN lineage_edges e ON e.target = c.source WHERE c.depth < 3)
SELECT root, count(*) FILTER (WHERE depth <= 2) AS edges, count(DISTINCT source) FILTER (WHERE depth <= 2) AS sources,
    max(depth) FILTER (WHERE depth <= 2) AS depth, bool_or(depth > 2) AS truncated FROM (
    SELECT root, source, target, min(depth) AS depth FROM c GROUP BY 1, 2, 3) GROUP BY 1""")
def cut_closure(t):
    """Two of the three levels above an order: every order says that its closure was cut."""
    roots = t.lineage_edges.filter(F.col("target").startswith("order:")).select(F.col("target").alias("name")).distinct()
    return ln.upstream_summary(ln.upstream(t.lineage_edges, roots, 2))


@query("y06_data_report", f"WITH {VERSIONS} SELECT count(DISTINCT dataset) AS datasets, count(*) AS versions, (SELECT count(*) FROM lineage_edges) AS lineage_entries FROM v")
def report(t):
    return ln.data_report(order_versions(t), t.lineage_edges)
