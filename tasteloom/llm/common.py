"""Helpers shared by the training-data operators: words, hashes, written tables, components, running totals."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import configure, scratch

SPACE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Rows and bytes of an Arrow batch: rows can be long, and a batch is held in memory at once.
BATCH_ROWS, BATCH_BYTES = "1000", "4m"
#: Bits of a broadcast filter, 64 to a row.
FILTER_BITS = 1 << 23


def session(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: read many times, made once, safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as a column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of characters other than the six white-space bytes; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values, modulo 2**64, from one running sum."""
    n = len(x)
    if n < k:
        return np.empty(0, np.uint64)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(BASE, n), dtype=np.uint64)])
    return mixed((run[k:] - run[:-k]) * powers(BASE_INV, n - k + 1))


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values as unsigned 64-bit numbers, and offsets, of an Arrow list column of longs."""
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return values.to_numpy(zero_copy_only=False).view(np.uint64), offsets - offsets[0]


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def each_row(batches: Iterator[pa.RecordBatch], lists: str) -> Iterator[tuple[dict[str, pa.Array], list[np.ndarray]]]:
    """Per batch: its columns, and the list column ``lists`` as one array per row."""
    for batch in batches:
        if batch.num_rows:
            values, at = lists_of(batch.column(lists))
            yield {n: batch.column(n) for n in batch.schema.names}, [values[i:j] for i, j in zip(at[:-1], at[1:])]


def _texts_as(change, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else change(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(kind) if n == "text" else batch.column(n) for n in batch.schema.names], batch.schema.names)

    return run


def _typed(df: DataFrame, kind: str) -> str:
    return ", ".join(f"`{n}` {kind if n == 'text' else t}" for n, t in df.dtypes)


def deflated(df: DataFrame) -> DataFrame:
    """``df`` with its column ``text`` deflated: what a shuffle of whole texts moves. Null stays null."""
    return df.mapInArrow(_texts_as(lambda t: zlib.compress(t, 1), pa.binary()), _typed(df, "binary"))


def inflated(df: DataFrame) -> DataFrame:
    """The texts of ``deflated`` as strings again."""
    return df.mapInArrow(_texts_as(zlib.decompress, pa.string()), _typed(df, "string"))


def may_meet(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Adds to ``df`` a boolean ``meets``: true for each row whose ``keys`` are in ``other``, false for most that have no partner.

    The keys of ``other`` set bits by their hash. The bits are broadcast, ``FILTER_BITS`` of them at most whatever the
    input, so that rows without a partner need not be shuffled to learn it.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    mask = lambda at: F.expr(f"shiftleft(1L, cast({at} % 64 as int))")
    bits = other.select(bit.alias("_bit")).groupBy(F.expr("_bit div 64").alias("_word")).agg(F.bit_or(mask("_bit")).alias("_mask"))
    found = df.withColumn("_bit", bit).withColumn("_word", F.expr("_bit div 64")).join(F.broadcast(bits), "_word", "left")
    return found.withColumn("meets", F.coalesce(F.col("_mask").bitwiseAND(mask("_bit")) != 0, F.lit(False))).drop("_bit", "_word", "_mask")


def meeting(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``df`` that may meet ``other``: all that do, and few that do not."""
    return may_meet(df, other, *keys).where("meets").drop("meets")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b); nodes without edges are absent.

    Large-star and small-star rounds [Kiveris et al. 2014]. Every round is a written table, and a
    hub's rows meet its label in a join of two plain tables, which adaptive execution can split.
    The rounds end when every node is its component's smallest or has that one as its only neighbour.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for done in range(rounds + 1):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least")
        if least.where("m <> a and n > 1").isEmpty():  # stars around their smallest nodes
            return least.select(F.col("a").alias("node"), F.col("m").alias("label"))
        if done == rounds:
            break
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large, "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        own = large.join(least, "a")
        small = own.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) of ``components`` after further ``edges`` (a, b): as over all edges at once.

    An edge inside a component says nothing new and the others are edges between labels, so that the rounds
    see only what still has to be joined.
    """
    end = lambda n: labels.select(F.col("node").alias(n), F.col("label").alias(f"l{n}"))
    apart = edges.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    apart = written(apart.where("a <> b"), "apart")
    if apart.isEmpty():
        return labels
    moved = components(apart)
    kept = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return written(kept.union(moved.join(labels, "node", "left_anti").select("node", "label")), "labels")


def running_total(df: DataFrame, order: str, size: str, out: str, width: int = 1024) -> DataFrame:
    """``df`` with the total of ``size`` over all rows with a smaller ``order`` (a distinct number from 0).

    Blocks of ``width`` numbers are summed, then blocks of blocks: no window holds more than
    ``width`` rows, whatever the input.
    """
    from pyspark.sql import Window

    level = df.select(F.col(order).alias("o"), F.col(size).alias("s"))
    sums = []
    top = df.agg(F.max(order)).first()[0] or 0
    while top >= width:
        level = written(level.groupBy(F.expr(f"o div {width}").alias("o")).agg(F.sum("s").alias("s")), "totals")
        sums.append(level)
        top //= width
    inside = lambda by: Window.partitionBy(F.expr(by)).orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    carried = None
    for level in reversed(sums):
        here = level.withColumn("p", F.coalesce(F.sum("s").over(inside(f"o div {width}")), F.lit(0)))
        if carried is not None:
            here = here.withColumn("u", F.expr(f"o div {width}")).join(carried.select(F.col("o").alias("u"), F.col("t")), "u")
            here = here.withColumn("p", F.col("p") + F.col("t"))
        carried = written(here.select("o", F.col("p").cast("long").alias("t")), "carried")
    own = Window.partitionBy(F.expr(f"{order} div {width}")).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(out, F.coalesce(F.sum(size).over(own), F.lit(0)))
    if carried is None:
        return df
    return (df.withColumn("_block", F.expr(f"{order} div {width}"))
            .join(carried.select(F.col("o").alias("_block"), F.col("t").alias("_carried")), "_block")
            .withColumn(out, F.col(out) + F.col("_carried")).drop("_block", "_carried"))
