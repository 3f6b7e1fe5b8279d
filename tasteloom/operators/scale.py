"""Order-dependent work split into bounded pieces.

A window ordered inside one key is one task per key, which fails when a key holds a
large share of the rows. The helpers here cut a key into ordered pieces, run the window
inside each piece, and carry one total or one boundary row per piece across. Pieces are
derived from the data by repeatable expressions, so a recomputed task agrees with itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import scratch


def value_counts(df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """One row per (keys, value) with summed measures: hot values shrink before any ordering."""
    return df.groupBy(*keys, value).agg(*[c.alias(n) for n, c in measures.items()])


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table, for frames that several passes read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], column: str, few_keys: bool) -> DataFrame:
    """Add a column of a one-row-per-key frame; a scalar subquery where there is no key.

    ``few_keys`` is the caller's word that the keys are a small closed set (columns, enum
    values), which allows a broadcast.
    """
    if not keys:
        return df.withColumn(column, per_key.select(column).scalar())
    return df.join(F.broadcast(per_key) if few_keys else per_key, list(keys), "left")


def _pieces(
    vc: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], pieces: int, sample: int, few_keys: bool
) -> DataFrame:
    """Split points per key: exact quantiles of a repeatable hash sample of the distinct values.

    Both uses of ``vc`` touch every measure, so that all uses of it share one shuffle.
    """
    keys = list(keys)
    size = vc.groupBy(*keys).agg(F.expr(f"count({', '.join(measures)})").alias("_n"))
    scale = 1 << 20
    draw = F.expr(f"pmod(xxhash64(`{value}`), {scale}) * _n < {scale * sample}")
    present = F.expr(" AND ".join(f"{m} IS NOT NULL" for m in measures))
    quantiles = F.expr(f"array({', '.join(f'{i / pieces}D' for i in range(1, pieces))})")
    return (
        attach(vc.filter(present), size, keys, "_n", few_keys)
        .filter(draw)
        .groupBy(*keys)
        .agg(F.array_distinct(F.percentile(F.col(value).cast("double"), quantiles)).alias("_splits"))
    )


def running_totals(
    vc: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], pieces: int = 32, sample: int = 20000,
    few_keys: bool = False,
) -> DataFrame:
    """Add ``<measure>_upto`` (running total including the row's value) and ``<measure>_all`` per key.

    ``vc`` holds one row per (keys, value). No task sees more than one piece of a key.
    """
    keys = list(keys)
    splits = _pieces(vc, keys, value, measures, pieces, sample, few_keys)
    # a plain sum of comparisons stays inside generated code, which a lambda over the array would leave
    passed = " + ".join(f"coalesce(int(CAST(`{value}` AS DOUBLE) > get(_splits, {i})), 0)" for i in range(pieces - 1))
    cut = attach(vc, splits, keys, "_splits", few_keys).select(*vc.columns, F.expr(passed).alias("_piece"))
    per_piece = cut.groupBy(*keys, "_piece").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = per_piece.select(
        *keys,
        "_piece",
        *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures],
        *[F.sum(f"_t_{m}").over(whole).alias(f"{m}_all") for m in measures],
    )
    inside = W.partitionBy(*keys, "_piece").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    joined = cut.join(offsets, [*keys, "_piece"])
    return joined.select(
        *keys,
        value,
        *measures,
        *[(F.col(f"_o_{m}") + F.sum(m).over(inside)).alias(f"{m}_upto") for m in measures],
        *[F.col(f"{m}_all") for m in measures],
    )


def quantile_columns(value: str, measure: str, probs: Sequence[float]) -> list[Column]:
    """Aggregates that pick exact linear-interpolated quantiles out of ``running_totals`` rows."""

    def at(rank: str) -> str:
        hit = f"{measure}_upto > {rank} AND {measure}_upto - {measure} <= {rank}"
        return f"max(CASE WHEN {hit} THEN CAST(`{value}` AS DOUBLE) END)"

    out = []
    for p in probs:
        pos = f"(({measure}_all - 1) * {float(p)}D)"
        low, high = at(f"floor({pos})"), at(f"ceil({pos})")
        out.append(F.expr(f"{low} + ({high} - {low}) * max({pos} - floor({pos}))"))
    return out


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], few_keys: bool = False
) -> DataFrame:
    """Exact quantiles per key without gathering a key's values in one task."""
    vc = value_counts(df.filter(F.col(value).isNotNull()), keys, value, {"n": F.count(F.lit(1))})
    rt = running_totals(vc, keys, value, ["n"], few_keys=few_keys)
    cols = quantile_columns(value, "n", list(probs.values()))
    return rt.groupBy(*keys).agg(*[c.alias(name) for name, c in zip(probs, cols)])


def chunked_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: str, cols: Sequence[str]
) -> DataFrame:
    """``prev_<col>``: the column in the row before, across chunks of one key.

    ``chunk`` grows with ``order``. Only one boundary row per chunk crosses between tasks.
    """
    keys = list(keys)
    packed = F.struct(*[F.col(c) for c in [*order, *cols]])
    last = df.groupBy(*keys, chunk).agg(F.max(packed).alias("_last"))
    carried = last.select(
        *keys, chunk, F.lag("_last").over(W.partitionBy(*keys).orderBy(chunk)).alias("_carry")
    )
    inside = W.partitionBy(*keys, chunk).orderBy(*order)
    first = F.row_number().over(inside) == 1
    return df.join(carried, [*keys, chunk]).select(
        *df.columns,
        *[
            F.when(first, F.col(f"_carry.{c}")).otherwise(F.lag(c).over(inside)).alias(f"prev_{c}")
            for c in cols
        ],
    )


def volume_segments(df: DataFrame, keys: Sequence[str], second: Column, rows: int, alias: str) -> DataFrame:
    """Number the rows of a key by ordered segments of at most ``rows`` rows and one more second's.

    Rows are counted by second first. Only keys above the bound get cut points, one per ``rows``
    rows, so the table of cuts is as small as the whole table divided by ``rows``.
    """
    keys, names = list(keys), [f"_k{i}" for i in range(len(keys))]
    counts = df.groupBy(*keys, second.alias("_second")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_second").rowsBetween(W.unboundedPreceding, -1)
    number = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / rows)
    starts = counts.withColumn("_number", number).filter("_number > 0").groupBy(*keys, "_number").agg(F.min("_second").alias("_cut"))
    cuts = starts.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.collect_list("_cut").alias("_cuts"))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    passed = F.size(F.filter("_cuts", lambda c: c <= second))
    return df.join(cuts, same, "left").select(*df.columns, F.coalesce(F.when(F.col("_cuts").isNotNull(), passed), F.lit(0)).alias(alias))


def chunked_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: str, col: str, alias: str
) -> DataFrame:
    """Running sum of ``col`` along ``order`` inside a key, one chunk per task."""
    keys = list(keys)
    per_chunk = df.groupBy(*keys, chunk).agg(F.sum(col).alias("_t"))
    before = W.partitionBy(*keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    offsets = per_chunk.select(*keys, chunk, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(offsets, [*keys, chunk]).select(
        *df.columns, (F.col("_o") + F.sum(col).over(inside)).alias(alias)
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row per key in a stated order.

    Spark limits each key inside the map tasks before it shuffles, so a hot key sends one row per task.
    """
    return top_k_per_key(df, keys, order, 1).drop("rank")


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def moment_matrices(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(position, total): the matrix of ``x' x`` over all rows, flat, with x = (1, columns).

    One matrix product per Arrow batch and one partial matrix per task, summed by position: one
    aggregate whatever the number of columns. Rows with a null or NaN in any column are left out.
    """
    k = len(columns) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False) for c in batch.columns]])
            x = x[~np.isnan(x).any(axis=1)]
            total += x.T @ x
        yield pa.record_batch({"position": pa.array(range(k * k), pa.int32()), "total": pa.array(total.ravel())})

    parts = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).mapInArrow(partial, "position int, total double")
    return parts.groupBy("position").agg(F.sum("total").alias("total"))


def gram_sums(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The matrix of ``moment_matrices`` on the driver: row count, column sums and sums of products; (columns + 1) squared numbers."""
    k = len(columns) + 1
    out = np.zeros(k * k)
    for row in moment_matrices(df, columns).collect():
        out[row.position] = row.total
    return out.reshape(k, k)
