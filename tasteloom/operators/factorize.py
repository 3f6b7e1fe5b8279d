"""Non-negative factorization of the zero-filled user x item matrix without building it.

The matrix stays a table of observed cells. Users and items are dealt to hash blocks, and a cell
lies in the block of its user block and item block. Cell blocks are packed once, kept by block on the
executors (and rebuilt from a written table where one is lost) and never move again: a half-step
sends each block the factors of the ids that it holds, gets back the sums ``value * f`` of its
rows, and solves the small non-negative least-squares problem of every row against the k x k Gram
matrix by coordinate descent (accelerated HALS, Gillis and Glineur 2012). Zero cells enter through the
Gram matrix only, so they cost nothing. A hot user or item is spread over all blocks of the
other side. A task that solves rows meets the sums of all blocks of the other side, whose number grows with
the input, so a side block is solved, written and cut in units of its ids, as many as keep these sums bounded.
Factors are tables ``(id, f0 .. f{k-1})``, packed by unit while the fit runs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.expr import clamp
from ..session import scratch
from .scale import gram_sums


def factor_names(k: int) -> list[str]:
    return [f"f{j}" for j in range(k)]


#: Cells of a block on average, and ids of a block on either side, that the number of blocks aims at. An id's factors
#: travel once for each block of the other side that it meets, so blocks are as large as a task can hold: a block is one row, and
#: the JVM copies rows in buffers that double.
BLOCK_CELLS, BLOCK_IDS = 500_000, 262_144
#: Bytes of sums, or of pieces cut, that a task holds for a unit of a side block, all blocks of the other side together.
UNIT_BYTES = 8 << 20
#: Files of a half-step's shuffles go when its factors are written, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Sweeps of the solver after which it looks for rows that are done.
LOOK = 32
#: A row of a written half-step: a whole unit.
SOLVED = "side int, ids binary, factors binary, gram binary, total double"
NAMES, TYPES = ["side", "ids", "factors", "gram", "total"], [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]


@dataclass
class Factors:
    users: DataFrame
    items: DataFrame
    item_gram: np.ndarray
    k: int
    errors: list[float]


def start_values(ids: np.ndarray, k: int, scale: float, seed: int) -> np.ndarray:
    """Positive start values from a hash of the id: the same on every run and partitioning."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(1_000_003) / 1_000_003 + 0.05) * scale


def non_negative(n: np.ndarray, g: np.ndarray, sweeps: int) -> np.ndarray:
    """Rows ``w >= 0`` that minimize ``w g w / 2 - n w``, solved from scratch, all rows at once.

    A row that a whole sweep leaves as it was is done: further sweeps would change nothing.
    """
    step = np.maximum(np.diag(g), 1e-12)
    # best multiple of the clipped gradient as the start
    w = np.maximum(n, 1e-12)
    w *= (np.sum(w * n, axis=1) / np.maximum(np.sum((w @ g) * w, axis=1), 1e-300)).clip(0)[:, None]
    out, open_ = w, None
    for turn in range(sweeps):
        was = w.copy() if turn % LOOK == LOOK - 1 else None
        for j in range(len(g)):
            w[:, j] = np.maximum(w[:, j] + (n[:, j] - w @ g[:, j]) / step[j], 1e-12)
        if was is None:
            continue
        moved = (w != was).any(axis=1)
        if not moved.all():
            open_ = np.arange(len(out)) if open_ is None else open_
            out[open_] = w
            open_, w, n = open_[moved], w[moved], n[moved]
            if not len(w):
                return out
    if open_ is not None:
        out[open_] = w
    return out


def numerators(cells: DataFrame, fixed: DataFrame, key: str, fixed_key: str, k: int) -> DataFrame:
    """``sum(value * f)`` per row key over the observed cells: partial sums in the map tasks."""
    return cells.join(fixed, fixed_key).groupBy(key).agg(
        *[F.sum(F.col("value") * F.col(f)).alias(f"n{j}") for j, f in enumerate(factor_names(k))]
    )


def solve_rows(nums: DataFrame, key: str, g: np.ndarray, k: int, sweeps: int = 20) -> DataFrame:
    """Factors of rows with numerators ``n0 ..`` against a fixed Gram matrix, vectorized over Arrow batches."""
    names, key_type = factor_names(k), dict(nums.dtypes)[key]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame(non_negative(pdf[[f"n{j}" for j in range(k)]].to_numpy(dtype="float64"), g, sweeps), columns=names)
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return nums.mapInPandas(solve, f"{key} {key_type}, " + ", ".join(f"{f} double" for f in names))


def gram_matrix(factors: DataFrame, k: int) -> np.ndarray:
    """``sum(f f')`` over the rows of a factor table; k * k numbers reach the driver."""
    return gram_sums(factors, factor_names(k))[1:, 1:]


# --- the fit on blocks


def _doubles(blob: bytes | pa.Buffer, k: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(-1, k)


def unit_of(ids: np.ndarray, units: int) -> np.ndarray:
    """The unit of its side block that an id belongs to."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(units)


def lone_labels(spark: SparkSession, n: int, width: int) -> list[int]:
    """``n`` numbers for blocks that hash to partitions of their own among ``width``, as far as there are that many."""
    rows = spark.range(32 * width).select(F.col("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(width)).alias("p"))
    alone = sorted(r.id for r in rows.groupBy("p").agg(F.min("id").alias("id")).collect())[:n]
    return alone + list(range(32 * width, 32 * width + n - len(alone)))


def cell_blocks(cells: DataFrame, user: str, item: str, user_blocks: int, item_blocks: int, width: int) -> DataFrame:
    """One row per block: its distinct users and items, ascending, and its cells as positions among them.

    Hash-partitioned and sorted by ``block``; a block holds at most one cell for each of its pairs.
    """

    def pack(table: pa.Table) -> pa.Table:
        one = {c: table.column(c)[0].as_py() for c in ("block", "p", "q")}
        users, rows = np.unique(table.column("u").to_numpy(), return_inverse=True)
        items, columns = np.unique(table.column("i").to_numpy(), return_inverse=True)
        blobs = [users.astype(np.int64), items.astype(np.int64), rows.astype(np.int32), columns.astype(np.int32), table.column("v").to_numpy().astype(np.float64)]
        return pa.table({**{c: pa.array([x], pa.int32()) for c, x in one.items()},
                         **{n: pa.array([b.tobytes()], pa.binary()) for n, b in zip(("users", "items", "r", "c", "v"), blobs)}})

    p, q = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in ((user, user_blocks), (item, item_blocks)))
    rows = cells.select(p.alias("p"), q.alias("q"), F.col(user).cast("long").alias("u"), F.col(item).cast("long").alias("i"), F.col("value").cast("double").alias("v"))
    labels = F.array(*[F.lit(n) for n in lone_labels(cells.sparkSession, user_blocks * item_blocks, width)])
    rows = rows.withColumn("block", F.get(labels, F.col("p") * item_blocks + F.col("q"))).repartition(width, "block")
    schema = "block int, p int, q int, users binary, items binary, r binary, c binary, v binary"
    return rows.groupBy("block").applyInArrow(pack, schema).repartition(width, "block").sortWithinPartitions("block")


def block_sums(blocks: DataFrame, pieces: DataFrame, side: str, k: int, width: int) -> DataFrame:
    """(side unit, ids, sums): what each cell block adds to the numerators of its rows; the cells stay where they are."""
    own, other = ("users", "items") if side == "users" else ("items", "users")
    rows, columns, to = ("r", "c", "p") if side == "users" else ("c", "r", "q")

    def added(block: int, units: int, other_units: int, blobs: list[pa.Buffer], pieces: list[tuple[int, pa.Buffer]]) -> Iterator[pa.RecordBatch]:
        ids, others, at, column, v = (np.frombuffer(x, t) for x, t in zip(blobs, (np.int64, np.int64, np.int32, np.int32, np.float64)))
        # a row for each factor: the sums read them one by one
        met, unit = np.empty((k, len(others))), unit_of(others, other_units)
        for u, piece in pieces:
            met[:, unit == u] = _doubles(piece, k).T
        sums, unit = np.empty((k, len(ids))), unit_of(ids, units)
        for j in range(k):
            sums[j] = np.bincount(at, v * met[j][column], len(ids))
        del met
        for u in map(int, np.unique(unit)):
            mine = unit == u
            yield pa.record_batch({"side": pa.array([block * units + u], pa.int32()), "ids": pa.array([ids[mine].tobytes()], pa.binary()),
                                   "sums": pa.array([np.ascontiguousarray(sums[:, mine].T).tobytes()], pa.binary())})

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, cut = {}, {}
        for batch in batches:
            for n in range(batch.num_rows):
                label, block, units, other_units, unit, many = (batch.column(c)[n].as_py() for c in range(6))
                cut.setdefault(label, []).append((unit, batch.column(6)[n].as_buffer()))
                if batch.column(7)[n].is_valid:
                    cells[label] = block, units, other_units, [batch.column(c)[n].as_buffer() for c in range(7, 12)]
                if len(cut[label]) == many:
                    yield from added(*cells.pop(label), cut.pop(label))

    # the pieces are hashed to where the cells are; nothing else would leave the cells in place. A block meets its pieces in
    # turn and its cells go to Python with the first of them
    met = blocks.join(pieces.hint("shuffle_hash"), "block").select(
        "block", F.col(to), f"{own}_units", f"{other}_units", "unit", "many", "piece", *[F.when(F.col("lead"), F.col(c)).alias(c) for c in (own, other, rows, columns, "v")])
    return met.mapInArrow(multiply, "side int, ids binary, sums binary").repartition(width, "side")


def solved_blocks(sums: DataFrame, g: np.ndarray | None, k: int, sweeps: int = 20, scale: float = 1.0, seed: int = 42) -> DataFrame:
    """Per unit of a side block its factors, their Gram matrix and ``sum(numerator * factor)``.

    Without ``g`` the sums are the factors themselves, and without sums the factors are start values from the ids.
    """

    def solve(table: pa.Table) -> pa.Table:
        ids = [np.frombuffer(b, np.int64) for b in table.column("ids").to_pylist()]
        all_ids = np.unique(np.concatenate(ids))
        n = np.zeros((len(all_ids), k))
        if "sums" in table.column_names:
            for own, part in zip(ids, table.column("sums")):
                if g is None:  # given rows may repeat an id
                    np.add.at(n, np.searchsorted(all_ids, own), _doubles(part.as_buffer(), k))
                else:
                    n[np.searchsorted(all_ids, own)] += _doubles(part.as_buffer(), k)
            w = n if g is None else non_negative(n, g, sweeps)
        else:
            w = start_values(all_ids, k, scale, seed)
        row = (table.column("side")[0].as_py(), all_ids.tobytes(), w.tobytes(), (w.T @ w).tobytes(), float(np.sum(n * w)))
        return pa.table({c: pa.array([x], t) for c, t, x in zip(NAMES, TYPES, row)})

    return sums.groupBy("side").applyInArrow(solve, SOLVED)


def pieces_of(solved: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    """(block, unit, many, lead, piece): for each cell block the factors of the ids that it holds, cut from the written units of side blocks.

    ``routes`` (side, unit, block, many, lead, need) says which ids those are. Pieces are many times as large as the factors, so they
    are sent and never written.
    """

    def cut(table: pa.Table, needs: pa.Table) -> pa.Table:
        schema = pa.schema([("block", pa.int32()), ("unit", pa.int32()), ("many", pa.int32()), ("lead", pa.bool_()), ("piece", pa.binary())])
        if not table.num_rows:
            return schema.empty_table()
        ids, w = np.frombuffer(table.column("ids")[0].as_buffer(), np.int64), _doubles(table.column("factors")[0].as_buffer(), k)
        # a batch for each piece: together they may pass what one Arrow array holds
        return pa.Table.from_batches([
            pa.record_batch([*[pa.array([needs.column(c)[n].as_py()], schema.field(c).type) for c in schema.names[:-1]],
                             pa.array([w[np.searchsorted(ids, np.frombuffer(needs.column("need")[n].as_buffer(), np.int64))].tobytes()], pa.binary())], schema)
            for n in range(needs.num_rows)], schema)

    sides = solved.select("side", "ids", "factors")
    return sides.groupBy("side").cogroup(routes.groupBy("side")).applyInArrow(cut, "block int, unit int, many int, lead boolean, piece binary")


def routes_of(blocks: DataFrame, to: str, ids: str, width: int) -> DataFrame:
    """(side, unit, block, many, lead, need): the ids of each unit that each cell block holds, sorted by side.

    ``many`` units meet the block, and one of them has the ``lead``.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                block, label, units = (batch.column(c)[n].as_py() for c in range(3))
                held = np.frombuffer(batch.column(3)[n].as_buffer(), np.int64)
                unit = unit_of(held, units)
                met = list(map(int, np.unique(unit)))
                for u in met:
                    yield pa.record_batch({**{c: pa.array([x], pa.int32()) for c, x in (("side", block * units + u), ("unit", u), ("block", label), ("many", len(met)))},
                                           "lead": pa.array([u == met[0]]), "need": pa.array([held[unit == u].tobytes()], pa.binary())})

    rows = blocks.select(to, "block", f"{ids}_units", ids).mapInArrow(split, "side int, unit int, block int, many int, lead boolean, need binary")
    return rows.repartition(width, "side").sortWithinPartitions("side")


def packed_factors(given: DataFrame, k: int, units: int) -> DataFrame:
    """Factor rows (side block, id, f0 ..) as one row per unit."""

    def pack(table: pa.Table) -> pa.Table:
        w = np.column_stack([table.column(f).to_numpy() for f in factor_names(k)]).astype(np.float64)
        ids, block = table.column("id").to_numpy().astype(np.int64), table.column("side")[0].as_py()
        unit = unit_of(ids, units)
        rows = [(block * units + u, ids[unit == u].tobytes(), w[unit == u].tobytes()) for u in map(int, np.unique(unit))]
        return pa.table({c: pa.array(x, t) for c, t, x in zip(("side", "ids", "sums"), (pa.int32(), pa.binary(), pa.binary()), zip(*rows))})

    return given.groupBy("side").applyInArrow(pack, "side int, ids binary, sums binary")


def _gram_and_total(solved: DataFrame, k: int) -> tuple[np.ndarray, float]:
    """Sums of the blocks' Gram matrices and totals: one partial row per task, k * k + 1 numbers in each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, total = np.zeros((k, k)), 0.0
        for batch in batches:
            for blob, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g += _doubles(blob, k)
                total += part
        yield pa.record_batch({"gram": pa.array([g.tobytes()], pa.binary()), "total": [total]})

    rows = solved.select("gram", "total").mapInArrow(add, "gram binary, total double").collect()
    return sum((_doubles(bytes(r.gram), k) for r in rows), np.zeros((k, k))), float(sum(r.total for r in rows))


def _unpacked(solved: DataFrame, key: str, kind: str, k: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = _doubles(blob, k)
                yield pa.record_batch({key: pa.array(np.frombuffer(ids, np.int64)), **{f: pa.array(np.ascontiguousarray(w[:, j])) for j, f in enumerate(factor_names(k))}})

    out = solved.select("ids", "factors").mapInArrow(rows, f"{key} long, " + ", ".join(f"{f} double" for f in factor_names(k)))
    return out.withColumn(key, F.col(key).cast(kind))


def fit_nmf(
    spark: SparkSession, cells: DataFrame, k: int = 20, iterations: int = 200, user: str = "UserID", item: str = "MovieID",
    seed: int = 42, tol: float = 1e-4, start: DataFrame | None = None, sweeps: int = 20,
) -> Factors:
    """Alternate half-steps over packed cell blocks, until the error falls by less than ``tol`` of its first
    value or ``iterations`` is reached. Ids are integers.

    ``start`` (item, f0 ..) gives the item factors to begin with, so that a fit can go on from an earlier
    one; items that it lacks begin at zero. Else they begin with a hash of their ids.

    ``errors`` is the norm ``|V - WH|`` over all cells after every full step. It comes for free:
    ``|V|^2 - 2 sum(numerator * factor) + tr(W'W HH')``.

    Factors go to two alternating tables per side, so lineage never grows and a lost executor
    re-reads a written table.
    """
    base, kinds = scratch(spark, "nmf"), dict(cells.dtypes)
    cells.select(user, item, "value").write.parquet(f"{base}/cells")
    stored = spark.read.parquet(f"{base}/cells")
    size = stored.agg(
        F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("vv"), F.count(F.lit(1)).alias("cells"),
        F.approx_count_distinct(user).alias("m"), F.approx_count_distinct(item).alias("n"),
    ).first()
    scale = float(np.sqrt(size.s / (size.m * size.n) / k)) if size.m else 1.0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # enough blocks for the cells, for the ids and for one block a core; more of them would only send factors to more places
    cores = min(width, spark.sparkContext.defaultParallelism)
    least = max(math.ceil(math.sqrt(size.cells / BLOCK_CELLS)), math.ceil(math.sqrt(cores)), 1)
    counts = max(least, math.ceil(size.m / BLOCK_IDS)), max(least, math.ceil(size.n / BLOCK_IDS))
    # units of a block on either side: its ids times the blocks that send sums of them
    of_users, of_items = (max(1, math.ceil(ids / own * other * k * 8 / UNIT_BYTES)) for ids, own, other in ((size.m, *counts), (size.n, *counts[::-1])))
    width = max(width, counts[0] * counts[1])
    blocks = cell_blocks(stored, user, item, *counts, width).withColumns({"users_units": F.lit(of_users), "items_units": F.lit(of_items)}).persist(StorageLevel.MEMORY_AND_DISK)
    routes = {side: routes_of(blocks, to, side, width).persist(StorageLevel.MEMORY_AND_DISK) for side, to in (("users", "p"), ("items", "q"))}

    def written(df: DataFrame, side: str, turn: int) -> tuple[DataFrame, np.ndarray, float]:
        path, was = f"{base}/{side}_{turn % 2}", spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            spark.conf.set(CLEANUP, was)
        back = spark.read.schema(SOLVED).parquet(path)
        return back, *_gram_and_total(back, k)

    def half_step(side: str, fixed: DataFrame, g: np.ndarray, turn: int) -> tuple[DataFrame, np.ndarray, float]:
        pieces = pieces_of(fixed, routes["items" if side == "users" else "users"], k)
        return written(solved_blocks(block_sums(blocks, pieces, side, k, width), g, k, sweeps), side, turn)

    ids = routes["items"].select("side", F.col("need").alias("ids"))
    if start is not None:
        given = stored.select(item).distinct().join(start, item, "left").select(
            F.pmod(F.xxhash64(item), F.lit(counts[1])).cast("int").alias("side"), F.col(item).cast("long").alias("id"), *[F.coalesce(f, F.lit(0.0)).alias(f) for f in factor_names(k)])
        ids = packed_factors(given, k, of_items)
    items, item_g, _ = written(solved_blocks(ids, None, k, scale=scale, seed=seed), "items", 0)
    users, errors = None, []
    for turn in range(1, iterations + 1):
        users, user_g, _ = half_step("users", items, item_g, turn)
        items, item_g, cross = half_step("items", users, user_g, turn)
        errors.append(float(np.sqrt(max((size.vv or 0) - 2 * cross + np.sum(user_g * item_g), 0.0))))
        if turn > 1 and errors[-2] - errors[-1] < tol * errors[0]:
            break
    for df in (*routes.values(), blocks):
        df.unpersist()
    return Factors(_unpacked(users, user, kinds[user], k), _unpacked(items, item, kinds[item], k), item_g, k, errors)


def fold_in(cells: DataFrame, model: Factors, user: str = "UserID", item: str = "MovieID", sweeps: int = 30) -> DataFrame:
    """User factors of unseen users against the fitted item factors."""
    nums = numerators(cells, model.items, user, item, model.k)
    return solve_rows(nums, user, model.item_gram, model.k, sweeps)


def predicted(k: int, left: str = "u_", right: str = "i_") -> Column:
    total = F.lit(0.0)
    for f in factor_names(k):
        total = total + F.col(left + f) * F.col(right + f)
    return total


def score_pairs(pairs: DataFrame, users: DataFrame, items: DataFrame, k: int, user: str = "UserID", item: str = "MovieID") -> DataFrame:
    """Add ``prediction`` to the pairs whose user and item are known."""
    names = factor_names(k)
    u = users.select(user, *[F.col(f).alias(f"u_{f}") for f in names])
    i = items.select(item, *[F.col(f).alias(f"i_{f}") for f in names])
    return pairs.join(u, user).join(i, item).select(*pairs.columns, predicted(k).alias("prediction"))


def reconstruction_error(cells: DataFrame, users: DataFrame, items: DataFrame, k: int, user: str = "UserID", item: str = "MovieID") -> DataFrame:
    """RMSE and MAE over ALL cells of the zero-filled matrix, and its sparsity, in closed form.

    ``|V - WH|^2 = sum(V^2) - 2 sum_obs(v p) + tr((W'W)(HH'))``, and with non-negative factors
    ``sum|V - WH| = sum_obs(|v - p| - p) + (sum_u W)(sum_i H)``.
    """
    names = factor_names(k)
    obs = score_pairs(cells, users, items, k, user, item)
    v, p = F.col("value"), F.col("prediction")
    one = obs.agg(
        F.sum(v * v).alias("vv"), F.sum(v * p).alias("vp"), F.sum(F.abs(v - p) - p).alias("l1"), F.count(F.lit(1)).alias("nnz")
    )

    # row count, column sums and Gram matrix of either side: (k + 1) squared numbers
    u, i = gram_sums(users, names), gram_sums(items, names)
    both = one.withColumns({
        "u_n": F.lit(int(u[0, 0])), "i_n": F.lit(int(i[0, 0])), "gg": F.lit(float(np.sum(u[1:, 1:] * i[1:, 1:]))), "ss": F.lit(float(np.sum(u[0, 1:] * i[0, 1:]))),
    })
    cells_total = F.col("u_n").cast("double") * F.col("i_n").cast("double")  # whole numbers overflow beyond 46,340 of each
    square = F.col("vv") - 2 * F.col("vp") + F.col("gg")
    absolute = F.col("l1") + F.col("ss")
    return both.select(
        F.sqrt(F.greatest(square, F.lit(0.0)) / cells_total).alias("reconstruction_rmse"),
        (absolute / cells_total).alias("reconstruction_mae"),
        (1 - F.col("nnz") / cells_total).alias("sparsity"),
        F.col("u_n").cast("bigint").alias("n_users"),
        F.col("i_n").cast("bigint").alias("n_items"),
    )


def masked_evaluation(test: DataFrame, users: DataFrame, items: DataFrame, k: int, low: float = 0.0, high: float = 5.0) -> DataFrame:
    """Error on the observed cells of folded-in users with predictions clipped, and the share of positive predictions among them."""
    scored = score_pairs(test, users, items, k).withColumn("prediction", clamp("prediction", low, high))
    e = F.col("prediction") - F.col("value")
    return scored.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(F.col("prediction") > 1e-9, 1.0).otherwise(0.0)).alias("coverage"), F.count(F.lit(1)).alias("cells"),
    )
