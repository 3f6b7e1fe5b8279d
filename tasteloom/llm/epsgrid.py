"""Near-duplicate vectors: epsilon grid order join on leading principal dimensions.

Unit vectors at cosine c or more are at distance eps = sqrt(2 - 2 c) or less, in any rotation and
in any subset of its coordinates. Vectors are rotated to their principal dimensions (the rotation
is fitted on a bounded sample; any rotation gives the same links), sorted by their eps-wide grid
cells on the leading ones in lexicographic order, and the sequence is cut into intervals. Two
intervals can hold links only if their first cells are neighbours and their bounding boxes are
within eps; such pairs are joined recursively, halving intervals and skipping distant ones.

Equal vectors are one class. A pair of intervals yields counts of links and edges to a root of
each group that it finds, never its links one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import components, session, written

COSINE = 0.98
BLOCK, LEAF = 1024, 128
GRID, BOX = 4, 16  # sorted and boxed principal dimensions
FIT_VALUES = 1_280_000  # numbers in the sample that the rotation is fitted on: 20,000 vectors of 64
SLACK = 1e-9


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist()):
            row = (None, None)
            if label is not None and v and None not in v:
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(x).all() and top > 0:
                    x = x / top
                    x = x / np.sqrt(x @ x) + 0.0  # no negative zero
                    row = hashlib.blake2b(repr((label, len(x))).encode() + x.tobytes(), digest_size=16).digest(), x.tobytes()
            out.append(row)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.binary())],
                                         ["vec_id", "label", "node", "unit"])


def _rotations(classes: DataFrame) -> dict[int, np.ndarray]:
    """An orthogonal matrix by dimension, from a bounded sample of classes in the order of their hash."""
    widest = classes.agg(F.max("dim")).first()[0]
    rows = classes.orderBy("node").limit(max(64, FIT_VALUES // widest)).select("dim", "unit").collect() if widest else []
    out = {}
    for dim in {r.dim for r in rows}:
        x = np.stack([np.frombuffer(r.unit, np.float64) for r in rows if r.dim == dim])
        x = x - x.mean(axis=0)
        out[dim] = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])
    return out


def _cells(rotations: dict[int, np.ndarray], eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for dim, unit in zip(batch.column("dim").to_pylist(), batch.column("unit").to_pylist()):
                x = np.frombuffer(unit, np.float64)
                x = x @ rotations[dim][:, :GRID] if dim in rotations else x[:GRID]
                cells.append(np.floor(x / eps).astype(np.int64).tolist() + [0] * (GRID - len(x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([c[i] for c in cells], pa.int64()) for i in range(GRID)]],
                                             [*batch.schema.names, *[f"c{i}" for i in range(GRID)]])

    return run


def _boxed(x: np.ndarray, rotations: dict[int, np.ndarray]) -> np.ndarray:
    dim = x.shape[1]
    return x @ rotations[dim][:, :BOX] if dim in rotations else x[:, :BOX]


def _blocks(rotations: dict[int, np.ndarray]):
    """Cuts the sorted rows of a partition into intervals of one label and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, held, key = TaskContext.get().partitionId(), 0, [], None

        def block():
            x = np.stack([np.frombuffer(r["unit"], np.float64) for r in held])
            box = _boxed(x, rotations)
            return pa.RecordBatch.from_pylist([{
                "block": (part << 32) + made, "label": key[0], "dim": key[1], "first": held[0]["c0"], "last": held[-1]["c0"],
                "lo": box.min(axis=0).tolist(), "hi": box.max(axis=0).tolist(),
                "nodes": [r["node"] for r in held], "copies": [r["copies"] for r in held], "units": x.tobytes()}], _BLOCK)

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) == BLOCK or (r["label"], r["dim"]) != key):
                    yield block()
                    made, held = made + 1, []
                key = r["label"], r["dim"]
                held.append(r)
        if held:
            yield block()

    return run


_BLOCK = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("lo", pa.list_(pa.float64())),
                    ("hi", pa.list_(pa.float64())), ("nodes", pa.list_(pa.binary())), ("copies", pa.list_(pa.int64())), ("units", pa.binary())])
_BLOCK_DDL = "block long, label long, dim int, first long, last long, lo array<double>, hi array<double>, nodes array<binary>, copies array<long>, units binary"


def interval_links(x: np.ndarray, y: np.ndarray | None, px: np.ndarray, py: np.ndarray | None, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at ``cosine`` or more between two sequences, or within one if ``y`` is None."""
    same = y is None
    if same:
        y, py = x, px
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def join(i, j, k, m):
        a, b = px[i:j], py[k:m]
        gap = np.maximum(0, np.maximum(a.min(axis=0) - b.max(axis=0), b.min(axis=0) - a.max(axis=0)))
        if gap @ gap > eps * eps + SLACK or (same and m <= i):
            return
        if j - i <= LEAF and m - k <= LEAF:
            u, v = np.nonzero(x[i:j] @ y[k:m].T >= cosine)
            u, v = u + i, v + k
            if same:
                u, v = u[u < v], v[u < v]
            left.append(u)
            right.append(v)
        elif j - i >= m - k:
            mid = (i + j) // 2
            join(i, mid, k, m)
            join(mid, j, k, m)
        else:
            mid = (k + m) // 2
            join(i, j, k, mid)
            join(i, j, mid, m)

    join(0, len(x), 0, len(y))
    return np.concatenate(left), np.concatenate(right)


def _join(cosine: float, eps: float, rotations: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r] for n in batch.schema.names}
                dim, same = row["dim"].as_py(), row["a"].as_py() == row["b"].as_py()
                x = np.frombuffer(row["units_a"].as_buffer(), np.float64).reshape(-1, dim)
                y = None if same else np.frombuffer(row["units_b"].as_buffer(), np.float64).reshape(-1, dim)
                u, v = interval_links(x, y, _boxed(x, rotations), None if same else _boxed(y, rotations), cosine, eps)
                if not len(u):
                    continue
                nodes, copies = row["nodes_a"].as_py(), np.array(row["copies_a"].as_py())
                if not same:
                    v = v + len(x)
                    nodes, copies = nodes + row["nodes_b"].as_py(), np.concatenate([copies, row["copies_b"].as_py()])
                links = np.bincount(u, copies[v], len(nodes)) + np.bincount(v, copies[u], len(nodes))
                root = np.arange(len(nodes))
                while True:  # the least index of each group, by spreading and jumping
                    was = root.copy()
                    low = np.minimum(root[u], root[v])
                    np.minimum.at(root, u, low)
                    np.minimum.at(root, v, low)
                    root = root[root]
                    if (was == root).all():
                        break
                hit = np.nonzero(links)[0]
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in hit], pa.binary()), pa.array(links[hit].astype(np.int64)),
                                                  pa.array([nodes[root[i]] for i in hit], pa.binary())], ["node", "links", "root"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label; other columns are not read).

    Vectors are compared within a label and a dimension. A null label, and a vector that is null,
    empty, zero or holds null or non-finite values, links with nothing. Rows with a null id count as
    partners but name no component; rows that repeat an id are separate vectors. Equal vectors
    are linked. An empty table gives an empty result.
    """
    session(vectors.sparkSession)
    eps = float(np.sqrt(2 - 2 * cosine))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    valid = written(rows.mapInArrow(_valid, "vec_id long, label long, node binary, unit binary"), "valid")
    classes = written(valid.where("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("dim", (F.length("unit") / 8).cast("int")), "classes")
    rotations = _rotations(classes)
    order = ["label", "dim", *[f"c{i}" for i in range(GRID)], "node"]
    celled = classes.select("node", "label", "dim", "copies", "unit").mapInArrow(
        _cells(rotations, eps), "node binary, label long, dim int, copies long, unit binary, " + ", ".join(f"c{i} long" for i in range(GRID)))
    celled = written(celled, "celled")
    blocks = written(celled.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(rotations), _BLOCK_DDL), "blocks")

    brief = blocks.select("block", "label", "dim", "first", "last", "lo", "hi")
    side = lambda n, lo, hi: brief.select("label", "dim", F.col("block").alias(n), F.col("lo").alias(f"lo_{n}"), F.col("hi").alias(f"hi_{n}"),
                                          F.explode(F.sequence(F.col("first") - lo, F.col("last") + hi)).alias("cell"))
    gap = lambda i: F.greatest(F.lit(0.0), F.get("lo_a", F.lit(i)) - F.get("hi_b", F.lit(i)), F.get("lo_b", F.lit(i)) - F.get("hi_a", F.lit(i)))
    distance = sum((F.coalesce(gap(i) * gap(i), F.lit(0.0)) for i in range(1, BOX)), gap(0) * gap(0))
    pairs = side("a", 0, 0).join(side("b", 1, 1), ["label", "dim", "cell"]).where("a <= b")
    pairs = pairs.where(distance <= eps * eps + SLACK).select("a", "b", "dim").distinct()
    data = lambda n: blocks.select(F.col("block").alias(n), F.col("nodes").alias(f"nodes_{n}"), F.col("copies").alias(f"copies_{n}"), F.col("units").alias(f"units_{n}"))
    met = written(pairs, "pairs").join(data("a"), "a").join(data("b"), "b")
    found = written(met.mapInArrow(_join(cosine, eps, rotations), "node binary, links long, root binary"), "found")

    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = written(labels.join(classes.select("node", "least"), "node"), "linked")
    named = linked.join(linked.groupBy("label").agg(F.min("least").alias("first_id")), "label").select("node", "first_id")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = written(classes.select("node", "copies", "least").join(named, "node", "left").join(counts, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("first_id", "least").alias("first_id")), "known")
    component = F.coalesce("first_id", "vec_id")
    return valid.select("vec_id", "node").join(known, "node", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
