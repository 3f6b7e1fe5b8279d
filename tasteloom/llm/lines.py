"""Line dedup across documents.

A line's key is the line without white space at its ends, ASCII letters in lower case. Keys of at
least ``LEAST`` code points are hashed to 128 bits, and the hashes are range-partitioned with a
secondary sort by document and position: (hash, id, position) is the sort key and the range key,
so that a line that a third of all documents hold lies in several tasks. A task streams its rows
and knows a key's first document where the run of the key begins. Only the run at a task's head
may have begun before; its rows are set aside with the task's number, and one row per task (last
hash and its first document) settles them. Nothing is held but one batch.

What is returned is a compressed bitmap of kept lines for each document, not a text. Texts are
read again only to apply it.

Defined results: rows of one id are one document, and rows without an id are one document that
comes after all others. Decisions depend on id and key only, so rows that repeat an id and a text
get the same bitmap; the bitmaps are filed under id and a hash of the text. A null text is one
empty line, as the empty text is. Keys below ``LEAST`` code points are always kept. Empty tables
give no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import lower_ascii, session, written

LEAST = 10
WHITE = " \t\n\x0b\x0c\r"
DROP, HEAD, TASK = 0, 1, 2


def line_hashes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2, doc_id, text_hash, pos) of every line whose key has ``least`` code points."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("key", lower_ascii(F.trim("line", F.lit(WHITE)))).where(F.length("key") >= least)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(LEAST), "key").alias("h2"), "doc_id", "text_hash", "pos")


def stream_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows after the first document of their run (DROP), all rows of the task's first run (HEAD), and the task's two ends (TASK).

    The rows come sorted by hash, id and position. A HEAD or TASK row holds the first document that
    this task saw: of its first run in ``first``, of its last one in ``last``.
    """
    task = TaskContext.get().partitionId()

    def rows(kind, doc, has, text_hash, pos):
        n = len(doc)
        blank = pa.nulls(n, pa.int64())
        return pa.record_batch([
            pa.array(np.full(n, task, np.int64)), pa.array(np.full(n, kind, np.int8)), pa.array(doc, mask=~has), pa.array(text_hash), pa.array(pos), *[blank] * 6,
        ], names=NAMES)

    head = run = None  # (h1, h2, first id, whether it is an id)
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, text_hash = (batch.column(c).to_numpy() for c in (0, 1, 3))
        ids = batch.column(2)
        has = ids.is_valid().to_numpy(zero_copy_only=False)
        doc, pos = ids.fill_null(0).to_numpy(), batch.column(4).to_numpy()
        if run is None:
            head = run = (int(h1[0]), int(h2[0]), int(doc[0]), bool(has[0]))
        new = np.empty(len(h1), bool)
        new[0] = (int(h1[0]), int(h2[0])) != run[:2]
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        starts, run_of = np.flatnonzero(new), np.cumsum(new)
        first = np.concatenate([[run[2]], doc[starts]])[run_of]
        first_has = np.concatenate([[run[3]], has[starts]])[run_of]
        in_head = (h1 == head[0]) & (h2 == head[1])
        later = ~in_head & ((doc != first) | (has != first_has))
        for kind, pick in ((DROP, later), (HEAD, in_head)):
            if pick.any():
                yield rows(kind, doc[pick], has[pick], text_hash[pick], pos[pick])
        if len(starts):
            at = starts[-1]
            run = (int(h1[at]), int(h2[at]), int(doc[at]), bool(has[at]))
    if run is not None:
        ends = [x for h in (head, run) for x in (h[0], h[1], h[2] if h[3] else None)]
        yield pa.record_batch([pa.array([task]), pa.array([TASK], pa.int8()), *[pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int32())],
                               *[pa.array([x], pa.int64()) for x in ends]], names=NAMES)


NAMES = ["task", "kind", "doc_id", "text_hash", "pos", "head1", "head2", "first", "last1", "last2", "last"]
SCHEMA = "task long, kind byte, doc_id long, text_hash long, pos int, head1 long, head2 long, first long, last1 long, last2 long, last long"


def heads(ends: list) -> list[tuple[int, int | None]]:
    """(task, first document of its first run): from the task in which the run began. ``ends`` are TASK rows by task."""
    out, hash_before, doc_before = [], None, None
    for e in ends:
        first = doc_before if hash_before == (e.head1, e.head2) else e.first
        out.append((e.task, first))
        one_run = (e.head1, e.head2) == (e.last1, e.last2)
        hash_before, doc_before = (e.last1, e.last2), first if one_run else e.last
    return out


def dropped_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text_hash, pos) of the lines to drop."""
    spark = docs.sparkSession
    order = [F.asc("h1"), F.asc("h2"), F.asc_nulls_last("doc_id"), F.asc("text_hash"), F.asc("pos")]
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = line_hashes(docs, least).repartitionByRange(width, *order).sortWithinPartitions(*order)
    found = written(dealt.mapInArrow(stream_firsts, SCHEMA), "lines")
    # one row per task
    ends = found.where(F.col("kind") == TASK).orderBy("task").collect()
    settled = spark.createDataFrame(heads(ends), "task long, least long")
    late = found.where(F.col("kind") == HEAD).drop("first").join(F.broadcast(settled), "task").where(~F.col("doc_id").eqNullSafe(F.col("least")))
    columns = ["doc_id", "text_hash", "pos"]
    return found.where(F.col("kind") == DROP).select(*columns).unionByName(late.select(*columns))


def bitmap(dropped: np.ndarray) -> bytes:
    """Kept lines as bits, the first line lowest; lines beyond the last byte are kept. Deflated."""
    keep = np.ones(int(dropped.max()) // 8 * 8 + 8, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def kept_lines(text: str | None, keep: bytes | None) -> str:
    if keep is None:
        return text or ""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return "\n".join(line for i, line in enumerate((text or "").split("\n")) if i >= len(bits) or bits[i])


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep) of every id and text that loses lines; all other documents keep all."""
    session(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [np.asarray(p, np.int64) for p in batch.column(2).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "text_hash": batch.column(1), "n_dropped": pa.array([len(p) for p in lines], pa.int64()),
                                   "keep": pa.array([bitmap(p) for p in lines], pa.binary())})

    sets = dropped_lines(docs, least).groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("pos"))
    return written(sets.mapInArrow(pack, "doc_id long, text_hash long, n_dropped long, keep binary"), "bitmaps")


def with_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, keep) of every row; ``keep`` is null where all lines stay."""
    maps = keep_bitmaps(docs, least).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("h"), "n_dropped", "keep")
    text = F.coalesce("text", F.lit(""))
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(text).alias("text_hash"))
    joined = mine.join(maps, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h")), "left")
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    return joined.select("doc_id", "text", lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep")


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the kept text of ``with_bitmaps`` rows."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keeps = batch.column(1), batch.column(4)
            kept = [hashlib.sha256(kept_lines(texts[i].as_py(), keeps[i].as_py()).encode()).hexdigest() for i in range(batch.num_rows)]
            yield pa.record_batch({"doc_id": batch.column(0), "n_lines": batch.column(2), "n_dropped": batch.column(3), "kept_sha256": pa.array(kept, pa.string())})

    return rows.mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
