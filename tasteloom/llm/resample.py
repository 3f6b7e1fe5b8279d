"""Importance resampling of documents towards a target distribution.

Words of all documents and of all target texts are counted in hashed buckets, and every bucket
gets a gain, the scaled logarithm of how much likelier it is in the target. The gains are one array
that tasks index with the buckets of a whole batch of texts. A document's weight is the floored
mean gain of its words; its score adds Gumbel noise from a hash of its id, so that the highest
scores are a sample without replacement in proportion to the weights.

The cutoff is found without sorting all scores: a quantile sketch brackets it, exact counts of the
rows above and inside prove that the bracket holds it or have it widened, and only the bracket is
sorted to locate it. Rows above the bracket are drawn whatever their order; they are sorted by a
range exchange of their own to be numbered.

Defined results: a null or empty text has no words, weight 0, and is never drawn unless
``least_words`` is 0. A null id is hashed as the empty text and comes last among ties. Rows that
repeat an id or a text are rows of their own; where score and id tie, they are numbered by words,
weight and input split, and such rows cannot be told apart. Empty tables give no rows, an empty
target gives gains against the smoothed uniform distribution. Further columns are not read. Texts
are taken in slices of some megabytes, so one long text costs its own length.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import session, written

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 10, 20, 2024
#: Width of the first bracket on either side, as a share of the rows; it affects speed only.
SLACK = 0.005
#: Bytes of text that are hashed at once, and the longest word that is hashed with the others.
SLICE, WIDE = 1 << 21, 40


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()
#: Lower-cased byte of a word, or 0: ASCII letters, digits and every byte beyond ASCII make words.
WORD_BYTE = np.zeros(256, np.uint8)
WORD_BYTE[48:58] = np.arange(48, 58)
WORD_BYTE[97:123] = WORD_BYTE[65:91] = np.arange(97, 123)
WORD_BYTE[128:] = np.arange(128, 256)


def crc32_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The crc32 of every slice of ``data``: byte k of all slices at once, long slices one by one."""
    short = np.minimum(sizes, WIDE + 1).astype(np.uint8)
    order = np.argsort(short, kind="stable")[::-1]
    at, left = starts[order], short[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    reach = len(left) - np.searchsorted(left[::-1], np.arange(1, WIDE + 1), "left")
    for k, n in enumerate(reach):
        if not n:
            break
        now = crc[:n]
        crc[:n] = CRC[(now ^ data[at[:n] + k]) & 0xFF] ^ (now >> 8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in np.flatnonzero(sizes > WIDE):
        out[i] = zlib.crc32(data[starts[i]:starts[i] + sizes[i]].tobytes())
    return out


def word_buckets(texts: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row of every word, its bucket) for slices of whole rows."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1
        end = min(max(end, first + 1), len(texts))
        data = WORD_BYTE[raw[offsets[first]:offsets[end]]]
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = data != 0
        breaks = offsets[first:end] - offsets[first]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        opens[breaks] = inside[breaks]
        starts = np.flatnonzero(opens)
        # a word ends where the next one opens or where no word is
        gaps = np.flatnonzero(opens | ~inside)
        sizes = gaps[np.searchsorted(gaps, starts, "right")] - starts
        rows = np.searchsorted(breaks, starts, "right") - 1
        yield first, end, rows, (crc32_of(data, starts, sizes) % np.uint32(buckets)).astype(np.int64)
        first = end


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Words of column ``text`` by bucket: one partial array per task, summed by bucket; ``buckets`` numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, bucket in word_buckets(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(held), "n": pa.array(total[held])})

    out = np.zeros(buckets, np.int64)
    parts = texts.select("text").mapInArrow(count, "bucket long, n long")
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    size, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (all_source + size)) / float((s + 1) * (all_target + size))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(seed: int, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and the input split of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = TaskContext.get().partitionId()
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, end, rows, bucket in word_buckets(batch.column(1), len(gains)):
                n[first:end] = np.bincount(rows, minlength=end - first)
                total[first:end] = np.bincount(rows, gains[bucket], end - first)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            noise = np.array([gumbel(seed, i) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.record_batch({"doc_id": batch.column(0), "n_features": n, "weight": weight, "score": weight + noise,
                                   "split": np.full(batch.num_rows, split, np.int64)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        score, "doc_id long, n_features long, weight long, score long, split long")


def bracketed(rows: DataFrame, wanted: int, total: int, slack: float = SLACK) -> tuple[int | None, int | None, int]:
    """(low, high, rows above high): an interval of scores proven to hold the ``wanted``-th highest; None is open."""
    share = 1 - wanted / total
    while True:
        low, high = share - slack, share + slack
        cuts = rows.agg(F.percentile_approx("score", [min(max(low, 0.0), 1.0), min(max(high, 0.0), 1.0)], 20_000)).first()[0]
        low, high = cuts[0] if low > 0 else None, cuts[1] if high < 1 else None
        above = F.col("score") > (F.lit(high) if high is not None else F.lit(None).cast("long"))
        inside = ~F.coalesce(above, F.lit(False)) & (F.lit(True) if low is None else F.col("score") >= low)
        seen = rows.agg(F.count_if(above).alias("above"), F.count_if(inside).alias("inside")).first()
        if seen.above < wanted <= seen.above + seen.inside:
            return low, high, seen.above
        slack *= 4


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``place`` 1, 2, 3... from the highest score: a range exchange, and one offset per range.

    The exchange cuts at score, id and input split together, so no score or id needs to fit in one task.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "split"]
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = written(rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
                   .withColumns({"piece": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)
    ends = {r.piece: (r.n, r.at) for r in held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")).collect()}
    before, offsets = 0, []
    for piece, (n, at) in sorted(ends.items()):
        offsets.append((piece, before - at + 1))
        before += n
    # one row per range of the exchange
    shift = rows.sparkSession.createDataFrame(offsets, "piece int, shift long")
    return held.join(F.broadcast(shift), "piece").withColumn("place", F.col("at") + F.col("shift")).drop("piece", "at", "shift")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
              seed: int = SEED, slack: float = SLACK) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; the drawn ``percent`` of rows are ranked from 1, the others null."""
    session(docs.sparkSession)
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = written(scored(docs, gains, seed), "scored")
    able = F.col("n_features") >= least_words
    total = rows.where(able).count()
    wanted = percent * total // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return rows.select(*columns, unranked)
    low, high, n_above = bracketed(rows.where(able), wanted, total, slack)
    above = able & (F.col("score") > high) if high is not None else F.lit(False)
    inside = able & ~above & (F.col("score") >= low if low is not None else F.lit(True))
    cut = F.col("place") + n_above
    bracket = numbered(rows.where(inside), "bracket").select(*columns, F.when(cut <= wanted, cut).alias("rank"))
    rest = rows.where(~above & ~inside).select(*columns, unranked)
    if n_above:
        rest = rest.unionByName(numbered(rows.where(above), "above").select(*columns, F.col("place").alias("rank")))
    return rest.unionByName(bracket)
