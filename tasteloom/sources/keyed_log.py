"""A log that takes each key once, with an index that says which of its buckets a batch must look at.

Rows are stored by a hash bucket of their key. Beside them lies a Bloom index: every key sets a few
bits in one block of 32,768 bits, built and merged by Spark's bitmap aggregates. Keys of a batch
whose bits are not all set are new for certain; only the buckets of the others are read, and there
keys are compared themselves. Rows and index of a batch become visible by one manifest.

Every batch adds one folder of rows and one of blocks. The newest folders are rewritten together with
a batch while they are not twice as large as what follows them, so that a log of n batches
has about log(n) folders and a row is rewritten about log(n) times.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.scale import keep_first
from ..session import scratch
from . import snapshots
from .snapshots import Entry, Snapshot

ROWS, INDEX, BUCKET = "rows", "index", "_bucket"
BUCKETS = 64
#: Bits of a block, bits that a key sets, and the keys of a block beyond which the index gets more blocks (14 bits a key: one new key in a thousand looks held).
BLOCK_BITS, PROBES, KEYS_PER_BLOCK = 32_768, 10, 2_300
FIRST_BLOCKS = 64


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def bucket_of(h: Column | str, buckets: int) -> Column:
    """Independent of the block, which takes the remainder of the hash itself."""
    return F.pmod(F.xxhash64(F.lit("bucket"), h), F.lit(buckets)).cast("int")


def probes(h: str) -> Column:
    """The bits of a key inside its block."""
    return F.expr(f"transform(sequence(0, {PROBES - 1}), i -> pmod((xxhash64({h}) & 4294967295) + i * (shiftrightunsigned(xxhash64({h}), 32) | 1), {BLOCK_BITS}))")


def blocks_of(hashes: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the hashes in column ``h``."""
    bit = hashes.select(F.pmod("h", F.lit(blocks)).alias("block"), F.explode(probes("h")).alias("bit"))
    return bit.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def held_perhaps(hashes: DataFrame, index: DataFrame, blocks: int) -> DataFrame:
    """The hashes all of whose bits are set; a block's bits travel once, whatever the number of its keys."""
    wanted = hashes.groupBy(F.pmod("h", F.lit(blocks)).alias("block")).agg(F.collect_list("h").alias("hs"))
    bits = index.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))
    set_bit = "shiftright(int(conv(hex(substring(bits, int(p div 8) + 1, 1)), 16, 10)), int(p % 8)) & 1 = 1"
    each = wanted.join(bits, "block").select("bits", F.explode("hs").alias("h")).withColumn("probes", probes("h"))
    return each.where(F.expr(f"forall(probes, p -> {set_bit})")).select("h")


def log_rows(spark: SparkSession, log: Snapshot, buckets: Sequence[int] | None = None) -> DataFrame:
    """The stored rows, of some buckets only if given: other buckets' files are not opened."""
    entries = log.of([ROWS])
    if not entries:
        return spark.createDataFrame([], log.schema)

    def one(entry: Entry) -> DataFrame:
        df = spark.read.schema(entry.schema).parquet(f"{log.base}/{entry.path}")
        return df if buckets is None else df.where(F.col(BUCKET).isin([*buckets]))

    return reduce(DataFrame.unionByName, [one(e) for e in entries])


def read(spark: SparkSession, base: str) -> DataFrame:
    log = snapshots.current(spark, base)
    if not log.exists:
        raise FileNotFoundError(f"no log at {base}")
    return log_rows(spark, log).drop(BUCKET)


def _tail(entries: list[Entry], rows: int) -> list[Entry]:
    """The newest entries that are rewritten with a batch of ``rows``."""
    tail: list[Entry] = []
    for entry in reversed(entries):
        if entry.rows > 2 * rows:
            break
        tail.append(entry)
        rows += entry.rows
    return tail


def absent(spark: SparkSession, log: Snapshot, batch: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Rows of ``batch``, a written table with its key hash in ``h``, whose key the log does not hold."""
    if not log.of([ROWS]):
        return batch
    index = log.of([INDEX])
    # every index entry has the number of blocks in its key's column
    blocks = snapshots.rows_of(spark, log, [INDEX]).agg(F.max("blocks")).first()[0] if index else None
    if not blocks:
        return batch
    perhaps = held_perhaps(batch.select("h").distinct(), snapshots.rows_of(spark, log, [INDEX]), blocks)
    path = scratch(spark, "perhaps")
    perhaps.write.parquet(path)
    perhaps = spark.read.schema("h long").parquet(path)
    # at most one number for each bucket
    near = [r[0] for r in perhaps.select(bucket_of("h", buckets)).distinct().collect()]
    if not near:
        return batch
    held = log_rows(spark, log, near).select(*[F.col(k).alias(f"_held_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in keys])
    known = batch.join(perhaps, "h", "left_semi").join(held, same, "left_semi").select(F.col("h").alias("_known"), *[F.col(k).alias(f"_held_{k}") for k in keys])
    return batch.join(known, (F.col("h") == F.col("_known")) & same, "left_anti")


def insert(spark: SparkSession, base: str, rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = (), buckets: int = BUCKETS) -> Snapshot:
    """Add the rows whose key the log does not hold, one for each key: the first by ``order``, then by the digest of the whole row.

    A null in a key equals a null. A batch that comes again, whole or in part, adds nothing.
    """
    log = snapshots.current(spark, base)
    digest = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    first = keep_first(rows.withColumn("_digest", digest), list(keys), [*order, "_digest"]).drop("_digest")
    path = scratch(spark, "batch")
    first.withColumn("h", key_hash(keys)).write.parquet(path)
    batch = spark.read.schema(first.schema.add("h", "long")).parquet(path)
    path = scratch(spark, "fresh")
    absent(spark, log, batch, keys, buckets).write.parquet(path)
    fresh = spark.read.schema(batch.schema).parquet(path)
    count = fresh.count()
    if not count:
        return log if log.exists else snapshots.commit(spark, log, [], rows.schema)
    held = log.of([ROWS])
    tail = _tail(held, count)
    marked = fresh.withColumn(BUCKET, bucket_of("h", buckets))
    new = marked.drop("h")
    if tail:
        older = log_rows(spark, Snapshot(base, log.version, tuple(tail), log.schema))
        new = older.unionByName(new.select(*older.columns))
    stored = snapshots.staged(new.repartition(BUCKET), base, ROWS, BUCKET)
    kept = [e for e in held if e not in tail]
    return snapshots.commit(spark, log, [*kept, stored, *_indexed(spark, log, fresh, keys, sum(e.rows for e in kept) + stored.rows)], rows.schema)


def _indexed(spark: SparkSession, log: Snapshot, fresh: DataFrame, keys: Sequence[str], total: int) -> list[Entry]:
    """Index entries with the new keys: one more, merged with the newest ones, or all anew with more blocks."""
    held = log.of([INDEX])
    blocks = snapshots.rows_of(spark, log, [INDEX]).agg(F.max("blocks")).first()[0] if held else FIRST_BLOCKS
    if total > blocks * KEYS_PER_BLOCK or not held:
        while total > blocks * KEYS_PER_BLOCK // 2:
            blocks *= 4
        hashes = fresh.select("h")
        if log.of([ROWS]):
            hashes = hashes.union(log_rows(spark, log).select(key_hash(keys).alias("h")))
        return [snapshots.staged(blocks_of(hashes, blocks).withColumn("blocks", F.lit(blocks)), log.base, INDEX)]
    new = blocks_of(fresh.select("h"), blocks).withColumn("blocks", F.lit(blocks))
    touched = new.count()
    tail = _tail(held, touched)
    if tail:
        older = snapshots.rows_of(spark, Snapshot(log.base, log.version, tuple(tail), log.schema))
        new = older.unionByName(new).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"), F.max("blocks").alias("blocks"))
    return [*[e for e in held if e not in tail], snapshots.staged(new.select("block", "bits", "blocks"), log.base, INDEX)]
