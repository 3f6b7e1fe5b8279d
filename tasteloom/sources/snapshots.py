"""Tables as versioned snapshots: immutable folders of Parquet, and a manifest that names those that count.

A change writes new folders first and a manifest last. A manifest is one JSON row in one file, which
the output committer moves into place in one step, so a reader sees the table before the change or
after it, whatever a job leaves behind when it stops. A stopped change is run again as it is; its
folders are named by no manifest. Entries carry a key (a partition value, a tier, a kind of data),
so that one manifest can swap some parts of a table, or move rows between tiers, at once.

One writer at a time changes a table. Two that do so name the same version, which readers and later
writers report as an error instead of losing one of the changes.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Changes whose manifests stay readable; older ones go with their folders in ``vacuum``.
KEPT_VERSIONS = 8
MANIFEST = "version long, schemas array<string>, entries array<struct<key: string, path: string, rows: long, schema: int>>"
ENTRY_KEY = "_entry"
#: What an entry key may consist of, as it names a folder.
KEY_PATTERN = re.compile("[0-9A-Za-z._-]+")


@dataclass(frozen=True)
class Entry:
    key: str
    path: str
    rows: int
    schema: T.StructType


@dataclass(frozen=True)
class Snapshot:
    base: str
    version: int = 0
    entries: tuple[Entry, ...] = ()
    #: The rows' type where no entry is left to tell it.
    schema: T.StructType | None = None

    @property
    def exists(self) -> bool:
        return self.version > 0

    def of(self, keys: Sequence[str]) -> list[Entry]:
        return [e for e in self.entries if e.key in keys]

    def but(self, keys: Sequence[str]) -> list[Entry]:
        return [e for e in self.entries if e.key not in keys]


def _manifests(spark: SparkSession, base: str) -> list[T.Row]:
    try:
        return spark.read.schema(MANIFEST).json(f"{base}/_manifests/*").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def current(spark: SparkSession, base: str, version: int | None = None) -> Snapshot:
    """The newest snapshot, or that of a version; one of version 0 where the table does not exist."""
    rows = [r for r in _manifests(spark, base) if version is None or r.version == version]
    if not rows:
        if version is not None:
            raise FileNotFoundError(f"no version {version} of {base}")
        return Snapshot(base)
    last = max(r.version for r in rows)
    newest = [r for r in rows if r.version == last]
    if len(newest) > 1:
        raise RuntimeError(f"version {last} of {base} was written {len(newest)} times: two writers changed it at once")
    row = newest[0]
    schemas = [T.StructType.fromJson(json.loads(s)) for s in row.schemas]
    return Snapshot(base, last, tuple(Entry(e.key, e.path, e.rows, schemas[e.schema]) for e in row.entries), schemas[0])


def commit(spark: SparkSession, was: Snapshot, entries: Sequence[Entry], schema: T.StructType) -> Snapshot:
    """Name ``entries`` as the table that follows ``was``: one row in one file, written last."""
    version = was.version + 1
    schemas = list(dict.fromkeys([schema.json(), *[e.schema.json() for e in entries]]))
    row = (version, schemas, [(e.key, e.path, e.rows, schemas.index(e.schema.json())) for e in entries])
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.json(f"{was.base}/_manifests/{version:010d}-{uuid.uuid4().hex}")
    return Snapshot(was.base, version, tuple(entries), schema)


def staged(df: DataFrame, base: str, key: str, partition: str | None = None) -> Entry:
    """``df`` as one new folder; it counts once a manifest names it."""
    spark, path = df.sparkSession, f"data/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(f"{base}/{path}")
    return Entry(key, path, spark.read.schema(df.schema).parquet(f"{base}/{path}").count(), df.schema)


def key_text(column: str) -> Column:
    """A partition value as an entry key."""
    return F.coalesce(F.col(column).cast("string"), F.lit("__null__"))


def staged_by(df: DataFrame, base: str, key: Column) -> list[Entry]:
    """``df`` as one new folder for each value of ``key``: short plain texts, as they name folders."""
    spark, path = df.sparkSession, f"data/{uuid.uuid4().hex}"
    marked = df.withColumn(ENTRY_KEY, key)
    # few files for each key, more where a key is large
    marked.hint("rebalance", ENTRY_KEY).write.partitionBy(ENTRY_KEY).parquet(f"{base}/{path}")
    counts = spark.read.schema(marked.schema).parquet(f"{base}/{path}").groupBy(ENTRY_KEY).agg(F.count(F.lit(1)).alias("n")).collect()
    bad = [r[0] for r in counts if r[0] is None or not KEY_PATTERN.fullmatch(r[0])]
    if bad:
        raise ValueError(f"not the name of a folder: {bad[:3]}")
    return [Entry(r[0], f"{path}/{ENTRY_KEY}={r[0]}", r.n, df.schema) for r in sorted(counts)]


def rows_of(spark: SparkSession, snapshot: Snapshot, keys: Sequence[str] | None = None) -> DataFrame:
    """The rows of all entries, or of those with one of ``keys``; entries of other columns are filled with nulls."""
    if not snapshot.exists:
        raise FileNotFoundError(f"no table at {snapshot.base}")
    entries = snapshot.entries if keys is None else snapshot.of(keys)
    kinds = list(dict.fromkeys(e.schema.json() for e in entries))
    if not kinds:
        return spark.createDataFrame([], snapshot.schema)
    frames = []
    for kind in kinds:
        paths = [f"{snapshot.base}/{e.path}" for e in entries if e.schema.json() == kind]
        frames.append(spark.read.schema(T.StructType.fromJson(json.loads(kind))).parquet(*paths))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read(spark: SparkSession, base: str, keys: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
    """The table as its newest manifest names it; a running change does not disturb the frame."""
    return rows_of(spark, current(spark, base, version), keys)


def replace(df: DataFrame, base: str, key: str = "all") -> Snapshot:
    """``df``, which may be read from the table itself, takes the place of all entries with ``key``."""
    was = current(df.sparkSession, base)
    return commit(df.sparkSession, was, [*was.but([key]), staged(df, base, key)], df.schema)


def append(df: DataFrame, base: str, key: str = "all") -> Snapshot:
    was = current(df.sparkSession, base)
    return commit(df.sparkSession, was, [*was.entries, staged(df, base, key)], was.schema or df.schema)


def moved(spark: SparkSession, base: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], source: str, target: str) -> Snapshot:
    """Move rows from tier ``source`` to tier ``target`` in one step.

    ``split`` gives the rows to move and the rows to keep. Both are written aside, then one manifest
    shows them in their new tiers: no row is ever in both tiers or in neither.
    """
    was = current(spark, base)
    out, keep = split(rows_of(spark, was, [source]))
    gone = staged(out, base, target)
    if not gone.rows:
        return was
    stay = staged(keep, base, source)
    if gone.rows + stay.rows != sum(e.rows for e in was.of([source])):
        raise ValueError("the two parts of the split are not all rows of the tier")
    return commit(spark, was, [*was.but([source]), stay, gone], was.schema)


def vacuum(spark: SparkSession, base: str, keep: int = KEPT_VERSIONS) -> int:
    """Delete manifests beyond the newest ``keep``, and the folders that no other manifest names; returns the folders deleted.

    It is a writer's work: a change under way has folders that no manifest names yet.
    """
    rows = _manifests(spark, base)
    last = max((r.version for r in rows), default=0)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def children(folder: str) -> list[str]:
        here = path(f"{base}/{folder}")
        return [s.getPath().getName() for s in files.listStatus(here)] if files.exists(here) else []

    for name in children("_manifests"):
        number = name.split("-")[0]
        if number.isdigit() and int(number) <= last - keep:
            files.delete(path(f"{base}/_manifests/{name}"), True)
    named = {e.path.split("/")[1] for r in rows if r.version > last - keep for e in r.entries}
    gone = [name for name in children("data") if name not in named]
    for name in gone:
        files.delete(path(f"{base}/data/{name}"), True)
    return len(gone)
