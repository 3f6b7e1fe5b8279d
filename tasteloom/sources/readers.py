"""Sources: delimited and columnar files, listings, version lookup and SQL tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import snapshots

CORRUPT = "_corrupt_record"
VERSION = "data_version"


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "::", encoding: str = "iso-8859-1") -> DataFrame:
    """Headerless delimited files under a declared schema; a broken line keeps its text in ``_corrupt_record``."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("sep", sep).option("encoding", encoding).option("header", "false")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """``(path, name, length, modificationTime)`` of the files below ``path``.

    The content column is pruned, so no file is opened for its bytes.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    )
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")


def missing_files(manifest: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected names that the manifest does not hold."""
    spark = manifest.sparkSession
    wanted = spark.createDataFrame([(n,) for n in expected], "name string")
    return wanted.join(manifest.select("name").distinct(), "name", "left_anti")


def versions(spark: SparkSession, base: str) -> DataFrame:
    """``(data_version, files, bytes, newest)`` per version that the manifest names, from the listing alone."""
    entries = snapshots.current(spark, base).entries
    named = spark.createDataFrame([(e.key, e.path) for e in entries], f"{VERSION} string, folder string")
    listed = list_files(spark, f"{base}/data", "*.parquet") if entries else spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    files = listed.withColumn("folder", F.regexp_extract("path", "/(data/[0-9a-f]{32})/", 1))
    return files.join(F.broadcast(named), "folder").groupBy(VERSION).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest")
    )


def latest_version(spark: SparkSession, base: str, policy: str = "name") -> str | None:
    """One version string: the largest name (default), the most bytes, or the newest file."""
    order = {"name": [VERSION], "bytes": ["bytes", VERSION], "modified": ["newest", VERSION]}[policy]
    row = versions(spark, base).orderBy(*[F.desc(c) for c in order]).select(VERSION).first()
    return row[0] if row else None


def read_version(spark: SparkSession, base: str, version: str | None = None) -> DataFrame:
    """All parts of one version; the latest by name when none is given."""
    table = snapshots.current(spark, base)
    version = version or max((e.key for e in table.entries), default=None)
    if version is None or not table.of([version]):
        raise FileNotFoundError(f"no version {version or ''} below {base}")
    return snapshots.rows_of(spark, table, [version])


def read_all_versions(spark: SparkSession, base: str) -> DataFrame:
    """The rows of every version, with its name in ``data_version``."""
    table = snapshots.current(spark, base)
    if not table.entries:
        raise FileNotFoundError(f"no version below {base}")
    parts = [snapshots.rows_of(spark, table, [e.key]).withColumn(VERSION, F.lit(e.key)) for e in table.entries]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_or_raw(spark: SparkSession, base: str, raw: str, schema: T.StructType) -> DataFrame:
    """The latest version, or the raw delimited files where no version exists."""
    if snapshots.current(spark, base).entries:
        return read_version(spark, base)
    return read_delimited(spark, raw, schema).drop(CORRUPT)


def read_sql(spark: SparkSession, tables: dict[str, DataFrame], statement: str) -> DataFrame:
    """Run a SQL statement over named frames."""
    return spark.sql(statement, **tables)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of ``column``."""
    return (
        spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts, **options).load()
    )
