from pyspark.sql import functions as F

from tasteloom.functions import expr
from tasteloom.operators import lineage
from tasteloom.sources import sinks, snapshots


def test_shifted_nulls_differ(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None), (None, "a", "b")], "x string, y string, z string")
    cols = ["x", "y", "z"]
    got = df.select(expr.stable_id(*cols).alias("i"), expr.digest_order(cols).alias("d")).collect()
    assert len({r.i for r in got}) == len({r.d for r in got}) == 3
    prints = [df.limit(0).union(spark.createDataFrame([row], df.schema)).agg(lineage.fingerprint(df).alias("f")).first().f
              for row in [("a", None, "b"), ("a", "b", None)]]
    assert prints[0] != prints[1]


def test_marks_inside_values_differ(spark):
    rows = [("a|b", "c", "d"), ("a", "b|c", "d"), ("a", "b", "c|d"), ("a\\", "b|c", "d"), ("a\\|b", "c", "d")]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    got = df.select(expr.stable_id("x", "y", "z").alias("i"), expr.digest_order(["x", "y", "z"]).alias("d")).collect()
    assert len({r.i for r in got}) == len({r.d for r in got}) == len(rows)


def test_archive_in_place_and_again(spark, tmp_path):
    base = str(tmp_path / "table")
    snapshots.replace(spark.range(100).withColumnRenamed("id", "k"), base, "hot")
    for _ in range(2):
        sinks.archive(spark, base, lambda df: (df.where("k < 30"), df.where("k >= 30")))
        hot = snapshots.read(spark, base, ["hot"])
        assert (snapshots.read(spark, base, ["archive"]).count(), hot.agg(F.min("k")).first()[0], hot.count()) == (30, 30, 70)


def test_a_window_ends_with_its_date(spark):
    from tasteloom.operators.relational import since

    times = ["2024-01-12 23:59:59", "2024-01-13 00:00:00", "2024-01-20 23:59:59", "2024-01-21 00:00:00", None]
    rows = spark.createDataFrame([(t,) for t in times], "t string").selectExpr("cast(t as timestamp_ntz) AS at", "t")
    assert [r.t for r in since(rows, "at", "2024-01-20", 7).orderBy("t").collect()] == times[1:3]
