"""Work bounded by volume, closures that say when they are cut, and reports over every sample and stage."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasteloom.operators import drift as dr
from tasteloom.operators import lineage as ln
from tasteloom.operators import monitoring as mo
from tasteloom.operators import quality as q
from tasteloom.operators import scale

RNG = np.random.default_rng(5)


def samples(spark, rows):
    """(event_id, micros, instance, value) as metric samples."""
    df = spark.createDataFrame(rows, "event_id long, us long, instance long, value double")
    return df.select("event_id", F.timestamp_micros("us").alias("ts"), F.lit("m").alias("metric"), "instance", "value")


@pytest.fixture(scope="module")
def hot():
    """One series with nine tenths of the samples, most of them in one hour, with resets, nulls and ties."""
    rows = []
    for i in range(3000):
        one = RNG.random() < 0.9
        second = int(RNG.integers(7200, 7500)) if one and RNG.random() < 0.8 else int(RNG.integers(0, 200_000))
        rows.append((i, second * 1_000_000 + int(RNG.integers(0, 3)) * 1000, 0 if one else 1, None if RNG.random() < 0.05 else float(RNG.integers(0, 50))))
    return rows


def test_counter_rate_in_small_segments(spark, hot):
    want: dict = {}
    for series in (0, 1):
        before = None
        for n, (_, us, _, v) in enumerate(sorted((r for r in hot if r[2] == series), key=lambda r: (r[1], r[0]))):
            slot = us // 1_000_000 // 900
            rise = 0.0 if n == 0 or before is None else None if v is None else v if v < before else v - before
            old = want.get((series, slot))
            want[(series, slot)] = old if rise is None else rise if old is None else old + rise
            before = v
    for rows in (7, 100_000):
        got = {(r.instance, r.slot): r.increase for r in mo.counter_rate(samples(spark, hot), 900, segment_rows=rows).collect()}
        assert got == want


def test_segments_are_bounded_by_rows(spark, hot):
    df = samples(spark, hot).withColumn("k", F.lit("all"))
    cut = scale.volume_segments(df, ["k"], F.unix_timestamp("ts"), 50, "s")
    assert cut.count() == len(hot)
    per_second = df.groupBy(F.unix_timestamp("ts").alias("t")).count().agg(F.max("count")).first()[0]
    sizes = cut.groupBy("s").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("s").collect()
    assert max(r.n for r in sizes) <= 50 + per_second and len(sizes) >= len(hot) // (50 + per_second)
    assert all(x.b <= y.a for x, y in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("window", [0, 1, 37, 3600])
def test_trailing_mean_against_all_frames(spark, hot, window):
    got = {r.event_id: r.avg_value for r in mo.avg_over_time(samples(spark, hot), window).collect()}
    assert len(got) == len(hot)
    for series in (0, 1):
        rows = [(us // 1_000_000, i, v) for i, us, s, v in hot if s == series]
        t = np.array([r[0] for r in rows])
        v = np.array([np.nan if r[2] is None else r[2] for r in rows])
        for second, i, _ in rows:
            frame = v[(t >= second - window) & (t <= second)]
            frame = frame[~np.isnan(frame)]
            assert (got[i] is None) == (len(frame) == 0)
            assert got[i] is None or got[i] == pytest.approx(frame.mean(), abs=1e-9)


def test_rates_of_empty_samples(spark):
    empty = samples(spark, [])
    assert mo.counter_rate(empty, 60).count() == 0 and mo.avg_over_time(empty, 60).count() == 0


def chain(spark, n):
    return spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(n)], "source string, target string")


def test_long_chain_by_doubling(spark):
    edges, root = chain(spark, 40), spark.createDataFrame([("n0",)], "name string")
    whole = ln.upstream(edges, root, None)
    assert sorted((r.depth, r.source, r.truncated) for r in whole.collect()) == sorted((i + 1, f"n{i + 1}", False) for i in range(40))
    rounds = max(Path(ln.scratch(spark, "x")).parents[1].glob("*/distances"), key=lambda p: p.stat().st_mtime)
    assert len(list(rounds.iterdir())) <= 8
    cut = ln.upstream(edges, root, 7).collect()
    assert sorted(r.depth for r in cut) == list(range(1, 8)) and all(r.truncated for r in cut)
    exact = ln.upstream(edges, root, 40).collect()
    assert len(exact) == 40 and not any(r.truncated for r in exact)


def test_closure_of_cycles_diamonds_and_strangers(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("b", "d"), ("d", "d"), (None, "a"), ("a", None), ("a", "b")], "source string, target string")
    roots = spark.createDataFrame([("d",), ("d",), ("nowhere",), (None,)], "name string")
    for bound in (None, 10):
        got = sorted((r.root, r.source, r.target, r.depth, r.truncated) for r in ln.upstream(edges, roots, bound).collect())
        assert got == [("d", "a", "b", 2, False), ("d", "a", "d", 1, False), ("d", "b", "c", 3, False), ("d", "b", "d", 1, False), ("d", "c", "a", 2, False), ("d", "d", "d", 1, False)]


def test_recorded_edges(spark, tmp_path):
    edges = spark.createDataFrame([("raw", "clean", "filter")], "source string, target string, transform_type string")
    for operation, tags in (("drop nulls", {"rows": "5"}), ("drop nulls", None)):
        ln.record(edges, str(tmp_path / "log"), operation, tags, "2024-01-31 10:00:00")
    rows = ln.recorded(spark, str(tmp_path / "log")).collect()
    assert sorted((r.target, r.operation, sorted(r.metadata.items())) for r in rows) == [("clean", "drop nulls", []), ("clean", "drop nulls", [("rows", "5")])]
    assert ln.direct_lineage(ln.recorded(spark, str(tmp_path / "log")), "clean").count() == 2


def test_snapshot_counts_nulls_by_column_and_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (None, None), (3, "x")], "a long, b string")
    row = ln.snapshot(df, "d", "v").first()
    assert (row.null_cells, row.null_counts) == (3, "a:1,b:2")
    df.repartition(2).write.parquet(str(tmp_path / "t"))
    size = ln.stored_size(spark.read.parquet(str(tmp_path / "t")), "d").first()
    files = [p for p in (tmp_path / "t").iterdir() if p.suffix == ".parquet"]
    assert (size.byte_size, size.files) == (sum(p.stat().st_size for p in files), len(files))


def test_too_few_values_in_either_sample(spark):
    many = spark.createDataFrame([(float(i), float(i) if i < 9 else None) for i in range(40)], "x double, y double")
    few = spark.createDataFrame([(float(i), float(i)) for i in range(12)], "x double, y double")
    for a, b in ((many, few), (few, many)):
        counts = dr.sample_counts(a, b, ["x", "y"])
        assert [r.feature for r in dr.feature_drift(counts).collect()] == ["x"]
        assert [r.feature for r in dr.ks(counts).collect()] == ["x"]
        assert sorted((r.feature, r["sample"]) for r in dr.summary_pair(a, b, ["x", "y"]).collect()) == [("x", "baseline"), ("x", "current")]
        assert [r.feature for r in dr.report(a, b, ["x", "y"]).collect()] == ["x", "overall"]


def test_stage_without_a_frame_fails(spark):
    df = spark.createDataFrame([(1,)], "a int")
    rows = {(r.dataset, r["check"]): r.status for r in q.stage_suites({"raw": {"t": ["a"], "gone": ["a"]}, "training": {}}, {"raw": {"t": df}}).collect()}
    assert rows == {("raw.t", "ordered_columns"): q.PASSED, ("raw.t", "row_count"): q.PASSED,
                    ("raw.gone", "ordered_columns"): q.FAILED, ("raw.gone", "row_count"): q.FAILED}


def test_feature_report_joins_the_ratings_once(spark):
    """Every check reads one written table of ratings; the join of lines and orders is in no plan of the report."""
    import __spark_entry__ as entry

    report = entry.queries()["v17_feature_report"](spark, "/root/testdata/sf0.001")
    assert "o_custkey" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert report.count() == 8


def test_closure_of_many_roots_below_one_node(spark, monkeypatch):
    """300 orders of 30 customers of one nation: the tasks of a closure grow in number with its edges."""
    monkeypatch.setattr(ln, "EDGES_A_TASK", 20)
    rows = [(f"c{i % 30}", f"o{i}") for i in range(300)] + [("n", f"c{i}") for i in range(30)] + [("r", "n")]
    edges = spark.createDataFrame(rows, "source string, target string")
    roots = spark.createDataFrame([(f"o{i}",) for i in range(300)], "name string")
    for bound, truncated in ((5, False), (2, True)):
        found = ln.upstream(edges, roots, bound)
        want = sorted((f"o{i}", *e, truncated) for i in range(300) for e in ((f"c{i % 30}", f"o{i}", 1), ("n", f"c{i % 30}", 2), ("r", "n", 3)) if e[2] <= bound)
        assert sorted(map(tuple, found.collect())) == want
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 8
