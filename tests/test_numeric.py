"""Numeric operators against numpy on random data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasteloom.functions import tails
from tasteloom.operators import drift as dr
from tasteloom.operators import experiments as ex
from tasteloom.operators import factorize as fz
from tasteloom.operators import monitoring as mo
from tasteloom.operators import recommend as rc
from tasteloom.operators import scale

RNG = np.random.default_rng(7)


def frame(spark, x, name="x"):
    return spark.createDataFrame([(float(v),) for v in x], f"{name} double")


def numpy_psi(b, c, bins=10):
    points = np.unique(np.percentile(b, np.linspace(0, 100, bins + 1)))
    if len(points) < 2:
        return 0.0
    hb, hc = np.histogram(b, points)[0], np.histogram(c, points)[0]
    eps = 1e-6
    pb, pc = (hb + eps) / (hb.sum() + eps * len(hb)), (hc + eps) / (hc.sum() + eps * len(hc))
    return float(np.sum((pc - pb) * np.log(pc / pb)))


def numpy_ks(b, c):
    at = np.concatenate([b, c])
    return float(np.max(np.abs(np.searchsorted(np.sort(b), at, "right") / len(b) - np.searchsorted(np.sort(c), at, "right") / len(c))))


@pytest.mark.parametrize("b,c", [
    (RNG.normal(size=400), RNG.normal(0.3, 1.2, size=300)),
    (RNG.integers(0, 5, size=300).astype(float), RNG.integers(0, 7, size=200).astype(float)),
    (np.ones(50), RNG.normal(size=50)),
    (RNG.normal(size=200), RNG.normal(50, 1, size=100)),
])
def test_psi_and_ks(spark, b, c):
    row = dr.feature_drift(dr.sample_counts(frame(spark, b), frame(spark, c), ["x"])).first()
    assert math.isclose(row.psi, numpy_psi(b, c), abs_tol=1e-9)
    assert math.isclose(row.statistic, numpy_ks(b, c), abs_tol=1e-12)


def test_identical_samples_do_not_drift(spark):
    x = RNG.normal(size=200)
    rows = {r.feature: r for r in dr.report(frame(spark, x), frame(spark, x), ["x"]).collect()}
    assert rows["x"].psi == 0 and rows["x"].p_value == 1 and rows["overall"].severity == "none"


def test_severity_bounds(spark):
    df = spark.createDataFrame([(0.10,), (0.15,), (0.20,), (0.25,), (0.30,)], "s double").select(dr.severity(F.col("s")).alias("v"))
    assert [r.v for r in df.collect()] == ["none", "warning", "warning", "critical", "critical"]


def test_exact_quantiles_with_hot_value_and_many_pieces(spark):
    x = np.concatenate([np.full(3000, 5.0), RNG.exponential(10, 6000)])
    df = frame(spark, x).withColumn("k", F.lit("a"))
    vc = scale.value_counts(df, ["k"], "x", {"n": F.count(F.lit(1))})
    rt = scale.running_totals(vc, ["k"], "x", ["n"], pieces=16, sample=500)
    probs = [0.0, 0.1, 0.5, 0.95, 0.999, 1.0]
    got = rt.groupBy("k").agg(*[c.alias(f"q{i}") for i, c in enumerate(scale.quantile_columns("x", "n", probs))]).first()
    assert np.allclose([got[f"q{i}"] for i in range(len(probs))], np.quantile(x, probs), rtol=1e-12)


def test_running_totals_do_not_depend_on_partitioning(spark):
    df = frame(spark, RNG.normal(size=2000)).withColumn("k", F.lit(1))
    rows = [
        sorted(map(tuple, scale.running_totals(scale.value_counts(d, ["k"], "x", {"n": F.count(F.lit(1))}), ["k"], "x", ["n"], pieces=8, sample=100).collect()))
        for d in (df, df.repartition(13))
    ]
    assert rows[0] == rows[1]
    assert [r[3] for r in sorted(rows[0], key=lambda r: r[1])] == list(range(1, 2001))


def test_chunked_previous_and_running_sum(spark):
    ts = np.sort(RNG.choice(5000, size=400, replace=False))
    rows = [(int(k), int(t), float(i)) for i, (t, k) in enumerate(zip(ts, RNG.integers(0, 2, size=400)))]
    df = spark.createDataFrame(rows, "k long, t long, v double").withColumn("c", F.floor(F.col("t") / 300))
    prev = {(r.k, r.t): r.prev_v for r in scale.chunked_previous(df, ["k"], ["t"], "c", ["v"]).collect()}
    run = {(r.k, r.t): r.s for r in scale.chunked_running_sum(df, ["k"], ["t"], "c", "v", "s").collect()}
    for key in (0, 1):
        last, total = None, 0.0
        for k, t, v in rows:
            if k == key:
                total += v
                assert prev[(k, t)] == last and run[(k, t)] == total
                last = v


def test_counter_resets_and_average_across_chunks(spark):
    rows = [(0, 0, 10.0), (1, 60, 15.0), (2, 120, 3.0), (3, 86400 + 30, 7.0)]
    df = spark.createDataFrame(rows, "event_id long, s long, value double").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), F.lit("m").alias("metric"), F.lit(0).alias("instance"), "value")
    assert {r.slot: r.increase for r in mo.counter_rate(df, 86400).collect()} == {0: 8.0, 1: 4.0}
    wide = mo.avg_over_time(df, 86400, chunk_seconds=86400)
    assert {r.event_id: r.avg_value for r in wide.collect()} == {0: 10.0, 1: 12.5, 2: 28 / 3, 3: 25 / 3}
    with pytest.raises(ValueError):
        mo.avg_over_time(df, 100, chunk_seconds=50)


def test_alert_holds_and_gap_ends_it(spark):
    pts = [(t, v) for t, v in [(0, 1.0), (60, 1.0), (120, 1.0), (180, 0.0), (240, 1.0), (300, 1.0), (900, 1.0), (960, 1.0), (1020, 1.0)]]
    df = spark.createDataFrame([("m", 0, t, v) for t, v in pts], "metric string, instance int, t long, value double")
    got = sorted((r.started, r.last_seen) for r in mo.held_alerts(df, F.col("value") > 0.5, 60, 120).collect())
    assert got == [(0, 120), (900, 1020)]


def test_histogram_quantile(spark):
    b = spark.createDataFrame([("s", 1.0, 10), ("s", 2.0, 30), ("s", float("inf"), 40), ("t", 1.0, 0), ("t", float("inf"), 5)], "s string, le double, count long")
    assert {r.s: r.quantile for r in mo.histogram_quantile(b, 0.5, ["s"]).collect()} == {"s": 1.5, "t": 1.0}
    assert {r.s: r.quantile for r in mo.histogram_quantile(b, 0.9, ["s"]).collect()}["s"] == 2.0


def test_tail_probabilities():
    assert math.isclose(tails.student_two_sided(2.0, 10), 0.07338803477074048, rel_tol=1e-9)
    x = 0.5 / math.sqrt(3)  # closed form for three degrees of freedom
    assert math.isclose(tails.student_two_sided(-0.5, 3), 1 - 2 / math.pi * (x / (1 + x * x) + math.atan(x)), rel_tol=1e-9)
    assert math.isclose(tails.chi_square_upper(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(tails.chi_square_upper(2.0, 4), 0.7357588823428847, rel_tol=1e-9)


def test_ks_p_value(spark):
    p = spark.range(1).select(tails.ks_p_value(F.lit(0.1358), F.lit(200), F.lit(200)).alias("p")).first().p
    assert math.isclose(p, 0.05, abs_tol=0.002)


def test_paired_t_and_z(spark):
    c, b = RNG.normal(size=200), RNG.normal(0, 1.3, size=200)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(c, b)], "c double, b double")
    d = c**2 - b**2
    row = ex.with_p_value(ex.paired_t(df, F.col("c"), F.col("b"))).first()
    t = d.mean() / (d.std(ddof=1) / math.sqrt(len(d)))
    assert math.isclose(row.t, t, rel_tol=1e-9) and math.isclose(row.p_value, tails.student_two_sided(t, 199), rel_tol=1e-9)
    arms = spark.createDataFrame([("a", 1000, 100), ("b", 1200, 150)], "arm string, n long, x long")
    pooled = 250 / 2200
    z = (150 / 1200 - 100 / 1000) / math.sqrt(pooled * (1 - pooled) * (1 / 1000 + 1 / 1200))
    assert math.isclose(ex.ctr_z_test(arms, "a", "b").first().z, z, rel_tol=1e-12)
    none = spark.createDataFrame([("a", 10, 0), ("b", 10, 0)], "arm string, n long, x long")
    assert ex.ctr_z_test(none, "a", "b").first().z == 0


def low_rank(n=30, m=20, k=3, keep=0.5):
    dense = RNG.gamma(1, 1, (n, k)) @ RNG.gamma(1, 1, (k, m))
    return np.where(RNG.random((n, m)) < keep, dense, 0.0)


def cells_of(spark, v):
    return spark.createDataFrame([(int(i), int(j), float(v[i, j])) for i, j in zip(*np.nonzero(v))], "UserID long, MovieID long, value double")


def test_nmf_error_falls_and_matches_the_dense_error(spark):
    v = low_rank()
    v = v[np.any(v > 0, axis=1)][:, np.any(v > 0, axis=0)]
    cells = cells_of(spark, v)
    errors = []
    for iterations in (1, 6):
        f = fz.fit_nmf(spark, cells, k=3, iterations=iterations)
        row = fz.reconstruction_error(cells, f.users, f.items, 3).first()
        w = np.array([r[1:] for r in sorted(map(tuple, f.users.collect()))])
        h = np.array([r[1:] for r in sorted(map(tuple, f.items.collect()))])
        dense = v - w @ h.T
        assert (w >= 0).all() and (h >= 0).all()
        assert math.isclose(row.reconstruction_rmse, math.sqrt((dense**2).mean()), rel_tol=1e-9)
        assert math.isclose(row.reconstruction_mae, np.abs(dense).mean(), rel_tol=1e-9)
        assert math.isclose(row.sparsity, 1 - (v > 0).mean(), rel_tol=1e-12)
        errors.append(row.reconstruction_rmse)
        assert math.isclose(f.errors[-1], math.sqrt((dense**2).sum()), rel_tol=1e-6)
    assert errors[1] < errors[0] and all(a >= b - 1e-9 for a, b in zip(f.errors, f.errors[1:]))
    folded = fz.fold_in(cells, f)
    again = fz.reconstruction_error(cells, folded, f.items, 3).first()
    assert again.reconstruction_rmse <= errors[1] + 1e-6


def test_reconstruction_error_of_more_cells_than_an_integer_counts(spark):
    """50,000 users and items: 2.5 billion cells, of which three are seen."""
    ids = spark.range(50_000).withColumn("f0", F.lit(0.0))
    cells = spark.createDataFrame([(1, 2, 3.0), (4, 5, 4.0), (6, 6, 5.0)], "UserID long, MovieID long, value double")
    row = fz.reconstruction_error(cells, ids.withColumnRenamed("id", "UserID"), ids.withColumnRenamed("id", "MovieID"), 1).first()
    assert (row.n_users, row.n_items) == (50_000, 50_000)
    assert math.isclose(row.reconstruction_rmse, math.sqrt(50 / 2.5e9)) and math.isclose(row.reconstruction_mae, 12 / 2.5e9)
    assert math.isclose(row.sparsity, 1 - 3 / 2.5e9, rel_tol=1e-15)


def test_nmf_with_a_hot_user(spark):
    v = np.zeros((40, 60))
    v[0, :] = 4.0
    v[np.arange(40), np.arange(40)] = 5.0
    f = fz.fit_nmf(spark, cells_of(spark, v), k=2, iterations=4)
    assert f.users.count() == 40 and f.items.count() == 60
    hot = fz.score_pairs(spark.createDataFrame([(0, 50)], "UserID long, MovieID long"), f.users, f.items, 2).first()
    assert abs(hot.prediction - 4.0) < 0.5


def test_top_k_against_brute_force(spark):
    u, i = RNG.random((25, 4)), RNG.integers(0, 3, (40, 4)) / 2.0  # repeated item rows give ties
    users = spark.createDataFrame([(n, *map(float, r)) for n, r in enumerate(u)], "UserID long, f0 double, f1 double, f2 double, f3 double")
    items = spark.createDataFrame([(n, *map(float, r)) for n, r in enumerate(i)], "MovieID long, f0 double, f1 double, f2 double, f3 double")
    seen_pairs = {(int(a), int(b)) for a, b in zip(RNG.integers(0, 25, 200), RNG.integers(0, 40, 200))} | {(3, b) for b in range(38)}
    seen = spark.createDataFrame(sorted(seen_pairs), "UserID long, MovieID long")
    got = {}
    for r in rc.top_k_items(users, items, ["f0", "f1", "f2", "f3"], 5, seen, user_block=4, item_block=7).collect():
        got.setdefault(r.UserID, []).append((r["rank"], r.MovieID))
    scores = np.floor((u @ i.T) * 1e6 + 0.5) / 1e6
    for n in range(25):
        best = sorted((-scores[n, m], m) for m in range(40) if (n, m) not in seen_pairs)[:5]
        assert [m for _, m in sorted(got[n])] == [m for _, m in best]
    assert len(got[3]) == 2


def test_top_k_skips_blocks_that_cannot_matter(spark):
    """Items of falling length: the result is that of all pairs, most meetings are not held, and ties beyond the first block are found."""
    rng = np.random.default_rng(3)
    u = np.vstack([rng.normal(size=(60, 3)), np.zeros((1, 3)), -np.ones((1, 3))])
    i = rng.normal(size=(400, 3)) * (0.97 ** np.arange(400))[:, None]
    i[300:320] = i[5]  # the longest vectors again, under larger ids
    frames = [spark.createDataFrame([(n, *map(float, r)) for n, r in enumerate(x)], f"{key} long, f0 double, f1 double, f2 double") for x, key in ((u, "UserID"), (i, "MovieID"))]
    seen_pairs = {(int(a), int(b)) for a, b in zip(rng.integers(0, 62, 300), rng.integers(0, 400, 300))} | {(7, b) for b in range(395)}
    seen = spark.createDataFrame(sorted(seen_pairs), "UserID long, MovieID long")
    top = rc.pruned_top_k(*frames, ["f0", "f1", "f2"], 4, seen, user_block=1, item_block=20)
    got = {}
    for r in top.rows.collect():
        got.setdefault(r.UserID, []).append((r["rank"], r.MovieID))
    scores = np.floor((u @ i.T) * 1e6 + 0.5) / 1e6
    for n in range(62):
        best = sorted((-scores[n, m], m) for m in range(400) if (n, m) not in seen_pairs)[:4]
        assert [m for _, m in sorted(got[n])] == [m for _, m in best]
    # the meetings held are just those that the bound asks for, worked out anew from the blocks
    placed, longest = rc.norm_blocks(frames[1], "MovieID", ["f0", "f1", "f2"], 20)
    first_items = {r.MovieID for r in placed.where("ib = 0").collect()}
    blocks = {}
    for r in frames[0].select("UserID", F.pmod(F.xxhash64("UserID"), F.lit(62)).alias("ub")).collect():
        found = sorted((scores[r.UserID, m] for m in first_items if (r.UserID, m) not in seen_pairs), reverse=True)
        floor = found[3] if len(found) > 3 else -np.inf
        blocks.setdefault(r.ub, set()).update(b for b in range(1, len(longest)) if np.linalg.norm(u[r.UserID]) * longest[b] + 1e-6 >= floor)
    report = top.report.first()
    assert (report.met, report.possible) == (len(blocks) + sum(map(len, blocks.values())), len(blocks) * len(longest))
    assert 0 < report.pruned_share < 1
    one = rc.pruned_top_k(*frames, ["f0", "f1", "f2"], 4, None, item_block=10_000)
    assert one.report.first().pruned_share == 0 and one.rows.count() == 62 * 4


def test_top_k_of_empty_tables(spark):
    empty = spark.createDataFrame([], "UserID long, f0 double"), spark.createDataFrame([], "MovieID long, f0 double")
    some = spark.createDataFrame([(1, 1.0)], "UserID long, f0 double"), spark.createDataFrame([(1, 1.0)], "MovieID long, f0 double")
    for users, items in ((empty[0], some[1]), (some[0], empty[1]), empty):
        assert rc.top_k_items(users, items, ["f0"], 3).count() == 0


def test_fallback_and_baseline(spark):
    df = spark.createDataFrame([(3.0, 4.0), (5.0, 4.9), (1.0, 0.6)], "u double, m double")
    assert [r.s for r in df.select(rc.fallback_score("u", "m").alias("s")).collect()] == [4.0, 5.0, 0.5]
    row = rc.mean_baseline(spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "Rating double")).first()
    assert (row.baseline_value, row.mae) == (3.0, 2.0)


def test_runs_and_rollback(spark):
    nan = float("nan")
    runs = spark.createDataFrame([("a", 1, 0.9, 0.7, None, None), ("b", 1, None, None, 1.1, 0.9), ("c", 1, nan, nan, None, None)],
                                 "run_id string, experiment int, rmse double, mae double, baseline_rmse double, baseline_mae double")
    row = rc.compare_runs(runs).first()
    assert (row.best_run, row.unscored) == ("a", 1) and math.isclose(row.worst_score, 1.0)
    versions = spark.createDataFrame([("m", 3, "Production", "a"), ("m", 1, "Archived", "b"), ("m", 2, "Staging", "c")], "model_name string, version int, stage string, run_id string")
    assert [(r.run_id, r.role, r.version) for r in rc.select_best(runs, versions).orderBy("rank").collect()] == [("a", "selected", 3), ("b", "runner_up", 1)]
    assert (rc.rollback_targets(versions).first().production_version, rc.rollback_targets(versions).first().rollback_version) == (3, 2)


def test_cells_stay_in_place_without_broadcasts(spark, monkeypatch):
    """In every half-step the plan hashes pieces and sums, never the cell blocks."""
    v = np.where(RNG.random((50, 40)) < 0.3, RNG.integers(1, 6, (50, 40)), 0).astype(float)
    plans, real = [], fz.block_sums

    def block_sums(blocks, pieces, side, k, width):
        out = real(blocks, pieces, side, k, width)
        plans.append(out._jdf.queryExecution().sparkPlan().toString() + "\n====\n" + out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(fz, "block_sums", block_sums)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fz.fit_nmf(spark, cells_of(spark, v), k=2, iterations=2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert len(plans) == 4
    for plan in plans:
        top = [line for line in plan.split("====")[1].split("InMemoryRelation")[0].splitlines() if line.strip()]
        join = next(i for i, line in enumerate(top) if "ShuffledHashJoin" in line)
        # the first child of the join is the kept blocks as they are; the exchange above the join is that of the sums
        assert "Exchange" not in " ".join(top[join + 1:]) and "InMemoryTableScan" in " ".join(top[join + 1:])


def test_blocks_do_not_change_a_fit(spark, monkeypatch):
    v = np.where(RNG.random((60, 45)) < 0.3, RNG.integers(1, 6, (60, 45)), 0).astype(float)
    fits = []
    for cells, ids in ((500_000, 65_536), (100, 9)):
        monkeypatch.setattr(fz, "BLOCK_CELLS", cells)
        monkeypatch.setattr(fz, "BLOCK_IDS", ids)
        fits.append(fz.fit_nmf(spark, cells_of(spark, v), k=3, iterations=3))
    for side in ("users", "items"):
        a, b = (np.array(sorted(map(tuple, getattr(f, side).collect()))) for f in fits)
        assert np.allclose(a, b, rtol=1e-6, atol=1e-9)


def test_half_step_against_exact_least_squares(spark):
    """Non-negative least squares by trying every set of free factors."""
    v = np.where(RNG.random((20, 15)) < 0.4, RNG.integers(1, 6, (20, 15)), 0).astype(float)
    v[:, 0], v[0, :] = np.where(v[:, 0] == 0, 1, v[:, 0]), np.where(v[0] == 0, 1, v[0])
    h = RNG.random((15, 3))
    start = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(h)], "MovieID long, f0 double, f1 double, f2 double")
    got = np.array(sorted(map(tuple, fz.fit_nmf(spark, cells_of(spark, v), 3, 1, start=start, sweeps=3000).users.collect())))[:, 1:]
    for row, w in zip(v, got):
        best = np.inf
        for free in range(8):
            on = [j for j in range(3) if free >> j & 1]
            x = np.zeros(3)
            if on:
                x[on] = np.linalg.lstsq(h[:, on], row, rcond=None)[0]
            if (x >= -1e-12).all():
                best = min(best, np.sum((row - h @ x) ** 2))
        assert math.isclose(np.sum((row - h @ w) ** 2), best, rel_tol=1e-6, abs_tol=1e-9)


def test_correlation_takes_the_rows_of_each_pair(spark):
    x = RNG.normal(size=(300, 4)) + 1e6
    x[:, 1] += x[:, 0]
    x[:, 3] = 7.0
    rows = [tuple(None if RNG.random() < 0.2 else float(c) for c in r) for r in x]
    import pandas as pd

    from tasteloom.operators.relational import pairwise_correlation

    want = pd.DataFrame(rows, columns=list("abcd")).corr()
    for r in pairwise_correlation(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd")).collect():
        assert (r.r is None) if "d" in (r.a, r.b) else math.isclose(r.r, want[r.a][r.b], rel_tol=1e-7, abs_tol=1e-9)


def test_top_k_deals_the_meetings_of_one_item_block(spark, monkeypatch):
    """All users meet the first item block: its meetings are dealt to many tasks, whatever the shuffle width."""
    users = spark.range(600).select(F.col("id").alias("UserID"), (F.col("id") % 17 * 0.1).alias("f0"), (F.col("id") % 5 * 0.3).alias("f1"))
    items = spark.range(300).select(F.col("id").alias("MovieID"), (F.col("id") % 13 * 0.2).alias("f0"), (F.col("id") % 7 * 0.1).alias("f1"))
    wide, keep = {}, rc.stored

    def spied(df, name):
        wide[name] = df.rdd.getNumPartitions()
        return keep(df, name)

    monkeypatch.setattr(rc, "MEETINGS_A_TASK", 2)
    monkeypatch.setattr(rc, "stored", spied)
    top = rc.pruned_top_k(users, items, ["f0", "f1"], 3, user_block=20, item_block=30).rows
    got = sorted((r.UserID, r["rank"], r.MovieID, r.score) for r in top.collect())
    want = []
    for u in range(600):
        scores = sorted((-math.floor((u % 17 * 0.1 * (i % 13 * 0.2) + u % 5 * 0.3 * (i % 7 * 0.1)) * 1e6 + 0.5) / 1e6, i) for i in range(300))
        want += [(u, n + 1, i, -s) for n, (s, i) in enumerate(scores[:3])]
    assert [(u, n, i) for u, n, i, _ in got] == [(u, n, i) for u, n, i, _ in want]
    assert wide["first"] >= 15


def test_rows_that_are_solved_leave_the_sweeps():
    """Factors at right angles settle in one sweep: a thousand million sweeps end at the first look."""
    g, n = np.diag([1.0, 2.0, 4.0]), RNG.normal(size=(200, 3))
    assert np.allclose(fz.non_negative(n.copy(), g, 10**9), np.maximum(n / np.diag(g), 1e-12), rtol=1e-12)
    x = RNG.random((50, 4))
    g, n = x.T @ x, RNG.normal(size=(200, 4))
    assert np.allclose(fz.non_negative(n.copy(), g, 500), fz.non_negative(n.copy(), g, 531), rtol=1e-6, atol=1e-9)


def test_factors_are_written_once_and_blocks_follow_the_cores(spark, monkeypatch):
    """A half-step writes a row for each side block and no pieces; more shuffle partitions make no more blocks."""
    v = np.where(RNG.random((60, 45)) < 0.3, RNG.integers(1, 6, (60, 45)), 0).astype(float)
    made, rows, cell_blocks, gram_and_total = [], [], fz.cell_blocks, fz._gram_and_total

    def blocks(cells, user, item, user_blocks, item_blocks, width):
        made.append((user_blocks, item_blocks))
        return cell_blocks(cells, user, item, user_blocks, item_blocks, width)

    def total(solved, k):
        rows.append(solved.count())
        return gram_and_total(solved, k)

    monkeypatch.setattr(fz, "cell_blocks", blocks)
    monkeypatch.setattr(fz, "_gram_and_total", total)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "36")
    try:
        fz.fit_nmf(spark, cells_of(spark, v), k=2, iterations=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert made == [(2, 2)] and rows == [2, 2, 2]


def test_top_k_sends_single_users_to_the_blocks_that_may_hold_better_items(spark, monkeypatch):
    """All users share one user block, which by length meets every item block; a few users are sent on. Ties, seen pairs, a NaN, users without k items."""
    rng = np.random.default_rng(11)
    turn = rng.random(300) * 0.5 * math.pi
    u = np.vstack([np.column_stack([np.cos(turn), np.sin(turn)]), [[1.0, -1.0], [0.0, 0.0], [-1.0, -1.0]]])
    turn = rng.random(2000) * 0.5 * math.pi
    i = np.column_stack([np.cos(turn), np.sin(turn)]) * (3 - np.arange(2000) / 1000)[:, None]
    i[700:740] = i[30]
    i[900] = np.nan, 1.0
    users, items = (spark.createDataFrame([(n, *map(float, r)) for n, r in enumerate(x)], f"{key} long, f0 double, f1 double") for x, key in ((u, "UserID"), (i, "MovieID")))
    seen_pairs = {(int(a), int(b)) for a, b in zip(rng.integers(0, 303, 3000), rng.integers(0, 2000, 3000))} | {(7, b) for b in range(1990)}
    seen = spark.createDataFrame(sorted(seen_pairs) * 2, "UserID long, MovieID long")
    held, keep = {}, rc.stored

    def spied(df, name):
        held[name] = keep(df, name)
        return held[name]

    monkeypatch.setattr(rc, "stored", spied)
    monkeypatch.setattr(rc, "BOX_ITEMS", 8)
    monkeypatch.setattr(rc, "USERS_AT_ONCE", 50)
    monkeypatch.setattr(rc, "OPEN_ROWS", 100)
    with np.errstate(invalid="ignore"):
        scores = np.floor((u @ i.T) * 1e6 + 0.5) / 1e6
    for pairs in (seen, None):
        top = rc.pruned_top_k(users, items, ["f0", "f1"], 4, pairs, user_block=1024, item_block=100)
        got, gone = {}, seen_pairs if pairs is not None else set()
        for r in top.rows.collect():
            got.setdefault(r.UserID, []).append((r["rank"], r.MovieID))
        for n in range(303):
            best = sorted((-scores[n, m], m) for m in range(2000) if (n, m) not in gone and np.isfinite(scores[n, m]))[:4]
            assert [m for _, m in sorted(got[n])] == [m for _, m in best]
        report = top.report.first()
        assert held["open"].count() < 0.3 * 303 * report.met
        assert held["open"].groupBy("UserID", "ib").count().filter("count > 1").count() == 0


def test_side_blocks_are_solved_in_units_of_bounded_sums(spark, monkeypatch):
    """More blocks of the other side make more units: no written row holds sums beyond the bound, and the factors stay as they are."""
    v = np.where(RNG.random((60, 45)) < 0.4, RNG.integers(1, 6, (60, 45)), 0).astype(float)
    start = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(RNG.random((45, 3)))], "MovieID long, f0 double, f1 double, f2 double")
    rows, fits, gram_and_total = [], [], fz._gram_and_total

    def total(solved, k):
        rows.append([len(r.ids) // 8 for r in solved.select("ids").collect()])
        return gram_and_total(solved, k)

    monkeypatch.setattr(fz, "_gram_and_total", total)
    for bound in (1 << 20, 300):
        monkeypatch.setattr(fz, "UNIT_BYTES", bound)
        rows.clear()
        fits += [fz.fit_nmf(spark, cells_of(spark, v), k=3, iterations=2, start=s) for s in (None, start)]
    # (2, 2) blocks, 24 bytes an id from each of two blocks: 300 bytes hold six ids on average
    assert all(sum(r) in (45, 60) and len(r) > 6 and max(r) <= 18 for r in rows)
    for a, b in zip(fits[:2], fits[2:]):
        assert np.allclose(a.errors, b.errors, rtol=1e-9)
        for side in ("users", "items"):
            x, y = (np.array(sorted(map(tuple, getattr(f, side).collect()))) for f in (a, b))
            assert np.allclose(x, y, rtol=1e-6, atol=1e-9)
