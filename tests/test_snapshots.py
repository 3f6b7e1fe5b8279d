"""Snapshot tables, the keyed log and keyed label state: stopped runs, repeats, nulls and pruned reads."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import DataFrameWriter, functions as F

from tasteloom.operators import feedback as fb
from tasteloom.operators.relational import retention
from tasteloom.sources import keyed_log, readers, sinks, snapshots
from tasteloom.streaming import jobs, pairs


class Stopped(Exception):
    pass


@pytest.fixture
def stop_at(monkeypatch):
    """Let the n-th write of a change fail: before it, or after its files are there but the job is not told."""

    def arm(n, after=False):
        left = [n]
        for name in ("parquet", "json"):
            real = getattr(DataFrameWriter, name)

            def write(self, path, *args, real=real, **kw):
                left[0] -= 1
                if left[0] == 0 and not after:
                    raise Stopped
                real(self, path, *args, **kw)
                if left[0] == 0:
                    raise Stopped

            monkeypatch.setattr(DataFrameWriter, name, write)
        return left

    yield arm
    monkeypatch.undo()


def every_stop(stop_at, monkeypatch, change, seen, allowed):
    """Run ``change`` with a stop before and after each of its writes, then whole; ``seen`` is always one of ``allowed``."""
    states = set()
    for after in (False, True):
        n = 0
        while True:
            n += 1
            left = stop_at(n, after)
            try:
                change()
                ended = True
            except Stopped:
                ended = False
            monkeypatch.undo()
            state = seen()
            assert state in allowed, (n, after, state)
            states.add(allowed.index(state))
            if ended and left[0] > 0:
                break
    assert states <= {0, 1} and allowed.index(seen()) == 1
    return states


def test_replaced_table_is_old_or_new_at_every_stop(spark, tmp_path, stop_at, monkeypatch):
    base = str(tmp_path / "t")
    snapshots.replace(spark.range(5), base)
    seen = lambda: snapshots.read(spark, base).count()
    states = every_stop(stop_at, monkeypatch, lambda: snapshots.replace(spark.range(9), base), seen, [5, 9])
    assert states == {0, 1}


def test_upsert_is_all_or_nothing_at_every_stop(spark, tmp_path, stop_at, monkeypatch):
    base, schema = str(tmp_path / "t"), "k long, v double, d date"
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    sinks.upsert_partitions(spark, base, spark.createDataFrame([(1, 1.0, days[0]), (2, 2.0, days[1]), (None, 3.0, days[0]), (5, 5.0, None)], schema), ["k", "d"], "d")
    update = spark.createDataFrame([(1, 9.0, days[0]), (3, 3.0, days[2]), (None, 4.0, days[0]), (5, 6.0, None)], schema)
    seen = lambda: sorted(map(tuple, snapshots.read(spark, base).collect()), key=str)
    old = seen()
    new = sorted([(1, 9.0, days[0]), (2, 2.0, days[1]), (None, 4.0, days[0]), (3, 3.0, days[2]), (5, 6.0, None)], key=str)
    every_stop(stop_at, monkeypatch, lambda: sinks.upsert_partitions(spark, base, update, ["k", "d"], "d"), seen, [old, new])
    sinks.upsert_partitions(spark, base, update, ["k", "d"], "d")
    assert seen() == new
    untouched = [e for e in snapshots.current(spark, base).entries if e.key == "2024-01-02"]
    assert untouched == [e for e in snapshots.current(spark, base, 1).entries if e.key == "2024-01-02"]


def test_archive_moves_all_or_nothing_at_every_stop(spark, tmp_path, stop_at, monkeypatch):
    base, old, new = str(tmp_path / "t"), "2024-01-01", "2024-01-20"
    rows = [(1, old), (1, old), (1, "2024-01-02"), (None, old), (None, old), (None, new), (2, new), (2, new), (3, None), (None, None), (None, None)]
    table = lambda data: spark.createDataFrame(data, "k long, t string").selectExpr("k", "cast(t as timestamp_ntz) AS at", "t")
    run = lambda: sinks.archive(spark, base, lambda hot: retention(hot, "at", "2024-01-20", 7))
    held = lambda tier: Counter((r.k, r.t) for r in snapshots.read(spark, base, [tier]).collect())
    seen = lambda: (held("archive"), held("hot"))
    snapshots.replace(table(rows), base, "hot")
    past = Counter(r for r in rows if r[1] in (old, "2024-01-02"))
    kept = Counter(rows) - past
    states = every_stop(stop_at, monkeypatch, run, seen, [(Counter(), Counter(rows)), (past, kept)])
    assert states == {0, 1}
    # rows that come again are moved again
    snapshots.append(table([(1, old), (None, old)]), base, "hot")
    run()
    run()
    assert seen() == (past + Counter([(1, old), (None, old)]), kept)


def test_archive_refuses_a_split_that_loses_rows(spark, tmp_path):
    base = str(tmp_path / "t")
    snapshots.replace(spark.range(10), base, "hot")
    with pytest.raises(ValueError):
        sinks.archive(spark, base, lambda hot: (hot.where("id < 3"), hot.where("id > 3")))
    assert snapshots.read(spark, base, ["hot"]).count() == 10


def test_two_writers_are_reported(spark, tmp_path):
    base = str(tmp_path / "t")
    was = snapshots.replace(spark.range(1), base)
    for _ in range(2):
        snapshots.commit(spark, was, was.entries, was.schema)
    with pytest.raises(RuntimeError, match="two writers"):
        snapshots.read(spark, base)


def test_old_versions_and_vacuum(spark, tmp_path, stop_at, monkeypatch):
    base = str(tmp_path / "t")
    for n in range(1, 5):
        snapshots.replace(spark.range(n), base)
    assert snapshots.read(spark, base, version=2).count() == 2
    stop_at(1, True)
    with pytest.raises(Stopped):
        snapshots.replace(spark.range(99), base)
    monkeypatch.undo()
    assert snapshots.vacuum(spark, base, keep=2) == 3  # two old versions and the stopped one
    assert snapshots.read(spark, base).count() == 4 and snapshots.read(spark, base, version=3).count() == 3
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, base, version=1)
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, str(tmp_path / "absent"))


def test_versions_of_other_columns_and_empty_tables(spark, tmp_path):
    base = str(tmp_path / "t")
    sinks.write_version(spark.range(2), base, "20240101_000000")
    sinks.write_version(spark.range(3).withColumn("s", F.lit("x")), base, "20240102_000000")
    sinks.write_version(spark.range(0), base, "20240103_000000")
    assert {r.data_version: (r.n, r.s) for r in readers.read_all_versions(spark, base).groupBy("data_version").agg(F.count("*").alias("n"), F.count("s").alias("s")).collect()} == {
        "20240101_000000": (2, 0), "20240102_000000": (3, 3)}
    assert readers.read_version(spark, base).count() == 0 and readers.read_version(spark, base, "20240101_000000").columns == ["id"]
    with pytest.raises(ValueError):
        sinks.write_version(spark.range(1), base, "a/b")


# ---- the log


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, j long, v long")


def test_log_takes_each_key_once_in_a_stated_order(spark, tmp_path):
    base, rng = str(tmp_path / "log"), random.Random(1)
    want, keys = {}, [None, "a", "b", "|", "a|b"]
    for batch in range(7):
        rows = [(rng.choice(keys) if rng.random() < 0.3 else f"k{rng.randrange(400)}", rng.choice([None, 1]), rng.randrange(1000)) for _ in range(rng.choice([1, 30, 300]))]
        least = {}
        for k, j, v in rows:
            least[(k, j)] = min(v, least.get((k, j), v))
        for key, v in least.items():
            want.setdefault(key, v)
        for _ in range(2):  # a batch that comes again adds nothing
            sinks.insert_if_absent(spark, base, frame(spark, rows).repartition(3), ["k", "j"], ["v"])
    got = [((r.k, r.j), r.v) for r in keyed_log.read(spark, base).collect()]
    assert len(got) == len(dict(got)) and dict(got) == want


def test_repeats_without_an_order_do_not_depend_on_partitions(spark, tmp_path):
    rows = [("a", i % 3, i) for i in range(50)]
    picks = set()
    for n in (1, 2, 7):
        base = str(tmp_path / f"log{n}")
        keyed_log.insert(spark, base, frame(spark, rows).repartition(n, "v"), ["k"])
        picks.add(tuple(keyed_log.read(spark, base).first()))
    assert len(picks) == 1


def test_a_batch_reads_only_buckets_that_may_hold_its_keys(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "log")
    rows = spark.range(20_000).selectExpr("concat('k', id) AS k", "CAST(id AS LONG) AS j", "CAST(id AS LONG) AS v")
    keyed_log.insert(spark, base, rows, ["k"])
    log = snapshots.current(spark, base)
    blocks = snapshots.rows_of(spark, log, [keyed_log.INDEX]).agg(F.max("blocks")).first()[0]
    index = snapshots.rows_of(spark, log, [keyed_log.INDEX])
    hashed = lambda df: df.select(keyed_log.key_hash(["k"]).alias("h"))
    old, new = hashed(rows), hashed(spark.range(20_000, 40_000).selectExpr("concat('k', id) AS k"))
    assert keyed_log.held_perhaps(old, index, blocks).distinct().count() == 20_000  # no held key is missed
    assert keyed_log.held_perhaps(new, index, blocks).count() < 200  # 1 in 1,000 expected
    # a key that is there: one bucket of 64 is scanned
    one = frame(spark, [("k77", 0, 0)]).withColumn("h", keyed_log.key_hash(["k"]))
    near = [r[0] for r in one.select(keyed_log.bucket_of("h", keyed_log.BUCKETS)).collect()]
    scan = keyed_log.log_rows(spark, log, near)
    assert sum(r.k == "k77" for r in scan.collect()) == 1
    metrics = scan._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics()
    assert (metrics.apply("numFiles").value(), metrics.apply("numPartitions").value(), len(scan.inputFiles())) == (1, 1, 64)
    opened = []
    real = keyed_log.log_rows
    monkeypatch.setattr(keyed_log, "log_rows", lambda s, t, b=None: opened.append(b) or real(s, t, b))
    keyed_log.insert(spark, base, frame(spark, [("fresh", 0, 0)]), ["k"])
    assert not opened  # its bits are not set: no bucket is read
    keyed_log.insert(spark, base, frame(spark, [("k77", 0, 0)]), ["k"])
    assert opened == [near]
    monkeypatch.undo()
    assert keyed_log.read(spark, base).count() == 20_001


def test_log_folders_stay_few_and_the_index_grows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed_log, "FIRST_BLOCKS", 1)
    monkeypatch.setattr(keyed_log, "KEYS_PER_BLOCK", 40)
    base = str(tmp_path / "log")
    for n in range(12):
        keyed_log.insert(spark, base, spark.range(n * 10, n * 10 + 15).selectExpr("string(id) AS k", "id AS v"), ["k"], buckets=4)
    log = snapshots.current(spark, base)
    assert sorted(int(r.k) for r in keyed_log.read(spark, base).collect()) == list(range(125))
    assert len(log.of([keyed_log.ROWS])) <= 5 and snapshots.rows_of(spark, log, [keyed_log.INDEX]).agg(F.max("blocks")).first()[0] > 1


def test_insert_is_all_or_nothing_at_every_stop(spark, tmp_path, stop_at, monkeypatch):
    base = str(tmp_path / "log")
    keyed_log.insert(spark, base, frame(spark, [("a", 1, 1), ("b", 1, 1)]), ["k"])
    batch = frame(spark, [("b", 2, 2), ("c", 2, 2), (None, 2, 2)])
    seen = lambda: sorted((str(r.k), r.v) for r in keyed_log.read(spark, base).collect())
    old = [("a", 1), ("b", 1)]
    every_stop(stop_at, monkeypatch, lambda: keyed_log.insert(spark, base, batch, ["k"]), seen, [old, sorted([*old, ("c", 2), ("None", 2)])])
    keyed_log.insert(spark, base, batch.limit(0), ["k"])
    assert len(seen()) == 4


# ---- labels from keyed state

EVENTS = ("event_id long, event_type string, user_id long, item_id long, recommendation_id string, completion_rate double, "
          "feedback_type string, rating double, is_synthetic boolean, created_at timestamp_ntz")


def random_events(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["click", "click", "watch", "feedback"])
        feedback = rng.choice(["like", "dislike", "not_interested", "rating"]) if kind == "feedback" else None
        rows.append((i, kind, rng.randrange(4), rng.randrange(3), rng.choice([None, "r1", "r2", "r3"]), rng.choice([None, 0.1, 0.5, 0.9]) if kind == "watch" else None,
                     feedback, float(rng.randrange(6)) if feedback == "rating" else None, rng.choice([True, False]),
                     dt.datetime(2023, 12, 20) + dt.timedelta(minutes=rng.randrange(60 * 24 * 50))))
    return rows


def test_labels_from_state_are_those_of_the_whole_history(spark, tmp_path):
    """Events in any order, one file a batch, some before the window and some after its end; the batch job is the measure."""
    rows, source = random_events(240, 3), str(tmp_path / "src")
    for lo in range(0, 240, 60):
        spark.createDataFrame(rows[lo:lo + 60], EVENTS).coalesce(1).write.mode("append").parquet(source)
    whole = spark.read.parquet(source)
    key = lambda r: (r.user_id, r.item_id, r.recommendation_id, r.label, r.last_interaction)
    want = sorted(map(key, fb.build_labels(whole, "2024-01-31").collect()), key=str)
    stream = jobs.parquet_stream(spark, source, whole.schema, files_per_trigger=1)
    jobs.refresh_labels(stream, str(tmp_path / "labels"), "2024-01-31")
    assert sorted(map(key, snapshots.read(spark, str(tmp_path / "labels")).collect()), key=str) == want and len(want) > 6


def test_a_later_day_forgets_days_before_its_window(spark, tmp_path):
    """The same state under a later date: only pairs with new events get a label, from the days of the new window."""
    source, labels = str(tmp_path / "src"), str(tmp_path / "labels")

    def event(i, day, kind="click", item=1, **more):
        return (i, kind, 1, item, "r", more.get("completion"), None, None, False, dt.datetime(2024, 1, 1) + dt.timedelta(days=day))

    spark.createDataFrame([event(1, 0), event(2, 0, "watch", completion=0.9), event(3, 0, item=2)], EVENTS).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: jobs.parquet_stream(spark, source, spark.read.parquet(source).schema)
    jobs.refresh_labels(stream(), labels, "2024-01-02")
    spark.createDataFrame([event(4, 45)], EVENTS).coalesce(1).write.mode("append").parquet(source)
    jobs.refresh_labels(stream(), labels, "2024-02-15")
    got = sorted((str(r.label_date), r.item_id, r.label) for r in snapshots.read(spark, labels).collect())
    assert got == [("2024-01-02", 1, 4.0), ("2024-01-02", 2, 1.0), ("2024-02-15", 1, 1.0)]


def test_many_pairs_share_a_call_of_the_state(spark, tmp_path, monkeypatch):
    """400 pairs, some without a user or an item, and ids above 2**53, in two batches: a call serves many pairs and the labels are those of the batch job."""
    calls = str(tmp_path / "calls")

    class Counted(pairs.PairSignals):
        def handleInputRows(self, key, rows, timerValues):
            with open(calls, "a") as f:
                f.write(".")
            return super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(pairs, "PairSignals", Counted)
    monkeypatch.setattr(pairs, "BUCKETS", 8)
    base = 2**53 + 1
    rows = [(i, "click", None if i % 50 == 7 else base + i % 400, None if i % 50 == 9 else 1, f"r{i % 3}", None, None, None, False, dt.datetime(2024, 1, 20, 0, i % 60)) for i in range(600)]
    source = str(tmp_path / "src")
    for lo in (0, 300):
        spark.createDataFrame(rows[lo:lo + 300], EVENTS).coalesce(1).write.mode("append").parquet(source)
    whole = spark.read.parquet(source)
    key = lambda r: (r.user_id, r.item_id, r.recommendation_id, r.label, r.last_interaction)
    want = sorted(map(key, fb.build_labels(whole, "2024-01-31").collect()), key=str)
    jobs.refresh_labels(jobs.parquet_stream(spark, source, whole.schema, files_per_trigger=1), str(tmp_path / "labels"), "2024-01-31")
    assert sorted(map(key, snapshots.read(spark, str(tmp_path / "labels")).collect()), key=str) == want and len(want) > 380
    with open(calls) as f:
        assert len(f.read()) <= 8 * 2 * 2  # buckets and batches, and a try again
