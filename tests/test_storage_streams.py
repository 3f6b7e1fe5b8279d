import datetime as dt

from pyspark.sql import functions as F

from tasteloom.operators import feedback as fb
from tasteloom.operators import lineage as ln
from tasteloom.sources import keyed_log, snapshots
from tasteloom.sources import readers as rd
from tasteloom.sources import sinks as sk
from tasteloom.streaming import intake as it
from tasteloom.streaming import jobs
from tasteloom.tables import MOVIES, RATINGS, RAW_EVENT


def test_delimited_latin1_and_corrupt_line(spark, tmp_path):
    (tmp_path / "movies.dat").write_bytes("1::Amélie (2001)::Comedy|Romance\nx::Bad::Drama\n".encode("iso-8859-1"))
    rows = rd.read_delimited(spark, str(tmp_path / "movies.dat"), MOVIES).collect()
    assert rows[0].Title == "Amélie (2001)" and rows[0][rd.CORRUPT] is None
    assert rows[1].MovieID is None and rows[1][rd.CORRUPT] == "x::Bad::Drama"


def test_raw_fallback_and_latest(spark, tmp_path):
    (tmp_path / "r.dat").write_text("1::1193::5::978300760\n")
    base = str(tmp_path / "ratings")
    assert rd.read_or_raw(spark, base, str(tmp_path / "r.dat"), RATINGS).first().Rating == 5.0
    sk.write_version(spark.range(100), base, "20240101_000000")
    sk.write_version(spark.range(3), base, "20240201_000000")
    assert rd.read_or_raw(spark, base, "unused", RATINGS).count() == 3
    assert (rd.latest_version(spark, base), rd.latest_version(spark, base, "bytes")) == ("20240201_000000", "20240101_000000")


def test_observed_write_counts_once(spark, tmp_path):
    row = sk.observed_write(spark.range(42), "src", str(tmp_path / "t"), "v").first()
    assert (row.rows, row.columns, spark.read.parquet(row.target).count()) == (42, "id", 42)


def test_upsert_touches_only_its_partitions_and_repeats_safely(spark, tmp_path):
    path = str(tmp_path / "labels")
    schema = "k long, label double, d date"
    day1, day2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    keys = ["k", "d"]
    sk.upsert_partitions(spark, path, spark.createDataFrame([(1, 1.0, day1), (2, 2.0, day1)], schema), keys, "d")
    update = spark.createDataFrame([(2, 9.0, day1), (3, 3.0, day1), (1, 7.0, day2)], schema)
    for _ in range(2):
        sk.upsert_partitions(spark, path, update, keys, "d")
    assert sorted((r.k, r.label, r.d) for r in snapshots.read(spark, path).collect()) == [(1, 1.0, day1), (1, 7.0, day2), (2, 9.0, day1), (3, 3.0, day1)]


def test_update_with_null_replaces(spark):
    old = spark.createDataFrame([(1, 5.0)], "k long, v double")
    row = sk.merge_rows(old, spark.createDataFrame([(1, None)], "k long, v double"), ["k"]).first()
    assert row.v is None and row.updated


def test_lineage_closure_and_cycle(spark):
    edges = spark.createDataFrame([("raw", "validated"), ("validated", "featured"), ("reference", "featured")], "source string, target string")
    root = spark.createDataFrame([("featured",)], "name string")
    row = ln.upstream_summary(ln.upstream(edges, root)).first()
    assert (row.edges, row.sources) == (3, 3)
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string")
    rows = ln.upstream(cycle, spark.createDataFrame([("b",)], "name string")).collect()
    assert sorted((r.source, r.target, r.depth) for r in rows) == [("a", "b", 1), ("b", "a", 2)]


def test_versions(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, s string")
    a, b = ln.snapshot(df, "d", "v1").first(), ln.snapshot(df.repartition(3).orderBy(F.desc("id")), "d", "v2").first()
    assert len(a.content_hash) == 64 and a.content_hash == b.content_hash and (a.row_count, a.column_count, a.null_cells) == (2, 2, 1)
    versions = ln.snapshot(df, "d", "v1").unionByName(ln.snapshot(df.limit(1), "d", "v2"))
    changed = {r.metric: r.changed for r in ln.compare(versions, "d", "v1", "v2", ["row_count", "column_count", "content_hash"]).collect()}
    assert changed == {"row_count": True, "column_count": False, "content_hash": True}
    assert [r.version for r in ln.history(versions, "d").collect()] == ["v2", "v1"]


def raw(**over):
    base = dict(event_id="e", event_type="click", user_id=1, item_id=1, recommendation_id="r", position=0, timestamp="2024-01-30 00:00:00")
    return {**base, **over}


BAD = [
    raw(event_id="1", position=-1), raw(event_id="2", event_type="feedback", feedback_type="rating", rating=6.0),
    raw(event_id="3", event_type="poke"), raw(event_id="4", event_type="impression", item_ids=[], model_name="m", model_version="v"),
]
GOOD = [
    raw(event_id="5"), raw(event_id="6", event_type="impression", item_ids=[1], model_name="m", model_version="v1"),
    raw(event_id="7", event_type="watch", watch_duration_seconds=90, total_duration_seconds=60),
    raw(event_id="8", event_type="feedback", feedback_type="like"),
]


def write_json(path, name, rows):
    import json

    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_intake_routes_and_batch_equals_stream(spark, tmp_path):
    write_json(tmp_path / "in", "a.json", BAD + GOOD[:2])
    write_json(tmp_path / "in", "b.json", GOOD[2:])
    stream = jobs.json_stream(spark, str(tmp_path / "in"), RAW_EVENT, files_per_trigger=1)
    table = jobs.run_to_table(it.routed(stream).select("event_id", "route"), str(tmp_path / "out"), ["route"])
    got = {r.event_id: r.route for r in table.collect()}
    batch = it.routed(spark.read.schema(RAW_EVENT).json(str(tmp_path / "in")))
    assert got == {r.event_id: r.route for r in batch.collect()}
    assert got == {"1": "quarantine", "2": "quarantine", "3": "quarantine", "4": "quarantine", "5": "events", "6": "impressions", "7": "events", "8": "events"}
    watch = it.enriched(batch).filter("event_id = '7'").first()
    assert watch.completion_rate == 1.5 and watch.watched_over_total


def test_inserted_impressions_keep_one_row_without_state(spark, tmp_path):
    shown = raw(event_type="impression", item_ids=[1], model_name="m", model_version="v1")
    late = {**shown, "timestamp": "2024-01-30 09:00:00"}
    stream = lambda: jobs.json_stream(spark, str(tmp_path / "in"), RAW_EVENT, files_per_trigger=1).select("recommendation_id")
    for name, rows in (("a.json", [shown, shown]), ("b.json", [late, {**shown, "recommendation_id": "other"}])):
        write_json(tmp_path / "in", name, rows)
        table = jobs.run_to_inserts(stream(), str(tmp_path / "log"), ["recommendation_id"])
    assert sorted(r[0] for r in table.collect()) == sorted([shown["recommendation_id"], "other"])


def test_open_windows_show_and_later_batches_replace_them(spark, tmp_path):
    one = raw(event_type="click", item_id=1, position=0)
    untyped = {**one, "event_type": None}
    keys = ["window_start", "event_type", "is_synthetic", "window_date"]
    (tmp_path / "in").mkdir()
    stream = jobs.json_stream(spark, str(tmp_path / "in"), RAW_EVENT, files_per_trigger=1)
    counts = it.counts_per_window(stream).withColumn("window_date", F.to_date("window_start"))
    for name, n in (("a.json", 1), ("b.json", 3)):
        write_json(tmp_path / "in", name, [one, untyped] * (1 if n == 1 else 2))
        table = jobs.run_to_upserts(counts, str(tmp_path / "windows"), keys, "window_date")
        assert sorted((str(r.event_type), r.n) for r in table.collect()) == [("None", n), ("click", n)]


EVENTS = ("event_id long, event_type string, user_id long, item_id long, recommendation_id string, completion_rate double, "
          "feedback_type string, rating double, is_synthetic boolean, created_at timestamp_ntz")


def test_labels_one_batch_many_batches_and_replay_agree(spark, tmp_path):
    def row(i, kind, item, completion=None, feedback=None):
        return (i, kind, 1, item, f"r{item}", completion, feedback, None, False, dt.datetime(2024, 1, 30, 0, i))

    parts = [[row(1, "click", 1), row(2, "click", 2)], [row(3, "watch", 1, 0.9)], [row(4, "feedback", 2, None, "like"), row(1, "click", 1)]]
    source = str(tmp_path / "src")
    for p in parts:
        spark.createDataFrame(p, EVENTS).coalesce(1).write.mode("append").parquet(source)
    whole = spark.read.parquet(source)
    want = sorted((r.item_id, r.label) for r in fb.build_labels(whole, "2024-01-31").collect())
    for n, per in enumerate((1, None)):
        stream = jobs.parquet_stream(spark, source, whole.schema, files_per_trigger=per)
        jobs.refresh_labels(stream, str(tmp_path / f"lab{n}"), "2024-01-31")
        got = sorted((r.item_id, r.label) for r in snapshots.read(spark, str(tmp_path / f"lab{n}")).collect())
        assert got == want == [(1, 4.0), (2, 3.0)]


def test_windowed_counts_match_batch(spark, tmp_path):
    rows = [raw(event_id=str(i), timestamp=f"2024-01-30 {i // 60:02d}:{i % 60:02d}:30") for i in range(300)]
    write_json(tmp_path / "in", "a.json", rows[:150])
    write_json(tmp_path / "in", "b.json", rows[150:])
    stream = jobs.json_stream(spark, str(tmp_path / "in"), RAW_EVENT, files_per_trigger=1)
    got = jobs.run_to_table(it.sliding_ctr(stream), str(tmp_path / "out"))
    rates = {r.window_start: r.n for r in got.collect()}
    want = {r.window_start: r.n for r in it.sliding_ctr(spark.read.schema(RAW_EVENT).json(str(tmp_path / "in"))).collect()}
    assert rates and all(want[w] == n for w, n in rates.items())
    assert max(rates) <= dt.datetime(2024, 1, 30, 3)
