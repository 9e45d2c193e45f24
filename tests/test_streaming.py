"""Streams give what the batch operators give, whatever the order of the rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lapline import schemas, session
from lapline.operators import sessions
from lapline.sources import messages
from lapline.streaming import lifecycle, pipelines

SECONDS = "(unix_micros(timestamp) - 1704067200000000) DIV 1000000"


@pytest.fixture(scope="module")
def replay(samples):
    """Two streams over an hour, then one sample far later that moves the watermark on."""
    rng = random.Random(11)
    rows, laps = [], {"a": 0, "b": 3}
    for i in range(400):
        key = rng.choice("aab")
        laps[key] += rng.random() < 0.1
        rows.append({
            "ts": i * 9, "session_id": key, "packet_id": i, "completed_laps": laps[key],
            "status": rng.choice(["live"] * 12 + ["pause", "replay"]), "is_in_pit": rng.random() < 0.1,
            "speed_kmh": float(rng.randrange(300)), "tc_level": rng.randrange(4), "fuel_remaining": 60.0 - i / 10})
    rows.append({"ts": 100_000, "session_id": "z", "packet_id": 999, "status": "off"})
    return samples(rows)


def streamed(spark, df, parts, shuffle_within=1):
    """The rows as files read one per micro-batch."""
    path = session.new_folder(spark, "in")
    rows = df.orderBy("timestamp_wall", "packet_id").collect()
    size = -(-len(rows) // parts)
    rng = random.Random(2)
    for i in range(parts):
        chunk = rows[i * size:(i + 1) * size]
        rng.shuffle(chunk)
        spark.createDataFrame(chunk, df.schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option(
        "latestFirst", False).parquet(f"{path}/*")


def run(spark, stream, **options):
    out, state = session.new_folder(spark, "out"), session.new_folder(spark, "state")
    pipelines.start_append(stream, out, state, **options).awaitTermination()
    return spark.read.parquet(out)


@pytest.fixture(scope="module")
def online(spark, replay):
    return run(spark, lifecycle.lifecycle_events(streamed(spark, replay, 6))).persist()


@pytest.mark.parametrize("kind, batch, columns", [
    ("lap_completion", sessions.lap_completions, ["lap_number", "fuel_remaining", "tyre_temp_fl"]),
    ("setup_change", sessions.setup_changes, ["parameter", "old_value", "new_value", "lap_number"]),
    ("setup_snapshot", sessions.setup_snapshots, ["lap_applied_from", "tc_level"]),
])
def test_stream_equals_batch(online, replay, kind, batch, columns):
    got = lifecycle.events_of(online, kind).selectExpr("session_id", "ts_us", *columns).collect()
    want = batch(replay).selectExpr("session_id", "unix_micros(timestamp) AS ts_us", *columns).collect()
    assert sorted(map(str, (tuple(map(num, r)) for r in got))) == sorted(map(str, (tuple(map(num, r)) for r in want)))
    assert got


def num(value):
    return float(value) if isinstance(value, (int, float)) else value


def test_sessions_and_segments(online, replay):
    events = sessions.session_events(replay)
    for kind, columns in (("session_start", ["session_no"]), ("session_end", ["session_no", "total_laps"])):
        got = lifecycle.events_of(online, kind).select("session_id", "ts_us", *columns).collect()
        want = events.where(F.col("event_type") == kind).selectExpr(
            "session_id", "unix_micros(timestamp) AS ts_us", *columns).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    columns = ["session_id", "session_no", "segment_no", "lap_number", "samples", "max_speed"]
    got = set(map(tuple, lifecycle.events_of(online, "lap_segment").select(*columns).collect()))
    want = set(map(tuple, sessions.lap_segments(replay).select(*columns).collect()))
    assert got < want and len(want - got) <= 2  # only laps of open sessions are still held


def test_idle_sessions_give_out_their_lap(spark, replay):
    got = lifecycle.events_of(
        run(spark, lifecycle.lifecycle_events(streamed(spark, replay, 3), idle_ms=3_600_000)), "lap_segment")
    assert got.count() == sessions.lap_segments(replay).count()


def test_gap_within_what_is_known_already(spark, samples):
    t = samples([{"ts": 0}, {"ts": 10}, {"ts": 9000}, {"ts": 9010}, {"ts": 90_000, "status": "off"}])
    got = lifecycle.events_of(run(spark, lifecycle.lifecycle_events(streamed(spark, t, 1), idle_ms=600_000)), "lap_segment")
    assert got.count() == 2
    rows = [{"ts": s} for s in (0, 10, 9000, 9010, 90_000)] + [{"ts": 990_000, "session_id": "z"}]
    got = lifecycle.events_of(run(spark, lifecycle.lifecycle_events(
        streamed(spark, samples(rows), 2), idle_ms=600_000)), "lap_segment").orderBy("ts_us")
    assert [r.samples for r in got.collect()] == [2, 2, 1]


def test_late_rows_are_dropped(spark, samples):
    early = samples([{"ts": 0}, {"ts": 10, "completed_laps": 1}, {"ts": 5000, "completed_laps": 2}])
    late = samples([{"ts": 5, "completed_laps": 7, "packet_id": 5}, {"ts": 9000, "completed_laps": 3}])
    path = session.new_folder(spark, "in")
    out, state = session.new_folder(spark, "out"), session.new_folder(spark, "state")

    def feed(df):
        df.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(early.schema).parquet(path)
        pipelines.start_append(lifecycle.lifecycle_events(stream), out, state).awaitTermination()

    feed(early)
    feed(late)  # a new query from the same checkpoint: the state of the first goes on
    got = lifecycle.events_of(spark.read.parquet(out), "lap_completion").orderBy("ts_us").collect()
    assert [r.lap_number for r in got] == [1, 2]


@pytest.mark.parametrize("files, rows_per_slice", [(1, 10_000), (7, 80), (3, 150)])
def test_backfill_gives_everything(spark, replay, files, rows_per_slice):
    """Rows in no order over many files: what the batch operators give, open laps too."""
    out, work = session.new_folder(spark, "out"), session.new_folder(spark, "work")
    shuffled = replay.repartition(files, F.xxhash64("packet_id"))
    runs = pipelines.backfill(shuffled, lifecycle.lifecycle_events, out, work, rows_per_slice=rows_per_slice)
    assert sum(r.rows for r in runs) == replay.count() + 1 and not any(r.late for r in runs)
    assert len(runs) == -(-401 // rows_per_slice) + 1
    got = spark.read.schema(lifecycle.EVENTS).parquet(out)
    columns = ["session_id", "session_no", "segment_no", "lap_number", "samples", "max_speed"]
    assert sorted(map(tuple, lifecycle.events_of(got, "lap_segment").select(*columns).collect())) == sorted(
        map(tuple, sessions.lap_segments(replay).select(*columns).collect()))
    for kind, batch in (("lap_completion", sessions.lap_completions), ("setup_change", sessions.setup_changes)):
        names = ["session_id", "session_no", "lap_number"]
        assert sorted(map(tuple, lifecycle.events_of(got, kind).select(*names).collect())) == sorted(
            map(tuple, batch(replay).select(*names).collect()))


def test_state_holds_a_slice_not_the_table(spark, samples):
    """Four hours in slices of one: what waits after a slice are minutes of that slice."""
    t = samples([{"ts": i * 20, "packet_id": i, "completed_laps": i // 50} for i in range(720)])
    out, work = session.new_folder(spark, "out"), session.new_folder(spark, "work")
    runs = pipelines.backfill(t, lifecycle.lifecycle_events, out, work, rows_per_slice=180)
    assert len(runs) == 5 and all(abs(r.rows - 180) <= 1 for r in runs[:4]) and not any(r.late for r in runs)
    assert max(r.held for r in runs) <= 70  # entries are minutes of a session; a slice has 60 of them


def test_few_rows_wait_together(spark, samples):
    """A row an hour for 30 days: state has a few entries, not one for each row."""
    t = samples([{"ts": i * 3600, "packet_id": i, "completed_laps": i // 50} for i in range(720)])
    out, work = session.new_folder(spark, "out"), session.new_folder(spark, "work")
    runs = pipelines.backfill(t, lifecycle.lifecycle_events, out, work, rows_per_slice=400)
    assert sum(r.rows for r in runs) == 721 and max(r.held for r in runs) <= 20
    got = lifecycle.events_of(spark.read.schema(lifecycle.EVENTS).parquet(out), "lap_segment")
    assert sorted(r.samples for r in got.collect()) == [20] + 14 * [50]


@pytest.mark.parametrize("at_once, rows_per_slice", [(5, 10_000), (40, 90)])
def test_intervals_with_many_rows_are_dealt_into_finer_ones(spark, replay, monkeypatch, at_once, rows_per_slice):
    monkeypatch.setattr(lifecycle, "ROWS_AT_ONCE", at_once)
    out, work = session.new_folder(spark, "out"), session.new_folder(spark, "work")
    pipelines.backfill(replay, lifecycle.lifecycle_events, out, work, rows_per_slice=rows_per_slice)
    got = spark.read.schema(lifecycle.EVENTS).parquet(out)
    columns = ["session_id", "session_no", "segment_no", "lap_number", "samples", "max_speed"]
    assert sorted(map(tuple, lifecycle.events_of(got, "lap_segment").select(*columns).collect())) == sorted(
        map(tuple, sessions.lap_segments(replay).select(*columns).collect()))


def test_slices_follow_each_other(spark, samples):
    rng = random.Random(4)
    times = [rng.choice([0, 5, 5, 5, rng.randrange(4000)]) for _ in range(500)]
    t = samples([{"ts": at, "packet_id": i} for i, at in enumerate(times)]).withColumn(
        "timestamp_wall", F.when(F.col("packet_id") != 7, F.col("timestamp_wall")))
    path = session.new_folder(spark, "slices")
    known = pipelines.time_slices(t, path, 9)
    rows = spark.read.parquet(path).groupBy("_slice").agg(
        F.min("timestamp_wall").alias("low"), F.max("timestamp_wall").alias("high"), F.count("*").alias("n"),
        F.count_if(F.col("timestamp_wall").isNull()).alias("untimed")).orderBy("_slice").collect()
    assert sum(r.n for r in rows) == 500 and [r.untimed for r in rows if r.untimed] == [1] and rows[0].untimed == 1
    assert all(x.high < y.low for x, y in zip(rows, rows[1:]))
    assert [f"{path}/_slice={r['_slice']}" for r in rows] == known["folders"] and len(rows) > 10


def test_a_single_slice_is_not_shuffled(spark, samples):
    t = samples([{"packet_id": i} for i in range(90)]).repartition(3, "packet_id")
    path = session.new_folder(spark, "slices")
    pipelines.time_slices(t, path, 1000)
    assert len(spark.read.parquet(path).inputFiles()) == 3  # a file of each task that had the rows


@pytest.mark.parametrize("field", ["completed_laps", "speed_kmh", "brake_bias", "is_in_pit", "status"])
def test_missing_fields_are_taken_as_in_the_batch(spark, samples, field):
    rows = [{"ts": i * 10, "packet_id": i, "completed_laps": i // 3, **({field: None} if i in (0, 4, 5) else {})}
            for i in range(12)]
    t = samples(rows)
    out = session.new_folder(spark, "out")
    pipelines.backfill(t, lifecycle.lifecycle_events, out, session.new_folder(spark, "work"))
    got = spark.read.schema(lifecycle.EVENTS).parquet(out)
    columns = ["session_no", "segment_no", "lap_number", "samples", "max_speed", "avg_speed", "fuel_used"]
    assert sorted(map(str, lifecycle.events_of(got, "lap_segment").select(*columns).collect())) == sorted(
        map(str, sessions.lap_segments(t).select(*columns).collect()))
    for kind, batch in (("lap_completion", sessions.lap_completions), ("setup_change", sessions.setup_changes)):
        names = ["session_no", "lap_number"]
        assert sorted(map(str, lifecycle.events_of(got, kind).select(*names).collect())) == sorted(
            map(str, batch(t).select(*names).collect()))


def test_repeats_go_wherever_they_are(spark, replay):
    twice = replay.unionByName(replay)
    got = run(spark, pipelines.without_repeats(streamed(spark, twice, 4)))
    assert got.count() == replay.count()


def test_samples_are_appended_by_session_and_lap(spark, replay):
    sent = messages.encode(replay.withColumn("timestamp_wall", F.date_format("timestamp_wall", "yyyy-MM-dd'T'HH:mm:ss")),
                           "telemetry_raw")
    path = session.new_folder(spark, "messages")
    broken = sent.limit(1).withColumn("value", F.encode(F.lit("no json"), "UTF-8"))
    sent.unionByName(broken).write.parquet(path)
    out, state = session.new_folder(spark, "out"), session.new_folder(spark, "state")
    for query in pipelines.start_telemetry(messages.message_files(spark, path), out, state):
        query.awaitTermination()
    got = pipelines.samples_table(spark, out).read()
    assert got.count() == replay.count() + 1
    assert got.where("status IS NULL").count() == 1  # kept, without values
    assert got.where("processed_at IS NOT NULL AND session_key = 'a'").count() > 0
    assert set(schemas.SAMPLE.names) <= set(got.columns)
    again = pipelines.start_telemetry(messages.message_files(spark, path), out, state)[0]
    again.awaitTermination()
    assert pipelines.samples_table(spark, out).read().count() == got.count()


def test_kafka_options():
    assert messages.kafka_options("h:1", ("a", "b"), per_trigger=5) == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "a,b", "startingOffsets": "earliest",
        "failOnDataLoss": "false", "maxOffsetsPerTrigger": "5"}


def message_frame(spark, rows):
    rows = [(k.encode(), (v if isinstance(v, str) else json.dumps(v)).encode(), topic, at)
            for at, (k, topic, v) in enumerate(rows)]
    return spark.createDataFrame(rows, "key binary, value binary, topic string, at int").selectExpr(
        "key", "value", "topic", "timestamp_seconds(at) AS timestamp")


START = {"event_type": "session_start", "session_id": "a", "platform": "ACC", "track": "Monza", "car": "c",
         "session_type": "race", "timestamp": "t0"}


def test_event_store(spark):
    end = {"event_type": "session_end", "session_id": "a", "total_laps": 5, "timestamp": "t9"}
    lap = {"session_id": "a", "lap_number": 1, "lap_time_ms": 100, "is_valid": True}
    setup = {"session_id": "a", "lap_applied_from": 2, "tc_level": 1, "brake_bias": 57.5}
    rows = [
        ("b", "session_events", {**end, "session_id": "b"}),  # its session starts later
        ("a", "session_events", START), ("a", "session_events", {**START, "car": "other"}),
        ("a", "session_events", end), ("zz", "session_events", {**end, "session_id": "zz"}),
        ("a", "lap_completions", lap), ("a", "lap_completions", {**lap, "lap_time_ms": 101}),
        ("zz", "lap_completions", {**lap, "session_id": "zz"}), ("a", "lap_completions", {"session_id": "a"}),
        ("a", "lap_completions", "{broken"), ("a", "other_topic", lap),
        ("a", "setup_snapshots", setup), ("a", "setup_snapshots", setup),
        ("b", "session_events", {**START, "session_id": "b"}),
    ]
    store = session.new_folder(spark, "store")
    sent = message_frame(spark, rows)
    pipelines.store_batch(sent, 0, store, "r1")
    pipelines.store_batch(sent, 0, store, "r1")  # the same batch once more
    got = {r.session_id: r for r in pipelines.stored_sessions(spark, store).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].car, got["a"].total_laps, got["a"].best_lap_ms, got["a"].end_time) == ("c", 5, None, "t9")
    assert (got["b"].total_laps, got["b"].end_time) == (0, None)
    laps = pipelines.stored_laps(spark, store).collect()
    assert [(r.session_id, r.lap_number, r.lap_time_ms, r.sector_1_ms) for r in laps] == [("a", 1, 101, None)]
    setups = pipelines.stored_setups(spark, store).collect()
    assert [(r.session_id, r.lap_number, r.tc_level) for r in setups] == [("a", 2, 1)]
    assert pipelines.quarantined(spark, store).count() == 3
    # a later batch completes what is there
    pipelines.store_batch(message_frame(spark, [("a", "session_events", {**end, "best_lap_ms": 99, "total_laps": None})]),
                          1, store, "r1")
    later = {r.session_id: r for r in pipelines.stored_sessions(spark, store).collect()}["a"]
    assert (later.total_laps, later.best_lap_ms) == (5, 99)
    # a new checkpoint numbers its batches from 0 again and overwrites nothing
    pipelines.store_batch(message_frame(spark, [("c", "session_events", {**START, "session_id": "c"})]), 0, store, "r2")
    assert {r.session_id for r in pipelines.stored_sessions(spark, store).collect()} == {"a", "b", "c"}


def test_large_batches_are_spread_over_tasks(spark, monkeypatch):
    rows = [(f"s{i}", "session_events", {**START, "session_id": f"s{i}"}) for i in range(60)]
    sent = message_frame(spark, rows).unionByName(message_frame(spark, [("x", "no topic", {})])).coalesce(1)
    assert pipelines._spread(sent).rdd.getNumPartitions() == 1
    monkeypatch.setattr(pipelines, "MESSAGES_PER_TASK", 10)
    assert pipelines._spread(sent).rdd.getNumPartitions() == 7
    store = session.new_folder(spark, "store")
    pipelines.store_batch(sent, 0, store, "r1")
    assert pipelines.stored_sessions(spark, store).count() == 60 and pipelines.quarantined(spark, store).count() == 1


def test_unreadable(spark):
    sent = message_frame(spark, [("a", "t", {"x": 1}), ("a", "t", "nope"), ("a", "t", "[1]")])
    assert messages.unreadable(sent).count() == 2


def test_samples_without_session_are_kept(spark, samples, monkeypatch, tmp_path):
    from lapline.plans import queries

    t = samples([{"packet_id": 1}, {"packet_id": 2, "session_id": ""}, {"packet_id": 3, "session_id": None}])
    monkeypatch.setattr(queries.binding, "samples", lambda *_: t)
    got = queries.stream_without_repeats(spark, str(tmp_path)).collect()
    assert sorted((r.packet_id, r.session_id, r.status) for r in got) == [
        (1, "s", "live"), (2, "", "live"), (3, None, "live")]
