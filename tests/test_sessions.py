"""Rules of sessions, laps and setups on hand-written samples."""

import random

import pytest
from pyspark.sql import functions as F

from lapline import fixed_values as fixed
from lapline.operators import sessions
from lapline.streaming import lifecycle


def seconds(df, column="timestamp"):
    return df.withColumn("s", (F.unix_micros(column) - 1704067200000000) / 1000000)


def test_states(samples):
    statuses = ["replay", "live", "replay", "live", "pause", "off", "live", "off", "live"]
    t = samples([{"status": s, "completed_laps": i, "best_lap_time_ms": 1000 + i} for i, s in enumerate(statuses)])
    events = seconds(sessions.session_events(t)).orderBy("s").collect()
    assert [(e.event_type, e.session_no, e.s) for e in events] == [
        ("session_start", 1, 1), ("session_end", 1, 4), ("session_start", 2, 6),
        ("session_end", 2, 7), ("session_start", 3, 8)]
    # an end takes its numbers from the sample before it, a start has none
    assert [(e.total_laps, e.best_lap_ms) for e in events] == [
        (None, None), (3, 1003), (None, None), (6, 1006), (None, None)]
    members = seconds(sessions.sessionize(t), "timestamp_wall").orderBy("s").collect()
    assert [(m.s, m.session_no) for m in members] == [(1, 1), (2, 1), (3, 1), (6, 2), (8, 3)]


def test_lap_completion_compares_live_samples_of_one_session(samples):
    t = samples([
        {"completed_laps": 5}, {"completed_laps": 6, "last_lap_time_ms": 91000, "is_in_pit": True},
        {"completed_laps": 7, "status": "replay"}, {"completed_laps": 7},
        {"completed_laps": 2}, {"completed_laps": 3}, {"status": "pause", "completed_laps": 4},
        {"completed_laps": 9}, {"completed_laps": 10},
    ])
    rows = seconds(sessions.lap_completions(t)).orderBy("s").collect()
    assert [(r.s, r.lap_number) for r in rows] == [(1, 6), (3, 7), (5, 3), (8, 10)]
    assert rows[0].lap_time_ms == 91000


def test_negative_count_gives_no_lap(samples):
    assert sessions.lap_completions(samples([{"completed_laps": -1}, {"completed_laps": 0}])).count() == 0


def test_setup_changes(samples):
    t = samples([
        {}, {"brake_bias": 57.005}, {"brake_bias": 57.009}, {"brake_bias": 57.014},  # drifts
        {"brake_bias": 57.5, "tc_level": 3},  # two at once
        {"status": "replay", "tc_level": 9}, {"brake_bias": 57.5, "tc_level": 3},
        {"status": "pause"}, {"tc_level": 8, "brake_bias": 60.0},
    ])
    changes = seconds(sessions.setup_changes(t)).orderBy("s", "parameter").collect()
    assert [(c.s, c.parameter, c.old_value, c.new_value) for c in changes] == [
        (4, "brake_bias", 57.014, 57.5), (4, "tc_level", 1.0, 3.0)]
    raw = seconds(sessions.setup_snapshots(t)).orderBy("s").collect()
    assert [(s.s, s.lap_applied_from, s.tc_level) for s in raw] == [(0, 0, 1), (4, 0, 3), (4, 0, 3), (8, 0, 8)]
    assert sessions.setup_snapshots(t, distinct=True).count() == 3


def test_unknown_old_setup_value_is_no_change(samples):
    t = samples([{"tc_level": None}, {"tc_level": 3}])
    assert sessions.setup_changes(t).count() == 0


def test_segments_advance_in_the_pit(samples):
    t = samples([
        {"speed_kmh": 10.0}, {"completed_laps": 1, "is_in_pit": True}, {"completed_laps": 1, "speed_kmh": 30.0},
        {"completed_laps": 1, "is_in_pit": None, "speed_kmh": 50.0}, {"status": "off"},
    ])
    rows = sessions.lap_segments(t).orderBy("segment_no").collect()
    assert [(r.lap_number, r.samples, r.avg_speed) for r in rows] == [(0, 1, 10.0), (1, 2, 40.0)]


def test_repeated_packets(samples):
    t = samples([{"packet_id": p} for p in (1, 1, 2, 2, 1, 3)])
    rows = seconds(sessions.drop_repeated_packets(t), "timestamp_wall").orderBy("s").collect()
    assert [(r.s, r.packet_id) for r in rows] == [(0, 1), (2, 2), (4, 1), (5, 3)]


def test_setup_on_laps(spark):
    laps = spark.createDataFrame([("a", 1, n) for n in range(6)] + [("b", 1, 0), ("a", 2, 4)],
                                 "session_id string, session_no long, completed_laps int")
    snaps = spark.createDataFrame(
        [("a", 1, 1, 1, 10), ("a", 1, 3, 2, 30), ("a", 1, 3, 3, 31), ("a", 2, 0, 9, 50)],
        "session_id string, session_no long, lap_applied_from int, tc_level int, timestamp int",
    ).selectExpr("*", "0 AS tc_cut", "0 AS abs_level", "0 AS engine_map", "57.0D AS brake_bias")
    got = sessions.setup_on_laps(laps, snaps).collect()
    # a later session's setup is no setup of an earlier one
    assert [r.tc_level for r in got if r.session_no == 2] == [9]
    rows = {(r.session_id, r.completed_laps): r.tc_level for r in got if r.session_no == 1}
    assert rows == {("a", 0): None, ("a", 1): 1, ("a", 2): 1, ("a", 3): 3, ("a", 4): 3, ("a", 5): 3, ("b", 0): None}


def test_merge_keeps_what_the_event_lacks(spark):
    stored = spark.createDataFrame(
        [("a", 7, 88000, None), ("b", 0, None, None)],
        "session_id string, total_laps int, best_lap_ms int, end_time string")
    ends = spark.createDataFrame(
        [("a", None, 87000, "t1"), ("zz", 3, 1, "t1")],
        "session_id string, total_laps int, best_lap_ms int, timestamp string")
    rows = {r.session_id: (r.total_laps, r.best_lap_ms, r.end_time)
            for r in sessions.merge_session_end(stored, ends).collect()}
    assert rows == {"a": (7, 87000, "t1"), "b": (0, None, None)}


def test_orphans(spark):
    table = spark.createDataFrame([("a",)], "session_id string")
    laps = spark.createDataFrame([("a", 1), ("x", 1)], "session_id string, lap_number int")
    assert [r.session_id for r in sessions.orphans(laps, table).collect()] == ["x"]
    assert [r.session_id for r in sessions.with_sessions(laps, table).collect()] == ["a"]


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(3)
    rows, laps = [], {}
    for i in range(900):
        key = rng.choice(["hot", "hot", "hot", "a", "b", "c"])
        laps[key] = laps.get(key, 0) + rng.choice([0, 0, 0, 1, 1, -1])
        rows.append({
            "session_id": key, "status": rng.choice(["live"] * 6 + ["pause", "off", "replay", "unknown"]),
            "completed_laps": laps[key], "best_lap_time_ms": rng.randrange(1000), "packet_id": i,
            "is_in_pit": rng.choice([True, False, False, None]), "speed_kmh": float(rng.randrange(200)),
            "fuel_remaining": float(rng.randrange(50)), "tc_level": rng.randrange(2),
            "brake_bias": rng.choice([57.0, 57.005, 57.02]),
        })
    return rows


def scalar(rows):
    """The state machine of the stream, one sample at a time."""
    from tests.conftest import DEFAULTS
    states, events = {}, []
    for i, row in enumerate(rows):
        full = {**DEFAULTS, **row}
        state = states.setdefault(full["session_id"], dict.fromkeys(lifecycle._STATE_NAMES) | lifecycle._START)
        sample = {n: full[n] for n in lifecycle._NAMES if n not in ("ts_us", "packet_id")}
        sample |= {"ts_us": i * 1_000_000, "packet_id": full["packet_id"],
                   **{p: float(full[p]) for p in fixed.SETUP_PARAMETERS}}
        for event in lifecycle.step(state, sample):
            events.append({**event, "session_id": full["session_id"]})
    return states, events


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 10])
def test_batch_equals_state_machine(samples, random_rows, rows_per_slice):
    states, events = scalar(random_rows)
    t = samples(random_rows)

    def batch(df, *columns):
        return sorted(map(tuple, seconds(df).select("session_id", F.col("s").cast("long"), *columns).collect()), key=str)

    def stream(kinds, *columns):
        return sorted([(e["session_id"], e["ts_us"] // 1_000_000, *[e.get(c) for c in columns])
                       for e in events if e["kind"] in kinds], key=str)

    got = sessions.session_events(t, rows_per_slice)
    assert batch(got, "session_no", "total_laps", "best_lap_ms") == stream(
        ("session_start", "session_end"), "session_no", "total_laps", "best_lap_ms")
    assert batch(sessions.lap_completions(t, rows_per_slice), "lap_number") == stream(
        ("lap_completion",), "lap_number")
    assert batch(sessions.setup_changes(t, rows_per_slice), "parameter", "old_value", "new_value") == stream(
        ("setup_change",), "parameter", "old_value", "new_value")
    assert batch(sessions.setup_snapshots(t, rows_per_slice), "lap_applied_from", "tc_level") == stream(
        ("setup_snapshot",), "lap_applied_from", "tc_level")
    segments = sessions.lap_segments(t, rows_per_slice).withColumn("timestamp", F.col("last_time"))
    tails = [e | {"session_id": k} for k, s in states.items() for e in lifecycle._segment(s)]
    columns = ("session_no", "segment_no", "lap_number", "samples", "max_speed", "fuel_used")
    want = stream(("lap_segment",), *columns) + [
        (e["session_id"], e["ts_us"] // 1_000_000, *[e[c] for c in columns]) for e in tails]
    assert batch(segments, *columns) == sorted(want, key=str)


def final_plan(df):
    """The plan that ran, without the one that was planned first."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("operator", [sessions.sessionize, sessions.session_events, sessions.lap_completions,
                                      sessions.setup_changes, sessions.lap_segments])
def test_three_reads_and_one_exchange_of_the_rows(spark, samples, tmp_path, operator):
    """Also where keys are cut: cuts, rows, and the few columns that slices hand on."""
    rows = [{"ts": i, "packet_id": i, "completed_laps": i // 40, "status": "pause" if i % 90 == 89 else "live"}
            for i in range(600)]
    samples(rows).write.parquet(str(tmp_path / "samples"))
    plan = final_plan(operator(spark.read.parquet(str(tmp_path / "samples")), 30))
    assert plan.count("FileScan") <= 3, plan
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(session_id" in line and "_slice" in line]
    assert len(wide) <= 2, plan  # the rows, and the columns of cut keys
