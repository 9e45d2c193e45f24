"""The event store with snapshots and deletions: what is read is what the log alone gives."""

import random

import pytest

from lapline import session
from lapline.sinks.versions import Versions
from lapline.streaming import pipelines, snapshots
from tests.test_streaming import START, message_frame

END = {"event_type": "session_end", "session_id": "a", "total_laps": 5, "timestamp": "t9"}
LAP = {"session_id": "a", "lap_number": 1, "lap_time_ms": 100, "is_valid": True}
SETUP = {"session_id": "a", "lap_applied_from": 2, "tc_level": 1, "brake_bias": 57.5}


def put(spark, store, number, rows, run="r1"):
    rows = [(v["session_id"], topic, v) for topic, v in rows]
    pipelines.store_batch(message_frame(spark, rows), number, store, run)


def read(spark, store):
    return [sorted(map(str, table(spark, store).collect())) for table in (
        pipelines.stored_sessions, pipelines.stored_laps, pipelines.stored_setups)]


def some(rng, number):
    """Starts, ends, laps and setups of five sessions, in any order, many of them again."""
    out = []
    for _ in range(12):
        key = rng.choice("abcde")
        out.append(rng.choice([
            ("session_events", {**START, "session_id": key, "car": f"c{number}"}),
            ("session_events", {**END, "session_id": key, "total_laps": rng.choice([None, number]),
                                "best_lap_ms": rng.choice([None, 1000 + number]), "timestamp": f"t{rng.randrange(99)}"}),
            ("lap_completions", {**LAP, "session_id": key, "lap_number": rng.randrange(3), "lap_time_ms": number}),
            ("setup_snapshots", {**SETUP, "session_id": key, "tc_level": rng.randrange(2)})]))
    return out


def test_snapshots_change_nothing(spark):
    """Two runs whose batches come in between each other, a snapshot now and then."""
    rng, log, store = random.Random(6), session.new_folder(spark, "log"), session.new_folder(spark, "store")
    # ends of one session have different times, so that the latest is one
    numbers = {"r1": 0, "r2": 0}
    for turn in range(6):
        run = rng.choice(["r1", "r2"])
        rows = [(topic, {**v, "timestamp": f"t{turn:02d}-{i}"} if v.get("event_type") == "session_end" else v)
                for i, (topic, v) in enumerate(some(rng, turn))]
        for folder in (log, store):
            put(spark, folder, numbers[run], rows, run)
        numbers[run] += 1
        if turn in (1, 2, 4):
            assert snapshots.compact(spark, store)
        assert read(spark, store) == read(spark, log)
    assert snapshots.vacuum(spark, store) > 0
    assert read(spark, store) == read(spark, log)


def test_a_read_takes_the_snapshot_and_the_tail(spark):
    store = session.new_folder(spark, "store")
    for number in range(3):
        put(spark, store, number, [("session_events", START), ("lap_completions", {**LAP, "lap_number": number})])
    snapshots.compact(spark, store)
    put(spark, store, 3, [("lap_completions", {**LAP, "lap_number": 3})])
    files = snapshots.stored(spark, store, "lap_completions").inputFiles()
    assert any("_snapshots" in f for f in files)
    assert {f.split("batch_id=")[1].split("/")[0] for f in files if "batch_id=" in f} == {"3"}
    assert pipelines.stored_laps(spark, store).count() == 4


def test_a_compaction_that_breaks_off_changes_nothing(spark, monkeypatch):
    store = session.new_folder(spark, "store")
    put(spark, store, 0, [("session_events", START), ("lap_completions", LAP), ("setup_snapshots", SETUP)])
    snapshots.compact(spark, store)
    put(spark, store, 1, [("lap_completions", {**LAP, "lap_time_ms": 90}), ("session_events", END)])
    before = read(spark, store)
    with monkeypatch.context() as broken:
        broken.setattr(Versions, "change", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            snapshots.compact(spark, store)
    assert read(spark, store) == before
    put(spark, store, 1, [("lap_completions", {**LAP, "lap_time_ms": 90}), ("session_events", END)])  # again
    assert read(spark, store) == before
    assert snapshots.compact(spark, store) and read(spark, store) == before
    assert snapshots.vacuum(spark, store) and read(spark, store) == before


def test_deleted_sessions_take_their_laps_and_setups(spark):
    store = session.new_folder(spark, "store")
    rows = [("session_events", START), ("lap_completions", LAP), ("setup_snapshots", SETUP)]
    put(spark, store, 0, rows + [(topic, {**v, "session_id": "b"}) for topic, v in rows])
    gone = spark.createDataFrame([("a",), ("a",), (None,), ("unknown",)], "session_id string")
    assert snapshots.delete_sessions(spark, store, gone, "first")
    left = read(spark, store)
    assert [len(t) for t in left] == [1, 1, 1] and all("'a'" not in r for t in left for r in t)
    assert not snapshots.delete_sessions(spark, store, gone, "first") and read(spark, store) == left
    # laps alone don't bring it back; a new start does, without the laps it had
    put(spark, store, 1, [("lap_completions", {**LAP, "lap_number": 7})])
    assert read(spark, store) == left
    put(spark, store, 2, [("session_events", {**START, "car": "new"})])
    again = read(spark, store)
    assert [len(t) for t in again] == [2, 2, 1] and any("lap_number=7" in r for r in again[1])
    assert not snapshots.delete_sessions(spark, store, gone, "first") and read(spark, store) == again
    for _ in range(2):
        assert snapshots.compact(spark, store) and read(spark, store) == again
    snapshots.vacuum(spark, store)
    assert read(spark, store) == again
    assert not spark.read.parquet(f"{store}/{snapshots._versions(spark, store).latest()[1]['snapshot']}/lap_completions"
                                  ).where("session_id = 'a' and lap_number = 1").count()


def test_an_empty_store(spark):
    store = session.new_folder(spark, "store")
    assert read(spark, store) == [[], [], []]
    assert snapshots.compact(spark, store) and read(spark, store) == [[], [], []]
