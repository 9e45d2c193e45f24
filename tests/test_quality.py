"""Checks against the rules they stand for."""

import pytest

from lapline import schemas
from lapline.operators import quality, sessions


def blocks(n):
    first = min(500, n // 10) if n > 1000 else 0
    chosen = set()
    for start in (first, n // 4, n // 2, 3 * n // 4, max(0, n - 500)):
        chosen |= set(range(start, min(start + 200, n)))
    return chosen


@pytest.mark.parametrize("rows_per_slice", [1_000_000, 100])
def test_sampled_blocks(samples, rows_per_slice):
    sizes = {"a": 2345, "b": 1000, "c": 150, "d": 1001}
    rows = [{"session_id": s, "packet_id": i} for s, n in sizes.items() for i in range(n)]
    got = quality.slice_sample(samples(rows), rows_per_slice).select("session_id", "packet_id").collect()
    for s, n in sizes.items():
        assert sorted(r.packet_id for r in got if r.session_id == s) == sorted(blocks(n))


def test_verdicts(samples):
    rows = [{"speed_kmh": 100.0, "brake": 0.5 if i else 9.0, "throttle": 5.0, "tyre_temp_fl": None} for i in range(100)]
    got = {r.field: r for r in quality.range_checks(samples(rows).drop("tyre_pressure_rr")).collect()}
    assert len(got) == 18
    assert (got["speed_kmh"].verdict, got["brake"].verdict, got["throttle"].verdict) == ("ok", "warn", "fail")
    assert (got["brake"].out_of_range, got["brake"].vmax) == (1, 9.0)
    assert (got["tyre_temp_fl"].verdict, got["tyre_temp_fl"].n) == ("warn", 0)
    assert got["tyre_pressure_rr"].verdict == "fail"  # an absent column counts as zeros


def test_one_outlier_anywhere_fails(samples):
    rows = [{"speed_kmh": 399.0 if i < 1099 else 999.0, "car": "" if i in (5, 500) else "c"} for i in range(1100)]
    t = samples(rows)
    got = {r.field: (r.verdict, r.n) for r in quality.strict_range_checks(t).collect()}
    assert got["speed_kmh"] == ("fail", 1100)
    empty = {r.field: (r.empty, r.verdict) for r in quality.required_checks(t).collect()}
    assert empty["car"] == (2, "fail") and empty["track"] == (0, "ok")


def test_columns(samples):
    row = quality.column_checks(samples([{}]).withColumnRenamed("gear", "extra")).first()
    assert row.verdict == "fail" and "gear" in row.missing_columns.split(",") and row.expected == 76
    assert schemas.missing_columns(samples([{}]), schemas.SETUP_CHANGE) == [
        "parameter", "old_value", "new_value", "lap_number", "timestamp"]


LAPS = ("session_id string, session_no long, lap_number int, lap_time_ms int, is_valid boolean, fuel_remaining double, "
        "timestamp int, sector_1_ms int, sector_2_ms int, sector_3_ms int")


def lap_verdicts(spark, rows):
    """Rows without a session number are of session 1; verdicts are those of session 1."""
    numbered = [r if len(r) == 10 else (r[0], 1, *r[1:]) for r in rows]
    return {r.check: (r.verdict, r.value) for r in quality.lap_checks(spark.createDataFrame(numbered, LAPS)).collect()
            if r.session_no == 1}


def test_laps(spark):
    good = [("a", i + 1, 100_000, i != 1, 50.0 - 3 * i, i, 30_000, 30_000, 40_000 + i) for i in range(4)]
    got = lap_verdicts(spark, good)
    assert {v for v, _ in got.values()} == {"ok"}
    assert got["fuel_decreasing"][1] == 3.0
    bad = lap_verdicts(spark, [("a", 2, 70_000, True, 50.0, 0, 1, 1, 1), ("a", 3, 85_000, True, 55.0, 1, 30_000, 30_000, 25_101)])
    assert bad["lap_time_plausible"] == ("fail", 1.0) and bad["lap_time_realistic"] == ("fail", 2.0)
    assert bad["laps_in_turn"] == ("fail", 1.0) and bad["fuel_decreasing"][0] == "warn"
    assert bad["has_invalid_lap"] == ("fail", 0.0) and bad["sectors_add_up"] == ("fail", 2.0)
    late = [("a", 1, 100_000, False, 9.0, 5, 1, 1, 99_998), ("a", 2, 100_000, True, 8.0, 4, 1, 1, 99_998)]
    assert lap_verdicts(spark, late)["laps_in_turn"] == ("fail", 2.0)
    again = [("a", 2, *r[1:]) for r in good]  # the next session of the stream begins with lap 1 again
    assert {v for v, _ in lap_verdicts(spark, good + again).values()} == {"ok"}
    assert lap_verdicts(spark, good[:1])["fuel_decreasing"] == (None, None)


def test_events(spark):
    ddl = "session_id string, session_no long, event_type string, total_laps int"
    rows = [("a", 1, "session_start", None), ("a", 1, "session_end", 3), ("b", 1, "session_start", None),
            ("c", 1, "session_end", 0), ("a", 2, "session_start", None), ("a", 2, "session_start", None),
            ("a", 2, "session_end", 3), ("a", 3, "session_start", None), ("a", 3, "session_end", 0)]
    got = {(r.session_id, r.session_no): (r.verdict, r.one_of_each, r.ends_with_laps)
           for r in quality.event_checks(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {("a", 1): ("ok", True, 1), ("b", 1): ("warn", False, 0), ("c", 1): ("fail", False, 0),
                   ("a", 2): ("warn", False, 1), ("a", 3): ("warn", True, 0)}


@pytest.mark.parametrize("bias, verdict", [(0.57, "warn: 0-1 scale"), (57.0, "ok"), (90.0, "warn: unusual")])
def test_brake_bias(samples, bias, verdict):
    rows = [{"brake_bias": 0.0 if i % 2 else bias} for i in range(140)]
    row = quality.brake_bias_checks(samples(rows)).first()
    assert (row.verdict, row.bias_max) == (verdict, bias)


def test_reports(spark, samples):
    ddl = ("session_id string, session_no long, lap_number int, lap_time_ms int, is_valid boolean, fuel_remaining double, "
           "tyre_temp_fl double, avg_tyre_temp_fl double, avg_tyre_temp_fr double")
    rows = [("a", 1, 1, 61_500, None, None, None, 81.0, 82.0)]
    row = quality.lap_report(spark.createDataFrame(rows, ddl)).first()
    assert (row.time, row.is_valid, row.fuel, row.fl, row.fr, row.rl) == ("1:01.500", True, 0.0, 81.0, 82.0, 0.0)
    line = quality.setup_report(sessions.setup_snapshots(samples([{"tc_cut": None}]))).first().line
    assert line == "Lap 0: TC=1 TCCut=? ABS=2 BB=57.0 Map=1"
