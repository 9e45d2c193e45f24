"""Column expressions against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from lapline import fixed_values as fixed
from lapline import schemas
from lapline.functions import columns as C
from lapline.functions import frames
from lapline.operators import laps, wheels


def one(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def test_lap_time_label(spark):
    got = one(spark, [None, 0, -5, 1, 59999, 60000, 107123, 3600000], "int", C.lap_time_label)
    assert got == ["--:--.---"] * 3 + ["0:00.001", "0:59.999", "1:00.000", "1:47.123", "60:00.000"]


def test_delta_label(spark):
    assert one(spark, [1500, 0, -250], "int", C.delta_label) == ["+1.500s", "0.000s", "-0.250s"]
    assert one(spark, [1, 0, -1], "int", C.delta_band) == ["warn", "good", "good"]


@pytest.mark.parametrize("digits", [1, 2, 3, 4, 6])
def test_fixed_decimals_are_those_of_python(spark, digits):
    import numpy as np
    values = [0.0, 0.125, 2.5, -0.001, 1234.5678, 0.05, 99.995, -7.0, 2.675, 1e-9, 300.25]
    values += list(np.random.default_rng(1).normal(0, 300, 300))
    floats = [float(np.float32(v)) for v in values]
    got = one(spark, floats, "float", lambda v: C.fixed_decimals(v, digits))
    assert got == [f"{v:.{digits}f}" for v in floats]
    assert one(spark, [None, math.inf], "double", lambda v: C.fixed_decimals(v, digits))[0] is None


def test_codes(spark):
    assert one(spark, [0, 1, 2, 3, 4, None], "int", C.status_name) == [
        "off", "replay", "live", "pause", "unknown", "unknown"]
    assert one(spark, [-1, 0, 5, 6, 7, 8], "int", C.session_type_name) == [
        "unknown", "practice", "unknown", "unknown", "hotstint", "superpole"]
    assert one(spark, [6, 7], "int", C.grip_name) == ["flooded", "unknown"]
    assert one(spark, [0, 5], "int", C.rain_name) == ["no_rain", "thunderstorm"]


def test_brake_bias(spark):
    got = one(spark, ["12", "3", "2", "99", None], "string", lambda car: C.brake_bias_percent(F.lit(0.70), car))
    assert [round(x, 6) for x in got] == [63.0, 56.0, 53.0, 65.0, 65.0]


def test_names(spark):
    assert one(spark, [7, 123, 1234], "int", C.lap_file_name) == ["lap_007", "lap_123", "lap_1234"]
    assert one(spark, ["Audi R8 LMS"], "string", C.path_safe) == ["Audi_R8_LMS"]
    name = C.session_name(F.lit("ACC"), F.lit("2026-03-30 12:01:02").cast("timestamp"), F.lit("Brands Hatch"), F.lit("GT3"))
    assert one(spark, [1], "int", lambda _: name) == ["acc_20260330_120102_brands_hatch_gt3"]
    assert one(spark, [0, 1, 2, 7], "int", C.gear_label) == ["R", "N", "1", "6"]


def test_bands(spark):
    assert one(spark, [3.5, 3.6], "double", C.fuel_used_band) == ["", "warn"]
    assert one(spark, [75.0, 75.1, 100.0, 100.1], "double", C.tyre_temp_band) == ["", "good", "good", "warn"]
    assert one(spark, [2.9, 3.0], "double", C.laps_left_band) == ["warn", "good"]


def test_time_parsing_never_fails(spark):
    got = one(spark, ["2026-03-30T12:00:00.250+02:00", "bad", None], "string", lambda _: C.parse_time("v"))
    assert got[0].isoformat().startswith("2026-03-30T10:00:00.25") and got[1:] == [None, None]


def test_pit_filter_drops_unknown_flags(samples):
    t = samples([{"is_in_pit": False}, {"is_in_pit": None}, {"is_in_pit": True}, {"status": "replay"}])
    assert frames.on_track(t).count() == 1
    counts = laps.filter_counts(t).first()
    assert (counts.total, counts.live, counts.kept) == (4, 3, 1)


def test_two_means_of_tyres(samples):
    t = samples([{"tyre_temp_fl": None, "tyre_temp_fr": 90.0}, {"tyre_temp_fl": 60.0}])
    rows = frames.with_derived(t).orderBy("timestamp_wall").collect()
    assert rows[0].avg_tyre_temp is None and rows[1].avg_tyre_temp == 75.0
    headline = laps.lap_headline(t).first()
    assert headline.avg_tyre_temp == pytest.approx((90 + 80 + 80 + 60 + 80 + 80 + 80) / 7)


def test_absent_column_in_tyre_balance(samples):
    rows = {r.axle: (r.left, r.right) for r in wheels.tyre_balance(samples([{}]).drop("tyre_temp_rl")).collect()}
    assert rows == {"Front": (80.0, 80.0), "Rear": (0.0, 80.0)}


def test_flatten_and_variants(spark):
    nested = spark.createDataFrame([], schemas.NESTED_SAMPLE)
    assert frames.flatten_wheels(nested).columns == schemas.SAMPLE.names
    assert [len(s) for s in (schemas.SAMPLE, schemas.LAKE_SAMPLE, schemas.ETL_SAMPLE, schemas.LAP_FILE)] == [76, 77, 49, 55]
    narrow = frames.narrow_to_lap_file(spark.createDataFrame([], schemas.LAKE_SAMPLE))
    assert narrow.schema == schemas.LAP_FILE


def test_display_takes_what_exists(samples):
    summary = laps.multi_lap_summary(samples([{}])).drop("avg_fuel")
    shown = frames.summary_display(summary)
    assert shown.columns == ["session_id", "Lap", "Time", "Max Spd", "Avg Spd", "Avg Tyre °C", "Samples"]


def test_usable(samples):
    t = samples([{}, {"status": "off"}, {"car": ""}, {"track": ""}, {"status": "replay"}])
    assert frames.usable(t).count() == 2


def test_text_to_types(spark):
    df = spark.createDataFrame([("12.5", "True", "x", "7")], "speed_kmh string, is_in_pit string, rpm string, gear string")
    row = frames.typed_from_text(df).first()
    assert (row.speed_kmh, row.is_in_pit, row.rpm, row.gear) == (12.5, True, None, 7)


def test_guards(samples):
    t = samples([{"fuel_per_lap": 0.0, "speed_kmh": 0.0}])
    assert laps.fuel_forecast(t).first().laps_left == 0.0
    assert laps.normalized_speed(t).first().speed_normalized is None
    assert laps.braking_stats(t).first().heavy_percent == 0.0


def test_best_lap_and_burn(spark):
    summary = spark.createDataFrame(
        [("a", 0, 0, 50.0), ("a", 1, 95000, 47.0), ("a", 2, 95000, 45.0), ("a", 4, 99000, 60.0)],
        "session_id string, completed_laps int, lap_time_ms int, avg_fuel double")
    rows = laps.lap_progression(summary).orderBy("completed_laps").collect()
    assert [(r.completed_laps, r.is_best, r.label) for r in rows] == [
        (1, True, "1:35.000"), (2, False, "1:35.000"), (4, False, "1:39.000")]
    burn = laps.fuel_burn(summary).orderBy("completed_laps").collect()
    assert [r.burn for r in burn] == [0.0, 3.0, 2.0, 15.0]  # refuelling looks like burn


def test_wheel_constants_match_schema():
    assert [f"{p}_{w}" for _, p in fixed.WHEEL_METRICS for w in fixed.WHEELS] == [
        n for n in schemas.SAMPLE.names if n[-3:] in ("_fl", "_fr", "_rl", "_rr")]
