"""One telemetry schema; every other variant is derived from it."""

from pyspark.sql import types as T

from lapline import fixed_values as fixed

_KINDS = {
    "string": T.StringType(), "float": T.FloatType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
    "double": T.DoubleType(),
}


def _fields(ddl: str) -> list[T.StructField]:
    """Fields from ``name type, ...``, without a session."""
    return [T.StructField(name, _KINDS[kind]) for name, kind in map(str.split, ddl.split(", "))]


# Fixed column order of a recording.
_HEAD = _fields(
    "timestamp_wall string, timestamp_game float, car string, track string, "
    "session_type string, status string, completed_laps int, current_lap_time_ms int, "
    "last_lap_time_ms int, best_lap_time_ms int, distance_into_lap float, "
    "normalized_position float, current_sector int, last_sector_time_ms int, "
    "is_valid_lap boolean, is_in_pit boolean, is_in_pit_lane boolean, throttle float, "
    "brake float, steering float, clutch float, speed_kmh float, gear int, rpm int, "
    "fuel_remaining float, fuel_per_lap float, g_lat float, g_lon float, g_vert float"
)
_WHEEL_COLUMNS = [
    T.StructField(f"{prefix}_{wheel}", T.FloatType())
    for _, prefix in fixed.WHEEL_METRICS
    for wheel in fixed.WHEELS
]
_TAIL = _fields(
    "tc_level int, tc_cut int, abs_level int, engine_map int, brake_bias float, "
    "air_temp float, road_temp float, track_grip string, rain_intensity string, "
    "wind_speed float, wind_direction float"
)
_SESSION = T.StructField("session_id", T.StringType())

#: 76 columns: one flat sample as recorded.
SAMPLE = T.StructType(_HEAD + _WHEEL_COLUMNS + _TAIL)

#: 77 columns: a sample in the lake, which also names its session.
LAKE_SAMPLE = T.StructType(SAMPLE.fields[:2] + [_SESSION] + SAMPLE.fields[2:])

#: A row of a recording that shares its folder with other sessions; elsewhere the last column is not there.
RECORDING = T.StructType(SAMPLE.fields + [_SESSION])

_NARROW_WHEELS = ("tyre_pressure", "tyre_temp")
_DROPPED = {
    f"{prefix}_{wheel}"
    for _, prefix in fixed.WHEEL_METRICS if prefix not in _NARROW_WHEELS
    for wheel in fixed.WHEELS
}
#: 49 columns: what the batch job reads of a lake sample.
ETL_SAMPLE = T.StructType([f for f in LAKE_SAMPLE.fields if f.name not in _DROPPED])

#: A lake sample whose values were all written as JSON strings.
TEXT_SAMPLE = T.StructType([T.StructField(f.name, T.StringType()) for f in LAKE_SAMPLE.fields])

_WHEEL = T.StructType([T.StructField(f, T.FloatType()) for f, _ in fixed.WHEEL_METRICS])
#: A sample before its wheels are flattened.
NESTED_SAMPLE = T.StructType(
    _HEAD + [T.StructField(f"wheel_{w}", _WHEEL) for w in fixed.WHEELS] + _TAIL
)


def _lap_file() -> T.StructType:
    types = {f.name: f.dataType for f in LAKE_SAMPLE.fields}
    types |= {"timestamp_wall": T.TimestampType(), "lap_number": T.IntegerType()}
    small = ("current_sector", "gear", "tc_level", "tc_cut", "abs_level", "engine_map")
    types |= {name: T.ByteType() for name in small}
    wheels = ("tyre_temp", "tyre_pressure", "tyre_wear", "tyre_slip", "brake_temp",
              "suspension_travel")
    # Fixed column order of a lap file.
    names = (
        "timestamp_wall timestamp_game session_id car track session_type lap_number "
        "distance_into_lap normalized_position current_sector is_valid_lap "
        "throttle brake steering clutch speed_kmh gear rpm fuel_remaining g_lat g_lon g_vert"
    ).split()
    names += [f"{prefix}_{wheel}" for prefix in wheels for wheel in fixed.WHEELS]
    names += "tc_level tc_cut abs_level engine_map brake_bias".split()
    names += "air_temp road_temp track_grip rain_intensity".split()
    return T.StructType([T.StructField(name, types[name]) for name in names])


#: 55 columns: one sample in a per-lap file.
LAP_FILE = _lap_file()

SESSION_EVENT = T.StructType(_fields(
    "event_type string, session_id string, platform string, track string, car string, "
    "session_type string, timestamp string, total_laps int, best_lap_ms int"
))
_WHEELWISE = ", ".join(
    f"{prefix}_{wheel} double"
    for prefix in ("avg_tyre_temp", "tyre_temp", "tyre_pressure") for wheel in fixed.WHEELS
)
#: Both shapes of a lap completion: as recorded and as sent live.
LAP_COMPLETION = T.StructType(_fields(
    "session_id string, timestamp string, lap_number int, lap_time_ms int, is_valid boolean, "
    "fuel_remaining double, sector_1_ms int, sector_2_ms int, sector_3_ms int, fuel_used double, "
    "last_sector_time_ms int, " + _WHEELWISE
))
SETUP_SNAPSHOT = T.StructType(_fields(
    "session_id string, car string, track string, timestamp string, lap_applied_from int, "
    "lap_number int, tc_level int, tc_cut int, abs_level int, engine_map int, brake_bias double"
))
SETUP_CHANGE = T.StructType(_fields(
    "session_id string, parameter string, old_value double, new_value double, lap_number int, "
    "timestamp string"
))
_CORNER = T.StructType(
    _fields("entry_m int, apex_m int, exit_m int, braking_zone_start_m int")
    + [T.StructField("typical_speed_range_kmh", T.ArrayType(T.IntegerType()))]
)
TRACK_FILE = T.StructType(
    _fields("track_name string, track_id string, track_length_m int, sector_count int") + [
        T.StructField("sector_boundaries_m", T.ArrayType(T.IntegerType())),
        T.StructField("corners", T.MapType(T.StringType(), _CORNER)),
    ]
)
MESSAGE = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()), T.StructField("timestamp", T.TimestampType()),
])


def missing_columns(df, expected=SAMPLE) -> list[str]:
    """Expected columns that ``df`` lacks; extra ones are fine."""
    present = set(df.columns)
    return [name for name in expected.names if name not in present]
