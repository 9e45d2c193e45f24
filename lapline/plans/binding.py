"""The ``events`` table seen as telemetry samples.

Each user is a stream, each six days a lap; every column is a stated function of the
row, so SQL over the same table gives the same samples.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapline import fixed_values as fixed

LAP_US = 518_400_000_000

_WHEEL_OFFSETS = {"fl": 2.0, "fr": 0.0, "rl": -3.0, "rr": -1.5}
_PRESSURE = {"fl": 27.4, "fr": 27.1, "rl": 26.8, "rr": 26.9}

#: column -> expression over (event_id, ts, user_id, event_type, value, k, us); valid in
#: both Spark SQL and DuckDB
COLUMNS = {
    "timestamp_wall": "ts",
    "timestamp_game": "us / 1e6",
    "session_id": "concat('s', user_id)",
    "car": "CASE WHEN user_id % 2 = 0 THEN 'Ferrari 488 GT3' ELSE 'Audi R8 LMS' END",
    "track": "CASE WHEN user_id % 2 = 0 THEN 'Monza' ELSE 'Circuit de Spa-Francorchamps' END",
    "session_type": "CASE user_id % 3 WHEN 0 THEN 'practice' WHEN 1 THEN 'qualify' ELSE 'race' END",
    "status": "CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 'off' "
              "WHEN event_type = 'error' THEN 'pause' "
              "WHEN event_type = 'view' AND k % 10 = 0 THEN 'replay' ELSE 'live' END",
    "completed_laps": f"CAST(floor(us / {LAP_US}e0) AS INT)",
    "current_lap_time_ms": f"CAST(floor((us % {LAP_US}) / 1000e0) AS INT)",
    "last_lap_time_ms": "CAST(78000 + k * 700 AS INT)",
    "best_lap_time_ms": "CAST(77000 + k * 600 AS INT)",
    "distance_into_lap": f"(us % {LAP_US}) / {LAP_US}e0 * 5793e0",
    "normalized_position": f"(us % {LAP_US}) / {LAP_US}e0",
    "current_sector": "k % 3",
    "last_sector_time_ms": "CAST(30000 + k * 10 AS INT)",
    "is_valid_lap": "event_type <> 'click'",
    "is_in_pit": "CASE WHEN k = 99 THEN NULL ELSE event_type = 'signup' END",
    "is_in_pit_lane": "event_type = 'signup' AND k > 50",
    "throttle": "1e0 - k / 100e0",
    "brake": "k / 100e0",
    "steering": "(k - 50) / 50e0",
    "clutch": "(k % 4) / 4e0",
    "speed_kmh": "value",
    "gear": "k % 8",
    "rpm": "CAST(4000 + k * 40 AS INT)",
    "fuel_remaining": f"50e0 - 8e0 * floor(us / {LAP_US}e0) - (us % {LAP_US}) / {LAP_US}e0 * 5.793e0",
    "fuel_per_lap": "(k % 5) * 0.5e0",
    "g_lat": "(k - 50) / 25e0",
    "g_lon": "(value - 50e0) / 100e0",
    "g_vert": "1e0 + (k % 7) / 100e0",
    **{f"tyre_pressure_{w}": f"{_PRESSURE[w]}e0 + k * 0.01e0" for w in fixed.WHEELS},
    **{f"tyre_temp_{w}": f"70e0 + k * 0.4e0 + {_WHEEL_OFFSETS[w]}e0" for w in fixed.WHEELS},
    **{
        f"{prefix}_{w}": f"{base}e0 + k * {slope}e0 + {_WHEEL_OFFSETS[w]}e0"
        for prefix, base, slope in (
            ("tyre_inner_temp", 72.0, 0.4), ("tyre_middle_temp", 70.0, 0.4),
            ("tyre_outer_temp", 68.0, 0.4), ("tyre_slip", 5.0, 0.01),
            ("suspension_travel", 6.0, 0.01), ("brake_temp", 300.0, 9.0), ("tyre_wear", 4.0, 0.001),
        ) for w in fixed.WHEELS
    },
    "tc_level": "k % 3",
    "tc_cut": "k % 2",
    "abs_level": "k % 5",
    "engine_map": "k % 4",
    "brake_bias": "CASE WHEN k % 6 = 5 THEN 57.005e0 ELSE 57e0 + (k % 4) * 0.5e0 END",
    "air_temp": "20e0 + k % 10",
    "road_temp": "30e0 + k % 15",
    "track_grip": "CASE WHEN k % 2 = 0 THEN 'optimum' ELSE 'fast' END",
    "rain_intensity": "CASE WHEN k % 9 = 0 THEN 'drizzle' ELSE 'no_rain' END",
    "wind_speed": "(k % 12) / 2e0",
    "wind_direction": "k * 3.6e0",
    "packet_id": "event_id",
}

# seconds with six decimals between two timestamps without a zone, so no session zone enters
_BASE = (
    "CAST(get_json_object(props, '$.k') AS INT) AS k",
    "CAST(CAST(CAST(ts - TIMESTAMP_NTZ'2024-01-01 00:00:00' AS INTERVAL SECOND) "
    "AS DECIMAL(20, 6)) * 1000000 AS BIGINT) AS us",
)

#: the same samples in DuckDB: a WITH clause that ends in ``t``
WITH_SAMPLES = (
    "WITH base AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, "
    "epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM events), "
    "t AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM base)"
)


def samples_of(events: DataFrame) -> DataFrame:
    keep = ("event_id", "ts", "user_id", "event_type", "value")
    return events.selectExpr(*keep, *_BASE).selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()])


EVENTS = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
          "props string")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of(spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet"))


def sample_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 100) -> DataFrame:
    """The same samples as a stream over the same files."""
    return samples_of(
        spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    )
