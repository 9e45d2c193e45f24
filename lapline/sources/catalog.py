"""Database, external tables and SQL."""

from pyspark.sql import DataFrame, SparkSession

from lapline import schemas
from lapline.sinks.versions import Folder
from lapline.sources.files import PART

# Fixed columns of the processed table as declared.
PROCESSED_COLUMNS = (
    "timestamp_wall timestamp_game car track session_type status current_lap_time_ms "
    "last_lap_time_ms best_lap_time_ms distance_into_lap normalized_position current_sector "
    "throttle brake steering speed_kmh gear rpm fuel_remaining g_lat g_lon "
    "tyre_temp_fl tyre_temp_fr tyre_temp_rl tyre_temp_rr"
).split()
_DERIVED = ("avg_tyre_temp DOUBLE, avg_tyre_pressure DOUBLE, is_heavy_braking BOOLEAN, "
            "is_full_throttle BOOLEAN, timestamp_parsed TIMESTAMP")
_SUMMARY = (
    "session_id STRING, completed_laps INT, car STRING, track STRING, max_speed_kmh FLOAT, "
    "avg_speed_kmh DOUBLE, avg_tyre_temp DOUBLE, avg_tyre_pressure DOUBLE, avg_fuel DOUBLE, "
    "min_fuel FLOAT, heavy_braking_count BIGINT, full_throttle_count BIGINT, sample_count BIGINT, "
    "lap_start_time TIMESTAMP, lap_end_time TIMESTAMP"
)


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql("CREATE DATABASE IF NOT EXISTS IDENTIFIER(:name)", args={"name": name})


def _quoted(*parts: str) -> str:
    """A name as SQL takes it, whatever letters it has."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _columns(names) -> str:
    types = {f.name: f.dataType.simpleString() for f in schemas.LAKE_SAMPLE.fields}
    return ", ".join(f"{name} {types[name]}" for name in names)


def create_tables(spark: SparkSession, database: str, raw: str, telemetry: str, summary: str) -> None:
    """telemetry_raw (JSON), telemetry_processed (Parquet by session and lap, or by part), lap_summary.

    telemetry_raw is a view of the files below ``raw`` that leaves out event files by their folder.
    """
    create_database(spark, database)
    in_parts = Folder(spark, telemetry).names(f"{PART}=*")
    processed, folders = (f", {PART} INT", PART) if in_parts else ("", "session_id, completed_laps")
    tables = {
        "telemetry_files": (_columns(schemas.LAKE_SAMPLE.names), "json", "", raw,
                            " OPTIONS (recursiveFileLookup 'true')"),
        "telemetry_processed": (
            f"{_columns(PROCESSED_COLUMNS)}, {_DERIVED}, session_id STRING, completed_laps INT{processed}",
            "parquet", f" PARTITIONED BY ({folders})", telemetry, ""),
        "lap_summary": (_SUMMARY, "parquet", "", summary, ""),
    }
    for name, (columns, source, partitions, location, options) in tables.items():
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_quoted(database, name)} ({columns}) USING {source}"
            f"{options}{partitions} LOCATION {_text(location)}"
        )
    spark.sql(
        f"CREATE OR REPLACE VIEW {_quoted(database, 'telemetry_raw')} AS "
        f"SELECT * FROM {_quoted(database, 'telemetry_files')} "
        "WHERE NOT contains(_metadata.file_path, '/events/')"
    )


def repair_table(spark: SparkSession, name: str) -> None:
    """Find partitions that were written next to the table."""
    spark.sql(f"MSCK REPAIR TABLE {_quoted(*name.split('.'))}")


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """SQL with named parameters (``:name``)."""
    return spark.sql(sql, args=args)
