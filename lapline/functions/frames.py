"""Row-wise steps that take and give whole frames: no shuffle in any of them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapline import fixed_values as fixed
from lapline import schemas
from lapline.functions import columns as C


def flatten_wheels(nested: DataFrame) -> DataFrame:
    """``wheel_fl.pressure`` and its kind become ``tyre_pressure_fl`` and its kind."""
    wheels = [
        F.col(f"wheel_{wheel}.{field}").alias(f"{prefix}_{wheel}")
        for field, prefix in fixed.WHEEL_METRICS
        for wheel in fixed.WHEELS
    ]
    flat = nested.select(
        *[c for c in nested.columns if c not in {f"wheel_{w}" for w in fixed.WHEELS}], *wheels
    )
    extra = [c for c in flat.columns if c not in schemas.SAMPLE.names]
    return flat.select(*[c for c in schemas.SAMPLE.names if c in flat.columns], *extra)


def decode_codes(raw: DataFrame) -> DataFrame:
    """Integer status, session type, grip and rain codes to their names."""
    return raw.withColumns({
        "status": C.status_name(F.col("status")),
        "session_type": C.session_type_name(F.col("session_type")),
        "track_grip": C.grip_name(F.col("track_grip")),
        "rain_intensity": C.rain_name(F.col("rain_intensity")),
    })


def usable(samples: DataFrame) -> DataFrame:
    """Samples taken while the game was on and the car and track were known."""
    return samples.where((F.col("status") != "off") & (F.col("car") != "") & (F.col("track") != ""))


def with_derived(samples: DataFrame) -> DataFrame:
    """The five columns the batch job adds."""
    return samples.withColumns({
        "timestamp_parsed": C.parsed_time(samples),
        "avg_tyre_temp": C.wheel_mean("tyre_temp"),
        "avg_tyre_pressure": C.wheel_mean("tyre_pressure"),
        "is_heavy_braking": C.heavy_braking(),
        "is_full_throttle": C.full_throttle(),
    })


def on_track(samples: DataFrame) -> DataFrame:
    """Live samples outside the pit."""
    return samples.where(C.is_live() & C.out_of_pit())


def stamped(samples: DataFrame) -> DataFrame:
    """When Spark processed the row."""
    return samples.withColumn("processed_at", F.current_timestamp())


def narrow_to_lap_file(samples: DataFrame) -> DataFrame:
    """Names, order and types of a lap file."""
    renamed = samples.withColumn("timestamp_wall", C.parsed_time(samples)).withColumnRenamed(
        "completed_laps", "lap_number"
    )
    return renamed.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.LAP_FILE.fields]
    )


def present(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns that exist, under their display names."""
    return df.select(*[F.col(c).alias(label) for c, label in wanted.items() if c in df.columns])


SUMMARY_DISPLAY = {
    "completed_laps": "Lap", "lap_time": "Time", "max_speed": "Max Spd", "avg_speed": "Avg Spd",
    "avg_temp": "Avg Tyre °C", "avg_fuel": "Fuel (L)", "sample_count": "Samples",
}


def summary_display(summary: DataFrame) -> DataFrame:
    """The session table: time label, mean tyre temperature, display names."""
    mean = (F.col("avg_temp_fl") + F.col("avg_temp_fr")
            + F.col("avg_temp_rl") + F.col("avg_temp_rr")) / 4
    shown = summary.withColumn("lap_time", C.lap_time_label(F.col("lap_time_ms"))).withColumn(
        "avg_temp", F.bround(mean, 1)
    )
    return present(shown, {c: c for c in ("session_id",)} | SUMMARY_DISPLAY)


def csv_text(samples: DataFrame) -> DataFrame:
    """Every column as the text a recording holds: fixed decimals, True/False, ISO time."""
    def text(field):
        column = F.col(field.name)
        if field.name == "timestamp_wall" and field.dataType.typeName() != "string":
            return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        digits = fixed.CSV_DECIMALS.get(field.name, fixed.CSV_DECIMALS.get(field.name[:-3]))
        if digits is not None:
            return C.fixed_decimals(column, digits)
        if field.dataType.typeName() == "boolean":
            return F.initcap(column.cast("string"))
        return column.cast("string")

    return samples.select(*[text(f).alias(f.name) for f in samples.schema.fields])


def typed_from_text(df: DataFrame, schema=schemas.LAKE_SAMPLE) -> DataFrame:
    """Text columns to their types; what does not parse becomes NULL."""
    return df.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name)
          for f in schema.fields if f.name in df.columns]
    )
