"""Per-lap and per-session numbers. Grouped aggregates combine before they shuffle."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapline import fixed_values as fixed
from lapline.functions import columns as C
from lapline.operators.ordered import Slices, order_key, time_order

LAP = ["session_id", "completed_laps"]


def lap_summary(processed: DataFrame) -> DataFrame:
    """The lap summary table, from samples with the derived columns."""
    speed, fuel = F.col("speed_kmh"), F.col("fuel_remaining")
    return processed.groupBy(*LAP, "car", "track").agg(
        F.max(speed).alias("max_speed_kmh"),
        F.avg(speed).alias("avg_speed_kmh"),
        F.avg("avg_tyre_temp").alias("avg_tyre_temp"),
        F.avg("avg_tyre_pressure").alias("avg_tyre_pressure"),
        F.avg(fuel).alias("avg_fuel"),
        F.min(fuel).alias("min_fuel"),
        F.count_if("is_heavy_braking").alias("heavy_braking_count"),
        F.count_if("is_full_throttle").alias("full_throttle_count"),
        F.count(F.lit(1)).alias("sample_count"),
        F.min("timestamp_parsed").alias("lap_start_time"),
        F.max("timestamp_parsed").alias("lap_end_time"),
    )


SUMMARY = [*LAP, "car", "track"]
_MEANS = {"avg_speed_kmh": "speed_kmh", "avg_tyre_temp": "avg_tyre_temp",
          "avg_tyre_pressure": "avg_tyre_pressure", "avg_fuel": "fuel_remaining"}
_MERGED = {"max_speed_kmh": F.max, "min_fuel": F.min, "heavy_braking_count": F.sum, "full_throttle_count": F.sum,
           "sample_count": F.sum, "lap_start_time": F.min, "lap_end_time": F.max}


def lap_parts(processed: DataFrame) -> DataFrame:
    """What some of the samples add to the lap summary: means as sums and counts, so that parts can be merged."""
    speed, fuel = F.col("speed_kmh"), F.col("fuel_remaining")
    sums = [how(F.col(c).cast("double")).alias(f"{name}_{part}") for name, c in _MEANS.items()
            for part, how in (("sum", F.sum), ("n", F.count))]
    return processed.groupBy(*SUMMARY).agg(
        *sums, F.max(speed).alias("max_speed_kmh"), F.min(fuel).alias("min_fuel"),
        F.count_if("is_heavy_braking").alias("heavy_braking_count"),
        F.count_if("is_full_throttle").alias("full_throttle_count"), F.count(F.lit(1)).alias("sample_count"),
        F.min("timestamp_parsed").alias("lap_start_time"), F.max("timestamp_parsed").alias("lap_end_time"))


def merged_parts(parts: DataFrame) -> DataFrame:
    """One part for each lap."""
    sums = [F.sum(f"{name}_{part}").alias(f"{name}_{part}") for name in _MEANS for part in ("sum", "n")]
    return parts.groupBy(*SUMMARY).agg(*sums, *[how(c).alias(c) for c, how in _MERGED.items()])


def summary_of_parts(parts: DataFrame) -> DataFrame:
    """The lap summary table from the parts of all samples."""
    merged = merged_parts(parts)
    means = {name: F.try_divide(f"{name}_sum", f"{name}_n") for name in _MEANS}
    return merged.withColumns(means).select(
        *SUMMARY, "max_speed_kmh", *_MEANS, *[c for c in _MERGED if c != "max_speed_kmh"])


def _live_laps(samples: DataFrame) -> DataFrame:
    return samples.where(C.is_live() & F.col("completed_laps").isNotNull())


def multi_lap_summary(samples: DataFrame, session_id: str | None = None) -> DataFrame:
    """Eleven numbers per lap; of one session or of all of them."""
    laps = _live_laps(samples)
    if session_id is not None:
        laps = laps.where(F.col("session_id") == session_id)
    return laps.groupBy(*LAP).agg(
        F.max("speed_kmh").alias("max_speed"),
        F.avg("speed_kmh").alias("avg_speed"),
        F.max("current_lap_time_ms").alias("lap_time_ms"),
        *[F.avg(f"tyre_temp_{w}").alias(f"avg_temp_{w}") for w in fixed.WHEELS],
        F.avg("fuel_remaining").alias("avg_fuel"),
        F.min("fuel_remaining").alias("min_fuel"),
        F.avg("brake_bias").alias("avg_brake_bias"),
        F.count(F.lit(1)).alias("sample_count"),
        F.count("speed_kmh").alias("speed_count"),
    )


def sessions(samples: DataFrame) -> DataFrame:
    """All sessions with live samples."""
    return samples.where(C.is_live()).groupBy(
        "session_id", "car", "track", "session_type"
    ).agg(
        F.max("completed_laps").alias("total_laps"),
        F.min("timestamp_wall").alias("session_start"),
        F.max("timestamp_wall").alias("session_end"),
        F.avg("speed_kmh").alias("avg_speed"),
    )


def newest_sessions(samples: DataFrame, n: int) -> DataFrame:
    return head(sessions(samples), n, F.desc("session_start"), F.col("session_id"))


def available_laps(samples: DataFrame, session_id: str | None = None) -> DataFrame:
    laps = _live_laps(samples)
    if session_id is not None:
        laps = laps.where(F.col("session_id") == session_id)
    return laps.select(*LAP).distinct()


def other_laps(laps: DataFrame, selected: int) -> DataFrame:
    """The laps a selected one can be compared with."""
    return laps.where(F.col("completed_laps") != selected)


def lap_data(samples: DataFrame, session_id: str, lap: int) -> DataFrame:
    """Live samples of one lap in time order.

    On the processed table both conditions are on partition columns, so other laps
    are not even listed.
    """
    return samples.where(
        (F.col("session_id") == session_id) & (F.col("completed_laps") == lap) & C.is_live()
    ).orderBy(*time_order(samples))


def lap_summary_listing(summary: DataFrame, session_id: str | None = None) -> DataFrame:
    if session_id is not None:
        summary = summary.where(F.col("session_id") == session_id)
    return summary.orderBy(*LAP)


def head(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a stated order."""
    return df.orderBy(*order).limit(n)


def lap_headline(samples: DataFrame, keys=tuple(LAP)) -> DataFrame:
    """What the cards above a lap show, with their bands."""
    return samples.groupBy(*keys).agg(
        F.max("speed_kmh").alias("max_speed"),
        F.avg("speed_kmh").alias("avg_speed"),
        F.max("current_lap_time_ms").alias("lap_time_ms"),
        (F.max("fuel_remaining") - F.min("fuel_remaining")).alias("fuel_used"),
        F.max(C.peak_g()).alias("peak_g"),
        C.stacked_mean("tyre_temp").alias("avg_tyre_temp"),
    ).withColumns({
        "lap_time": C.lap_time_label(F.col("lap_time_ms")),
        "fuel_band": C.fuel_used_band(F.col("fuel_used")),
        "tyre_band": C.tyre_temp_band(F.col("avg_tyre_temp")),
    })


def lap_pair_deltas(samples: DataFrame, lap_a: int, lap_b: int) -> DataFrame:
    """Speeds and times of two laps side by side, per session that has both."""
    lap = F.col("completed_laps")
    values = {"max_speed": (F.max, "speed_kmh"), "avg_speed": (F.avg, "speed_kmh"),
              "lap_time_ms": (F.max, "current_lap_time_ms")}
    both = samples.where(lap.isin(lap_a, lap_b)).groupBy("session_id").agg(
        *[how(F.when(lap == number, F.col(column))).alias(f"{name}_{side}")
          for side, number in (("a", lap_a), ("b", lap_b))
          for name, (how, column) in values.items()],
        F.count_if(lap == lap_a).alias("_a"), F.count_if(lap == lap_b).alias("_b"),
    ).where("_a > 0 AND _b > 0").drop("_a", "_b")
    delta = F.col("delta_ms")
    return both.withColumn("delta_ms", F.col("lap_time_ms_a") - F.col("lap_time_ms_b")).withColumns(
        {"delta": C.delta_label(delta), "delta_band": C.delta_band(delta)}
    )


def braking_stats(samples: DataFrame, keys=tuple(LAP)) -> DataFrame:
    heavy = F.coalesce(F.count_if(C.heavy_braking()), F.lit(0))
    return samples.groupBy(*keys).agg(
        heavy.alias("heavy_samples"),
        F.when(F.count(F.lit(1)) > 0, heavy / F.count(F.lit(1)) * 100).otherwise(0.0)
        .alias("heavy_percent"),
        F.max("brake").alias("max_brake"),
    )


def g_stats(samples: DataFrame, keys=tuple(LAP)) -> DataFrame:
    return samples.groupBy(*keys).agg(
        F.max(F.abs("g_lat")).alias("max_lat_g"),
        F.min("g_lon").alias("max_braking_g"),
        F.max("g_lon").alias("max_accel_g"),
    )


def fuel_forecast(samples: DataFrame, keys=tuple(LAP)) -> DataFrame:
    """Fuel of the last sample, mean burn, and the laps that leaves."""
    burn, fuel = F.col("fuel_per_lap"), F.col("fuel_remaining")
    laps_left = F.when(burn > 0, fuel / burn).otherwise(0.0)
    return samples.groupBy(*keys).agg(
        F.max_by("fuel_remaining", order_key(samples)).alias("fuel_remaining"),
        F.avg("fuel_per_lap").alias("fuel_per_lap"),
    ).withColumn("laps_left", laps_left).withColumn(
        "laps_left_band", C.laps_left_band(F.col("laps_left"))
    )


def electronics_means(samples: DataFrame, keys=tuple(LAP)) -> DataFrame:
    return samples.groupBy(*keys).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in ("tc_level", "abs_level", "brake_bias")
          if c in samples.columns]
    )


def status_counts(samples: DataFrame, session_id: str | None = None) -> DataFrame:
    if session_id is not None:
        samples = samples.where(F.col("session_id") == session_id)
    return samples.groupBy(*LAP, "status").agg(F.count(F.lit(1)).alias("cnt"))


def gear_histogram(samples: DataFrame) -> DataFrame:
    """Share of each gear in all rows of its session."""
    counts = samples.groupBy("session_id", "gear").agg(F.count(F.lit(1)).alias("samples"))
    # one row per gear by now
    total = F.sum("samples").over(Window.partitionBy("session_id"))
    return counts.withColumn("percent", F.col("samples") / total * 100).where(
        F.col("gear").isNotNull()
    ).withColumn("label", C.gear_label(F.col("gear")))


def track_speed(samples: DataFrame) -> DataFrame:
    return samples.groupBy("track").agg(F.avg("speed_kmh").alias("avg_speed"))


def filter_counts(samples: DataFrame) -> DataFrame:
    """Rows read and rows kept, in one pass."""
    return samples.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(C.is_live()).alias("live"),
        F.count_if(C.is_live() & C.out_of_pit()).alias("kept"),
    )


def normalized_speed(samples: DataFrame, keys=tuple(LAP)) -> DataFrame:
    """Speed over the top speed of the lap; NULL where that is zero."""
    top = samples.groupBy(*keys).agg(F.max("speed_kmh").alias("_top"))
    order = time_order(samples)
    joined = Slices(samples, list(keys), order).join_per_key(top)
    share = F.when(F.col("_top") != 0, F.col("speed_kmh") / F.col("_top"))
    return joined.withColumn("speed_normalized", share).drop("_top")


def fuel_burn(summary: DataFrame) -> DataFrame:
    """Absolute change of the mean fuel from the lap before; 0 on the first lap."""
    laps = summary.select(*LAP, "avg_fuel")
    slices = Slices.of_numbers(laps, ["session_id"], ["completed_laps"])
    before = slices.look_back(before=slices.previous("avg_fuel")).result
    change = F.abs(F.col("avg_fuel") - F.col("before.avg_fuel"))
    return before.select(*LAP, F.coalesce(change, F.lit(0.0)).alias("burn"))


def lap_progression(summary: DataFrame) -> DataFrame:
    """Timed laps with seconds, label, and a flag on the first fastest one."""
    timed = summary.where(F.col("lap_time_ms") > 0).select(*LAP, "lap_time_ms")
    best = timed.groupBy("session_id").agg(
        F.min(F.struct("lap_time_ms", "completed_laps")).alias("best")
    )
    return timed.join(best, "session_id").select(
        *LAP, "lap_time_ms", (F.col("lap_time_ms") / F.lit(1000.0)).alias("lap_time_s"),
        C.lap_time_label(F.col("lap_time_ms")).alias("label"),
        (F.col("completed_laps") == F.col("best.completed_laps")).alias("is_best"),
    )
