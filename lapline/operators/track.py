"""Samples against the corners, sectors and braking zones of their track."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapline.operators.laps import LAP
from lapline.operators.ordered import ROWS_PER_SLICE, Slices, order_key, time_order
from lapline.operators.sessions import KEY, SESSION

CELL_M = 100
#: Parts of a (track, cell): samples are dealt to them by lap, zones are in all of them.
PARTS = 16
DISTANCE = "distance_into_lap"


def resolve_tracks(df: DataFrame, tracks: DataFrame) -> DataFrame:
    """Adds ``track_id``: the first known track whose name or id is part of ``track``.

    ``tracks`` has track_id, track_name and ``file`` for the order. The list is one value
    of the plan (a scalar subquery), so samples are neither joined nor shuffled. A name or
    id that is NULL or empty is part of no text.
    """
    listed = tracks.select("file", "track_id", F.lower("track_name").alias("name")).distinct().agg(
        F.array_sort(F.collect_list(F.struct("file", "track_id", "name"))).alias("listed")).scalar()
    here = F.lower(F.col("track"))

    def part(text: Column) -> Column:
        return F.coalesce((text != "") & here.contains(text), F.lit(False))

    known = F.filter("_listed", lambda t: part(t["name"]) | part(F.lower(t["track_id"])))
    return df.withColumn("_listed", listed).withColumn(
        "track_id", F.try_element_at(known, F.lit(1))["track_id"]).drop("_listed")


def join_zones(samples: DataFrame, zones: DataFrame, lo: str, hi: str,
               closed: bool = True) -> DataFrame:
    """Samples with every zone of their track that holds their distance.

    Zones are spread over 100 m cells, so the join compares a sample only with zones near
    it, and over parts, so that a track whose zones are too many for Spark to broadcast is
    still dealt over cells x parts.
    """
    d = F.col(DISTANCE)
    cells = zones.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col(lo) / CELL_M), F.floor(F.col(hi) / CELL_M)))
    ).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    inside = (d >= F.col(lo)) & ((d <= F.col(hi)) if closed else (d < F.col(hi)))
    part = F.pmod(F.xxhash64(*LAP), F.lit(PARTS)).cast("int")
    return samples.withColumns({"_cell": F.floor(d / CELL_M), "_part": part}).join(
        cells, ["track_id", "_cell", "_part"]
    ).where(inside).drop("_cell", "_part")


def corner_stats(samples: DataFrame, corners: DataFrame, keys=tuple(LAP)) -> DataFrame:
    """Lowest and mean speed in each corner against its reference range.

    Corners without samples give no row; a sample on a shared border counts in both.
    """
    inside = join_zones(resolve_tracks(samples, corners), corners.drop("track_name", "file"),
                        "entry_m", "exit_m")
    return inside.groupBy(*keys, "corner", "ref_low", "ref_high").agg(
        F.min("speed_kmh").alias("min_speed"), F.avg("speed_kmh").alias("avg_speed")
    ).select(
        *keys, F.replace(F.col("corner"), F.lit("_"), F.lit(" ")).alias("corner"),
        "min_speed", "avg_speed", "ref_low", "ref_high",
        (F.col("min_speed") - F.col("ref_low")).alias("delta_to_ref_low"),
    )


def samples_in_corners(samples: DataFrame, corners: DataFrame) -> DataFrame:
    return join_zones(resolve_tracks(samples, corners), corners.drop("track_name", "file"),
                      "entry_m", "exit_m")


def sector_times(samples: DataFrame, sectors: DataFrame, keys=tuple(LAP)) -> DataFrame:
    """Lap time at the end of each of three sectors, less that at the end of the one before.

    They add up to the lap time; a sector without samples is NULL.
    """
    inside = join_zones(resolve_tracks(samples, sectors), sectors.drop("track_name", "file"),
                        "start_m", "end_m", closed=False)
    ms = F.col("current_lap_time_ms")

    def end_of(number: int) -> Column:
        return F.max(F.when(F.col("sector") == number, ms))

    ends = inside.groupBy(*keys).agg(
        *[end_of(i).alias(f"_e{i}") for i in (1, 2, 3)], F.max(ms).alias("lap_time_ms")
    )
    before = {1: F.lit(0), 2: F.coalesce("_e1", F.lit(0)), 3: F.coalesce("_e2", "_e1", F.lit(0))}
    return ends.select(
        *keys, *[(F.col(f"_e{i}") - before[i]).alias(f"sector_{i}_ms") for i in (1, 2, 3)],
        "lap_time_ms",
    )


def sector_crossings(samples: DataFrame, sectors: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Times of three sectors of a lap from the moments at which it first passes their borders.

    A border lies between two samples of a lap that follow each other; the moment is on the straight line between
    theirs. So what a sector loses the next one gains, and the three add up to the lap's time, that of its last
    sample. A sector is NULL where no two samples lie around one of its borders, as on a track that isn't known.
    Samples without a distance or lap time are left out.
    """
    ms = "current_lap_time_ms"
    timed = resolve_tracks(samples, sectors).where(F.col(DISTANCE).isNotNull() & F.col(ms).isNotNull())
    slices = Slices(timed, KEY, time_order(samples), rows_per_slice)
    seen = slices.look_back(_p=slices.previous("completed_laps", DISTANCE, ms)).result
    # two borders for each track, one value of the plan
    borders = sectors.groupBy("track_id").agg(*[
        F.max(F.when(F.col("sector") == i, F.col("start_m"))).alias(f"_{i}") for i in (2, 3)]).agg(
        F.map_from_entries(F.collect_list(F.struct("track_id", F.struct("_2", "_3"))))).scalar()
    border = F.try_element_at(borders, F.coalesce("track_id", F.lit("")))
    here, before = F.col(DISTANCE), F.col(f"_p.{DISTANCE}")

    def passed(i: int) -> Column:
        at = F.col("_border")[f"_{i}"]
        share = (at - before) / (here - before)
        return F.min(F.when(F.col("_p.completed_laps").eqNullSafe(F.col("completed_laps")) & (before < at) & (here >= at),
                            F.col(f"_p.{ms}") + share * (F.col(ms) - F.col(f"_p.{ms}"))))

    laps = seen.withColumn("_border", border).groupBy(*LAP).agg(
        passed(2).alias("_e1"), passed(3).alias("_e2"), F.max(ms).cast("double").alias("lap_time_ms"))
    return laps.select(*LAP, F.col("_e1").alias("sector_1_ms"), (F.col("_e2") - F.col("_e1")).alias("sector_2_ms"),
                       (F.col("lap_time_ms") - F.col("_e2")).alias("sector_3_ms"), "lap_time_ms")


def lap_records(samples: DataFrame, completions: DataFrame, sectors: DataFrame) -> DataFrame:
    """Lap completions with the sector times, fuel used and mean temperatures of their lap.

    ``samples`` and ``completions`` have session_no. A completion carries the new count, so
    it belongs to the samples of the count before.
    """
    lap = [*SESSION, "completed_laps"]
    times = sector_times(samples, sectors, lap).drop("lap_time_ms")
    used = samples.groupBy(*lap).agg(
        (F.max("fuel_remaining") - F.min("fuel_remaining")).alias("fuel_used"),
        *[F.avg(f"tyre_temp_{w}").alias(f"avg_tyre_temp_{w}") for w in ("fl", "fr", "rl", "rr")],
    )
    facts = used.join(times, lap, "left").withColumn(
        "lap_number", F.col("completed_laps") + 1).drop("completed_laps")
    return completions.join(facts, [*SESSION, "lap_number"], "left")


def braking_zones(samples: DataFrame, corners: DataFrame, keys=tuple(LAP),
                  brake_on: float = 0.05) -> DataFrame:
    """First brake point, peak brake, entry and lowest speed from braking start to apex."""
    inside = join_zones(resolve_tracks(samples, corners), corners.drop("track_name", "file"),
                        "brake_m", "apex_m")
    return inside.groupBy(*keys, "corner").agg(
        F.min(F.when(F.col("brake") > brake_on, F.col(DISTANCE))).alias("brake_point_m"),
        F.max("brake").alias("peak_brake"),
        F.min_by("speed_kmh", order_key(samples)).alias("entry_speed"),
        F.min("speed_kmh").alias("min_speed"),
    )


def corner_time_loss(losses: DataFrame, corners: DataFrame) -> DataFrame:
    """Time lost to the best lap between the first and last grid point of each corner.

    ``losses`` are the rows of ``time_loss`` with their ``track``.
    """
    known = losses.where(F.col("time_delta_ms").isNotNull())
    inside = join_zones(resolve_tracks(known, corners), corners.drop("track_name", "file"),
                        "entry_m", "exit_m")
    return inside.groupBy(*LAP, "corner").agg(
        (F.max_by("time_delta_ms", "grid_i") - F.min_by("time_delta_ms", "grid_i"))
        .alias("lost_ms"),
    )
