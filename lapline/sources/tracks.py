"""The track dimension: from JSON files, or the built-in tracks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapline import fixed_values as fixed
from lapline.schemas import TRACK_FILE

_CORNERS = ("track_id string, corner string, entry_m int, apex_m int, exit_m int, "
            "brake_m int, ref_low int, ref_high int")
_SECTORS = "track_id string, track_name string, file string, sector int, start_m int, end_m int"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACK_FILE).option("multiLine", True).json(path).withColumn(
        "file", F.element_at(F.split("_metadata.file_path", "/"), -1)
    )


def read_corners(spark: SparkSession, path: str) -> DataFrame:
    """One row per corner of every track file; corner names are the keys of a JSON object."""
    return _files(spark, path).select(
        "file", "track_id", "track_name", F.explode("corners").alias("corner", "c")
    ).select(
        "file", "track_id", "track_name", "corner", "c.entry_m", "c.apex_m", "c.exit_m",
        F.col("c.braking_zone_start_m").alias("brake_m"),
        F.try_element_at("c.typical_speed_range_kmh", F.lit(1)).alias("ref_low"),
        F.try_element_at("c.typical_speed_range_kmh", F.lit(2)).alias("ref_high"),
    )


def read_sectors(spark: SparkSession, path: str) -> DataFrame:
    """One row per sector: from its boundary up to, not including, the next."""
    bounds = F.col("sector_boundaries_m")
    pairs = F.transform(
        F.slice(bounds, F.lit(1), F.size(bounds) - 1),
        lambda start, i: F.struct(
            (i + 1).alias("sector"), start.alias("start_m"),
            F.element_at(bounds, (i + 2).cast("int")).alias("end_m"),
        ),
    )
    return _files(spark, path).select(
        "track_id", "track_name", "file", F.explode(pairs).alias("s")
    ).select("track_id", "track_name", "file", "s.*")


def known_corners(spark: SparkSession) -> DataFrame:
    names = spark.createDataFrame([(t[0], t[1], f"{t[0]}.json") for t in fixed.TRACKS],
                                  "track_id string, track_name string, file string")
    return names.join(F.broadcast(spark.createDataFrame(list(fixed.CORNERS), _CORNERS)), "track_id")


def known_sectors(spark: SparkSession) -> DataFrame:
    rows = [
        (track_id, name, f"{track_id}.json", i + 1, bounds[i], bounds[i + 1])
        for track_id, name, _, bounds in fixed.TRACKS
        for i in range(len(bounds) - 1)
    ]
    return spark.createDataFrame(rows, _SECTORS)
