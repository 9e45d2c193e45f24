"""Recordings, lake files, lap files and event files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapline import fixed_values as fixed
from lapline import schemas
from lapline.functions.frames import typed_from_text

EVENT_SCHEMAS = {
    "session_events": schemas.SESSION_EVENT,
    "lap_completions": schemas.LAP_COMPLETION,
    "setup_snapshots": schemas.SETUP_SNAPSHOT,
    "setup_changes": schemas.SETUP_CHANGE,
}
_PATH = "_metadata.file_path"
#: Name of the folders that hold many sessions each.
PART = "session_part"
#: Names of recordings, compressed or not.
RECORDINGS = "*.{csv,csv.gz}"


def folder_name(depth: int = 2):
    """Name of the folder a file is in; of ``key=value`` the value."""
    return F.regexp_replace(F.element_at(F.split(F.col(_PATH), "/"), -depth), "^[^=]*=", "")


def _session(named):
    """The session of a row: that of its folder, or in a folder of many sessions the one the row names."""
    return F.when(F.col(_PATH).contains(f"/{PART}="), named).otherwise(folder_name())


def read_lake_samples(spark: SparkSession, path: str, schema=schemas.ETL_SAMPLE) -> DataFrame:
    """JSON lines at any depth below ``path``, only the fields in ``schema``.

    Event files lie under the same prefix, in folders named ``events``, and are left out.
    """
    return _samples_only(spark.read.schema(schema).option("recursiveFileLookup", True).json(path))


def stream_lake_samples(spark: SparkSession, path: str, schema=schemas.ETL_SAMPLE) -> DataFrame:
    """The same as a stream: each file once, as it comes."""
    return _samples_only(spark.readStream.schema(schema).option("recursiveFileLookup", True).json(path))


def _samples_only(files: DataFrame) -> DataFrame:
    return files.where(~F.col(_PATH).contains("/events/"))


def read_text_samples(spark: SparkSession, path: str) -> DataFrame:
    """Lake files whose values were all written as strings and that name no session.

    The session is the folder, unless that holds many sessions; a value that does not parse becomes NULL.
    """
    rows = read_lake_samples(spark, path, schemas.TEXT_SAMPLE).withColumn(
        "session_id", F.coalesce("session_id", _session(F.col("session_id"))))
    return typed_from_text(rows)


def read_recordings(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Telemetry CSV files below ``path``; the session is the folder of the file, or the last column where a folder
    holds many."""
    rows = spark.read.schema(schemas.RECORDING).option("header", True).option(
        "recursiveFileLookup", True).option("pathGlobFilter", RECORDINGS).csv(path)
    rows = rows.withColumn("session_id", _session(F.col("session_id")))
    return rows.select(*columns) if columns else rows


def recording_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names in the header of the recordings."""
    return spark.read.option("header", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", RECORDINGS).csv(path).columns


def read_lap_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LAP_FILE).option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").parquet(path)


def file_stats(spark: SparkSession, path: str, rate_hz: float = fixed.SAMPLE_RATE_HZ) -> DataFrame:
    """Rows, size, duration and speed range per lap file.

    The duration is rows over the sampling rate; the span of the times is next to it.
    """
    rows = read_lap_files(spark, path)
    span = F.max("timestamp_wall").cast("double") - F.min("timestamp_wall").cast("double")
    return rows.groupBy(F.col(_PATH).alias("file"), F.col("_metadata.file_size").alias("size")).agg(
        F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) / rate_hz).alias("duration_s"),
        span.alias("span_s"), F.min("speed_kmh").alias("speed_min"),
        F.max("speed_kmh").alias("speed_max"),
    )


def schema_widths(spark: SparkSession, path: str) -> DataFrame:
    """How many files have how many columns; one row means they agree.

    Executors read one footer per file.
    """
    listed = list_files(spark, path, "*.parquet").select("path")

    def widths(batches):
        import pyarrow.fs as fs
        import pyarrow.parquet as pq
        for batch in batches:
            counts = []
            for uri in batch["path"]:
                where, name = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1)
                                                     if uri.startswith("file:/")
                                                     and not uri.startswith("file:///") else uri)
                with where.open_input_file(name) as f:
                    counts.append(len(pq.read_schema(f)))
            yield batch.assign(columns=counts)[["path", "columns"]]

    return listed.mapInPandas(widths, "path string, columns int").groupBy("columns").agg(
        F.count(F.lit(1)).alias("files"))


def read_events(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines files of a kind, at any depth; the kind is in the file's path."""
    files = spark.read.schema(EVENT_SCHEMAS[kind]).option("recursiveFileLookup", True).json(path)
    return files.where(F.col(_PATH).contains(kind))


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modificationTime and length of files; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", glob).load(path).select("path", "modificationTime", "length")


def latest_session(spark: SparkSession, path: str, glob: str = RECORDINGS) -> DataFrame:
    """The folder whose files were changed last."""
    return list_files(spark, path, glob).agg(
        F.max_by(F.element_at(F.split("path", "/"), -2), F.struct("modificationTime", "path"))
        .alias("session_id"), F.max("modificationTime").alias("modified"),
    )


def session_files(spark: SparkSession, path: str, session_id: str, glob: str = "*") -> DataFrame:
    """Files of a session wherever its folder is below ``path``."""
    return list_files(spark, path, glob).where(
        F.array_contains(F.split("path", "/"), session_id)
        | F.col("path").contains(f"/session_id={session_id}/")
    )
