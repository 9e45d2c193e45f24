"""The batch job: lake JSON to the processed table and the lap summary."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapline.functions.frames import on_track, with_derived
from lapline.operators.laps import LAP, SUMMARY, filter_counts, lap_parts, lap_summary, merged_parts, summary_of_parts
from lapline.sinks.files import write_clustered, write_in_parts, write_partitioned, write_table
from lapline.sinks.versions import AppendTable, Folder
from lapline.sources.files import PART, read_lake_samples, stream_lake_samples
from lapline.streaming.pipelines import start_fan_out

#: The most laps that get a folder each where the layout isn't named.
LAP_FOLDERS = 1000


def processed(raw: DataFrame) -> DataFrame:
    """Filters first, so that columns are derived for kept rows only."""
    return with_derived(on_track(raw))


def run(spark: SparkSession, raw_path: str, out_path: str, layout: str | None = None) -> DataFrame:
    """Write the processed table, summarize that, and return the row counts.

    The summary reads Parquet, not JSON again. The counts come from one more pass over
    the two fields they need, because counters kept during the write count rows of
    repeated tasks twice. ``laps`` makes a folder per lap and replaces those it has rows
    for; ``parts`` deals sessions to 64 folders ordered by lap, and ``clustered`` orders
    the rows by lap without folders: both replace the table. Without a name a table keeps
    the folders it has, and a new one gets a folder per lap up to 1000 laps, else parts.
    """
    raw = read_lake_samples(spark, raw_path)
    write = {"laps": write_partitioned, "parts": write_in_parts, "clustered": write_clustered}[
        layout or _layout(spark, raw, f"{out_path}/telemetry")]
    write(processed(raw), f"{out_path}/telemetry")
    table = read_processed(spark, out_path)
    write_table(lap_summary(table), f"{out_path}/lap_summary")
    return filter_counts(raw)


def _layout(spark: SparkSession, raw: DataFrame, path: str) -> str:
    there = Folder(spark, path)
    if there.names(f"{PART}=*"):
        return "parts"
    if there.names("session_id=*"):
        return "laps"
    laps = on_track(raw).select(*LAP).distinct().limit(LAP_FOLDERS + 1).count()
    return "laps" if laps <= LAP_FOLDERS else "parts"


def increment(spark: SparkSession, raw_path: str, out_path: str) -> DataFrame:
    """The same job over lake files that no earlier increment has read; gives the lap summary of all.

    A stream over the files that are there now tells which are new. Each batch is read once and goes to two tables with
    a manifest: its samples, and what it adds to the lap summary, a row for each lap it touches. So an increment costs
    its own files and the laps' parts, not the table, and one that breaks off goes on where it was.
    """
    samples, parts = processed_samples(spark, out_path), summary_parts(spark, out_path)
    start_fan_out(
        stream_lake_samples(spark, raw_path),
        {"telemetry": lambda batch, run, number: samples.append_and_merge(processed(batch), run, number),
         "summary": lambda batch, run, number: parts.append_and_merge(lap_parts(processed(batch)), run, number)},
        f"{out_path}/increments").awaitTermination()
    return summary_of_parts(parts.read())


def processed_samples(spark: SparkSession, out_path: str) -> AppendTable:
    return AppendTable(spark, f"{out_path}/telemetry", LAP, "timestamp_wall")


def summary_parts(spark: SparkSession, out_path: str) -> AppendTable:
    return AppendTable(spark, f"{out_path}/lap_parts", SUMMARY, merge=merged_parts)


def read_processed(spark: SparkSession, out_path: str) -> DataFrame:
    """The processed table, whatever its folders are; partition values keep their types."""
    return spark.read.option("basePath", f"{out_path}/telemetry").parquet(
        f"{out_path}/telemetry").withColumn("session_id", F.col("session_id").cast("string")).drop(PART)


def flagship(samples: DataFrame) -> DataFrame:
    """Lap summary straight from samples."""
    return lap_summary(processed(samples))


