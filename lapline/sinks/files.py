"""Tables and files to write."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapline.functions import columns as C
from lapline.functions.frames import csv_text, narrow_to_lap_file
from lapline.operators.laps import LAP
from lapline.sinks.versions import Folder
from lapline.sources.files import PART, RECORDINGS, folder_name

ROWS_PER_FILE = 5_000_000
#: Rows of a recording's file: it is compressed, so one task reads it, and a task reads several.
ROWS_PER_RECORDING = 10_000
#: Folders that a table of many sessions is dealt into, by a hash of the session.
PARTS = 64


#: The most sessions that get a folder each in recordings; beyond it 64 folders hold the sessions by their hash.
SESSION_FOLDERS = 1000


def _part():
    return F.pmod(F.xxhash64("session_id"), F.lit(PARTS)).cast("int")


def _spread(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Rows of a key together; Spark splits what gets too large when it sees the sizes."""
    return df.hint("rebalance", *keys).sortWithinPartitions(*keys, time)


def write_partitioned(df: DataFrame, path: str, keys: list[str] = LAP,
                      time: str = "timestamp_wall", mode: str = "overwrite") -> None:
    """Parquet in one folder per key; a rerun replaces only the folders it has rows for."""
    _spread(df, keys, time).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic").option(
        "maxRecordsPerFile", ROWS_PER_FILE).partitionBy(*keys).parquet(path)


def write_in_parts(df: DataFrame, path: str, keys: list[str] = LAP, time: str = "timestamp_wall") -> None:
    """Parquet in 64 folders by a hash of the session, ordered by key inside; replaces the table.

    For more laps than folders should be made for: a folder per lap costs the time of some folders and files for each.
    """
    df.withColumn(PART, _part()).hint("rebalance", PART).sortWithinPartitions(PART, *keys, time).write.mode(
        "overwrite").option("partitionOverwriteMode", "static").option(
        "maxRecordsPerFile", ROWS_PER_FILE).partitionBy(PART).parquet(path)


def write_clustered(df: DataFrame, path: str, time: str = "timestamp_wall",
                    partitions: int | None = None, mode: str = "overwrite") -> None:
    """Parquet ordered by (session, lap, time) without a folder per lap.

    For tables with more laps than a file listing should hold: readers skip row groups
    by their minimum and maximum, and a large session spans several files.
    """
    order = [*LAP, time]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode(mode).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_laps(samples: DataFrame, path: str, platform: str = "ACC") -> None:
    """A Snappy file per lap at platform/track/car/session/lap, pit samples left out.

    Folder names have ``_`` for blanks. The partition value is the samples' own lap count.
    """
    driven = samples.where(~F.coalesce(F.col("is_in_pit"), F.lit(False)))
    laps = narrow_to_lap_file(driven)
    folders = {
        "platform": F.lit(platform),
        "track_folder": C.path_safe(F.col("track")),
        "car_folder": C.path_safe(F.col("car")),
        "session_folder": F.col("session_id"),
        "lap_folder": C.lap_file_name(F.col("lap_number")),
    }
    # folders are named after the shuffle, so that it doesn't carry them
    spread = laps.hint("rebalance", "session_id", "lap_number").withColumn(
        "_folder", F.array(*[value.cast("string") for value in folders.values()])
    ).sortWithinPartitions("_folder", "timestamp_wall")
    target = Folder(samples.sparkSession, path)
    target.clear()
    spread.mapInArrow(_folder_writer(target.uri, list(folders)), "files long").agg(F.sum("files")).first()
    target.put_new("_SUCCESS", "")


def _folder_writer(uri: str, keys: list[str], rows_per_group: int = 100_000, small: int = 1000):
    """A task that writes its rows, ordered by ``_folder``, a Parquet file for each value of it.

    Spark's own writer takes tens of milliseconds for each folder and file on a local disk. A file appears whole, under
    a name that a repeated task takes again. A file of fewer than ``small`` rows is mostly what Parquet says of its
    columns, so it has no dictionaries and statistics; none has Arrow's own copy of the schema.
    """
    def write(batches):
        import re

        import pyarrow as pa
        import pyarrow.fs as fs
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task = TaskContext.get()
        name, attempt = f"part-{task.partitionId():05d}.snappy.parquet", task.taskAttemptId()
        where, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))
        held, files, folder, writer = [], 0, None, None

        def escaped(value):  # as Spark escapes partition values
            if not value:
                return "__HIVE_DEFAULT_PARTITION__"
            return re.sub("[\x01-\x1f\"#%'*/:=?\\\\\x7f{\\[\\]^]", lambda c: f"%{ord(c[0]):02X}", value)

        def place():
            return "/".join([root, *[f"{key}={escaped(value)}" for key, value in zip(keys, folder)]])

        def flush():
            nonlocal writer
            table = pa.Table.from_batches(held)
            if writer is None:
                where.create_dir(place())
                large = table.num_rows >= small
                writer = pq.ParquetWriter(f"{place()}/.{attempt}.{name}", table.schema, filesystem=where,
                                          compression="snappy", use_deprecated_int96_timestamps=True,
                                          use_dictionary=large, write_statistics=large, store_schema=False)
            writer.write_table(table)
            held.clear()

        def close():
            nonlocal writer, files
            if held:
                flush()
            if writer is not None:
                writer.close()
                where.move(f"{place()}/.{attempt}.{name}", f"{place()}/{name}")
                writer, files = None, files + 1

        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("_folder")
            folders = batch.column(at).to_pylist()
            rows = batch.remove_column(at)
            starts = [0, *(i for i in range(1, len(folders)) if folders[i] != folders[i - 1])]
            for start, end in zip(starts, [*starts[1:], len(folders)]):
                if folders[start] != folder:
                    close()
                    folder = folders[start]
                held.append(rows.slice(start, end - start))
                if sum(part.num_rows for part in held) >= rows_per_group:
                    flush()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return write


def write_recordings(samples: DataFrame, path: str) -> None:
    """Compressed CSV with header and fixed decimals, one folder per session; see SESSION_FOLDERS.

    In folders of many sessions each row names its session, in the last column.
    """
    few = samples.select("session_id").distinct().limit(SESSION_FOLDERS + 1).count() <= SESSION_FOLDERS
    folder, value, kept = ("session", F.col("session_id"), []) if few else (PART, _part(), ["session_id"])
    spread = samples.withColumn(folder, value).hint("rebalance", folder).sortWithinPartitions(
        folder, "session_id", "timestamp_wall")
    columns = [c for c in samples.columns if c != "session_id"]
    csv_text(spread).select(*columns, *kept, folder).write.mode(
        "overwrite").option("header", True).option("compression", "gzip").option(
        "maxRecordsPerFile", ROWS_PER_RECORDING).partitionBy(folder).csv(path)


def write_events(events: DataFrame, path: str, layout: str = "parts") -> None:
    """JSON lines; NULL fields are left out.

    Every line names its session, so ``parts`` puts sessions together by their hash: files grow with the rows, not
    with the sessions. ``sessions`` makes a folder per session, for as few as a file listing should hold.
    """
    folder, value = {"parts": (PART, _part()), "sessions": ("session", F.col("session_id"))}[layout]
    events.withColumn(folder, value).hint("rebalance", folder).write.mode("overwrite").option(
        "ignoreNullFields", True).partitionBy(folder).json(path)


def rebatch_as_json(spark: SparkSession, csv_path: str, path: str, rows_per_file: int = 5000) -> None:
    """CSV rows as JSON lines of strings, at most 5,000 to a compressed file, in the folders that the recordings have."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option(
        "pathGlobFilter", RECORDINGS).csv(csv_path)
    folder = PART if Folder(spark, csv_path).names(f"{PART}=*") else "session"
    rows.withColumn(folder, folder_name()).write.mode("overwrite").option(
        "maxRecordsPerFile", rows_per_file).option("compression", "gzip").partitionBy(folder).json(path)


def compact(spark: SparkSession, source: str, target: str, keys: list[str],
            time: str = "timestamp_wall") -> None:
    """The many small files a stream leaves, as few per key."""
    write_partitioned(spark.read.parquet(source), target, keys, time)


def publish(messages: DataFrame, servers: str) -> None:
    """Messages to Kafka by key; needs the connector jar."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
