"""Streams from messages to tables."""

import hashlib
import json
import time
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lapline import schemas
from lapline.functions.frames import stamped
from lapline.operators.sessions import merge_session_end
from lapline.session import SETTINGS
from lapline.sinks.versions import FAN, AppendTable, Folder, Versions
from lapline.sources.messages import decode, is_readable
from lapline.streaming.snapshots import ORDER, PAYLOADS, stored

_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Rows of a slice of time in a replay, the most slices, cuts that are looked at together, how late rows may be.
ROWS_PER_SLICE = 50_000_000
_SLICES, _STEP, _LATE = 1000, 32, "1 minute"
#: How often a stream runs: as rows come, once a minute, or now over what is there.
TRIGGERS = {
    "continuous": {"processingTime": "0 seconds"},
    "minute": {"processingTime": "60 seconds"},
    "quarter_hour": {"processingTime": "15 minutes"},
    "now": {"availableNow": True},
}


def decoded(messages: DataFrame) -> DataFrame:
    """Telemetry messages as samples with their key and the time they were processed."""
    return stamped(decode(messages, schemas.SAMPLE))


def start_append(stream: DataFrame, path: str, checkpoint: str, partition_by=(),
                 trigger: str = "now") -> StreamingQuery:
    """Append to Parquet; the checkpoint makes each row arrive once."""
    stream.sparkSession.conf.set(_STORE, SETTINGS[_STORE])
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(**TRIGGERS[trigger])
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start()


def _run_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of a checkpoint's run, the same after a restart; a new checkpoint in its place has another."""
    return json.loads(Folder(spark, checkpoint).text("metadata"))["id"]


def start_table(stream: DataFrame, table: AppendTable, checkpoint: str, trigger: str = "now",
                fan: int = FAN) -> StreamingQuery:
    """Append to a table with a manifest, and merge small folders as they add up: each row arrives once."""
    def store(batch: DataFrame, number: int) -> None:
        table.append(batch, _run_name(table.spark, checkpoint), number)
        if number % fan == fan - 1:
            table.compact(fan=fan)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(
        **TRIGGERS[trigger]).start()


def start_fan_out(stream: DataFrame, sinks: dict, checkpoint: str, trigger: str = "now") -> StreamingQuery:
    """One source, decoded once a batch, to several sinks by name: each a function of (batch, run, number).

    Beside the checkpoint each sink has a record of the last batch it took. A batch that broke off in one sink comes
    again only to those that don't have it yet; a sink that broke off half way gets it again and has to replace what
    it has of that number, as ``AppendTable.append`` does.
    """
    spark = stream.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        run = _run_name(spark, checkpoint)
        records = {name: Versions(spark, f"{checkpoint}-sinks/{name}") for name in sinks}
        open_ = [name for name, record in records.items() if record.latest()[1].get(run, -1) < number]
        if not open_:
            return
        batch = batch.persist()
        try:
            for name in open_:
                sinks[name](batch, run, number)
                records[name].change(lambda now: {**now, run: number})
                records[name].forget()
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(
        **TRIGGERS[trigger]).start()


def await_any(spark: SparkSession, seconds: int | None = None) -> bool:
    """Wait until one of the running streams ends, or fails: then its error is raised here."""
    return spark.streams.awaitAnyTermination(seconds) is not False


def start_console(stream: DataFrame, checkpoint: str, trigger: str = "minute") -> StreamingQuery:
    return stream.writeStream.outputMode("append").format("console").option(
        "truncate", "false").option("checkpointLocation", checkpoint).trigger(
        **TRIGGERS[trigger]).start()


def start_telemetry(messages: DataFrame, path: str, checkpoint: str, console: bool = False,
                    trigger: str = "now") -> list[StreamingQuery]:
    """Samples to a table ordered by session and lap, and to the console if asked for; see ``samples_table``."""
    samples = decoded(messages)
    table = samples_table(messages.sparkSession, path)
    if not console:
        return [start_table(samples, table, checkpoint, trigger)]
    return [start_fan_out(samples, {"table": table.append_and_merge, "console": lambda batch, run, number: batch.show(20, False)},
                          checkpoint, trigger)]


def samples_table(spark: SparkSession, path: str) -> AppendTable:
    """The table that ``start_telemetry`` appends to."""
    return AppendTable(spark, path, ("session_key", "completed_laps"), "timestamp_wall")


def start_of_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


@dataclass(frozen=True)
class Replayed:
    """One slice of a replay: rows read, rows later than the watermark, entries of state after it."""

    rows: int
    late: int
    held: int


def _slice_number(micros, cuts: list[int]):
    """How many cuts are at or before a time: by every 32nd cut, then by those after it."""
    every = F.array(*map(F.lit, cuts[_STEP - 1::_STEP])).cast("array<bigint>")
    coarse = F.size(F.filter(every, lambda cut: cut <= micros))
    near = F.slice(F.array(*map(F.lit, cuts)).cast("array<bigint>"), coarse * _STEP + 1, F.lit(_STEP))
    return coarse * _STEP + F.size(F.filter(near, lambda cut: cut <= micros))


def time_slices(samples: DataFrame, path: str, rows_per_slice: int, at: str = "timestamp_wall") -> dict:
    """Deal samples into folders of about ``rows_per_slice`` rows that follow each other in time.

    Rows of one time are in one slice; rows without a time are in the first. Gives the first and last time and the
    folders in order. There are at most 1000 slices, so the cuts are a few numbers of the plan whatever the table holds.
    """
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    facts = samples.agg(
        F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"), F.min(micros).alias("low"),
        F.percentile_approx(micros, [k / _SLICES for k in range(1, _SLICES)], 10 * _SLICES).alias("parts")).first()
    number = min(_SLICES, max(1, -(-facts["rows"] // rows_per_slice)))
    parts = facts["parts"] or []
    cuts = sorted({parts[k * _SLICES // number - 1] for k in range(1, number)} - {facts["low"]}) if parts else []
    place = F.coalesce(_slice_number(micros, cuts), F.lit(0)) if cuts else F.lit(0)
    dealt = samples.withColumn("_slice", place)
    if cuts:  # files of a slice's rows together; a single slice needs no shuffle
        dealt = dealt.hint("rebalance", "_slice")
    dealt.write.partitionBy("_slice").parquet(path)
    return {"first": facts["first"], "last": facts["last"],
            "folders": [f"{path}/_slice={k}" for k in range(len(cuts) + 1)]}


def backfill(samples: DataFrame, build, out: str, work: str, margin_s: int = 3600,
             rows_per_slice: int = ROWS_PER_SLICE) -> list[Replayed]:
    """All events of samples that are there in full, whatever the order they are read in.

    ``build(stream, watermark, idle_ms)`` makes the stream that is appended to ``out``. Samples are dealt into slices
    of time, and one run of the stream after the other, all from one checkpoint, reads a slice. Each slice begins where
    the one before ended, so a watermark of a minute makes no row late, and state holds what has come in one slice
    since the watermark, not the table. A last run reads one more row, of no session and a time beyond all timers, that
    moves the watermark past everything that is held, open laps too. ``work`` is a folder for the slices and the
    checkpoint; a replay that broke off is begun anew in another. Gives what each run read.
    """
    spark, at = samples.sparkSession, "timestamp_wall"
    known = time_slices(samples, f"{work}/samples", rows_per_slice, at)
    if known["last"] is None:
        stream = start_of_stream(spark, f"{work}/samples", samples.schema)
        spark.createDataFrame([], build(stream, _LATE, None).schema).write.parquet(out)
        return []
    length = int((known["last"] - known["first"]).total_seconds()) + margin_s

    def run(folder: str) -> Replayed:
        stream = start_of_stream(spark, folder, samples.schema)
        query = start_append(build(stream, _LATE, length * 1000), out, f"{work}/state")
        query.awaitTermination()
        progress = query.recentProgress
        states = [state for p in progress for state in p.stateOperators]
        return Replayed(sum(p.numInputRows for p in progress), sum(s.numRowsDroppedByWatermark for s in states),
                        states[-1].numRowsTotal if states else 0)

    runs = [run(folder) for folder in known["folders"]]
    end = known["last"] + timedelta(seconds=2 * length + margin_s)
    kinds = {f.name: f.dataType for f in samples.schema.fields}
    spark.range(1).select(*[
        (F.lit(end) if name == at else F.lit("") if name == "session_id" else F.lit(None)).cast(kind).alias(name)
        for name, kind in kinds.items()
    ]).write.parquet(f"{work}/end")
    return [*runs, run(f"{work}/end")]


def without_repeats(samples: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """A stream without packets seen before within the watermark, whatever their order."""
    return samples.withColumn("event_time", F.col("timestamp_wall").cast("timestamp")).withWatermark(
        "event_time", watermark
    ).dropDuplicatesWithinWatermark(["session_id", "packet_id"])


# ---- events to the session, lap and setup tables -------------------------------------

_QUARANTINE = "quarantine"


def route(messages: DataFrame, topic: str) -> DataFrame:
    """Readable messages of a topic that have the fields the table is keyed by."""
    schema, required = PAYLOADS[topic]
    payload = F.from_json(F.col("value").cast("string"), schema)
    rows = messages.where((F.col("topic") == topic) & is_readable()).select(
        payload.alias("p"), F.col("timestamp").alias("arrived"))
    for name in required:
        rows = rows.where(F.col(f"p.{name}").isNotNull())
    return rows.select("p.*", "arrived")


def rejected(messages: DataFrame) -> DataFrame:
    """Messages that no table takes: other topics, no JSON, or a key field missing."""
    value = F.col("value").cast("string")
    taken = F.lit(False)
    for topic, (schema, required) in PAYLOADS.items():
        payload = F.from_json(value, schema)
        complete = is_readable()
        for name in required:
            complete = complete & payload[name].isNotNull()
        taken = taken | ((F.col("topic") == topic) & complete)
    return messages.where(~F.coalesce(taken, F.lit(False)))


#: Messages that one task holds of a batch; files of messages are many times smaller than the messages in them.
MESSAGES_PER_TASK = 250_000


def _spread(batch: DataFrame) -> DataFrame:
    """A large batch dealt by its messages' hash, so that the work of a task doesn't grow with the batch."""
    needed = -(-batch.count() // MESSAGES_PER_TASK)
    # hashes of the rows alone: a repeated task deals them the same way
    return batch.repartition(needed, F.xxhash64("key", "value", "timestamp")) if needed > 1 else batch


def store_batch(batch: DataFrame, batch_id: int, store: str, run: str) -> None:
    """One micro-batch into the store, under its run and number: a repeated batch replaces itself.

    A run is told by its checkpoint, as numbers begin anew with each, and named so that later
    ones sort after earlier ones.
    Nothing already stored is read or rewritten; the tables are put together on read, from the last snapshot of the
    store (``snapshots.compact``) and the batches after it.
    """
    batch = _spread(batch).persist()
    try:
        for topic in PAYLOADS:
            route(batch, topic).write.mode("overwrite").parquet(f"{store}/{topic}/run={run}/batch_id={batch_id}")
        rejected(batch).write.mode("overwrite").parquet(f"{store}/{_QUARANTINE}/run={run}/batch_id={batch_id}")
    finally:
        batch.unpersist()


def _run_of(spark: SparkSession, store: str, checkpoint: str) -> str:
    """Name of a checkpoint's run: the one it has in the store, else when it began."""
    mark = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{store}/*/run=r*-{mark}")
    known = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    if known:
        return known[0].getPath().getName().removeprefix("run=")
    return f"r{int(time.time() * 1000):015d}-{mark}"


def start_event_store(messages: DataFrame, store: str, checkpoint: str,
                      trigger: str = "now") -> StreamingQuery:
    run = _run_of(messages.sparkSession, store, checkpoint)
    return messages.writeStream.foreachBatch(
        lambda batch, batch_id: store_batch(batch, batch_id, store, run)
    ).option("checkpointLocation", checkpoint).trigger(**TRIGGERS[trigger]).start()


def stored_sessions(spark: SparkSession, store: str) -> DataFrame:
    """One row per session: its first start, updated by ends that came after it."""
    events = stored(spark, store, "session_events")
    kind = F.col("event_type")
    starts = events.where(kind == "session_start").groupBy("session_id").agg(
        F.min_by(F.struct("platform", "track", "car", "session_type", "timestamp", *ORDER),
                 F.struct(*ORDER)).alias("s"))
    sessions = starts.select(
        "session_id", "s.platform", "s.track", "s.car", "s.session_type",
        F.col("s.timestamp").alias("start_time"), F.lit(None).cast("string").alias("end_time"),
        F.lit(0).alias("total_laps"), F.lit(None).cast("int").alias("best_lap_ms"),
    )
    ends = events.where(kind == "session_end").join(
        starts.select("session_id", F.struct(*[f"s.{c}" for c in ORDER]).alias("_since")), "session_id"
    ).where(F.struct(*ORDER) >= F.col("_since"))
    return merge_session_end(sessions, ends.select(
        "session_id", "total_laps", "best_lap_ms", "timestamp"))


def _latest(df: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in df.columns if c not in {*keys, *ORDER}]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct(*ORDER)).alias("_v")).select(*keys, "_v.*")


def stored_laps(spark: SparkSession, store: str) -> DataFrame:
    """One row per session and lap, the last one that came; laps of unknown sessions left out."""
    laps = _latest(stored(spark, store, "lap_completions"), ["session_id", "lap_number"])
    return laps.join(stored_sessions(spark, store).select("session_id"), "session_id", "left_semi")


def stored_setups(spark: SparkSession, store: str) -> DataFrame:
    """One row per setup; its lap is the one it applies from where no lap is named."""
    setups = stored(spark, store, "setup_snapshots")
    lap = F.coalesce("lap_number", "lap_applied_from", F.lit(0))
    rows = setups.withColumn("lap_number", lap).drop("lap_applied_from", *ORDER).distinct()
    return rows.join(stored_sessions(spark, store).select("session_id"), "session_id", "left_semi")


def quarantined(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.option("basePath", f"{store}/{_QUARANTINE}").parquet(f"{store}/{_QUARANTINE}")
