"""The event store on disk: a log of batches, snapshots of it, and sessions deleted from it.

A pointer file says which snapshot holds, up to which batch of each run it goes, and which deletions count. It is
written last and appears whole, so a compaction that breaks off changes nothing. A read takes the snapshot and the
batches after it. Rows of a snapshot are rows of the log, with the place they had in it, only those that still matter:
so what is put together from them is the same.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapline import schemas
from lapline.sinks.versions import Folder, Versions

#: The place of a row in the log.
ORDER = ("run", "batch_id", "arrived")
PAYLOADS = {
    "session_events": (schemas.SESSION_EVENT, ("session_id", "event_type")),
    "lap_completions": (schemas.LAP_COMPLETION, ("session_id", "lap_number")),
    "setup_snapshots": (schemas.SETUP_SNAPSHOT, ("session_id",)),
}
_SNAPSHOTS = "_snapshots"


def _versions(spark: SparkSession, store: str) -> Versions:
    return Versions(spark, f"{store}/{_SNAPSHOTS}/versions")


def _batches(spark: SparkSession, store: str, topic: str, inside: str = "") -> list[tuple[str, int, str]]:
    """(run, number, folder) of the batches in the log."""
    found = []
    for name in Folder(spark, store).names(f"{topic}/run=*/batch_id=*{inside}"):
        run, number = name.split("/")[1:3]
        found.append((run.removeprefix("run="), int(number.removeprefix("batch_id=")), "/".join(name.split("/")[:3])))
    return found


def _complete(spark: SparkSession, store: str, topic: str, now: dict) -> dict[str, int]:
    """The last batch of each run that is written in full, in the log or in the snapshot already."""
    last = dict(now.get("covered", {}).get(topic, {}))
    for run, number, _ in _batches(spark, store, topic, "/_SUCCESS"):
        last[run] = max(last.get(run, -1), number)
    return last


def _rows(spark: SparkSession, store: str, topic: str, now: dict, upto: dict[str, int] | None = None) -> DataFrame:
    """The snapshot and the batches after it, up to those in ``upto`` if given, without deleted sessions."""
    payload = PAYLOADS[topic][0]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in payload.fields)
    schema = f"{ddl}, arrived timestamp, run string, batch_id int"
    covered = now.get("covered", {}).get(topic, {})
    tail = [folder for run, number, folder in _batches(spark, store, topic)
            if number > covered.get(run, -1) and (upto is None or number <= upto.get(run, -1))]
    rows = spark.createDataFrame([], schema)
    if now.get("snapshot"):
        rows = spark.read.schema(schema).parquet(f"{store}/{now['snapshot']}/{topic}")
    if tail:
        rows = rows.unionByName(spark.read.schema(schema).option("basePath", f"{store}/{topic}").parquet(
            *[f"{store}/{folder}" for folder in tail]))
    for deletion in now.get("deletions", []):
        gone = spark.read.schema("session_id string").parquet(f"{store}/{deletion['folder']}")
        last = deletion["upto"].get(topic, {})
        if last:
            runs = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
            here = F.coalesce(F.col("batch_id") <= runs[F.col("run")], F.lit(False))
            marked = rows.withColumn("_of", F.when(here, F.col("session_id")))
            rows = marked.join(gone.withColumnRenamed("session_id", "_of"), "_of", "left_anti").drop("_of")
    return rows


def stored(spark: SparkSession, store: str, topic: str) -> DataFrame:
    """Rows of a topic that matter, each with its place in the log."""
    return _rows(spark, store, topic, _versions(spark, store).latest()[1])


def _session_events(events: DataFrame) -> DataFrame:
    """The first start of each session, and of the ends after it the latest with each value.

    Ends before the first start known, or of no known session, stay: a run that began earlier may bring their start.
    """
    order, row = F.struct(*ORDER), F.struct(*events.columns)
    starts = events.where("event_type = 'session_start'").groupBy("session_id").agg(
        F.min_by(row, order).alias("row"), F.min(order).alias("since"))
    ends = events.where("event_type = 'session_end'").join(starts.select("session_id", "since"), "session_id", "left")
    after = F.coalesce(order >= F.col("since"), F.lit(False))
    latest = [F.max_by(row, F.when(F.col(c).isNotNull(), F.struct("timestamp")))
              for c in ("total_laps", "best_lap_ms", "timestamp")]
    kept = ends.where(after).groupBy("session_id").agg(F.array_distinct(F.array(*latest)).alias("rows")).select(
        F.explode("rows").alias("row")).where("row is not null")
    return starts.select("row.*").unionByName(kept.select("row.*")).unionByName(ends.where(~after).drop("since"))


def _last_of(keys: list[str] | None):
    """The last row of each key; without keys, of each value."""
    def reduce(rows: DataFrame) -> DataFrame:
        by = keys or [c for c in rows.columns if c not in ORDER]
        row = F.struct(*[c for c in rows.columns if c not in by])
        return rows.groupBy(*by).agg(F.max_by(row, F.struct(*ORDER)).alias("row")).select(*by, "row.*")
    return reduce


_REDUCED = {"session_events": _session_events, "lap_completions": _last_of(["session_id", "lap_number"]),
            "setup_snapshots": _last_of(None)}


def compact(spark: SparkSession, store: str) -> bool:
    """A new snapshot of the last one and the complete batches after it; False if another compaction was faster."""
    versions = _versions(spark, store)
    _, now = versions.latest()
    folder = f"{_SNAPSHOTS}/{uuid.uuid4().hex}"
    covered = {topic: _complete(spark, store, topic, now) for topic in PAYLOADS}
    for topic, reduce in _REDUCED.items():
        reduce(_rows(spark, store, topic, now, covered[topic])).select(
            *[f.name for f in PAYLOADS[topic][0].fields], *reversed(ORDER)).write.parquet(f"{store}/{folder}/{topic}")

    def done(deletion: dict) -> bool:
        return all(number <= covered[topic].get(run, -1)
                   for topic, last in deletion["upto"].items() for run, number in last.items())

    def pointed(latest: dict) -> dict | None:
        if latest.get("snapshot") != now.get("snapshot"):
            return None
        known = [d["name"] for d in now.get("deletions", [])]
        # what came meanwhile isn't worked into the snapshot and counts on
        return {**latest, "snapshot": folder, "covered": covered, "deletions": [
            d for d in latest.get("deletions", []) if d["name"] not in known or not done(d)]}
    return versions.change(pointed)


def delete_sessions(spark: SparkSession, store: str, sessions: DataFrame, name: str) -> bool:
    """Delete sessions (session_id) with their laps and setups, as far as the log goes now.

    What comes later stays, so a session may begin anew, without the laps it had. The same ``name`` deletes once: a
    rerun changes nothing and gives False. Rows go from what is read at once, from disk with the next snapshot.
    """
    versions = _versions(spark, store)
    if name in versions.latest()[1].get("deleted", []):
        return False
    folder = f"{_SNAPSHOTS}/deleted-{uuid.uuid4().hex}"
    sessions.select(F.col("session_id").cast("string").alias("session_id")).where(
        "session_id is not null").distinct().write.parquet(f"{store}/{folder}")

    def marked(now: dict) -> dict | None:
        if name in now.get("deleted", []):
            return None
        upto = {topic: _complete(spark, store, topic, now) for topic in PAYLOADS}
        return {**now, "deleted": [*now.get("deleted", []), name],
                "deletions": [*now.get("deletions", []), {"name": name, "folder": folder, "upto": upto}]}
    return versions.change(marked)


def vacuum(spark: SparkSession, store: str) -> int:
    """Delete batches that the snapshot covers and folders the pointer doesn't name. Only while no one reads an older
    pointer or compacts."""
    _, now = _versions(spark, store).latest()
    folder = Folder(spark, store)
    spare = [name for topic in PAYLOADS for run, number, name in _batches(spark, store, topic)
             if number <= now.get("covered", {}).get(topic, {}).get(run, -1)]
    held = {now.get("snapshot"), *(d["folder"] for d in now.get("deletions", [])), f"{_SNAPSHOTS}/versions"}
    spare += [name for name in folder.names(f"{_SNAPSHOTS}/*") if name not in held]
    for name in spare:
        folder.delete(name)
    _versions(spark, store).forget()
    return len(spare)
