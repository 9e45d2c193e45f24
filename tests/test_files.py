"""Round trips through files, tables and the catalog."""

import gzip
import json
import os
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lapline import schemas
from lapline.operators import laps, sessions
from lapline.plans import etl
from lapline.sinks import files as sinks
from lapline.sources import catalog, files


def folders(path):
    return sorted({os.path.relpath(d, path) for d, _, names in os.walk(path) if any(n.startswith("part") for n in names)})


@pytest.fixture(scope="module")
def recording(samples):
    return samples([
        {"session_id": f"s{i % 2}", "completed_laps": i // 40, "speed_kmh": 100.125 + i, "is_in_pit": i % 7 == 0,
         "status": "replay" if i % 11 == 0 else "live", "car": "Audi R8 LMS", "packet_id": i} for i in range(120)
    ])


@pytest.fixture(scope="module")
def lake(recording, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lake"))
    present = [c for c in schemas.LAKE_SAMPLE.names if c in recording.columns]
    text = F.date_format("timestamp_wall", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    recording.select(*present).withColumn("timestamp_wall", text).write.json(f"{path}/year/month")
    os.makedirs(f"{path}/events/s0")
    with open(f"{path}/events/s0/session_events.jsonl", "w") as f:
        f.write(json.dumps({"event_type": "session_start", "session_id": "s0", "status": "live"}) + "\n")
    return path


def test_batch_job(spark, recording, lake, tmp_path):
    counts = etl.run(spark, lake, str(tmp_path)).first()
    kept = recording.where("status = 'live' AND NOT is_in_pit").count()
    assert (counts.total, counts.kept) == (120, kept)
    table = etl.read_processed(spark, str(tmp_path))
    assert table.count() == kept and len(table.columns) == 54
    summary = spark.read.parquet(f"{tmp_path}/lap_summary")
    assert summary.agg(F.sum("sample_count")).first()[0] == kept
    one = laps.lap_data(table, "s1", 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(session_id" in plan
    assert one.count() == recording.where("session_id = 's1' AND completed_laps = 1 AND status = 'live' AND NOT is_in_pit").count()


def test_rerun_replaces_only_its_laps(spark, recording, tmp_path):
    path = str(tmp_path)
    sinks.write_partitioned(recording, path)
    sinks.write_partitioned(recording.where("session_id = 's0' AND completed_laps = 0").limit(5), path)
    rows = spark.read.parquet(path).groupBy("session_id", "completed_laps").count().collect()
    got = {(r.session_id, r.completed_laps): r["count"] for r in rows}
    assert got == {(s, n): 5 if (s, n) == ("s0", 0) else 20 for s in ("s0", "s1") for n in range(3)}


def test_large_lap_takes_several_files(spark, recording, tmp_path):
    one = recording.withColumns({"session_id": F.lit("hot"), "completed_laps": F.lit(1)})
    many = one.crossJoin(spark.range(400).select(F.rand(1).alias("x"))).repartition(8)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "100KB")
    try:
        sinks.write_partitioned(many, str(tmp_path))
    finally:
        spark.conf.set(size, before)
    names = [n for _, _, ns in os.walk(tmp_path) for n in ns if n.startswith("part")]
    assert len(names) > 3 and spark.read.parquet(str(tmp_path)).count() == 48_000


def test_lap_files(spark, recording, tmp_path):
    full = recording
    for f in schemas.LAKE_SAMPLE.fields:
        if f.name not in full.columns:
            full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
    sinks.write_laps(full, str(tmp_path))
    assert folders(tmp_path)[0] == ("platform=ACC/track_folder=Monza/car_folder=Audi_R8_LMS/"
                                    "session_folder=s0/lap_folder=lap_000")
    driven = full.where("NOT is_in_pit")
    stats = files.file_stats(spark, str(tmp_path)).collect()
    assert len(stats) == 6 and sum(r["rows"] for r in stats) == driven.count()
    assert all(r.duration_s == pytest.approx(r["rows"] / 30) and r.size > 0 for r in stats)
    assert files.read_lap_files(spark, str(tmp_path)).schema == schemas.LAP_FILE
    assert [tuple(r) for r in files.schema_widths(spark, str(tmp_path)).collect()] == [(55, 6)]
    assert files.session_files(spark, f"{tmp_path}", "session_folder=s1", "*.parquet").count() == 3


def test_lap_files_take_any_name_and_large_laps(spark, recording, tmp_path):
    odd = F.when(F.col("session_id") == "s0", "a/b=c%[1]\"é").otherwise(F.lit(None))
    full = recording.withColumn("session_id", odd)
    for f in schemas.LAKE_SAMPLE.fields:
        if f.name not in full.columns:
            full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
    full = full.crossJoin(spark.range(400).select(F.col("id").alias("packet"))).drop("packet")
    path = str(tmp_path / "laps")
    sinks.write_laps(full, path)
    sinks.write_laps(full, path)  # replaces what is there
    back = files.read_lap_files(spark, path)
    driven = full.where("NOT is_in_pit").withColumnRenamed("completed_laps", "lap_number")
    columns = ["session_id", "lap_number", "timestamp_wall", "speed_kmh"]
    want = driven.select(*[F.col(f.name).cast(f.dataType) for f in back.select(*columns).schema.fields])
    assert back.count() == want.count() and back.select(*columns).exceptAll(want).count() == 0
    # the very folders that Spark makes
    values = driven.select("session_id", F.lit("x").alias("x")).distinct()
    values.write.partitionBy("session_id").text(str(tmp_path / "names"))
    spark_names = {d.removeprefix("session_id=") for d in os.listdir(tmp_path / "names") if d.startswith("session_id")}
    assert {f.split("/")[3].removeprefix("session_folder=") for f in folders(path)} == spark_names
    assert not [n for _, _, ns in os.walk(path) for n in ns if n.startswith(".") and "part" in n and not n.endswith(".crc")]


def test_files_of_short_laps_are_small(spark, recording, tmp_path):
    """Most of a short lap's file is what Parquet says of 55 columns; a long lap's file has statistics."""
    full = recording
    for f in schemas.LAKE_SAMPLE.fields:
        if f.name not in full.columns:
            full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
    many = full.where("completed_laps = 0").crossJoin(spark.range(200).select(F.col("id").alias("packet"))).drop("packet")
    sinks.write_laps(full.where("completed_laps > 0").unionByName(many), str(tmp_path))
    seen = set()
    for path in tmp_path.rglob("*.parquet"):
        meta = pq.read_metadata(path)
        assert "ARROW:schema" not in {k.decode() for k in meta.metadata or {}}
        column = meta.row_group(0).column(meta.schema.names.index("speed_kmh"))
        seen.add(meta.num_rows >= 1000)
        assert column.is_stats_set == (meta.num_rows >= 1000) and column.compression == "SNAPPY"
        assert meta.num_rows >= 1000 or path.stat().st_size < 9500
    assert seen == {True, False}


def test_clustered(spark, recording, tmp_path):
    sinks.write_clustered(recording, str(tmp_path), partitions=4)
    assert spark.read.parquet(str(tmp_path)).count() == 120
    assert len([n for n in os.listdir(tmp_path) if n.startswith("part")]) == 4  # two sessions over four files


def test_recordings(spark, recording, tmp_path):
    present = [c for c in schemas.LAKE_SAMPLE.names if c in recording.columns]
    full = recording.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(
            "timestamp" if f.name == "timestamp_wall" else f.dataType).alias(f.name) for f in schemas.LAKE_SAMPLE.fields])
    path = str(tmp_path / "csv")
    sinks.write_recordings(full, path)
    assert files.recording_columns(spark, path)[:3] == ["timestamp_wall", "timestamp_game", "car"]
    assert not schemas.missing_columns(files.read_recordings(spark, path))
    back = files.read_recordings(spark, path, "session_id", "speed_kmh", "is_in_pit", "completed_laps")
    assert back.groupBy("session_id").count().orderBy("session_id").collect()[0]["count"] == 60
    want = sorted(round(r.speed_kmh, 2) for r in recording.collect())
    assert sorted(round(r.speed_kmh, 2) for r in back.collect()) == pytest.approx(want, abs=0.006)
    assert back.where("is_in_pit").count() == recording.where("is_in_pit").count()
    sinks.rebatch_as_json(spark, path, str(tmp_path / "json"), rows_per_file=25)
    names = [n for _, _, ns in os.walk(tmp_path / "json") for n in ns if n.startswith("part")]
    assert len(names) == 6  # 60 rows per session, 25 to a file
    raw = files.read_lake_samples(spark, str(tmp_path / "json"))
    assert raw.where("speed_kmh IS NOT NULL").count() == 0  # quoted numbers do not decode
    typed = files.read_text_samples(spark, str(tmp_path / "json"))
    assert typed.where("speed_kmh > 0 AND session_id IN ('s0', 's1')").count() == 120


def test_recordings_and_their_batches_are_compressed(spark, recording, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_RECORDING", 25)
    full = recording.select(*[
        (F.col(f.name) if f.name in recording.columns else F.lit(None)).cast(
            "timestamp" if f.name == "timestamp_wall" else f.dataType).alias(f.name) for f in schemas.LAKE_SAMPLE.fields])
    path, batches = str(tmp_path / "csv"), str(tmp_path / "json")
    sinks.write_recordings(full, path)
    written = [p for p in (tmp_path / "csv").rglob("part*")]
    assert len(written) == 6 and all(p.name.endswith(".csv.gz") for p in written)  # 60 rows a session, 25 a file
    plain = tmp_path / "csv" / "session=s9" / "telemetry.csv"  # as a user's recorder leaves it
    plain.parent.mkdir()
    plain.write_bytes(gzip.decompress(written[0].read_bytes()))
    rows = len(plain.read_text().splitlines()) - 1
    assert files.read_recordings(spark, path, "session_id").groupBy("session_id").count().where("session_id = 's9'").first()["count"] == rows
    assert files.latest_session(spark, path).first().session_id == "session=s9"
    sinks.rebatch_as_json(spark, path, batches)
    assert all(p.name.endswith(".json.gz") for p in (tmp_path / "json").rglob("part*"))
    assert files.read_text_samples(spark, batches).where("speed_kmh > 0").count() == 120 + rows


def test_recordings_of_many_sessions_share_folders(spark, recording, tmp_path, monkeypatch):
    full = recording.select(*[
        (F.col(f.name) if f.name in recording.columns else F.lit(None)).cast(
            "timestamp" if f.name == "timestamp_wall" else f.dataType).alias(f.name) for f in schemas.LAKE_SAMPLE.fields])
    full = full.withColumn("session_id", F.when(F.col("gear") > 0, F.col("session_id")))
    columns = ["session_id", "speed_kmh", "is_in_pit", "completed_laps", "timestamp_wall"]
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    sinks.write_recordings(full, few)
    monkeypatch.setattr(sinks, "SESSION_FOLDERS", 1)
    sinks.write_recordings(full, many)
    assert folders(few) == ["session=s0", "session=s1"]
    assert all(f.startswith("session_part=") for f in folders(many))
    one, other = (files.read_recordings(spark, path, *columns) for path in (few, many))
    assert one.exceptAll(other).count() == 0 == other.exceptAll(one).count() and other.count() == 120
    sinks.rebatch_as_json(spark, many, str(tmp_path / "json"), rows_per_file=25)
    typed = files.read_text_samples(spark, str(tmp_path / "json"))
    assert {(r.session_id, r["count"]) for r in typed.groupBy("session_id").count().collect()} == {("s0", 60), ("s1", 60)}


def test_sessions_on_disk(spark, tmp_path):
    for i, name in enumerate(("newest", "older")):
        os.makedirs(tmp_path / "deep" / name)
        file = tmp_path / "deep" / name / "telemetry.csv"
        file.write_text("a\n1\n")
        os.utime(file, (time.time() - 1000 * i,) * 2)
    assert files.latest_session(spark, str(tmp_path)).first().session_id == "newest"
    assert files.session_files(spark, str(tmp_path), "older").first().length == 4
    assert files.session_files(spark, str(tmp_path), "old").count() == 0


def test_event_files_leave_out_nulls(spark, samples, tmp_path):
    events = sessions.session_events(samples([{}, {"status": "pause"}]))
    sinks.write_events(events, str(tmp_path / "session_events"))
    lines = [json.loads(line) for d, _, ns in os.walk(tmp_path) for n in ns if n.endswith(".json")
             for line in open(os.path.join(d, n))]
    assert {line["event_type"]: "total_laps" in line for line in lines} == {"session_start": False, "session_end": True}
    assert files.read_events(spark, str(tmp_path), "session_events").count() == 2
    assert files.read_events(spark, str(tmp_path), "lap_completions").count() == 0


def test_event_files_do_not_grow_with_sessions(spark, tmp_path):
    events = spark.range(0, 600, 1, 6).selectExpr("concat('s', id) AS session_id", "'session_start' AS event_type")
    sinks.write_events(events, str(tmp_path / "session_events"))
    assert len(folders(tmp_path)) <= sinks.PARTS
    back = files.read_events(spark, str(tmp_path), "session_events").select("session_id", "event_type")
    assert sorted(back.collect()) == sorted(events.collect())
    few = events.where("session_id IN ('s1', 's2')")
    sinks.write_events(few, str(tmp_path / "few"), "sessions")
    assert folders(tmp_path / "few") == ["session=s1", "session=s2"]


def test_both_shapes_of_lap_events(spark, tmp_path):
    rows = [{"session_id": "a", "lap_number": 1, "sector_1_ms": 3, "avg_tyre_temp_fl": 80.5},
            {"session_id": "a", "lap_number": 2, "last_sector_time_ms": 9, "tyre_temp_fl": 81.5}]
    os.makedirs(tmp_path / "s")
    (tmp_path / "s" / "lap_completions.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = files.read_events(spark, str(tmp_path), "lap_completions").orderBy("lap_number").collect()
    assert [(r.sector_1_ms, r.last_sector_time_ms) for r in got] == [(3, None), (None, 9)]


def test_table_of_many_laps_is_dealt_into_parts(spark, recording, lake, tmp_path, monkeypatch):
    monkeypatch.setattr(etl, "LAP_FOLDERS", 5)  # the recording has six laps
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    etl.run(spark, lake, few, "laps")
    etl.run(spark, lake, few)  # a table keeps its folders
    etl.run(spark, lake, many)
    assert len(folders(f"{few}/telemetry")) == 6
    assert all(f.startswith("session_part=") for f in folders(f"{many}/telemetry"))
    one, other = (etl.read_processed(spark, out) for out in (few, many))
    assert sorted(one.columns) == sorted(other.columns)
    assert one.exceptAll(other.select(*one.columns)).count() == 0 == other.select(*one.columns).exceptAll(one).count()
    assert laps.lap_data(one, "s1", 1).count() == laps.lap_data(other, "s1", 1).count() > 0
    catalog.create_tables(spark, "in_parts", lake, f"{many}/telemetry", f"{many}/lap_summary")
    catalog.repair_table(spark, "in_parts.telemetry_processed")
    assert spark.table("in_parts.telemetry_processed").count() == one.count()


def test_catalog(spark, lake, tmp_path):
    out = str(tmp_path)
    etl.run(spark, lake, out)
    catalog.create_tables(spark, "telemetry_test", lake, f"{out}/telemetry", f"{out}/lap_summary")
    catalog.create_tables(spark, "telemetry_test", lake, f"{out}/telemetry", f"{out}/lap_summary")
    processed = "SELECT count(*) AS n FROM telemetry_test.telemetry_processed WHERE completed_laps = :lap"
    assert catalog.query(spark, processed, lap=1).first().n == 0
    catalog.repair_table(spark, "telemetry_test.telemetry_processed")
    assert catalog.query(spark, processed, lap=1).first().n > 0
    assert len(spark.table("telemetry_test.telemetry_processed").columns) == 32
    assert len(spark.table("telemetry_test.telemetry_raw").columns) == 77
    raw = spark.table("telemetry_test.telemetry_raw")
    assert laps.status_counts(raw).agg(F.sum("cnt")).first()[0] == 120
    listing = laps.lap_summary_listing(spark.table("telemetry_test.lap_summary"), "s1").collect()
    assert [r.completed_laps for r in listing] == [0, 1, 2]
    speed = catalog.query(spark, "SELECT AVG(avg_speed_kmh) AS v, track FROM telemetry_test.lap_summary GROUP BY track")
    assert speed.first().track == "Monza"
