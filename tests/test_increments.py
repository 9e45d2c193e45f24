"""The lap summary by increments equals that of one run over all files."""

import pytest
from pyspark.sql import functions as F

from lapline import schemas, session
from lapline.plans import etl
from lapline.sinks.versions import AppendTable
from lapline.sources.files import read_lake_samples


@pytest.fixture
def lake(spark, samples):
    rows = [{"ts": i, "completed_laps": i // 7, "session_id": "ab"[i % 2], "speed_kmh": float(i), "brake": i % 10 / 10,
             "is_in_pit": i % 11 == 0, "fuel_remaining": None if i % 13 == 0 else 50.0 - i} for i in range(60)]
    t = samples([{**r, "packet_id": i} for i, r in enumerate(rows)])
    for c in schemas.LAKE_SAMPLE.names:
        t = t if c in t.columns else t.withColumn(c, F.lit(None).cast("string"))
    return t.withColumn("timestamp_wall", F.date_format("timestamp_wall", "yyyy-MM-dd'T'HH:mm:ss"))


def rows_of(df):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_three_increments_equal_one_run(spark, lake):
    raw, out, whole = (session.new_folder(spark, name) for name in ("raw", "out", "whole"))
    for third in range(3):
        lake.where(F.col("packet_id") % 3 == third).drop("packet_id").coalesce(1).write.mode("append").json(raw)
        got = etl.increment(spark, raw, out)
    etl.run(spark, raw, whole, "clustered")
    want = spark.read.parquet(f"{whole}/lap_summary")
    assert rows_of(got.select(want.columns)) == rows_of(want)
    assert rows_of(etl.increment(spark, raw, out)) == rows_of(got)  # nothing new, nothing changed
    parts = etl.summary_parts(spark, out)
    before = parts.read().count()
    parts.compact(whole=True)
    assert parts.read().count() == want.count() < before  # a merge leaves one part for each lap
    assert etl.processed_samples(spark, out).read().count() == etl.read_processed(spark, whole).count()


def test_an_increment_that_breaks_off_goes_on(spark, lake, monkeypatch):
    raw, out = session.new_folder(spark, "raw"), session.new_folder(spark, "out")
    lake.drop("packet_id").write.json(raw)
    with monkeypatch.context() as broken:
        append = AppendTable.append
        broken.setattr(AppendTable, "append", lambda self, *a: 1 / 0 if "lap_parts" in self.path else append(self, *a))
        with pytest.raises(Exception):
            etl.increment(spark, raw, out)
    assert sum(r.sample_count for r in etl.increment(spark, raw, out).collect()) == lake.where(~F.col("is_in_pit")).count()
    assert etl.processed_samples(spark, out).read().count() == lake.where(~F.col("is_in_pit")).count()


def test_lake_files_are_compressed_and_of_few_rows(spark, lake, monkeypatch):
    from lapline.plans import queries

    monkeypatch.setattr(queries, "LAKE_FILE_ROWS", 10)
    raw = session.new_folder(spark, "raw")
    queries.write_lake(lake.drop("packet_id").coalesce(1), f"{raw}/2024")
    files = read_lake_samples(spark, raw).inputFiles()
    assert len(files) == 6 and all(f.endswith(".json.gz") for f in files)
    assert read_lake_samples(spark, raw).count() == 60
