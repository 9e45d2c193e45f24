"""Tables by manifest: merged, broken off, raced for, and several sinks on one source."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lapline import session
from lapline.sinks.versions import AppendTable, Folder, Versions
from lapline.streaming import pipelines


@pytest.fixture
def table(spark):
    return AppendTable(spark, session.new_folder(spark, "table"), ["k"], "v")


def rows(spark, start, n=10):
    return spark.range(start, start + n).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))


def values(table):
    return sorted(r.v for r in table.read().collect())


def test_a_batch_arrives_once(spark, table):
    assert table.append(rows(spark, 0), "r", 0)
    assert not table.append(rows(spark, 0), "r", 0)
    assert table.append(rows(spark, 10), "r", 1) and table.append(rows(spark, 20), "other", 0)
    assert values(table) == list(range(30))


def test_a_killed_run_leaves_no_row_twice(spark, table, monkeypatch):
    """Files written and no manifest; a manifest and no commit of the stream; a merge that ends before its manifest."""
    table.append(rows(spark, 0), "r", 0)
    with monkeypatch.context() as broken:
        broken.setattr(Versions, "change", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.append(rows(spark, 10, 7), "r", 1)
    assert values(table) == list(range(10))
    assert table.append(rows(spark, 10), "r", 1) and not table.append(rows(spark, 10), "r", 1)
    with monkeypatch.context() as broken:
        broken.setattr(Versions, "change", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.compact(whole=True)
    assert values(table) == list(range(20))
    assert table.compact(whole=True) == 1 and values(table) == list(range(20))
    assert not table.append(rows(spark, 10), "r", 1)  # known after its folder is gone
    assert table.vacuum() == 3 and values(table) == list(range(20))


def test_folders_grow_with_the_logarithm_of_batches(spark, table):
    for number in range(11):
        table.append(rows(spark, number * 10), "r", number)
        table.compact(fan=3)
    levels = sorted(f["level"] for f in table.versions.latest()[1]["folders"])
    assert levels == [0, 0, 2] and values(table) == list(range(110))
    table.compact(whole=True)
    files = {f.rpartition("/")[2] for f in table.read().inputFiles()}
    assert len(table.versions.latest()[1]["folders"]) == 1 and len(files) <= 4
    key = table.read().where("k = 1").select(F.input_file_name()).distinct().count()
    assert key == 1  # a key's rows lie together whatever the number of batches


def test_a_reader_keeps_its_folders_while_they_are_merged(spark, table):
    for number in range(3):
        table.append(rows(spark, number * 10), "r", number)
    before = table.read()
    table.compact(whole=True)
    table.append(rows(spark, 30), "r", 3)
    assert before.count() == 30 and table.read().count() == 40


def test_writers_that_race(spark, table, monkeypatch):
    """A merge commits over a batch that came meanwhile; two merges of one folder don't both count."""
    for number in range(2):
        table.append(rows(spark, number * 10), "r", number)
    write, other = AppendTable._write, AppendTable(spark, table.path, ["k"], "v")

    def meanwhile(self, df, folder):
        write(self, df, folder)
        monkeypatch.setattr(AppendTable, "_write", write)
        other.append(rows(spark, 20), "r", 2)
        other.compact(whole=True)

    monkeypatch.setattr(AppendTable, "_write", meanwhile)
    assert table.compact(whole=True) == 0
    assert values(table) == list(range(30))


def test_a_name_is_taken_once(spark):
    folder = Folder(spark, session.new_folder(spark, "names"))
    assert folder.put_new("a.json", "1") and not folder.put_new("a.json", "2")
    assert folder.text("a.json") == "1" and folder.names("*") == ["a.json"]
    assert folder.names("nothing/*") == []


def source(spark, parts):
    path = session.new_folder(spark, "in")
    for k in range(parts):
        rows(spark, k * 10).coalesce(1).write.mode("append").parquet(path)
    return lambda: spark.readStream.schema("k long, v long").option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_into_a_table(spark, table):
    stream, checkpoint = source(spark, 5), session.new_folder(spark, "state")
    for _ in range(2):  # the second run finds nothing new
        pipelines.start_table(stream(), table, checkpoint, fan=2).awaitTermination()
    assert values(table) == list(range(50))
    assert len(table.versions.latest()[1]["folders"]) <= 3


def test_two_sinks_are_equal_after_one_failed(spark):
    one, two = (AppendTable(spark, session.new_folder(spark, name), ["k"], "v") for name in ("one", "two"))
    stream, checkpoint, taken = source(spark, 3), session.new_folder(spark, "state"), []

    def first(batch, run, number):
        taken.append(number)
        one.append(batch, run, number)

    def second(broken):
        def store(batch, run, number):
            two.append(batch, run, number) if not broken or number != 1 else 1 / 0
        return store

    spark.streams.resetTerminated()
    with pytest.raises(StreamingQueryException):
        pipelines.start_fan_out(stream(), {"one": first, "two": second(True)}, checkpoint)
        pipelines.await_any(spark)
    assert (len(values(one)), len(values(two))) == (20, 10)
    spark.streams.resetTerminated()
    pipelines.start_fan_out(stream(), {"one": first, "two": second(False)}, checkpoint).awaitTermination()
    assert values(one) == values(two) == list(range(30))
    assert taken == [0, 1, 2]  # the sink that had batch 1 didn't get it again
