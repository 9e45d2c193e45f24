"""Written tables in the shared folder, and a few helpers that several operators use."""

from __future__ import annotations

import functools
import gc
from contextlib import contextmanager

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapline import session


class Scratch:
    """Intermediate tables of one run, below the folder that spark.checkpoint.dir names.

    Lineage ends at each: a lost executor costs a read of the table, not the work before it.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.folder = session.new_folder(spark, purpose)

    def write(self, df: DataFrame, name: str, *partitions: str) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partitions:
            writer = writer.partitionBy(*partitions)
        writer.parquet(f"{self.folder}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that no later read needs."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)


class Memo(dict):
    """Values by key from a function. Holds ``limit`` keys and as many of the generation before, so memory is bounded
    and keys that keep coming stay."""

    def __init__(self, of, limit: int = 500_000):
        super().__init__()
        self.of, self.limit, self.old = of, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.of(key)
            if key.__class__ is str and len(key) > 200:  # long and not likely to come again
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Functions whose tables a worker process keeps from task to task.
KEPT = []


def kept(make):
    """``make``, its results kept by the worker process until a task calls ``forget``."""
    KEPT.append(functools.lru_cache(maxsize=4)(make))
    return KEPT[-1]


def forget() -> None:
    """Let go of the tables that tasks of other operators left in this worker process."""
    held = [make for make in KEPT if make.cache_info().currsize]
    for make in held:
        make.cache_clear()
    if held:
        gc.collect()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What runs inside hands wide rows to Python at most ``rows`` at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sliced(batches, rows: int = 1024, size: int = 2 << 20, place: int = 1):
    """Batches with a text at ``place`` cut to at most ``rows`` rows and, but for a longer text alone, ``size`` bytes of text, so
    that few texts are Python values at a time."""
    for batch in batches:
        start = held = 0
        for at, n in enumerate(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_pylist()):
            if at > start and (held + n > size or at - start >= rows):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, as ``name=type``; what else the table has is left out."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()))


def free_prefix(df: DataFrame) -> str:
    """The beginning of names that no column of ``df`` has."""
    prefix = "__"
    while any(name.lower().startswith(prefix) for name in df.columns):
        prefix += "_"
    return prefix
