"""Tables that readers see by a manifest, so that files can be replaced while others read them."""

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lapline.operators.laps import LAP

#: Folders of one level that are merged into one of the next.
FAN = 8


class Folder:
    """The few calls to a shared file system that Spark's readers and writers don't cover."""

    def __init__(self, spark: SparkSession, path: str):
        self._context = spark.sparkContext
        self._hadoop = self._context._jvm.org.apache.hadoop.fs
        self._conf = self._context._jsc.hadoopConfiguration()
        root = self._hadoop.Path(path)
        self._system = root.getFileSystem(self._conf)
        self._root = self._system.makeQualified(root)
        self.path = path

    def _at(self, name: str):
        return self._hadoop.Path(self._root, name)

    def names(self, pattern: str) -> list[str]:
        """Names relative to the folder that match a glob, in order."""
        found = self._system.globStatus(self._at(pattern)) or []
        start = len(self._root.toUri().getPath().rstrip("/")) + 1
        return sorted(f.getPath().toUri().getPath()[start:] for f in found)

    def text(self, name: str) -> str:
        stream = self._system.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """A file that appears whole under its name; False if the name is taken.

        The rename that doesn't replace is one step on HDFS and local disks. An object store without such a rename
        needs a single writer.
        """
        held, target = self._at(f"{name}.{uuid.uuid4().hex}.tmp"), self._at(name)
        stream = self._system.create(held)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(self._root.toUri(), self._conf)
        options = self._context._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(held, target, options)
        except Py4JJavaError:
            if not self._system.exists(target):
                raise
            self._system.delete(held, False)
            return False
        return True

    @property
    def uri(self) -> str:
        return self._root.toString()

    def clear(self) -> None:
        """Delete the folder itself."""
        self._system.delete(self._root, True)

    def delete(self, name: str) -> None:
        self._system.delete(self._at(name), True)


class Versions:
    """Numbered states of something, each a small JSON file; the highest number holds.

    A writer that loses the race for a number works its change out again on the state that won.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._folder = Folder(spark, path)

    def latest(self) -> tuple[int, dict]:
        found = self._folder.names("*.json")
        return (int(found[-1].removesuffix(".json")), json.loads(self._folder.text(found[-1]))) if found else (-1, {})

    def change(self, work_out: Callable[[dict], dict | None]) -> bool:
        """Commit what ``work_out`` makes of the latest state; False if it makes None of it."""
        while True:
            number, now = self.latest()
            new = work_out(now)
            if new is None:
                return False
            if self._folder.put_new(f"{number + 1:020d}.json", json.dumps(new)):
                return True

    def forget(self, keep: int = 10) -> None:
        """Delete all but the last states."""
        for name in self._folder.names("*.json")[:-keep]:
            self._folder.delete(name)


class AppendTable:
    """Parquet that micro-batches append to, ordered by key inside, with a manifest of its folders.

    The manifest has the folders that hold, each with its level, and of each run the last batch. A batch that comes
    again, after whatever broke off, replaces its own folder or is known to be there. Eight folders of a level are
    merged into one of the next, so a row is rewritten a few times and the number of folders grows with the logarithm
    of the number of batches. Readers keep the folders of the manifest they read until ``vacuum``. With ``merge`` a
    merge of folders also merges rows, as for partial aggregates.
    """

    def __init__(self, spark: SparkSession, path: str, keys=tuple(LAP), time: str | None = None,
                 merge: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.path, self.order = spark, path.rstrip("/"), [*keys, *([time] if time else [])]
        self.merge = merge or (lambda rows: rows)
        self.versions = Versions(spark, f"{self.path}/manifest")

    def append(self, batch: DataFrame, run: str, number: int) -> bool:
        """Write a batch; False if the table has it."""
        _, now = self.versions.latest()
        if now.get("batches", {}).get(run, -1) >= number:
            return False
        folder = f"data/batch-{run}-{number}"
        self._write(batch, folder)

        def added(now):
            if now.get("batches", {}).get(run, -1) >= number:
                return None
            return {"schema": now.get("schema") or batch.schema.json(),
                    "folders": [*now.get("folders", []), {"name": folder, "level": 0}],
                    "batches": {**now.get("batches", {}), run: number}}
        return self.versions.change(added)

    def append_and_merge(self, batch: DataFrame, run: str, number: int) -> None:
        """A sink of a stream: append, and merge small folders as they add up."""
        self.append(batch, run, number)
        if number % FAN == FAN - 1:
            self.compact()

    def read(self) -> DataFrame:
        _, now = self.versions.latest()
        if not now:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._read(now, [f["name"] for f in now["folders"]])

    def compact(self, whole: bool = False, fan: int = FAN) -> int:
        """Merge ``fan`` folders of a level into one of the next, as long as there are some, or all into one.

        Gives how many merges were committed. A merge that breaks off leaves files no manifest names; one whose folders
        another merge has taken meanwhile is left out.
        """
        done = 0
        while True:
            _, now = self.versions.latest()
            folders = now.get("folders", [])
            levels = {}
            for f in folders:
                levels.setdefault(f["level"], []).append(f["name"])
            if whole:
                taken, level = [f["name"] for f in folders] if len(folders) > 1 else [], max(levels, default=0)
            else:
                level, taken = next(((k, v[:fan]) for k, v in sorted(levels.items()) if len(v) >= fan), (0, []))
            if not taken:
                return done
            merged = f"data/level{level + 1}-{uuid.uuid4().hex}"
            self._write(self.merge(self._read(now, taken)), merged)
            done += self.versions.change(lambda now: self._replaced(now, taken, merged, level + 1))

    @staticmethod
    def _replaced(now: dict, taken: list[str], merged: str, level: int) -> dict | None:
        if not set(taken) <= {f["name"] for f in now["folders"]}:
            return None
        kept = [f for f in now["folders"] if f["name"] not in taken]
        return {**now, "folders": [*kept, {"name": merged, "level": level}]}

    def vacuum(self) -> int:
        """Delete folders that the manifest doesn't name. Only while no one reads an older one or writes."""
        _, now = self.versions.latest()
        held, folder = {f["name"] for f in now.get("folders", [])}, Folder(self.spark, self.path)
        spare = [name for name in folder.names("data/*") if name not in held]
        for name in spare:
            folder.delete(name)
        self.versions.forget()
        return len(spare)

    def _read(self, now: dict, names: list[str]) -> DataFrame:
        reader = self.spark.read.schema(StructType.fromJson(json.loads(now["schema"])))
        return reader.parquet(*[f"{self.path}/{name}" for name in names])

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.repartitionByRange(*self.order).sortWithinPartitions(*self.order).write.mode("overwrite").parquet(
            f"{self.path}/{folder}")
