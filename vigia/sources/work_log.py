"""The work log as versioned snapshots and appended entries: reading costs the live keys and what came after them.

A log is a folder with ``entries`` (appended Parquet files) and ``base-N`` folders, each a snapshot of the last entry of each key.
The newest whole snapshot counts. Compaction writes a snapshot of the newest one and of the entries that it listed to a folder of
another name and renames it, which is the switch; entries that the snapshot before had taken in are deleted only at the next
compaction. A crash between any two steps leaves a log that reads the same: an entry that lies in a snapshot and in
``entries`` is the same entry twice, and the last one of each key counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigia.operators.serving import latest_actions

SCHEMA = "key string, status string, note string, updated_at string"


class WorkLog:
    """The log in one folder; any number of writers append, one at a time compacts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def append(self, action: DataFrame) -> None:
        """Add entries; those without a time have that of now."""
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        rows = action.select("key", "status", F.col("note") if "note" in action.columns else F.lit(None).cast("string").alias("note"), F.coalesce("updated_at", now).alias("updated_at") if "updated_at" in action.columns else now.alias("updated_at"))
        rows.write.mode("append").parquet(f"{self.path}/entries")

    def read(self) -> DataFrame:
        """The last entry of each key. A compaction meanwhile leaves what is read here for one compaction more."""
        number = self._newest()
        taken = self._taken(number)
        return self._parts(number, [f for f in self._entries() if f not in taken])

    def compact(self) -> int:
        """Write the next snapshot and switch to it; the number of the snapshot that counts then. Without new entries nothing happens."""
        number, found = self._newest(), self._entries()
        taken = self._taken(number)
        if not set(found) - taken:
            return number
        made = self._write_snapshot(number, found)
        self._list_taken(made, found)
        if not self._switch(made, number + 1):
            raise RuntimeError("another compaction was faster")
        self._clean(number, taken)
        return number + 1

    # The steps of a compaction, each of which may be the last one before a crash.

    def _write_snapshot(self, number: int, found: list[str]) -> str:
        made = f"{self.path}/_new-{uuid.uuid4().hex}"
        self._parts(number, found).write.parquet(made)
        return made

    def _list_taken(self, made: str, found: list[str]) -> None:
        rows = self.spark.createDataFrame([(f,) for f in found], "file string")
        rows.coalesce(1).write.mode("overwrite").json(f"{made}/_taken")

    def _switch(self, made: str, number: int) -> bool:
        target = self._path(f"{self.path}/base-{number}")
        return not self._system.exists(target) and self._system.rename(self._path(made), target)

    def _clean(self, number: int, taken: set[str]) -> None:
        """Delete what the snapshot before last and those entries hold that the last one had taken in already."""
        for file in taken:
            self._system.delete(self._path(file), False)
        for name in self._names(""):
            old = name.startswith("base-") and int(name[5:]) < number
            if old:
                self._system.delete(self._path(f"{self.path}/{name}"), True)

    def _parts(self, number: int, found: list[str]) -> DataFrame:
        parts = ([f"{self.path}/base-{number}"] if number else []) + found
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return latest_actions(self.spark.read.schema(SCHEMA).parquet(*parts))

    def _names(self, folder: str) -> list[str]:
        place = self._path(f"{self.path}/{folder}" if folder else self.path)
        return [s.getPath().getName() for s in self._system.listStatus(place)] if self._system.exists(place) else []

    def _entries(self) -> list[str]:
        return sorted(f"{self.path}/entries/{n}" for n in self._names("entries") if n.endswith(".parquet") and not n.startswith((".", "_")))

    def _newest(self) -> int:
        """The largest number of a snapshot, 0 without any."""
        return max((int(n[5:]) for n in self._names("") if n.startswith("base-") and n[5:].isdigit()), default=0)

    def _taken(self, number: int) -> set[str]:
        if not number or not self._system.exists(self._path(f"{self.path}/base-{number}/_taken")):
            return set()
        return {r["file"] for r in self.spark.read.schema("file string").json(f"{self.path}/base-{number}/_taken").toLocalIterator()}
