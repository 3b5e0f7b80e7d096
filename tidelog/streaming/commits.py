"""Numbered commits of a table: data first, marker last, and nothing twice.

A batch writes its rows to a folder of its own number, replacing what an attempt that failed may have left there, and
then a marker. Readers see folders with a marker only. A number that has its marker is never written again, and a
batch leaves out the ids that earlier commits have, so it may be repeated after any failure. The first commit's
settings hold: a run with others is refused. Files are reached through Spark's file systems alone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str = "record_id", settings: dict[str, Any] | None = None) -> None:
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key
        self.settings = hashlib.sha256(json.dumps(settings or {}, sort_keys=True).encode()).hexdigest()

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def markers(self) -> dict[int, dict[str, Any]]:
        """What was committed, by number."""
        files, top = self._files(), self._path("commits")
        if not files.exists(top):
            return {}
        names = sorted(s.getPath().getName() for s in files.listStatus(top) if s.getPath().getName().startswith("batch-"))
        if not names:
            return {}
        told = self.spark.read.schema("batch bigint, records bigint, settings string").json([f"{self.folder}/commits/{n}" for n in names])
        return {row.batch: row.asDict() for row in told.collect()}

    def table(self, only: list[int] | None = None) -> DataFrame:
        """The committed rows."""
        found = sorted(self.markers()) if only is None else only
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/batch-{n:08d}" for n in found))

    def _mark(self, number: int, records: int) -> None:
        files, final, part = self._files(), self._path("commits", f"batch-{number:08d}"), self._path("commits", f".batch-{number:08d}.part")
        out = files.create(part, True)
        out.write(bytearray(json.dumps({"batch": number, "records": records, "settings": self.settings}).encode()))
        out.close()
        files.rename(part, final)

    def commit(self, rows: DataFrame, number: int, before_marker: Callable[[int], None] | None = None) -> bool:
        """Commits rows under a number; False if that number is committed already. before_marker is for tests."""
        done = self.markers()
        if any(m["settings"] != self.settings for m in done.values()):
            raise ValueError("the settings differ from those of the commits before")
        if number in done:
            return False
        ids = self.table(sorted(done)).select(F.col(self.key).alias("__done")).distinct()
        fresh = rows.join(ids, F.col(self.key) == F.col("__done"), "left_anti").select(*self.schema.fieldNames())
        path = f"{self.folder}/data/batch-{number:08d}"
        fresh.write.mode("overwrite").parquet(path)
        if before_marker:
            before_marker(number)
        self._mark(number, self.spark.read.schema(self.schema).parquet(path).select(self.key).distinct().count())
        return True


def commit_every(log: CommitLog, records: DataFrame, process: Callable[[DataFrame], DataFrame], every: int, most: int | None = None) -> int:
    """Processes the records that aren't committed yet, `every` at a time in order of their key; how many commits.

    process returns a row or more for each record. most ends the run after so many commits, as a run that is stopped
    does.
    """
    made = 0
    while most is None or made < most:
        done = log.table().select(F.col(log.key).alias("__done")).distinct()
        part = records.join(done, F.col(log.key) == F.col("__done"), "left_anti").orderBy(log.key).limit(every)
        if not part.limit(1).count():
            break
        number = max(log.markers(), default=-1) + 1
        log.commit(process(part), number)
        if not log.markers()[number]["records"]:
            raise ValueError("processing returned no row for its records")
        made += 1
    return made
