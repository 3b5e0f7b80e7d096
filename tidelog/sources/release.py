"""Releases: a hashed manifest, two tables of records and id lists for subsets."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import validation
from tidelog.sources.filehash import compare
from tidelog.sources.jsonl import MONITORS, QUESTIONS, read_ids, read_strict

TASKS = {"qa": ("qa_file", QUESTIONS, "tiny_qa_ids_file"), "proactive": ("proactive_file", MONITORS, "tiny_proactive_ids_file")}
#: Fixed value: the file that lists the standard monitoring records; manifests don't name it.
STANDARD_IDS = "standard_proactive_ids.json"


class ReleaseError(ValueError):
    """A release that isn't whole."""


class Release:
    """A release directory; files are named by its manifest and stay inside it."""

    def __init__(self, root: str | Path):
        self.root = Path(root)
        path = self.root / "manifest.json"
        if not path.is_file():
            raise ReleaseError(f"{path} is missing")
        self.manifest = json.loads(path.read_text(encoding="utf-8"))
        for name, _, ids in TASKS.values():
            for key in (name, ids):
                if not self._path(self.manifest[key]).is_file():
                    raise ReleaseError(f"{self.manifest[key]} is missing")

    def _path(self, name: str) -> Path:
        path = (self.root / name).resolve()
        if not path.is_relative_to(self.root.resolve()):
            raise ReleaseError(f"{name} leaves the release")
        return path

    def records(self, spark: SparkSession, task: str, subset: str = "full") -> DataFrame:
        """A task's records, checked; tiny and standard in the order of their id lists (column pos)."""
        name, schema, tiny = TASKS[task]
        rows = read_strict(spark, str(self._path(self.manifest[name])), schema)
        if task == "proactive":
            rows = rows.withColumn("trigger_annotations", F.col("metadata.trigger_annotations"))
            problems = validation.proactive_problems(rows)
        else:
            problems = validation.question_problems(rows)
        bad = problems.where(F.size("problems") > 0).select("record_id", "problems").limit(3).collect()
        if bad:
            raise ReleaseError(f"records aren't sound: {bad}")
        if twice := validation.duplicates(rows, "record_id").limit(3).collect():
            raise ReleaseError(f"ids repeat: {twice}")
        if subset in ("full", "all") or (subset == "standard" and task == "qa"):
            return rows
        listed = self._path(STANDARD_IDS if subset == "standard" else self.manifest[tiny])
        if not listed.is_file():
            raise ReleaseError(f"the {subset} subset is unavailable in this release: {listed} is missing")
        ids = read_ids(spark, str(listed))
        if unknown := validation.unknown_ids(ids, rows, "record_id").limit(3).collect():
            raise ReleaseError(f"unknown ids: {unknown}")
        return validation.select_subset(ids, rows, "record_id").orderBy("pos")

    def validate(self, spark: SparkSession) -> dict:
        """Compares every listed hash and the counts; what was checked."""
        files = self.manifest["files"]
        needed = {self.manifest[k] for name, _, ids in TASKS.values() for k in (name, ids)}
        if lacking := needed - files.keys():
            raise ReleaseError(f"without a hash: {sorted(lacking)}")
        for name in files:
            self._path(name)
        wrong = compare(spark, str(self.root), files).where("state in ('changed', 'missing')").orderBy("path").first()
        if wrong is not None:
            raise ReleaseError(f"{wrong.path} was changed" if wrong.state == "changed" else f"{wrong.path} is missing")
        counts = {task: self.records(spark, task).count() for task in TASKS}
        for task, n in counts.items():
            if self.manifest.get("counts", {}).get(task, n) != n:
                raise ReleaseError(f"{task} has {n} records")
        return {"checked_files": sorted(files), "counts": counts}
