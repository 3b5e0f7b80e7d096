"""Run bundles: numbered checkpoints that a marker commits, a final result under hashes, and scores beside it.

The large parts are written by Spark as directories; the small ones by the driver, each under another name first and
then renamed. A checkpoint counts once its marker is there, and the marker is written last.
"""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import stable_hash
from tidelog.operators import validation
from tidelog.sources.filehash import compare, hashed_files
from tidelog.sources.jsonl import read_events, write_sorted

TABLES = ("records", "events")
OUTSIDE = ("integrity.json", "checkpoints", "rescored.json", "rescored_records")


class BundleError(ValueError):
    """A bundle that isn't whole, or an operation that it doesn't allow."""


def write_text(path: Path, text: str) -> None:
    part = path.with_name(f".{path.name}.part")
    with part.open("w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    fd = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def write_json(path: Path, value: Any) -> None:
    write_text(path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def hashes_of(folder: Path, without: tuple[str, ...] = ()) -> dict[str, str]:
    """The files of a folder, a manifest of a bundle's size; executors hash them."""
    found = hashed_files(SparkSession.builder.getOrCreate(), str(folder), without)
    return {r.path: r.found for r in found.orderBy("path").collect()}


def differing(folder: Path, told: dict[str, str], without: tuple[str, ...] = ()) -> list[str]:
    """Some files that are missing, changed or not listed."""
    states = compare(SparkSession.builder.getOrCreate(), str(folder), told, without).where("state <> 'same'")
    return [f"{r.path} is {r.state}" for r in states.orderBy("path").limit(3).collect()]


class RunBundle:
    """A run's directory."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    @property
    def finalized(self) -> bool:
        path = self.root / "manifest.json"
        return path.exists() and json.loads(path.read_text())["status"] == "finalized"

    def _open(self) -> None:
        if self.finalized:
            raise BundleError("the bundle is final")

    def prepare(self, config: dict[str, Any]) -> str:
        """Freezes the configuration before anything runs; its hash."""
        self._open()
        self.root.mkdir(parents=True, exist_ok=True)
        identity = {k: v for k, v in config.items() if k not in ("output", "resume", "checkpoint_every")}
        frozen = config | {"config_hash": stable_hash(identity)}
        write_json(self.root / "config.json", frozen)
        return frozen["config_hash"]

    def config(self) -> dict[str, Any]:
        return json.loads((self.root / "config.json").read_text())

    def _save(self, folder: Path, records: DataFrame, events: DataFrame) -> None:
        for name, rows in zip(TABLES, (records, events), strict=True):
            write_sorted(rows, str(folder / name))

    def _checked(self, records: DataFrame, events: DataFrame) -> None:
        state = validation.membership(records).first()
        if state["null_ids"] or state["repeated_ids"] or state["open_statuses"]:
            raise BundleError(f"records aren't whole: {state.asDict()}")
        if validation.orphans(events, records, "record_id").limit(1).count():
            raise BundleError("there are events of unknown records")

    def checkpoint(self, records: DataFrame, events: DataFrame) -> Path:
        self._open()
        self._checked(records, events)
        folder = self.root / "checkpoints" / f"{max(self._numbers(), default=0) + 1:06d}"
        folder.mkdir(parents=True)
        self._save(folder, records, events)
        write_json(folder / "config.json", self.config())
        write_json(folder / "commit.json", {"files": hashes_of(folder)})
        return folder

    def _numbers(self) -> list[int]:
        top = self.root / "checkpoints"
        return sorted(int(p.name) for p in top.iterdir() if p.name.isdigit()) if top.exists() else []

    def latest_checkpoint(self) -> Path | None:
        """The newest committed checkpoint; one that doesn't match its hashes is an error, not passed over."""
        for n in reversed(self._numbers()):
            folder = self.root / "checkpoints" / f"{n:06d}"
            if (folder / "commit.json").exists():
                told = json.loads((folder / "commit.json").read_text())["files"]
                if wrong := differing(folder, told, ("commit.json",)):
                    raise BundleError(f"checkpoint {n} was changed: {wrong}")
                return folder
        return None

    def resume(self, spark: SparkSession, config_hash: str) -> tuple[DataFrame, DataFrame] | None:
        found = self.latest_checkpoint()
        if found is None:
            return None
        if json.loads((found / "config.json").read_text())["config_hash"] != config_hash:
            raise BundleError("the checkpoint belongs to another configuration")
        return tuple(spark.read.json(str(found / name)) for name in TABLES)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """records or events, of the final result or else of the newest checkpoint."""
        final = self.root / name
        folder = self.root if final.exists() else self.latest_checkpoint()
        if folder is None:
            raise BundleError(f"there are no {name}")
        return spark.read.json(str(folder / name))

    def finalize(self, records: DataFrame, events: DataFrame, metrics: dict[str, Any], summary: dict[str, Any]) -> None:
        self._open()
        self._checked(records, events)
        self._save(self.root, records, events)
        write_json(self.root / "metrics.json", metrics)
        write_json(self.root / "summary.json", summary)
        write_json(self.root / "manifest.json", {"status": "finalized", "tables": list(TABLES)})
        write_json(self.root / "integrity.json", hashes_of(self.root, OUTSIDE))

    def discard_checkpoints(self) -> None:
        shutil.rmtree(self.root / "checkpoints", ignore_errors=True)

    def write_rescored(self, metrics: dict[str, Any], records: DataFrame) -> None:
        """New scores beside the result, which stays as it is."""
        if not self.finalized:
            raise BundleError("only a final bundle is scored again")
        shutil.rmtree(self.root / "rescored_records", ignore_errors=True)
        write_sorted(records, str(self.root / "rescored_records"))
        write_json(self.root / "rescored.json", metrics)

    def _drifted(self, records: DataFrame, events: DataFrame) -> DataFrame:
        """The records whose own events, if they have any, aren't those of the log."""
        inner = getattr(records.schema["events"].dataType, "elementType", None) if "events" in records.columns else None
        fields = [f for f in getattr(inner, "fieldNames", list)() if f not in ("record_id", "event_index")]
        if not fields:
            return records.limit(0)
        own = records.withColumn("events", F.transform("events", lambda e: F.struct(*(e[f].alias(f) for f in fields))))
        log = events if "event_index" in events.columns else read_events(records.sparkSession, str(self.root / "events"), events.schema)
        log = log.select("record_id", "event_index", *(F.col(f) if f in log.columns else F.lit(None).alias(f) for f in fields))
        return validation.event_drift(own, log).where("state = 'differs'")

    def validate(self, spark: SparkSession) -> dict[str, Any]:
        if not self.finalized:
            raise BundleError("the bundle isn't final")
        told = json.loads((self.root / "integrity.json").read_text())
        if wrong := differing(self.root, told, OUTSIDE):
            raise BundleError(f"files differ: {wrong}")
        records, events = (self.table(spark, n) for n in TABLES)
        self._checked(records, events)
        if bad := self._drifted(records, events).limit(3).collect():
            raise BundleError(f"embedded events disagree with the log: {[r.record_id for r in bad]}")
        return {"records": records.count(), "events": events.count(), "files": len(told)}
