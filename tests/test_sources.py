import json

import pytest

from tidelog.functions.hashing import file_hash
from tidelog.sources.bundle import BundleError, RunBundle
from tidelog.sources.config import RunConfig, resolve
from tidelog.sources.jsonl import QUESTIONS, read_events, read_ids, read_open, read_strict
from tidelog.sources.release import Release, ReleaseError


def make_release(root):
    qa = {"record_id": "qa:1", "source_id": "s", "task": "qa", "task_type": "T", "video_path": "v", "question": "?", "options": ["A", "B"], "answer": "A", "question_time_s": 2.0, "evidence_anchor_s": 1.0, "memory_length": 0.0, "metadata": {}}
    pro = {"record_id": "p:1", "source_id": "s", "task": "proactive", "task_type": "T", "video_path": "v", "instruction": "i", "instruction_time_s": 0.0, "deadline_s": 3.0, "windows": [{"start_s": 1.0, "end_s": 2.5, "expected_answer": "event"}], "memory_length": 0.0, "metadata": {}}
    (root / "qa.jsonl").write_text(json.dumps(qa) + "\n\n")
    (root / "pro.jsonl").write_text(json.dumps(pro) + "\n")
    (root / "qa_ids.json").write_text('["qa:1"]')
    (root / "pro_ids.json").write_text('["p:1"]')
    names = {"qa_file": "qa.jsonl", "proactive_file": "pro.jsonl", "tiny_qa_ids_file": "qa_ids.json", "tiny_proactive_ids_file": "pro_ids.json"}
    (root / "manifest.json").write_text(json.dumps(names | {"counts": {"qa": 1, "proactive": 1}, "files": {n: file_hash(root / n) for n in names.values()}}))


def test_release(spark, tmp_path):
    make_release(tmp_path)
    release = Release(tmp_path)
    assert release.validate(spark)["counts"] == {"qa": 1, "proactive": 1}
    assert release.records(spark, "qa", "tiny").first()["record_id"] == "qa:1"
    (tmp_path / "qa_ids.json").write_text('["qa:2"]')
    with pytest.raises(ReleaseError, match="unknown"):
        release.records(spark, "qa", "tiny")
    with pytest.raises(ReleaseError, match="changed"):
        release.validate(spark)
    release.manifest["qa_file"] = "../x"
    with pytest.raises(ReleaseError, match="leaves"):
        release.records(spark, "qa")


def test_strict_scan_names_the_bad_line(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"record_id": "a", "surprise": 1}\n')
    with pytest.raises(Exception, match="invalid row"):
        read_strict(spark, str(path), QUESTIONS).collect()
    (tmp_path / "ids.json").write_text('["a", "a"]')
    with pytest.raises(Exception, match="different strings"):
        read_ids(spark, str(tmp_path / "ids.json")).collect()
    assert read_open(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_events_keep_their_order(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("".join(json.dumps({"record_id": "r", "kind": "answer", "text": t, "telemetry": {"on_time": True}}) + "\n" for t in "abc"))
    assert [r["text"] for r in read_events(spark, str(tmp_path / "e.jsonl")).orderBy("event_index").collect()] == ["a", "b", "c"]


def test_bundle(spark, tmp_path):
    records = spark.createDataFrame([("a", "completed"), ("b", "failed")], "record_id string, status string")
    events = spark.createDataFrame([("a", "answer")], "record_id string, kind string")
    bundle = RunBundle(tmp_path / "run")
    told = bundle.prepare({"task": "qa", "output": "x"})
    first = bundle.checkpoint(records, events)
    (tmp_path / "run/checkpoints/000009").mkdir()
    assert bundle.latest_checkpoint() == first
    assert bundle.resume(spark, told)[0].count() == 2
    with pytest.raises(BundleError, match="another configuration"):
        bundle.resume(spark, "0")
    with pytest.raises(BundleError, match="unknown records"):
        bundle.checkpoint(records, spark.createDataFrame([("z", "answer")], "record_id string, kind string"))
    bundle.finalize(records, events, {"m": 1}, {"s": 1})
    bundle.discard_checkpoints()
    assert bundle.validate(spark)["records"] == 2
    with pytest.raises(BundleError, match="final"):
        bundle.checkpoint(records, events)
    bundle.write_rescored({"m": 2}, records)
    assert bundle.validate(spark)["events"] == 1
    (tmp_path / "run/metrics.json").write_text("{}")
    with pytest.raises(BundleError, match="differ"):
        bundle.validate(spark)


def test_config():
    assert resolve({"task": "proactive"}, {"fps": None}, {"TIDELOG_CHECKPOINT_EVERY": "3"}) == RunConfig(task="proactive", checkpoint_every=3)
    with pytest.raises(ValueError, match="proactive_window_s"):
        resolve({}, {"proactive_window_s": 7.0}, {})
    with pytest.raises(ValueError, match="unknown"):
        resolve({"speed": 1}, {}, {})
