"""Sinks and scans."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from skein.sources import files


def test_runs(spark, tmp_path):
    run = {"arm": "base", "seed": 42, "accuracy": 0.5, "predictions": [{"question_id": "a", "predicted_idx": None}, {"question_id": "b", "predicted_idx": 2}]}
    for seed in (42, 43):
        (tmp_path / f"base_seed{seed}.json").write_text(json.dumps(run | {"seed": seed}, indent=1))
    runs = files.read_runs(spark, str(tmp_path))
    assert sorted(r["file"] for r in runs.collect()) == ["base_seed42.json", "base_seed43.json"]
    assert all(r["exclusive"] for r in runs.collect()) and files.run_predictions(runs).count() == 4


def test_passages_and_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "text", "c", None, None)], files.PASSAGE)
    files.write_json_lines(rows, str(tmp_path / "p"))
    assert files.read_passages(spark, str(tmp_path / "p"), 1).collect() == rows.collect()
    with pytest.raises(ValueError, match="recorded"):
        files.read_passages(spark, str(tmp_path / "p"), 2)
    (tmp_path / "s.csv").write_text("question_id,question,reference,candidate,human_score,notes\n1,q,r,c,2,\n2,q,r,c,,\n9,q,r,c,1,x\n")
    known = spark.range(1, 4).select(F.col("id").alias("question_id"))
    assert [tuple(r) for r in files.read_sheet(spark, str(tmp_path / "s.csv"), known).collect()] == [("1", 2)]
    files.write_sheet(rows.select("id"), str(tmp_path / "w"))
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).columns == ["id", "human_label", "notes"]


def test_lexicon_settings_and_manifest(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"Hea": "heart"}')
    assert files.read_lexicon(spark, str(tmp_path / "l.json")) == {"hea": "heart"}
    with pytest.raises(ValueError, match="unknown settings: z"):
        files.settings({"z": 1}, {"a": 2})
    rows = spark.createDataFrame([("test", 2, "ab"), ("val", 1, "cd")], "split string, n int, digest string")
    made = json.loads(files.manifest_json(rows, seed=42).first()["manifest"])
    assert made == {"splits": {"test": {"n": 2, "digest": "ab"}, "val": {"n": 1, "digest": "cd"}}, "seed": 42}


def test_documents_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("a_seed1", "a", 1, None), ("b_seed2", "b", 2, 0.5)], "name string, arm string, seed int, accuracy double")
    files.write_documents(rows, str(tmp_path / "d"))
    got = files.read_runs(spark, str(tmp_path / "d"))
    assert sorted((r["file"], r["arm"], r["seed"], r["accuracy"]) for r in got.collect()) == [("a_seed1", "a", 1, None), ("b_seed2", "b", 2, 0.5)]


def test_judged_items_without_scores_are_left_out(spark, tmp_path):
    items = [{"item_id": "1", "scores": [2, 1], "majority": 2, "mean": 1.5}, {"item_id": "2", "scores": [], "majority": None, "mean": 0.0}, {"item_id": "3", "scores": [1], "majority": 1, "mean": 1.0}]
    (tmp_path / "a.json").write_text(json.dumps({"arm": "a", "judge_sd": 0.1, "unparseable_replies": 1, "items": items}, indent=1))
    assert sorted(map(tuple, files.read_judged(spark, str(tmp_path)).collect())) == [("a", "1", 0.75), ("a", "3", 0.5)]
    assert sorted(map(tuple, files.read_judged(spark, str(tmp_path), strict=True).collect())) == [("a", "1", 1.0), ("a", "3", 0.0)]


def test_frozen_file_has_a_digest(spark, tmp_path):
    files.write_frozen(spark.createDataFrame([('{"id":"b"}',), ('{"id":"a"}',)], "value string"), str(tmp_path / "f"))
    rows, digest = files.read_frozen(spark, str(tmp_path / "f"), "id string")
    assert [r["id"] for r in rows.collect()] == ["a", "b"]
    assert digest == hashlib.sha256(b'{"id":"a"}\n{"id":"b"}\n').hexdigest()


def test_settings_files(tmp_path):
    known = {"k": 5, "floor": None}
    assert files.read_settings(str(tmp_path / "none.yaml"), known) == known
    (tmp_path / "a.yaml").write_text("retrieval:\n  k: 7\n")
    (tmp_path / "b.json").write_text('{"floor": 0.3}')
    (tmp_path / "c.json").write_text("[1]")
    assert files.read_settings(str(tmp_path / "a.yaml"), known, "retrieval") == {"k": 7, "floor": None}
    assert files.read_settings(str(tmp_path / "b.json"), known, "retrieval") == {"k": 5, "floor": 0.3}
    with pytest.raises(ValueError, match="unknown settings: retrieval"):
        files.read_settings(str(tmp_path / "a.yaml"), known)
    with pytest.raises(TypeError, match="mapping"):
        files.read_settings(str(tmp_path / "c.json"), known)


def test_scope_deletes_what_is_not_kept(spark):
    from pathlib import Path

    from skein.sources import scratch

    there = lambda df: Path(df._skein_path.removeprefix("file://")).exists()
    with scratch.scope() as outer:
        one = scratch.store(spark.range(3), "one")
        with scratch.scope() as inner:
            two, three = scratch.store(spark.range(4), "two"), scratch.store(spark.range(5), "three")
            inner.append(three)
        assert there(one) and not there(two) and there(three)
        outer.append(one)
    assert there(one) and one.count() == 3 and not there(three)
