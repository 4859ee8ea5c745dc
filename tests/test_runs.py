"""Runs as they are written, broken off, read back and upgraded."""

import pytest

from factloom import runs
from factloom.engine import Engine
from factloom.operators.evidence import Budget


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}.sql", t, len(t), str(hash(t))) for i, t in enumerate(texts)], "path string, content string, size long, sha256 string")


def test_round_trip(spark, tmp_path):
    root, engine = f"file://{tmp_path}", Engine(spark, budget=Budget(max_findings=50, max_events=7))
    assert runs.manifest(spark, root).collect() == []
    with pytest.raises(KeyError):
        runs.load(spark, root, "a")
    first = engine.scan_files(files(spark, "BEGIN;\nCREATE TABLE a (i int);\nCOMMIT;", "CREATE INDEX x"))
    runs.save(first, root, "a")
    back = runs.load(spark, root, "a")
    assert back.budget == first.budget and sorted(map(str, back.findings.collect())) == sorted(map(str, first.findings.collect()))
    assert {r["state"] for r in back.diff(first).collect()} == {"same"} and {r["n"] for r in back.verify().collect()} == {0}
    second = engine.scan_files(files(spark, "BEGIN;\nCREATE TABLE a (i int);\nCOMMIT;"), base=back)
    runs.save(second, root, "b")
    assert sorted(r["state"] for r in runs.load(spark, root, "b").diff(back).collect()) == ["removed", "same", "same"]
    assert sorted((r["run_id"], r["version"]) for r in runs.manifest(spark, root).collect()) == [("a", 2), ("b", 2)]
    assert not runs.upgrade(spark, root, "a")


def test_a_killed_write_is_invisible(spark, tmp_path):
    root = f"file://{tmp_path}"
    one = files(spark, "BEGIN;\nCOMMIT;")
    runs.write(spark, root, "a", {"files": one})
    bad = one.selectExpr("path", "raise_error('killed') as content", "size", "sha256")
    for run in ("a", "b"):
        with pytest.raises(Exception, match="killed"):
            runs.write(spark, root, run, {"walked": one.selectExpr("path", "size", "'x' as reason"), "files": bad})
    assert [r["run_id"] for r in runs.manifest(spark, root).collect()] == ["a"]
    kept = runs.load(spark, root, "a")
    assert kept.files.count() == 1 and kept.walked.count() == 0 and kept.findings.columns == kept.found.columns
    runs.write(spark, root, "a", {"files": one.limit(0)})
    assert runs.load(spark, root, "a").files.count() == 0


def test_upgrade(spark, tmp_path):
    root = f"file://{tmp_path}"
    old = spark.createDataFrame([("a.sql", "db.transaction", 1, 3, 80)], "path string, kind string, start_line int, end_line int, confidence int")
    runs.write(spark, root, "old", {"findings": old, "files": files(spark, "BEGIN;\nCOMMIT;")}, version=1)
    before = runs.load(spark, root, "old")
    assert runs.upgrade(spark, root, "old") and not runs.upgrade(spark, root, "old")
    after = runs.load(spark, root, "old")
    assert before.findings.collect() == after.findings.collect() == after.found.collect()
    assert after.findings.first()["confidence"] == 0.8 and len(after.findings.first()["fid"]) > 0 and after.walked.first()["reason"] is None
    runs.write(spark, root, "new", {}, version=9)
    with pytest.raises(ValueError, match="version 9"):
        runs.load(spark, root, "new")
