import json

import pytest
from pyspark.sql import functions as F

from factloom.engine import Engine
from factloom.operators import rules
from factloom.operators.evidence import UNLIMITED, Budget
from factloom.operators.rules import ScanRule, glob_regex, sees
from factloom.sources import files as sources

from .test_extract import JAVA, PY


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    (at / "a.py").write_text(PY)
    (at / "O.java").write_text(JAVA)
    (at / "s.js").write_text("router.get('/x', h);\nmailQueue.add('m');\nfetch('/nowhere')\n")
    (at / "t.sql").write_text("BEGIN;\nCREATE TABLE one (a int);\nCOMMIT;\n")
    (at / "package.json").write_text(json.dumps({"dependencies": {"express": "4"}, "scripts": {"test": "jest"}}))
    (at / "big.txt").write_text("x" * 5000)
    (at / "notes.md").write_text("an idempotency key\nand another Idempotency Key\n")
    return at


@pytest.fixture(scope="module")
def scan(spark, tree):
    return Engine(spark, budget=Budget(max_file_bytes=4000)).scan(str(tree))


def test_drilldowns(scan):
    rows = scan.drilldowns(always=True, most=9).collect()
    assert {r["risk_id"] for r in rows} == {r["pattern_id"] for r in scan.patterns().collect()}
    assert all(r["drilled"] == (r["status"] == "suspected" and r["severity"] != "low") for r in rows)
    assert any(r["snippets"] for r in rows) == any(r["drilled"] for r in rows)
    assert all(s["snippet"] and s["path"] for r in rows for s in r["snippets"] or [])


def test_scan(spark, tree, scan):
    assert {r["language"] for r in scan.findings.collect()} == {"python", "java", "typescript", "sql", "node"}
    found = {(r["pattern_type"], r["path"], r["status"]) for r in scan.patterns().collect()}
    assert ("queue_without_consumer", "s.js", "confirmed") in found
    assert ("cross_language_api_unmatched", "cross_language_summary.json", "confirmed") in found
    assert not [f for f in found if f[0] == "transaction_missing"]
    scores = [r["priority_score"] for r in scan.risks("warn").collect()]
    assert scores == sorted(scores, reverse=True) and scores
    assert {r["reason"] for r in scan.walked.collect()} == {None, "too_large"}
    assert scan.sarif().count() == scan.findings.count()
    assert [(r["kind"], r["command"]) for r in scan.entrypoints().collect()] == [("tests", "npm run test")]


def test_scan_again(spark, tree, scan):
    e = Engine(spark, budget=scan.budget)
    again = e.scan_files(scan.files, base=scan)
    assert sorted(map(str, again.findings.collect())) == sorted(map(str, scan.findings.collect()))
    assert {r["state"] for r in scan.diff(scan).collect()} == {"same"}
    assert {r["state"] for r in scan.diff_graph(again).collect()} == {"unchanged"}
    less = e.scan_files(scan.files.where("path <> 't.sql'"))
    gone = {(r["part"], r["state"]) for r in less.diff_graph(scan).collect()}
    assert ("event", "removed") in gone and ("event", "added") not in gone
    assert e.query("duplicate_routes", "/root/testdata/sf0.001").columns


def test_scan_is_sound_and_told(scan):
    assert all(r["n"] == 0 for r in scan.verify().collect())
    told = {r["metric"]: r["actual"] for r in scan.metrics().collect()}
    assert told["skipped_files_count"] == 1 and told["scanned_files_count"] == 6 and told["findings_truncated"] == 0
    assert told["events_count"] == scan.nodes().count() and told["graph_edges"] == scan.edges().count()
    for entity in ("concepts", "findings", "evidence", "events", "graph"):
        assert scan.listing(entity).count() > 0
    with pytest.raises(ValueError):
        scan.listing("nothing")
    one = scan.findings.where("kind = 'schema.table'").first()
    (told,) = scan.explain(one["fid"]).collect()
    assert told["key"] == "table:one" and "CREATE TABLE" in told["snippet"]
    assert {r["part"] for r in scan.summary().collect()} >= {"language", "concept", "kind", "pattern", "entrypoint"}


def test_budgets(spark, tree):
    few = Engine(spark, budget=Budget(max_files=2, max_findings=1, max_file_bytes=4000)).scan(str(tree))
    assert sorted(r["path"] for r in few.files.collect()) == ["O.java", "a.py"] and few.findings.count() == 1
    told = {r["metric"]: r["actual"] for r in few.metrics().collect()}
    assert told["budget_cut"] == 1 and told["findings_truncated"] == 1
    bytes_ = Engine(spark, budget=Budget(max_total_bytes=len(JAVA.encode()) + 1, max_file_bytes=4000)).scan(str(tree))
    assert [r["path"] for r in bytes_.files.collect()] == ["O.java"]


def test_rules_from_a_file(spark, tree, tmp_path):
    rules = [
        {"rule_id": "t.key", "concept": "Guard", "globs": ["**/*.md"], "patterns": [{"type": "regex", "value": "idempotency key"}], "confidence_base": 0.4},
        {"rule_id": "t.none", "concept": "Guard", "globs": ["docs/*"], "patterns": ["key"]},
        {"rule_id": "t.signal", "concept": "Text", "exclude_globs": ["*.js"], "meta": {"signals": {"strong": ["another"], "negative": ["jest"]}, "gating": {"anti_patterns_block_if": ["jest"]}}},
    ]
    (tmp_path / "rules.json").write_text(json.dumps({"rules": rules}))
    e = Engine(spark, sources.read_rules(spark, str(tmp_path / "rules.json")), UNLIMITED)
    got = sorted((r["rule_id"], r["path"], r["start_line"], r["confidence"]) for r in e.scan(str(tree)).findings.collect())
    assert got == [("t.key", "notes.md", 1, 0.4), ("t.key", "notes.md", 2, 0.4), ("t.signal", "notes.md", 2, 0.5)]
    assert Engine(spark, []).scan(str(tree)).findings.count() == 0


def test_globs(spark):
    import re

    assert re.match(glob_regex("src/*.p[yx]"), "src/a/b.py") and not re.match(glob_regex("src/?.py"), "src/ab.py") and not re.match(glob_regex("[!a].x"), "a.x")
    paths = spark.createDataFrame([("a/b.SQL",), ("deep/Dockerfile.dev",), ("x.py",)], "path string")
    rule = ScanRule("r", "text", globs=("**/*.sql", "*Dockerfile*"), exclude=("*.dev",))
    assert [r["path"] for r in paths.where(sees(paths["path"], rule.globs, rule.exclude)).collect()] == ["a/b.SQL"]


def test_cases(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text('{"case_id": "c1", "concept": "API", "level": 2}\nnot json\n{"case_id": "c2"}\n')
    assert sorted(r["case_id"] for r in sources.read_cases(spark, str(tmp_path / "cases.jsonl")).collect()) == ["c1", "c2"]


def test_files_are_written_once_and_each_detector_reads_its_own(spark):
    files = spark.createDataFrame([("a.py", "x = 1"), ("t.sql", "BEGIN;\nCOMMIT;"), ("b.ts", "fetch('/x')"), ("readme", "none")], "path string, content string")
    files = files.selectExpr("path", "content", "cast(length(content) as bigint) AS size", "sha2(content, 256) AS sha256")
    scan = Engine(spark).scan_files(files)
    assert scan.files.columns == files.columns and sorted(scan.files.collect()) == sorted(files.collect())
    kept = scan.files.inputFiles()
    assert kept and all("/files-" in f and "/seen=_" in f for f in kept)
    seen = files.select("path", rules.seen_by(F.col("path"), rules.DEFAULT_RULES).alias("seen"), *[rules.sees(F.col("path"), r.globs, r.exclude).alias(f"r{k}") for k, r in enumerate(rules.DEFAULT_RULES)])
    for row in seen.collect():
        assert [f"_{k}_" in row["seen"] for k in range(len(rules.DEFAULT_RULES))] == list(row[2:])
    assert {(r["path"], r["rule_id"]) for r in scan.findings.collect()} == {("t.sql", "db.sql_tx"), ("b.ts", "source.script")}
