"""Queries of whole scans, over the files of several source queries together, without limits.

What is expected is told from the rows that the files were made of.
"""

from __future__ import annotations

import functools
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import UNLIMITED
from . import source_queries as s
from .registry import ORACLE_SQL, query

if TYPE_CHECKING:
    from ..engine import Scan

PARTS = [s.TX, s.JAVA, s.PYTHON, s.SIDE, s.CALLS, s.COMPOSE, s.CI, s.API_JSON]


@functools.lru_cache(maxsize=4)
def scanned(spark: SparkSession, sf_dir: str) -> Scan:
    """One scan for all the queries of a session over the same tables."""
    from ..engine import Engine  # the engine knows the catalog, which this module is a part of

    files = None
    for part in PARTS:
        rows = s.files(spark, sf_dir, part).select("path", "content")
        files = rows if files is None else files.union(rows)
    files = files.select("path", "content", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    return Engine(spark, budget=UNLIMITED).scan_files(files)


def _told(name: str, kind: str, concept: str, rule: str, line: str = "line_no", route: str = "NULL", method: str = "NULL", where: str = "true") -> str:
    return f"""SELECT path, CAST({line} AS INTEGER) AS start_line, {kind} AS kind, {concept} AS concept, '{rule}' AS rule_id, {method} AS method, {route} AS route FROM ({ORACLE_SQL[name]}) WHERE {where}"""


_CONCEPT = "CASE split_part(kind, '.', 1) WHEN 'api' THEN 'API' WHEN 'queue' THEN 'Queue' WHEN 'cache' THEN 'Cache' WHEN 'db' THEN CASE kind WHEN 'db.transaction' THEN 'Transaction' ELSE 'DB' END END"
EXPECTED = "found AS (" + " UNION ALL ".join([
    _told("source_sql_tx", "'db.transaction'", "'Transaction'", "db.sql_tx", "start_line"), _told("source_java", "kind", _CONCEPT, "source.parsed", "start_line", "route", "method"),
    _told("source_python", "kind", _CONCEPT, "source.parsed", "start_line", "route", "method"), _told("source_cache_operations", "kind", "'Cache'", "source.script"), _told("source_queue_operations", "kind", "'Queue'", "source.script"),
    _told("source_http_callers", "'api.call'", "'External IO'", "source.script", route="raw", method="method"), _told("source_compose", "'infra.service'", "concept", "infra.compose"), _told("source_workflows", "'ci.step'", "concept", "ci.workflow"),
    _told("source_openapi_json", "'api.route'", "'API'", "api.openapi", "1", "route", "method"),
]) + ")"


@query(f"WITH {EXPECTED} SELECT path, start_line, kind, concept, rule_id, method, route FROM found")
def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a scan finds."""
    return scanned(spark, sf_dir).findings.select("path", "start_line", "kind", "concept", "rule_id", "method", "route")


@query(
    f"""WITH {EXPECTED}, compose AS ({ORACLE_SQL['source_compose']}), n AS (SELECT 'api' AS type, concat(method, ' ', route) AS key FROM found WHERE kind = 'api.route' UNION SELECT 'service', service FROM compose
    UNION SELECT CASE concept WHEN 'KV/Storage' THEN 'kv_storage' WHEN 'Queue' THEN 'queue_infra' ELSE 'cache_infra' END, infra FROM compose UNION SELECT 'workflow', path FROM found WHERE kind = 'ci.step'
    UNION SELECT 'workflow_item', concept FROM found WHERE kind = 'ci.step' AND concept IN ('Scheduling', 'Cache', 'Concurrency')
    UNION SELECT CASE WHEN kind = 'db.transaction' THEN 'tx_boundary' WHEN kind LIKE 'db.%' THEN 'db_op' WHEN kind LIKE 'cache.%' THEN 'cache_op' ELSE replace(kind, '.', '_') END, concat(path, start_line)
        FROM found WHERE kind LIKE 'db.%' OR kind LIKE 'cache.%' OR kind LIKE 'queue.%')
    SELECT type, count(*) AS n FROM n GROUP BY type"""
)
def scan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes of each type the event graph has."""
    return scanned(spark, sf_dir).nodes().groupBy("type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {EXPECTED}, java AS (SELECT DISTINCT path FROM found WHERE path LIKE '%.java'), py AS (SELECT DISTINCT path FROM found WHERE path LIKE '%.py' AND kind = 'api.route'), compose AS ({ORACLE_SQL['source_compose']}),
    e AS (SELECT 'encloses_tx' AS type FROM java UNION ALL SELECT 'encloses_tx' FROM py UNION ALL SELECT 'dispatches_job' FROM java UNION ALL SELECT unnest(['observed_in_same_scope', 'observed_in_same_scope', 'observed_in_same_scope', 'observed_in_same_scope']) FROM java
    UNION ALL SELECT 'observed_in_same_scope' FROM py UNION ALL SELECT 'declares' FROM (SELECT DISTINCT path, concept FROM found WHERE kind = 'ci.step' AND concept IN ('Scheduling', 'Cache', 'Concurrency'))
    UNION ALL SELECT 'declares_dependency' FROM (SELECT DISTINCT service, concept, infra FROM compose)) SELECT type, count(*) AS n FROM e GROUP BY type"""
)
def scan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges of each type there are between nodes."""
    return scanned(spark, sf_dir).edges().where("type <> 'supported_by'").groupBy("type").agg(F.count("*").alias("n"))


_SIDES = f"""{EXPECTED}, ends AS (SELECT method, route AS path, CASE WHEN rule_id = 'api.openapi' THEN 'spec' ELSE 'code' END AS side, path AS file FROM found WHERE kind = 'api.route'),
    code AS (SELECT DISTINCT method, path FROM ends WHERE side = 'code'), spec AS (SELECT DISTINCT method, path FROM ends WHERE side = 'spec'),
    apart AS (SELECT 'missing_in_spec' AS side, * FROM (FROM code EXCEPT FROM spec) UNION ALL SELECT 'missing_in_code', * FROM (FROM spec EXCEPT FROM code)
    UNION ALL SELECT 'duplicate', method, path FROM ends WHERE side = 'code' GROUP BY method, path HAVING count(*) > 1)"""


@query(f"WITH {_SIDES} SELECT side, method, path FROM apart")
def scan_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints that only code or only a specification has, or that code declares several times."""
    return scanned(spark, sf_dir).mismatches()


@query(
    f"""WITH {_SIDES} SELECT file, method, path, CASE side WHEN 'spec' THEN 'openapi' WHEN 'code' THEN CASE WHEN file LIKE '%.py' THEN 'python_ast' ELSE 'java_l2' END END AS source_kind,
    CAST(CASE WHEN side = 'spec' THEN 1.0 WHEN file LIKE '%.py' THEN 0.9 ELSE 0.85 END AS DOUBLE) AS confidence FROM ends"""
)
def scan_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints with what they were read from and how sure they are."""
    return scanned(spark, sf_dir).surface().select("file", "method", "path", "source_kind", "confidence")


@query(
    f"""WITH {EXPECTED}, java AS (SELECT DISTINCT path FROM found WHERE path LIKE '%.java'), p AS (SELECT 'queue_without_consumer' AS pattern_type, 'confirmed' AS status FROM java
    UNION ALL SELECT 'queue_without_consumer', 'confirmed' FROM found WHERE kind = 'queue.dispatch' AND path LIKE '%.ts' AND NOT EXISTS (SELECT 1 FROM pages WHERE page_id % 3 = 0)
    UNION ALL SELECT 'api_write_without_idempotency_guard', 'suspected' FROM java UNION ALL SELECT 'hot_write_path', 'suspected' FROM java
    UNION ALL SELECT 'cross_language_api_unmatched', 'confirmed' WHERE EXISTS (SELECT 1 FROM found)) SELECT pattern_type, status, count(*) AS n FROM p GROUP BY ALL"""
)
def scan_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of a scan by type and status."""
    return scanned(spark, sf_dir).patterns().groupBy("pattern_type", "status").agg(F.count("*").alias("n"))


_CHECKS = "invalid_parse_level path_outside_root snippet_missing snippet_over_budget primary_evidence_missing linked_evidence_missing unknown_edge_type node_evidence_missing edge_node_missing".split()


@query(f"""SELECT unnest([{", ".join(f"'{c}'" for c in _CHECKS)}]) AS "check", CAST(0 AS BIGINT) AS n""")
def scan_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of a scan's integrity: all sound."""
    return scanned(spark, sf_dir).verify().select("check", "n")


@query(
    f"""WITH {_SIDES}, made AS (SELECT count(*) AS n FROM pages), m AS (SELECT 'artifacts_missing_count' AS metric, 0 AS actual UNION ALL SELECT unnest(['budget_cut', 'findings_truncated', 'events_truncated', 'skipped_ratio', 'skipped_files_count']), 0
    UNION ALL SELECT 'scanned_files_count', {len(PARTS)} * n FROM made UNION ALL SELECT 'warnings_count', count(*) FROM found WHERE kind = 'parse_error'
    UNION ALL SELECT 'api.missing_in_spec_count', count(*) FROM apart WHERE side = 'missing_in_spec' UNION ALL SELECT 'api.missing_in_code_count', count(*) FROM apart WHERE side = 'missing_in_code'
    UNION ALL SELECT 'events_count', sum(n) FROM ({ORACLE_SQL['scan_nodes']})) SELECT metric, CAST(actual AS DOUBLE) AS actual FROM m"""
)
def scan_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What gates are put to, but for the number of all edges."""
    return scanned(spark, sf_dir).metrics().where("metric <> 'graph_edges'")


@query(f"WITH {EXPECTED} SELECT concept, count(*) AS n FROM found GROUP BY concept")
def scan_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of concepts."""
    return scanned(spark, sf_dir).listing("concepts")


@query(
    f"""WITH {EXPECTED}, src AS ({' UNION ALL '.join(f"SELECT {p[0]} AS path, {p[1]} AS content FROM pages" for p in PARTS)}), l AS (SELECT path, string_split(content, chr(10)) AS l, sha256(content) AS sha256 FROM src),
    places AS (SELECT DISTINCT f.path, f.start_line, CASE WHEN rule_id = 'db.sql_tx' THEN t.end_line ELSE f.start_line END AS end_line FROM found f LEFT JOIN ({ORACLE_SQL['source_sql_tx']}) t ON f.path = t.path WHERE f.start_line IS NOT NULL)
    SELECT path, start_line, CAST(end_line AS INTEGER) AS end_line, sha256, array_to_string(l[greatest(1, start_line - 5):least(len(l), end_line + 5)], chr(10)) AS snippet FROM places JOIN l USING (path)
    WHERE path NOT LIKE '%.py'"""
)
def scan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a scan's findings with their lines, but for Python's, whose finds span statements."""
    return scanned(spark, sf_dir).evidence().where("path not like '%.py'").select("path", "start_line", "end_line", "sha256", "snippet")
