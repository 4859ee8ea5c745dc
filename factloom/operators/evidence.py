"""Findings with their evidence, the bridge between them, and checks of a run's integrity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import files as ff
from ..storage import union_all
from .graph import short_sha

# Levels of parsing, and types of edges.
LEVELS = ["L1", "L2", "L3"]
EDGE_TYPES = ["declares", "declares_dependency", "observed_in_same_scope", "supported_by", "encloses_tx", "uses_cache", "dispatches_job", "cache_within_tx", "dispatch_within_tx"]


@dataclass(frozen=True)
class Budget:
    """Limits of a scan, which are a feature of it: what they cut is told by its metrics.  None sets no limit."""

    max_files: int | None = 50_000
    max_total_bytes: int | None = 1 << 30
    max_file_bytes: int = 2 << 20
    max_lines: int | None = 20_000
    max_snippet_lines: int = 200
    max_snippet_bytes: int = 8192
    max_findings: int | None = 5000
    max_events: int | None = 2000
    context_lines: int = 5


UNLIMITED = Budget(None, None, 1 << 60, None, 200, 8192, None, None)


def text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def with_ids(found: DataFrame) -> DataFrame:
    """found with fid, from what and where it is, and primary_eid, from its place alone."""
    fid = short_sha(*[text(c) for c in ("path", "kind", "rule_id", "concept", "start_line", "end_line", "method", "route", "op", "name")])
    return found.withColumn("fid", fid).withColumn("primary_eid", short_sha(text("path"), text("start_line"), text("end_line"), text("parse_level")))


def evidence_of(findings: DataFrame, files: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """One row for each place: eid, path, lines, snippet with context and within the budget, the file's digest, parse level."""
    places = findings.select(F.col("primary_eid").alias("eid"), "path", "start_line", "end_line", "parse_level").distinct()
    rows = places.join(files.select("path", "sha256", F.split("content", "\n").alias("_lines")), "path")
    whole = ff.snippet(F.col("_lines"), F.col("start_line"), F.col("end_line"), budget.context_lines)
    snippet = ff.clamp_bytes(ff.clamp_lines(whole, budget.max_snippet_lines), budget.max_snippet_bytes)
    return rows.select("eid", "path", "start_line", "end_line", "parse_level", "sha256", snippet.alias("snippet"))


def links(findings: DataFrame) -> DataFrame:
    """Which evidence each finding has."""
    return findings.select("fid", F.col("primary_eid").alias("eid")).distinct()


def _count(rows: DataFrame, check: str, level: str, bad: Column | None = None) -> DataFrame:
    return (rows if bad is None else rows.where(bad)).agg(F.lit(check).alias("check"), F.lit(level).alias("level"), F.count("*").alias("n"))


def verify(findings: DataFrame, evidence: DataFrame, bridge: DataFrame, nodes: DataFrame, edges: DataFrame, budget: Budget = Budget(), strict: bool = False) -> DataFrame:
    """(check, level, n) of every check; a run is sound where no error counts more than 0."""
    soft = "error" if strict else "warning"
    ids = evidence.select("eid").distinct()
    outside = F.col("path").startswith("/") | F.array_contains(F.split(F.regexp_replace("path", r"\\", "/"), "/"), "..")
    named = F.explode("evidence").alias("eid")
    inner = edges.where("type <> 'supported_by'")
    known = nodes.select("event_id")
    out = [
        _count(evidence, "invalid_parse_level", "error", ~F.col("parse_level").isin(LEVELS) | F.col("parse_level").isNull()),
        _count(evidence, "path_outside_root", soft, outside),
        _count(evidence, "snippet_missing", "error", F.col("snippet").isNull()),
        _count(evidence, "snippet_over_budget", soft, (F.size(F.split("snippet", "\n")) > budget.max_snippet_lines) | (F.octet_length("snippet") > budget.max_snippet_bytes)),
        _count(findings.join(ids.withColumnRenamed("eid", "primary_eid"), "primary_eid", "left_anti"), "primary_evidence_missing", "error"),
        _count(bridge.join(ids, "eid", "left_anti"), "linked_evidence_missing", "error"),
        _count(edges, "unknown_edge_type", soft, ~F.col("type").isin(EDGE_TYPES)),
        _count(nodes.select("event_id", named).join(ids, "eid", "left_anti"), "node_evidence_missing", "error"),
        _count(inner.select(F.col("from_id").alias("event_id")).union(inner.select("to_id")).join(known, "event_id", "left_anti"), "edge_node_missing", "error"),
    ]
    return union_all(out)
