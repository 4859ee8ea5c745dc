"""Scores and ranks of risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points by severity, status and pattern type.
SEVERITY_POINTS = {"high": 30, "medium": 20, "low": 10}
STATUS_POINTS = {"confirmed": 20, "suspected": 10, "unknown": 5}
TYPE_POINTS = {"transaction_missing": 12, "db_write_outside_tx": 12, "cross_language_api_unmatched": 9, "queue_without_consumer": 9, "api_write_without_idempotency_guard": 8, "hot_write_path": 7}


def _points(value: Column, table: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def score(severity: Column, status: Column, pattern_type: Column, refs: Column, confidence: Column, gate_status: Column) -> Column:
    late = F.when(F.lower(F.coalesce(gate_status, F.lit(""))).isin("warn", "fail"), 5).otherwise(0)
    return (
        _points(severity, SEVERITY_POINTS, 20) + _points(status, STATUS_POINTS, 10) + _points(pattern_type, TYPE_POINTS, 4) + F.least(F.lit(10), refs * 2) + F.floor(F.coalesce(confidence, F.lit(0.0)) * 10) + late
    ).cast("double")


def rank(items: DataFrame) -> DataFrame:
    """The first of the items (with priority_score) of each risk_id: by seq where they have it, else the most pressing, by what it says."""
    order = ["seq"] if "seq" in items.columns else [F.desc("priority_score"), *sorted(c for c in items.columns if c not in ("risk_id", "priority_score"))]
    one = Window.partitionBy("risk_id").orderBy(*order)
    return items.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")


def severity_rank(value: Column) -> Column:
    return F.when(value == "high", 3).when(value == "medium", 2).otherwise(1)


def sarif_level(confidence: Column) -> Column:
    return F.when(confidence * 100 >= 80, "error").when(confidence * 100 >= 50, "warning").otherwise("note")


def level_rank(level: Column) -> Column:
    return F.when(level == "error", 3).when(level == "warning", 2).when(level == "note", 1).otherwise(0)
