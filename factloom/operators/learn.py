"""Learning cases: difficulty, and the closure of prerequisites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difficulty(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cases by how much evidence they have and over how many files."""
    counts = evidence.groupBy("fid").agg(F.count("*").alias("n"), F.countDistinct("path").alias("np"))
    level = F.when((F.col("n") >= 5) & (F.col("np") > 1), 3).when((F.col("n") >= 3) | (F.col("level") == "L3"), 2).otherwise(1)
    case_id = F.substring(F.sha1(F.concat_ws("|", F.col("fid").cast("string"), "concept", "level").cast("binary")), 1, 12)
    return findings.join(counts, "fid").select("fid", case_id.alias("case_id"), level.alias("difficulty"))


def prerequisites(concepts: DataFrame, needs: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth) for all that each concept needs, directly or not, nearest first: one join for each level."""
    level = concepts.select(F.col("concept").alias("start"), F.col("concept").alias("node"), F.lit(0).alias("depth"))
    out = level
    for d in range(1, depth + 1):
        level = level.join(needs, level["node"] == needs["concept"]).select("start", F.col("needs").alias("node"), F.lit(d).alias("depth")).distinct()
        out = out.union(level)
    return out.groupBy("start", "node").agg(F.min("depth").alias("depth"))
