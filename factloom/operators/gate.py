"""Gates, policies, baselines and differences of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .risks import level_rank


def compare(op: Column, left: Column, right: Column) -> Column:
    """left op right for an operator in a column; unknown operators are false."""
    tests = {"==": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}
    out = F.lit(False)
    for name, test in tests.items():
        out = F.when(op == name, test).otherwise(out)
    return out


def violations(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (metric, op, value, level) that a metric (metric, actual) breaks: those whose comparison does not hold."""
    return rules.join(metrics, "metric").where(~compare(F.col("op"), F.col("actual"), F.col("value")))


def worst(violated: DataFrame) -> DataFrame:
    """The gate's status: fail before warn before pass."""
    rank = F.max(F.when(F.col("level") == "fail", 2).when(F.col("level") == "warn", 1).otherwise(0))
    return violated.agg(F.coalesce(rank, F.lit(0)).alias("r"), F.count("*").alias("n_violations")).select(F.when(F.col("r") == 2, "fail").when(F.col("r") == 1, "warn").otherwise("pass").alias("status"), "n_violations")


def beyond_threshold(findings: DataFrame, allow: DataFrame, min_rank: int, min_confidence: float, threshold: int) -> DataFrame:
    """The findings of each concept beyond its threshold, after level, confidence and allowlist."""
    level = F.when(F.col("level") == "L1", 1).when(F.col("level") == "L2", 2).otherwise(3)
    kept = findings.where((level >= min_rank) & (F.col("confidence") >= min_confidence)).join(allow, "fid", "left_anti")
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy("concept").orderBy("fid"))).where(F.col("nth") > threshold)


def fingerprint(*parts: str) -> Column:
    return F.sha1(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]).cast("binary"))


def baseline_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join by fp: added, removed, upgraded, downgraded or same.  Each side has one row for each fp."""
    o = old.select("fp", F.col("severity").alias("old_severity"))
    n = new.select("fp", F.col("severity").alias("new_severity"))
    a, b = level_rank(F.col("old_severity")), level_rank(F.col("new_severity"))
    state = F.when(F.col("old_severity").isNull(), "added").when(F.col("new_severity").isNull(), "removed").when(b > a, "upgraded").when(b < a, "downgraded").otherwise("same")
    return o.join(n, "fp", "full_outer").withColumn("state", state)


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str, check: str) -> DataFrame:
    """One row: how many rows refer to a parent that isn't there."""
    left = rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")
    return left.agg(F.lit(check).alias("check"), F.count("*").alias("n_missing"))
