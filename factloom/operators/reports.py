"""Reports over findings, events and patterns: neighbours, bands, drilldown budgets, exports, overlays and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prefix


def bands(rows: DataFrame, confidence: str = "confidence", high: float = 0.8, mid: float = 0.5) -> DataFrame:
    """How many rows are of high, middling and low confidence."""
    c = F.col(confidence)
    return rows.agg(F.count_if(c >= high).alias("high"), F.count_if((c >= mid) & (c < high)).alias("mid"), F.count_if(c < mid).alias("low"))


def exploded_refs(rows: DataFrame, ids: str, targets: DataFrame, key: str) -> DataFrame:
    """Each row with the targets that its array of ids names: explode and an equi-join, never a test of membership for every pair."""
    return rows.withColumn("ref", F.explode(ids)).join(targets.withColumnRenamed(key, "ref"), "ref")


def neighbours(edges: DataFrame, node: str = "a", other: str = "b") -> DataFrame:
    """(id, direction, neighbour) of every node."""
    out = edges.select(F.col(node).alias("id"), F.lit("out").alias("direction"), F.col(other).alias("neighbour"))
    return out.union(edges.select(F.col(other).alias("id"), F.lit("in").alias("direction"), F.col(node).alias("neighbour"))).distinct()


def take_while(rows: DataFrame, group: list[str], order: list[str | Column], size: str, most: int) -> DataFrame:
    """The first rows of each group whose sizes together stay within a budget."""
    return prefix.running(rows, group, order, {"running": F.col(size)}).where(F.col("running") <= most)


def capped_files(ranges: DataFrame, group: str, max_files: int, per_file: int) -> DataFrame:
    """Ranges of the files with the most ranges, a few of each file: (group, path, start_line, end_line)."""
    by_file = Window.partitionBy(group, "path").orderBy("start_line", "end_line")
    counts = ranges.groupBy(group, "path").agg(F.count("*").alias("n_ranges"))
    files = counts.withColumn("file_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n_ranges"), "path"))).where(F.col("file_rank") <= max_files)
    return ranges.withColumn("range_rank", F.row_number().over(by_file)).where(F.col("range_rank") <= per_file).join(files, [group, "path"])


def overlay(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both by key, the new side's values where it has any."""
    o, n = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns]), new.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    return o.join(n, key, "full_outer").select(key, *[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in columns])


def upsert(base: DataFrame, more: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the largest version of each key."""
    rows = base.unionByName(more)
    return rows.groupBy(key).agg(*[F.max_by(c, F.struct(version, *[x for x in rows.columns if x not in (key, version)])).alias(c) for c in rows.columns if c != key])


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF result in JSON for each finding (rule_id, concept, path, start_line, end_line, severity, fp)."""
    region = F.struct(F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.regexp_replace("path", r"^\./", "").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.col("severity").alias("level"), F.struct(F.col("concept").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fp").alias("primary")).alias("fingerprints"))
    return findings.select("fp", F.to_json(result).alias("result"))


def manifest(files: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Artifacts (kind, path, bytes, sha256); kinds: what the end of a path says of it, the first that fits, else other."""
    kind = F.coalesce(*(F.when(F.col("path").endswith(end), name) for end, name in kinds.items()), F.lit("other"))
    return files.select(kind.alias("kind"), "path", F.octet_length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def rule_patterns(specs: DataFrame) -> DataFrame:
    """Text rules compiled from specifications (spec_id, kind, keywords): one whole-word pattern each, with the kind's default level and globs."""
    level = F.when(F.col("kind") == "text", "L1").when(F.col("kind").isin("openapi", "compose", "dockerfile", "gha", "deps", "sql_tx", "sql_ddl"), "L2").otherwise("L3")
    globs = F.when(F.col("kind") == "python_ast", "**/*.py").when(F.col("kind").startswith("sql"), "**/*.sql").otherwise("**/*")
    quoted = F.transform("keywords", lambda k: F.concat(F.lit(r"\b"), F.regexp_replace(k, r"([^A-Za-z0-9_ ])", r"\\$1"), F.lit(r"\b")))
    return specs.select("spec_id", "kind", F.array_join(F.array_sort(quoted), "|").alias("pattern"), level.alias("parse_level"), globs.alias("glob"))
