"""Pattern rules over events: co-occurrence in one path, and dispatches that nothing consumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signals of an idempotency guard, and concepts that make a path hot.
GUARD_SIGNALS = "idempot|dedup|setnx|exists|unique|guard|cache key|request key"
HOT_CONCEPTS = ["transaction", "queue", "db", "cache"]


def short_id(*parts: Column) -> Column:
    """First 12 hex digits of the SHA-1 of parts joined by ||."""
    return F.substring(F.sha1(F.concat_ws("||", *parts).cast("binary")), 1, 12)


def path_flags(events: DataFrame) -> DataFrame:
    """For each path, which kinds of event it has, and its first event of each (by event_id)."""
    has = {"api": "api.route", "db_write": "db.write", "tx": "db.transaction", "queue": "queue.dispatch", "cache_write": "cache.write"}
    flags = [F.max(F.when(F.col("kind") == kind, 1).otherwise(0)).alias(f"has_{name}") for name, kind in has.items()]
    firsts = [F.min(F.when(F.col("kind") == kind, F.col("event_id"))).alias(f"first_{name}") for name, kind in has.items()]
    return events.groupBy("path").agg(*flags, *firsts)


def pattern(rows: DataFrame, kind: str, severity: str, confidence: Column | float, status: Column | str, *support: str) -> DataFrame:
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    stat = status if isinstance(status, Column) else F.lit(status)
    return rows.select(
        short_id(F.lit(kind), F.col("path")).alias("pattern_id"), F.lit(kind).alias("pattern_type"), F.lit(severity).alias("severity"), conf.alias("confidence"), stat.alias("status"), "path",
        F.array_join(F.array(*[F.col(c).cast("string") for c in support]), ",").alias("support"),
    )


def transaction_missing(events: DataFrame) -> DataFrame:
    return pattern(path_flags(events).where("has_api = 1 and has_db_write = 1 and has_tx = 0"), "transaction_missing", "high", 0.84, "confirmed", "first_api", "first_db_write")


def db_write_outside_tx(events: DataFrame) -> DataFrame:
    return pattern(path_flags(events).where("has_db_write = 1 and has_tx = 0"), "db_write_outside_tx", "high", 0.9, "confirmed", "first_db_write")


def queue_without_consumer(dispatch: DataFrame, consume: DataFrame) -> DataFrame:
    """Dispatches whose (framework, queue_name) no consumer has; a missing name equals a missing name."""
    keys = consume.select(F.col("framework").alias("_f"), F.col("queue_name").alias("_q")).distinct()
    left = dispatch.join(keys, F.col("framework").eqNullSafe(F.col("_f")) & F.col("queue_name").eqNullSafe(F.col("_q")), "left_anti")
    named = F.trim(F.coalesce("queue_name", F.lit(""))) != ""
    return pattern(left, "queue_without_consumer", "medium", F.when(named, 0.8).otherwise(0.62), F.when(named, "confirmed").otherwise("suspected"), "event_id")


def write_without_guard(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Paths with an api and a write, and no finding there whose text has a guard signal."""
    writes = events.groupBy("path").agg(
        F.min(F.when(F.col("kind") == "api.route", F.col("event_id"))).alias("api"), F.min(F.when(F.col("kind").isin("db.write", "queue.dispatch"), F.col("event_id"))).alias("write")
    )
    guarded = findings.where(F.lower(F.col("text")).rlike(GUARD_SIGNALS)).select("path").distinct()
    return pattern(writes.where("api is not null and write is not null").join(guarded, "path", "left_anti"), "api_write_without_idempotency_guard", "medium", 0.68, "suspected", "api", "write")


def hot_write_path(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Paths with an api that write in three ways, or have two findings of a hot concept."""
    hot = findings.where(F.lower("concept").isin(HOT_CONCEPTS)).groupBy("path").agg(F.count("*").alias("n_hot"))
    rows = path_flags(events).join(hot, "path", "left").where("has_api = 1")
    every = (F.col("has_db_write") == 1) & (F.col("has_queue") == 1) & (F.col("has_cache_write") == 1)
    rows = rows.where(every | (F.col("n_hot") >= 2))
    return pattern(rows, "hot_write_path", "medium", F.when(every, 0.78).otherwise(0.64), F.when(every, "confirmed").otherwise("suspected"), "first_api", "first_db_write", "first_queue", "first_cache_write")


def cross_language_unmatched(counts: DataFrame) -> DataFrame:
    """One pattern if any of the callers or endpoints (one row of their counts) is unmatched."""
    rows = counts.where("callers > 0 or endpoints > 0").withColumn("path", F.lit("cross_language_summary.json"))
    return pattern(rows, "cross_language_api_unmatched", "medium", 0.86, "confirmed", "callers", "endpoints")


def summary(patterns: DataFrame) -> DataFrame:
    """Counts by type, severity and status in one pass of grouping sets."""
    return patterns.distinct().groupingSets([[F.col("pattern_type")], [F.col("severity")], [F.col("status")]], "pattern_type", "severity", "status").agg(F.count("*").alias("n"))
