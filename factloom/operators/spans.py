"""Operators on intervals and ranks within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column], n: int = 1) -> DataFrame:
    """The first n rows of each group of keys; order must be total for a fixed result."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def _pairs(outer: DataFrame, inner: DataFrame, keys: list[str]) -> DataFrame:
    o = outer.select(*keys, F.col("event_id").alias("outer_id"), F.col("a").alias("oa"), F.col("e").alias("oe"))
    i = inner.select(*keys, F.col("event_id").alias("inner_id"), "a", "e", "kind")
    return i.join(o, keys).where("oa <= a and oe >= e")


def contained(outer: DataFrame, inner: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of an outer and an inner interval (event_id, a, e) of the same keys, the inner within the outer: a hash join on keys with the containment as residual condition."""
    return _pairs(outer, inner, keys)


def innermost(outer: DataFrame, inner: DataFrame, keys: list[str]) -> DataFrame:
    """For each inner interval the smallest outer one that contains it: one aggregation, no sort of the pairs."""
    best = F.min(F.struct((F.col("oe") - F.col("oa")).alias("size"), F.negative("oa").alias("later"), "outer_id"))
    return _pairs(outer, inner, keys).groupBy("inner_id").agg(best.alias("b")).select("inner_id", F.col("b.outer_id").alias("outer_id"))


def merged(rows: DataFrame, keys: list[str], gap: int, also: Sequence[Column] = ()) -> DataFrame:
    """Intervals (seq, a, e) of each group merged into islands where the next begins at most gap after the end so far; also: more aggregates of an island's intervals."""
    order = Window.partitionBy(*keys).orderBy("a", "e", "seq")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col("a") > before + gap), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min("a").alias("start_line"), F.max("e").alias("end_line"), F.count("*").alias("n"), *also).drop("_island")
