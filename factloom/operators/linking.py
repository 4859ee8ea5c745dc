"""Endpoints, their callers, and mismatches between declared and coded routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as fp


def exact_links(callers: DataFrame, endpoints: DataFrame) -> DataFrame:
    """The first endpoint (by id) of each caller's method and path."""
    e = endpoints.groupBy("method", "path").agg(F.min("endpoint_id").alias("endpoint_id"))
    return callers.join(e, ["method", "path"]).select("caller_id", "endpoint_id", F.lit("exact").alias("match_type"))


def template_links(callers: DataFrame, endpoints: DataFrame) -> DataFrame:
    """The first endpoint (by path, id) whose template fits a caller's path.

    Templates meet paths with as many segments and an equal pattern of fixed ones: a caller is looked up under the
    shapes (positions of placeholders) that templates of its size have, which are few, so this is an equi-join too.
    """
    e = endpoints.withColumn("t", fp.segments(F.col("path"))).where(F.exists("t", fp.is_placeholder))
    e = e.withColumn("n", F.size("t")).withColumn("shape", F.transform("t", fp.is_placeholder)).withColumn("fixed", F.transform("t", lambda x: F.when(fp.is_placeholder(x), F.lit("*")).otherwise(x)))
    e = e.groupBy("method", "n", "shape", "fixed").agg(F.min(F.struct("path", "endpoint_id")).alias("first"))
    shapes = e.select("method", "n", "shape").distinct()
    c = callers.withColumn("s", fp.segments(F.col("path"))).withColumn("n", F.size("s"))
    c = c.join(shapes, ["method", "n"]).withColumn("fixed", F.zip_with("s", "shape", lambda x, wild: F.when(wild, F.lit("*")).otherwise(x)))
    hits = c.join(e, ["method", "n", "shape", "fixed"]).groupBy("caller_id").agg(F.min("first").alias("first"))
    return hits.select("caller_id", F.col("first.endpoint_id").alias("endpoint_id"), F.lit("template").alias("match_type"))


def links(callers: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Exact links, and template links of callers without one."""
    exact = exact_links(callers, endpoints)
    rest = callers.join(exact.select("caller_id"), "caller_id", "left_anti")
    out = exact.unionByName(template_links(rest, endpoints))
    text = F.concat_ws("|", F.col("caller_id").cast("string"), F.col("endpoint_id").cast("string"), "match_type")
    return out.withColumn("link_id", F.sha1(text.cast("binary")))


def missing(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of rows that others lack."""
    return rows.select(*keys).distinct().join(others.select(*keys), keys, "left_anti")


def method_mismatches(code: DataFrame, spec: DataFrame) -> DataFrame:
    """Paths on both sides whose sets of methods differ."""
    sets = [df.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias(name)) for df, name in ((code, "code_methods"), (spec, "spec_methods"))]
    return sets[0].join(sets[1], "path").where("code_methods <> spec_methods")


def suspect_paths(code: DataFrame, spec: DataFrame) -> DataFrame:
    """For each code key the first spec path of that method of which one is a proper prefix of the other.

    Prefixes of either side are looked up by equality (a path has as many as segments), so no pair that can't match is made.
    """
    c, s = code.select("method", "path").distinct(), spec.select("method", "path").distinct()

    def cuts(path: F.Column) -> F.Column:
        return F.transform(F.sequence(F.lit(1), F.length(path)), lambda i: F.substr(path, F.lit(1), i))

    down = c.select("method", "path", F.explode(cuts(F.col("path"))).alias("spec_path")).join(s.select("method", F.col("path").alias("spec_path")), ["method", "spec_path"])
    up = s.select("method", F.col("path").alias("spec_path"), F.explode(cuts(F.col("path"))).alias("path")).join(c, ["method", "path"])
    both = down.select("method", "path", "spec_path").union(up.select("method", "path", "spec_path")).where("path <> spec_path")
    return both.groupBy("method", "path").agg(F.min("spec_path").alias("spec_path"))
