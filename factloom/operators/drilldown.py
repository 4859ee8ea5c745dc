"""Source read for a target (a pattern, finding or event) under five limits at once.

Windows around a target's references are merged where they are near, files and snippets are ranked, and an ordered fold over
the few that remain reads them as far as the characters go.  Each limit's cuts are counted.  The limits are the feature: what
goes to a reader has a fixed size.  Null or empty paths refer to nothing; a null line is the first, a null confidence nought.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans

#: Windows that begin at most so many lines after the end of those before are one.
NEAR = 5
# Severities from the least on.
SEVERITIES = ["low", "medium", "high"]


@dataclass(frozen=True)
class Limits:
    context_lines: int = 25
    max_files: int = 5
    max_snippets: int = 8
    max_lines: int = 80
    max_chars: int = 12_000


def ranges(refs: DataFrame, context: int) -> DataFrame:
    """(target, path, start_line, end_line, n_refs, confidence) of merged windows around refs (target, path, start_line, end_line, confidence).

    Equal windows are counted before they move, so a line that very many refer to is one row.
    """
    a = F.greatest(F.lit(1), F.coalesce("start_line", F.lit(1)).cast("bigint") - context)
    rows = refs.where("path <> ''").withColumn("a", a).withColumn("e", F.greatest("a", F.coalesce("end_line", "a").cast("bigint") + context))
    rows = rows.groupBy("target", "path", "a", "e").agg(F.count("*").alias("refs"), F.max(F.coalesce("confidence", F.lit(0.0))).alias("sure")).withColumn("seq", F.lit(0))
    return spans.merged(rows, ["target", "path"], NEAR, [F.sum("refs").alias("n_refs"), F.max("sure").alias("confidence")]).drop("n")


def _chosen(rows: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """The ranges to be read, numbered in order of path and line; and for each target how many there were and what files and snippets were cut."""
    by_file = rows.groupBy("target", "path").agg(F.count("*").alias("n_ranges"), F.sum("n_refs").alias("refs"))
    busiest = Window.partitionBy("target").orderBy(F.desc("n_ranges"), "path")
    files = by_file.withColumn("_n", F.row_number().over(busiest)).where(F.col("_n") <= limits.max_files).drop("_n")
    of_all = by_file.groupBy("target").agg(F.sum("refs").alias("candidate_refs"), F.sum("n_ranges").alias("n_ranges"), F.count("*").alias("n_files"))
    of_chosen = files.groupBy("target").agg(F.count("*").alias("selected_files"), F.sum("n_ranges").alias("in_files"))
    told = of_all.join(of_chosen, "target").withColumn("cut_files", F.col("n_files") - F.col("selected_files"))
    told = told.withColumn("cut_snippets", F.greatest(F.lit(0), F.col("in_files") - limits.max_snippets)).drop("n_files", "in_files")
    first = Window.partitionBy("target").orderBy("path", "start_line", "end_line")
    kept = rows.join(files.select("target", "path"), ["target", "path"], "left_semi").withColumn("place", F.row_number().over(first)).where(F.col("place") <= limits.max_snippets)
    return kept, told


def _read(kept: DataFrame, files: DataFrame, limits: Limits) -> DataFrame:
    """kept with its text from files (path, content); state says what hinders it, if anything does."""
    last = F.col("start_line") + limits.max_lines - 1
    rows = kept.withColumn("clipped", F.col("end_line") > last).withColumn("end_line", F.least("end_line", last))
    rows = rows.join(files.select("path", F.split("content", "\n").alias("_lines")), "path", "left")
    state = F.when(F.col("_lines").isNull(), "missing").when(F.col("start_line") > F.size("_lines"), "outside").otherwise("loaded")
    rows = rows.withColumn("state", state).withColumn("end_line", F.when(F.col("state") == "loaded", F.least("end_line", F.size("_lines"))).otherwise(F.col("end_line")))
    text = F.array_join(F.slice("_lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    return rows.withColumn("snippet", F.when(F.col("state") == "loaded", text)).drop("_lines")


def _within(items: Column, most: int) -> Column:
    """What becomes of each item, in order: the first whose text does not fit ends the reading."""
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("states"))

    def step(so_far: Column, x: Column) -> Column:
        size = F.coalesce(F.length(x["snippet"]), F.lit(0)).cast("bigint")
        full = so_far["full"] | (so_far["total"] + size > most)
        state = F.when(full, F.lit("full")).otherwise(x["state"])
        return F.struct(F.when(full, so_far["total"]).otherwise(so_far["total"] + size).alias("total"), full.alias("full"), F.concat(so_far["states"], F.array(state)).alias("states"))

    return F.aggregate(items, start, step)


def packs(refs: DataFrame, files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(target, snippets, trace) of each target that refers to any file.

    snippets: what was read, by path and line; trace: how many references and ranges there were, and what each limit cut.
    """
    kept, told = _chosen(ranges(refs, limits.context_lines), limits)
    item = F.struct("place", "path", "start_line", "end_line", "confidence", "n_refs", "clipped", "state", "snippet")
    # at most max_snippets rows of a target are left here
    rows = _read(kept, files, limits).groupBy("target").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rows = rows.withColumn("done", _within(F.col("items"), limits.max_chars)).join(told, "target")
    state = lambda i: F.get(F.col("done.states"), i)
    read = F.transform(
        F.filter("items", lambda x: state(x["place"] - 1) == "loaded"), lambda x: F.struct(x["path"].alias("path"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), x["confidence"].alias("confidence"), x["n_refs"].alias("n_refs"), x["snippet"].alias("snippet"))
    )
    of = lambda what: F.size(F.filter("done.states", lambda s: s == what)).cast("bigint")
    counts = [F.col(c).cast("bigint").alias(c) for c in ("candidate_refs", "n_ranges", "selected_files", "cut_files", "cut_snippets")]
    counts += [F.size(F.filter("items", lambda x: x["clipped"])).cast("bigint").alias("cut_lines"), of("full").alias("cut_chars"), of("missing").alias("missing"), of("outside").alias("outside"), of("loaded").alias("loaded"), F.col("done.total").alias("total_chars")]
    return rows.select("target", read.alias("snippets"), F.struct(*counts).alias("trace"))


def needed(items: DataFrame, refs: DataFrame, least: str = "medium", always: bool = False, most: int = 5) -> DataFrame:
    """risk_id of the first items (risk_id, severity, status, in order of risk_id) whose source is to be read: suspected ones, at least that severe, with fewer than two references unless always."""
    n = refs.groupBy(F.col("target").alias("risk_id")).agg(F.count("*").alias("_refs"))
    severe = F.col("severity").isin(SEVERITIES[SEVERITIES.index(least) :]) & (F.col("status") == "suspected")
    few = F.lit(always) | (F.coalesce("_refs", F.lit(0)) < 2)
    return items.where(severe).select("risk_id").distinct().join(n, "risk_id", "left").where(few).orderBy("risk_id").limit(most).select("risk_id")


def with_packs(items: DataFrame, refs: DataFrame, files: DataFrame, limits: Limits = Limits(), least: str = "medium", always: bool = False, most: int = 5) -> DataFrame:
    """items, each with drilled (whether its source was to be read) and its pack; those that need none keep nulls."""
    ids = needed(items, refs, least, always, most)
    read = packs(refs.join(ids.withColumnRenamed("risk_id", "target"), "target", "left_semi"), files, limits).withColumnRenamed("target", "risk_id")
    rows = items.join(ids.withColumn("drilled", F.lit(True)), "risk_id", "left").withColumn("drilled", F.coalesce("drilled", F.lit(False)))
    return rows.join(read, "risk_id", "left")
