"""Operators over files: skip reasons, budgets, digests, weighted text rules, redaction."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files as ff
from . import prefix


def skip_reason(path: Column, size: Column, text: Column, dirs: list[str] = ff.IGNORED_DIRS, extensions: list[str] = ff.IGNORED_EXTENSIONS, max_bytes: int = 2 << 20, printable: float = ff.PRINTABLE_SHARE) -> Column:
    """The first reason to skip a file: its folder, extension, size, or bytes."""
    sample = F.substring(text, 1, ff.SAMPLE_BYTES)
    few = F.length(F.regexp_replace(sample, r"[^\t\n\r\x20-\x7e]", "")) < F.length(sample) * printable
    return (
        F.when(F.arrays_overlap(F.split(F.regexp_replace(path, r"\\", "/"), "/"), F.array(*map(F.lit, dirs))), "ignored_dir")
        .when(F.lower(ff.base_name(path)).contains(ff.IGNORED_NAME_PART) | ff.extension(path).isin(extensions), "ignored_ext")
        .when(size > max_bytes, "too_large").when((F.length(sample) > 0) & (sample.contains("\0") | few), "binary")
    )


def skip_counts(rows: DataFrame, samples: int = 20) -> DataFrame:
    """Number of files of each reason and the first samples by path; ranks are cut before anything is gathered."""
    rows = rows.where("reason is not null")
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("reason").orderBy("path"))).where(F.col("n") <= samples)
    first = first.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("samples"))
    return rows.groupBy("reason").agg(F.count("*").alias("n_files")).join(first, "reason")


def within_budget(files: DataFrame, root: str, max_files: int, max_bytes: int) -> DataFrame:
    """Root, path and size of files, with the running count and bytes of their root in path order, and whether both are in budget."""
    files = prefix.running(files.select(root, "path", "size"), [root], ["path"], {"n": F.lit(1).cast("bigint"), "total": F.col("size")})
    return files.withColumn("included", (F.col("n") <= max_files) & (F.col("total") <= max_bytes))


def content_id(files: DataFrame, root: str) -> DataFrame:
    """SHA-256 over path and digest of a root's files in path order; only digests are gathered."""
    line = F.concat("path", F.lit(":"), F.sha2("content", 256), F.lit("\n"))
    one = files.select(root, F.struct("path", line.alias("line")).alias("f"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["line"]), "")
    return one.groupBy(root).agg(F.sha2(joined, 256).alias("content_id"), F.count("*").alias("n"))


@dataclass(frozen=True)
class Rule:
    """A text rule: words by strength, markers it needs, markers that block it, weights, and its base confidence.

    A marker is needed among the strong and medium words that occur; one blocks where it is among the negative ones.
    """

    rule_id: str
    strong: list[str]
    medium: list[str] = field(default_factory=list)
    negative: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    blocking: list[str] = field(default_factory=list)
    weight_strong: float = 0.5
    weight_medium: float = 0.35
    penalty: float = 0.3
    base: float = 0.3


#: What no word goes on with, and a word's own bounds.
_WORD = r"[\p{L}\p{N}_]"


def bounded(word: str) -> str:
    """A pattern for a whole word or phrase."""
    return rf"(?<!{_WORD}){re.escape(word)}(?!{_WORD})"


def spread(rows: DataFrame) -> DataFrame:
    """rows over as many partitions as there are cores, where they come in fewer: for work that costs far more than a shuffle of its rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def score_rules(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """path, rule_id, score, confidence, start_line: at most one row for each file and rule.

    All single words are found in one pass over a file, phrases in one each; the line is that of the first match of
    the first word that occurs, strong before medium before negative.
    """
    words = sorted({w for r in rules for w in [*r.strong, *r.medium, *r.negative]})
    single = [w for w in words if re.fullmatch(r"\w+", w)]
    text = F.lower("content")
    one_of = rf"(?<!{_WORD})(?:{'|'.join(single)})(?!{_WORD})"
    hits = spread(files.select("path", "content")).withColumn("_hits", F.regexp_extract_all(text, F.lit(one_of), 0) if single else F.array())
    # the hits are few and are counted in place; without this step the pattern would run once for each word
    counted = hits.select("path", "content", F.explode(F.array("_hits")).alias("_hits"))
    count = {w: F.size("_hits") - F.size(F.array_remove("_hits", w)) if w in single else F.regexp_count(text, F.lit(bounded(w))) for w in words}
    at = {w: f"_c{i}" for i, w in enumerate(words)}
    counted = counted.select("path", "content", F.explode(F.array(F.struct(*[count[w].alias(c) for w, c in at.items()]))).alias("c")).select("path", "content", "c.*")
    rows = []
    for r in rules:
        order = [*[(w, r.weight_strong) for w in r.strong], *[(w, r.weight_medium) for w in r.medium], *[(w, -r.penalty) for w in r.negative]]
        total = sum((F.col(at[w]) * F.lit(x) for w, x in order), F.lit(0.0))
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)
        ok = sum((F.col(at[w]) for w, _ in order), F.lit(0)) > 0
        for w in r.required:
            ok &= (F.col(at[w]) > 0) if w in [*r.strong, *r.medium] else F.lit(False)
        for w in r.blocking:
            ok &= (F.col(at[w]) == 0) if w in r.negative else F.lit(True)
        first = F.coalesce(*[F.when(F.col(at[w]) > 0, F.lit(bounded(w))) for w, _ in order])
        rows.append(F.when(ok, F.struct(F.lit(r.rule_id).alias("rule_id"), score.alias("score"), F.greatest(score, F.lit(r.base)).alias("confidence"), first.alias("first"))))
    found = counted.select("path", "content", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("f"))
    before = F.substring(text, F.lit(1), F.regexp_instr(text, F.col("f.first")))
    return found.select("path", "f.rule_id", "f.score", "f.confidence", (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("start_line"))


def redact(rows: DataFrame, column: str, classes: list[tuple[str, str, str]]) -> DataFrame:
    """column with each class's pattern replaced in turn, and n_<class> counted just before."""
    rows = spread(rows)
    for name, regex, token in classes:
        rows = rows.withColumn(f"n_{name}", F.regexp_count(column, F.lit(regex)).cast("bigint")).withColumn(column, F.regexp_replace(column, regex, token))
    return rows


def classify(text: Column, classes: list[tuple[str, list[str]]], other: str = "unsupported") -> Column:
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = F.lit(other)
    for name, keys in reversed(classes):
        out = F.when(low.rlike("|".join(map(re.escape, keys))), name).otherwise(out)
    return out
