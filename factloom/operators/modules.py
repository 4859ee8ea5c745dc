"""Imports between source files: relative module paths resolved to files, and prefixes that routers get where they are mounted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as fp

# What a module path may stand for, in order of precedence.
ENDINGS = ["", ".ts", ".tsx", ".mts", ".cts", "/index.ts", "/index.tsx"]


def resolve(path: Column, module: Column) -> Column:
    """A relative module path seen from a file, without . and ..; null where it leaves the root or is not relative."""
    folder = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    steps = F.concat(folder, F.filter(F.split(module, "/"), lambda x: ~x.isin("", ".")))
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))
    found = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.when(module.startswith("."), F.array_join(found, "/"))


def imports(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(path, alias, target): default imports of relative modules with the file each stands for, by a join on the file's path.

    An alias that is imported more than once means its last import.
    """
    said = r"""import\s+([A-Za-z_][A-Za-z0-9_]*)\s+from\s+['"]([^'"]+)['"]"""
    rows = lines.select("path", "line_no", F.regexp_extract("line", said, 1).alias("alias"), F.regexp_extract("line", said, 2).alias("module")).where("alias <> ''")
    tried = rows.select("path", "line_no", "alias", F.posexplode(F.transform(F.array(*map(F.lit, ENDINGS)), lambda e: F.concat(resolve(F.col("path"), F.col("module")), e))).alias("rank", "target")).where("target is not null")
    hits = tried.join(files.select(F.col("path").alias("target")).distinct(), "target")
    best = hits.groupBy("path", "line_no", "alias").agg(F.min_by("target", "rank").alias("target"))
    return best.groupBy("path", "alias").agg(F.max_by("target", "line_no").alias("target"))


def mounted(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(path, prefix): files whose router another file mounts, with each prefix it gets there."""
    use = r"""app\.use\s*\(\s*['"]([^'"]+)['"]\s*,\s*([A-Za-z_][A-Za-z0-9_]*)\s*\)"""
    uses = lines.select("path", F.regexp_extract("line", use, 1).alias("prefix"), F.regexp_extract("line", use, 2).alias("alias")).where("alias <> ''")
    return uses.join(imports(lines, files), ["path", "alias"]).select(F.col("target").alias("path"), fp.link_path(F.col("prefix")).alias("prefix")).distinct()


def with_prefixes(endpoints: DataFrame, mounts: DataFrame, file: str = "file", route: str = "path") -> DataFrame:
    """Endpoints with their route below the prefix that their file's router is mounted at; of several, the route that sorts first."""
    told = mounts.groupBy(F.col("path").alias("__file")).agg(F.collect_set("prefix").alias("__prefixes"))
    below = F.array_min(F.transform("__prefixes", lambda p: fp.link_path(F.concat(p, F.lit("/"), F.col(route)))))
    return endpoints.join(told, F.col(file) == F.col("__file"), "left").withColumn(route, F.coalesce(below, F.col(route))).drop("__file", "__prefixes")
