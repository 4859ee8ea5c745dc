"""Digests of whole trees, folder by folder from the deepest up, and where two trees differ.

A folder's children are dealt into buckets by a hash of their name; a bucket's digest is that of its
lines (name, kind, digest) by name, and a folder's digest that of its buckets in order.  So no task
gathers a folder, however many children it has, and one changed file changes only the digests on its way up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

#: Hexadecimal digits of a bucket's name: a folder has at most 16 to this power of them.
DIGITS = 3


def _parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")).otherwise("")


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["line"]), "\n")


def digests(files: DataFrame, root: str) -> DataFrame:
    """(root, path, is_file, digest): of every file (root, path, sha256) and every folder; the top's path is empty.

    Repeated rows of a path count once, by their smallest digest; a null digest is that of the empty text.
    """
    leaves = files.groupBy(F.col(root).alias("root"), "path").agg(F.min(F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256))).alias("digest"))
    leaves = materialize(leaves.select("root", "path", F.lit(True).alias("is_file"), "digest", (F.size(F.split("path", "/")) - 1).alias("depth")), "tree")
    deepest = leaves.agg(F.max("depth")).first()[0]
    found = leaves.drop("depth")
    below = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        here = leaves.where(F.col("depth") == depth).drop("depth")
        here = here if below is None else here.unionByName(below)
        name = F.substring_index("path", "/", -1)
        lined = here.select("root", _parent(F.col("path")).alias("parent"), F.left(F.sha2(name.cast("binary"), 256), F.lit(DIGITS)).alias("bucket"), F.struct(name.alias("name"), "is_file", F.concat_ws(" ", F.when(F.col("is_file"), "file").otherwise("folder"), name, "digest").alias("line")).alias("x"))
        buckets = lined.groupBy("root", "parent", "bucket").agg(F.sha2(_joined(F.col("x")).cast("binary"), 256).alias("d"))
        folders = buckets.groupBy("root", "parent").agg(F.sha2(_joined(F.struct("bucket", F.concat_ws(" ", "bucket", "d").alias("line"))).cast("binary"), 256).alias("digest"))
        # depth counts a path's slashes, so the folders made here stand one level up
        below = materialize(folders.select("root", F.col("parent").alias("path"), F.lit(False).alias("is_file"), "digest"), "tree")
        found = found.unionByName(below)
    return found


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(root, path, is_file, state) of what was added, removed or changed between two results of digests: a join on the
    path, of which only what differs is kept."""
    keys = ["root", "path", "is_file"]
    o, n = old.select(*keys, F.col("digest").alias("o")), new.select(*keys, F.col("digest").alias("n"))
    both = o.join(n, keys, "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    return both.select(*keys, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed").alias("state"))
