"""Document fingerprints: the bottom-k sketch of a text's shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the K smallest distinct hashes of the text's word
5-shingles (A-Z lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; fewer than five words count as
one shingle).  Sketches of parts merge into that of the whole; two sketches estimate
resemblance, containment and distinct counts.

Defined results: a null or empty text, or one of white space, has the empty sketch and the
fingerprint ``''``; two empty sketches have resemblance 1, an empty and another 0; equal
texts have equal fingerprints; ties of doc_id are ordered by text; a single document is
its own next one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import parts

K = 128
SHINGLE = 5
_MAX = (1 << 63) - 1


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    return F.array_remove(F.split(flat, " "), "")


def shingle_hashes(hashes: Column, size: int = SHINGLE) -> Column:
    """Hashes of all runs of size entries of an array of word hashes; of the whole array where it is shorter."""
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(n >= size, windows).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def sketch(hashes: Column, k: int = K) -> Column:
    """Sorted bottom-k of an array of shingle hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """df with the sketch of a text column."""
    hashes = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    return df.withColumn(name, _let(hashes, lambda h: sketch(shingle_hashes(h), k)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once for each row: a lambda's variable is never inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what both sketches' texts have together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each group of keys: a part's hashes are cut to k before and after they meet."""
    one = df.select(*keys, F.explode(column).alias("_h")).distinct()
    order = Window.partitionBy(*keys).orderBy("_h")
    return one.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: how many of the k smallest of the union are in both."""
    return _let(merge(a, b, k), lambda both: F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(float(1 << 63))) / F.lit(float(1 << 64))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    j = resemblance(a, b, k)
    na, nb = distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (F.lit(1.0) + j) / na))


def fingerprint(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def in_ranges(docs: DataFrame, per_group: int = 2000, groups: int = 1024) -> DataFrame:
    """doc_id, text, g, late: documents dealt by ranges of doc_id, so that each one's next is in its group.

    The ids are cut by quantiles.  The first row of each range also goes, marked late, to the end of the range before
    (that of the first to the last), where it is the last row's next.  To the driver come at most ``groups`` bounds.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.agg(F.count("*")).first()[0]
    wanted = min(groups, max(parts(docs.sparkSession), n // per_group))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)] or [0.5], 10 * wanted)).first()[0] or []
    df = docs.withColumn("g", F.expr(_range_of("doc_id", sorted(set(cuts)))))
    firsts = sorted((r["g"], r["d"]) for r in df.groupBy("g").agg(F.min("doc_id").alias("d")).collect() if r["d"] is not None)
    first = df.where(F.col("doc_id").isin([d for _, d in firsts]))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("doc_id", "text"))).where("r = 1").drop("r")
    before = F.create_map(*[F.lit(x) for i, (g, _) in enumerate(firsts) for x in (g, firsts[i - 1][0])]) if firsts else F.create_map(F.lit(0), F.lit(0))
    both = df.withColumn("late", F.lit(0)).unionByName(first.withColumn("g", before[F.col("g")]).withColumn("late", F.lit(1)))
    return both.repartition(wanted, "g")


def _range_of(column: str, cuts: list[int]) -> str:
    """Number of cuts that are at most the column's value, as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"if({column} < {cuts[mid]}, {tree(lo, mid)}, {tree(mid + 1, hi)})"

    return tree(0, len(cuts)) if cuts else "0"


def report(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses."""
    order = Window.partitionBy("g").orderBy("late", "doc_id", "text")
    df = with_sketch(in_ranges(docs), "text", "own", k)
    df = df.withColumn("next_text", F.lead("text").over(order)).withColumn("following", F.lead("own").over(order)).where("late = 0")
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail)))
    df = with_sketch(df, "edited", "changed", k)
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"), resemblance(F.col("own"), F.col("following"), k).alias("near_next"),
    )
