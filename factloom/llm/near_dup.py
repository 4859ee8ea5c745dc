"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Each document becomes the set of its word 5-shingles (64-bit hashes) and a signature of
   TREES * DEPTH minima.  Documents with equal sets (128-bit digest) are one *class*,
   stood for by its smallest doc_id; all that follows is between classes.
2. Forest: tree t sorts signatures from its own position on.  A *region* is what shares
   the first DEPTH values; where more than CROWD classes meet, the region is divided by the
   next DEPTH values, and so on, so depth adapts to how crowded a region is, and no group
   is ever handled whole.  First candidates are neighbours in the sorted order (longest
   common prefix), each class with its region's most central class, and each divided part's
   centre with the centre of what it was divided from.
3. Candidates whose signatures agree too little to be possible (five standard deviations
   below the limit) go; the rest are confirmed on the full sets.  A first round confirms one
   candidate of each class, a second those that still join two components.
4. In a last round every region is looked at again: all its pairs of different components
   are candidates in regions of up to CROWD classes.  Classes of larger regions are compared
   exactly, all with all: prefixes of their sets, the rarest shingles first, meet by equality,
   and no two sets that are alike enough have prefixes that do not.
5. Components of confirmed links, by star contraction.

A link at the limit (0.75) has a common region in one tree with chance 0.75^4 = 0.32, so in
none of 36 trees once in a million times.

Defined results: a null or empty text, or one of white space only, has no shingles, is
linked with nothing and is kept; fewer than five words count as one shingle; rows of one
doc_id are one node (its smallest set digest counts) and are each returned; a row without a
doc_id is linked with nothing, has no component and is kept; a text of any length is one set,
worked on whole; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .idfilter import IdFilter, maybe_in
from .storage import materialize, small_batches
from .textcore import Texts, Words, joined_hash, lane, mix, release, sliced, window_hashes

SHINGLE, DEPTH, TREES, CROWD = 5, 4, 36, 64
PERCENT = 75


def shingle_sets(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, end to end, and the offset of each row."""
    words = Words(texts)
    h = words.hashes(lower=True)
    n = len(h) - size + 1
    ok = words.row[:n] == words.row[size - 1 :] if n > 0 else np.zeros(0, bool)
    value, row = window_hashes(h, size)[ok], words.row[:n][ok] if n > 0 else words.row[:0]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        extra = []
        for i in short.tolist():
            x = h[words.first[i] : words.first[i] + 1]
            for k in range(1, words.count[i]):
                x = joined_hash(x, h[words.first[i] + k : words.first[i] + k + 1])
            extra.append(mix(x + np.uint64(int(words.count[i])))[0])
        value, row = np.concatenate([value, np.array(extra, dtype=np.uint64)]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if len(value):
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(texts.n + 1))


def set_digests(value: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two halves of a digest of each row's set; zeros where it is empty."""
    out = [np.zeros(len(at) - 1, np.uint64) for _ in range(2)]
    some = np.flatnonzero(np.diff(at))
    if len(some):
        for k in range(2):
            out[k][some] = np.add.reduceat(mix(value * np.uint64(2 * k + 1) + np.uint64(k)), at[:-1][some])
    return out


_MULTIPLY = lane(4096, 71) | np.uint64(1)
_ADD = lane(4096, 72)


def signatures(value: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """(rows, size) 32-bit minima; rows without a shingle get zeros."""
    out = np.zeros((len(offsets) - 1, size), dtype=np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    at = offsets[:-1][full]
    for k in range(size):
        x = value * _MULTIPLY[k]
        x ^= _ADD[k]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x >>= np.uint64(32)
        out[full, k] = np.minimum.reduceat(x.astype(np.uint32), at)
    return out


def describe(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_shingles, the digest of the set in two halves, and the signature."""
    size = trees * depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, limit=1 << 20):
            value, at = shingle_sets(Texts(b.column("text")))
            n = np.diff(at)
            digest = set_digests(value, at)
            sig = signatures(value, at, size)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in digest), pa.array([r.tobytes() if k else None for r, k in zip(sig, n, strict=True)], pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "signature"],
            )
        release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, signature binary")


def forest(classes: DataFrame, trees: int, depth: int) -> DataFrame:
    """One row for each class and tree: keys of the first depth, 2 * depth, ... 4 * depth values from the tree's position on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                b = batch.slice(i, 2000)
                sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), dtype=np.uint32).reshape(b.num_rows, -1).astype(np.uint64)
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                size = sig.shape[1]
                got = []
                for t in range(trees):
                    keys, h = [], np.full(len(ids), mix(np.array([t + 1], np.uint64))[0])
                    for level in range(4):
                        for k in range(depth):
                            h = joined_hash(h, sig[:, (depth * (t + level) + k) % size])
                        keys.append(h)
                    got.append(keys)
                cols = [np.concatenate([g[level] for g in got]).view(np.int64) for level in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, trees)), *map(pa.array, cols)], names=["id", "k1", "k2", "k3", "k4"])

    return classes.mapInArrow(run, "id long, k1 long, k2 long, k3 long, k4 long")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) from (x, y)."""
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def candidates(classes: DataFrame, trees: int, depth: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Distinct first candidate pairs (a < b) of classes, and the forest's rows that share a region."""
    rows = forest(classes, trees, depth)
    met = materialize(rows.groupBy("k1").agg(F.count("*").alias("n")).where("n > 1"), "met")
    rows = rows.join(met, "k1")
    central = rows.groupBy("id").agg(F.sum("n").alias("central"))
    rows = whole_forest = materialize(rows.join(central, "id"), "forest")
    pairs = None
    region, parent = F.col("k1"), None
    for level in range(1, 5):
        # what is still whole at this level; members of a crowded region go on to the next
        here = rows.withColumn("region", region)
        centre = here.groupBy("region").agg(F.count("*").alias("size"), F.max(F.struct("central", F.negative("id").alias("i"))).alias("c"))
        centre = centre.select("region", "size", F.negative(F.col("c.i")).alias("centre"))
        here = here.join(centre, "region")
        if parent is not None:
            up = here.select(F.col("centre").alias("x"), F.col("above").alias("y"))
            pairs = pairs.union(up)
        star = here.select(F.col("id").alias("x"), F.col("centre").alias("y"))
        pairs = star if pairs is None else pairs.union(star)
        if level < 4:
            whole = here.where(F.col("size") <= crowd)
        else:  # sixteen equal values: a large group's neighbours are sought in parts of it
            part = F.expr(f"case when size > {crowd} then pmod(xxhash64(id), cast(ceil(size / {crowd}) as int)) else 0 end")
            whole = here.withColumn("region", F.xxhash64("region", part))
        order = Window.partitionBy("region").orderBy(*[f"k{k}" for k in range(1, 5)], "id")
        for step in (1, 2):
            pairs = pairs.union(whole.select(F.col("id").alias("x"), F.lag("id", step).over(order).alias("y")))
        if level < 4:
            rows = materialize(here.where(F.col("size") > crowd).select("id", "k1", "k2", "k3", "k4", "central", F.col("centre").alias("above")), "crowded")
            if not rows.take(1):
                break
            region, parent = F.col(f"k{level + 1}"), "above"
    return _ordered(pairs), whole_forest


def across_regions(forest_rows: DataFrame, root: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a < b) of classes of different components that share a region of up to crowd classes; and the classes
    (doc_id) of larger regions of several components, which prefix_meetings compares."""
    rows = forest_rows.select("id", F.col("k1").alias("region")).join(root.select(F.col("node").alias("id"), "root"), "id", "left")
    rows = rows.withColumn("root", F.coalesce("root", "id"))
    by_root = rows.groupBy("region", "root").agg(F.count("*").alias("n"))
    region = by_root.groupBy("region").agg(F.sum("n").alias("size"), F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("top")).where("roots > 1")
    rows = materialize(rows.join(region.select("region", F.col("top.root").alias("top"), (F.col("size") <= crowd).alias("fits")), "region"), "mixed")
    fit = rows.where("fits")
    # every pair has an end outside the region's largest component, and those are few
    few = fit.where("root <> top").select("region", F.col("id").alias("x"), F.col("root").alias("rx"))
    met = fit.select("region", F.col("id").alias("y"), "root").join(few, "region").where("root <> rx").select("x", "y")
    return _ordered(met), rows.where("not fits").select(F.col("id").alias("doc_id")).distinct()


def prefix_meetings(texts: DataFrame, root: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) of different components among texts (doc_id, text), with every pair that alike.  root: (doc_id, root).

    A set's shingles are put in order of about how many of texts have them (any one order of all would do).  Two sets that alike share one of the first
    n - ceil(n * percent / 100) + 1 of both, and at the first that they share enough are left in both; common shingles
    come last, so they gather only those sets that have few others.
    """
    return _meetings(texts, root, percent).distinct()


#: Shingles of a set that go with each of its prefix, those just before it; log2 of the slots in which texts are counted.
EARLIER, SLOTS = 8, 20


def _slot(value: np.ndarray, slots: int) -> np.ndarray:
    return (mix(value) >> np.uint64(64 - slots)).astype(np.int64)


def _commonness(texts: DataFrame, slots: int) -> np.ndarray:
    """For each slot of shingles how many of texts are in it, as eighths of its logarithm: of a fixed size, and 0 only where no two texts share a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            slot, n = np.unique(_slot(shingle_sets(Texts(b.column("text")))[0], slots), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(n, pa.int64())], names=["slot", "n"])

    counts = texts.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    counts = counts.select("slot", F.least(F.floor(8 * F.log2("n")), F.lit(127)).cast("byte").alias("level")).toArrow()
    level = np.zeros(1 << slots, dtype=np.uint8)
    level[counts.column("slot").to_numpy()] = counts.column("level").to_numpy()
    return level


def _meetings(texts: DataFrame, root: DataFrame, percent: int, slots: int = SLOTS) -> DataFrame:
    """The pairs of prefix_meetings, some of them several times: a pair that shares one of the EARLIER shingles before has met there, with more left in both."""

    shared = texts.sparkSession.sparkContext.broadcast(_commonness(texts, slots).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.frombuffer(shared.value, dtype=np.uint8)
        for b in sliced(batches):
            value, at = shingle_sets(Texts(b.column("text")))
            row, level = np.repeat(np.arange(b.num_rows), np.diff(at)), common[_slot(value, slots)]
            order = np.lexsort((value, level, row))
            value, level, size = value[order], level[order], np.diff(at)[row]
            place = np.arange(len(value)) - at[row] + 1
            # those that no other set has come first and meet nothing
            first = np.flatnonzero((level > 0) & (place <= size - (percent * size + 99) // 100 + 1))
            alone = np.bincount(row[level == 0], minlength=b.num_rows)
            n = np.minimum(first - (at[:-1] + alone)[row[first]], EARLIER)
            ends = np.cumsum(n)
            earlier = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), value[np.repeat(first - ends, n) + np.arange(n.sum())].view(np.int64))
            of = pa.array(row[first])
            cols = [b.column("doc_id").take(of), b.column("root").take(of), *(pa.array(c[first].astype(np.int64)) for c in (value.view(np.int64), size, place)), earlier]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "root", "shingle", "size", "place", "earlier"])

    rows = texts.join(root.select("doc_id", "root"), "doc_id").select("doc_id", "root", "text")
    met = materialize(rows.mapInArrow(run, "doc_id long, root long, shingle long, size long, place long, earlier array<long>"), "prefixes")
    x, y = (met.select("shingle", F.col("doc_id").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("root", "size", "place", "earlier"))) for c in ("a", "b"))
    enough = f"{100 + percent} * (1 + least(size_a - place_a, size_b - place_b)) >= {percent} * (size_a + size_b) and 100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
    return x.join(y, "shingle").where(f"a < b and root_a <> root_b and {enough} and not arrays_overlap(earlier_a, earlier_b)").select("a", "b")


def agreement(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs with the share of equal signature values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4000):
                b = batch.slice(i, 4000)
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint32).reshape(b.num_rows, -1) for c in ("sa", "sb"))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((x == y).mean(axis=1))], names=["a", "b", "likeness"])

    both = pairs.join(classes.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa")), "a").join(classes.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, likeness double")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose full sets are that alike, with both sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in sliced(iter([batch]), column="ta"):
                x, xa = shingle_sets(Texts(b.column("ta")))
                y, ya = shingle_sets(Texts(b.column("tb")))
                ok = np.zeros(b.num_rows, dtype=bool)
                for i in range(b.num_rows):
                    p, q = x[xa[i] : xa[i + 1]], y[ya[i] : ya[i + 1]]
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    ok[i] = 100 * common >= percent * (len(p) + len(q) - common) > 0
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    both = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def class_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, text) of classes (doc_id, d1, d2); of several texts of one doc_id the one with the class's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            value, at = shingle_sets(Texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), *(pa.array(d.view(np.int64)) for d in set_digests(value, at))], names=["doc_id", "text", "d1", "d2"])

    rows = maybe_in(docs.where("doc_id is not null").select("doc_id", "text"), classes.select("doc_id")).mapInArrow(run, "doc_id long, text string, d1 long, d2 long")
    return rows.join(classes, ["doc_id", "d1", "d2"], "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"])


def clusters(docs: DataFrame, percent: int = PERCENT, trees: int = TREES, depth: int = DEPTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    small_batches(docs.sparkSession)
    described = materialize(describe(docs, trees, depth), "signatures")
    linked = described.where("n_shingles > 0 and doc_id is not null")
    ones = materialize(linked.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "sets")
    # of one doc_id the smallest digest; joined on doc_id, so that copies of one text are no hot key
    mine = ones.groupBy(F.col("class_id").alias("doc_id")).agg(F.min(F.struct("d1", "d2")).alias("d")).select("doc_id", "d.d1", "d.d2")
    classes = materialize(linked.join(mine, ["doc_id", "d1", "d2"]).select("doc_id", "d1", "d2", "signature").dropDuplicates(["doc_id"]), "classes")
    limit = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / (trees * depth)) ** 0.5
    likely = lambda pairs: materialize(agreement(pairs, classes).where(F.col("likeness") >= limit), "pairs")
    texts = lambda ends: materialize(class_texts(docs, classes.join(ends, "doc_id", "left_semi").select("doc_id", "d1", "d2")), "texts")

    near, rows = candidates(classes, trees, depth, crowd)
    pairs = likely(near)
    text = texts(_ends(pairs))
    # first one candidate of each class: the smallest among those that look safe, else the likeliest
    either = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "likeness"))
    safe = F.when(F.col("likeness") >= percent / 100 + 0.05, F.lit(1)).otherwise(0)
    rank = F.struct(safe.alias("s"), F.when(safe == 1, F.negative("b").cast("double")).otherwise(F.col("likeness")).alias("r"), F.negative("b").alias("t"))
    first = either.groupBy("a").agg(F.max(F.struct(rank.alias("k"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    first = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialize(confirmed(first, text, percent), "links")
    root = materialize(components(links), "roots")
    joins = _across(pairs, root).join(first, ["a", "b"], "left_anti")
    links = materialize(links.union(confirmed(joins, text, percent)), "links")
    root = materialize(components(links), "roots")
    # what shares a region and is still apart
    apart, divided = across_regions(rows, root, crowd)
    more = likely(apart.join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    if more.take(1):
        links = materialize(links.union(confirmed(more, texts(_ends(more)), percent)), "links")
        root = materialize(components(links), "roots")
    divided = materialize(divided, "divided")
    if divided.take(1):
        now = divided.select("doc_id").join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        text = texts(divided.select("doc_id"))
        rest = likely(prefix_meetings(text, now, percent).join(pairs.select("a", "b").union(more.select("a", "b")), ["a", "b"], "left_anti"))
        if rest.take(1):
            links = materialize(links.union(confirmed(rest, text, percent)), "links")
            root = materialize(components(links), "roots")

    # only sets of several documents or links have to be told their component; as a table, the join may be split
    told = ones.join(root, ones["class_id"] == root["node"], "left").where("n > 1 or root is not null")
    told = materialize(told.select("d1", "d2", F.coalesce("root", "class_id").alias("component_id")), "told")
    out = described.join(told, ["d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()


def _across(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    ra, rb = root.select(F.col("node").alias("a"), F.col("root").alias("ra")), root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(ra, "a", "left").join(rb, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def report(docs: DataFrame, **options: int) -> DataFrame:
    return clusters(docs, **options).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, **options: int) -> DataFrame:
    """docs without those that are near copies of a document with a smaller doc_id; few rows are shuffled where few go."""
    gone = materialize(clusters(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone_doc")).distinct(), "gone")
    maybe = IdFilter(gone)
    rows = maybe.keep(docs)
    return rows.join(gone, rows["doc_id"] == gone["_gone_doc"], "left_anti").union(maybe.drop(docs))
