"""Phrase collocations, mined level by level.

Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``, A-Z
lower-cased.  Level 1 counts words; level k counts only those k-grams whose first and last k-1
words both reached the minimum at level k-1, as no other can reach it.  What is broadcast of a level
is a filter of fixed size over hashes of its phrases: it never denies a phrase that is there, so
where it is full it lets more k-grams be counted and changes no count.  Counts are added up within
a task first, then in Spark by (lang, phrase) itself, so hashes decide nothing.

A candidate's score comes from its worst cut into two phrases, both of which are in the tables of
the levels below.  All arithmetic is exact.

Results for odd input:

* Null and empty texts, and pieces without a word, add nothing; a null lang is ``und``.
* A row counts each time it is there, equal rows and equal doc_ids as well.
* Ties go by score, then count, then the phrase's UTF-8 bytes, so ranks are unique.
* A text of any length is handled whole; its memory is a small multiple of it.
* Without candidates, or on an empty table, there is no row.
* Only the text and lang columns are read; others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .idfilter import IdFilter
from .storage import materialize, small_batches
from .textcore import Texts, Words, fold, mix, release, sliced, span_hashes, span_strings, window_hashes

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
#: A longer candidate with this share of its count (in hundredths) takes a shorter one's place.
INSIDE = 50
#: log2 of the bits of a level's filter: 8 MB.
FILTER_BITS = 26
#: Text counted at a time, rows of a batch sent on, and sub-lists of a language that are ranked before its ranks are told.
CHUNK, ROWS, SALTS = 2 << 20, 1 << 15, 64

_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BETWEEN = _END.copy()
_BETWEEN[[0x20, 0x09]] = True


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about limit bytes of text, and cut where they are larger."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from sliced(iter(pa.Table.from_batches(held).combine_chunks().to_batches()), "text", limit)
            held, size = [], 0
    if held:
        yield from sliced(iter(pa.Table.from_batches(held).combine_chunks().to_batches()), "text", limit)


class _Grams:
    """The words of some texts with the piece of each, and hashes that go with the language."""

    def __init__(self, text: pa.Array, lang: pa.Array):
        self.texts = Texts(text)
        self.words = w = Words(self.texts, _BETWEEN)
        self.bytes = fold(self.texts.buf)
        # a piece ends at a mark; texts part words as well
        piece = np.cumsum(_END[self.texts.buf], dtype=np.int64)[w.starts] if len(w) else np.zeros(0, np.int64)
        new = np.zeros(len(w), dtype=bool)
        if len(w):
            new[1:] = (piece[1:] != piece[:-1]) | (w.row[1:] != w.row[:-1])
        self.piece = np.cumsum(new)
        tongues = Texts(lang)
        self.tongue = span_hashes(tongues.buf, tongues.offsets[:-1], tongues.offsets[1:], 1)[w.row]
        self.hashes = [span_hashes(self.bytes, w.starts, w.ends, which) for which in (0, 1)]

    def keys(self, size: int, which: int = 0) -> np.ndarray:
        """A hash of (lang, phrase) for every window of size words."""
        h = window_hashes(self.hashes[which], size, which)
        return mix(h ^ self.tongue[: len(h)])

    def whole(self, size: int) -> np.ndarray:
        """Windows within one piece."""
        n = max(0, len(self.words) - size + 1)
        return self.piece[:n] == self.piece[size - 1 :] if n else np.zeros(0, bool)

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        w = self.words
        parts = [span_strings(self.bytes, w.starts[at + j], w.ends[at + j]) for j in range(size)]
        return parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def _counted(docs: DataFrame, size: int, below: IdFilter | None) -> DataFrame:
    """(lang, phrase, f): counts of phrases of size words whose parts below may be frequent.  At level 1 there is a row with
    the empty phrase besides, which counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, CHUNK):
            lang = b.column(1)
            g = _Grams(b.column(0), lang)
            some = g.whole(size)
            if below is not None and len(some):
                may = np.zeros(len(g.words) - size + 2, dtype=bool)
                inner = np.flatnonzero(g.whole(size - 1))
                may[inner] = below.has(g.keys(size - 1)[inner])
                some &= may[:-1] & may[1:]
            at = np.flatnonzero(some)
            if not len(at):
                continue
            one, two = g.keys(size)[at], g.keys(size, 1)[at]
            order = np.argsort(one, kind="stable")
            one, two = one[order], two[order]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            first = np.flatnonzero(new)
            at = at[order[first]]
            counts = np.diff(np.append(first, len(order)))
            del one, two, order, some
            for i in range(0, len(at), ROWS):
                a = at[i : i + ROWS]
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(g.words.row[a])), g.phrases(a, size).cast(pa.string()), pa.array(counts[i : i + ROWS], pa.int64())], names=["lang", "phrase", "f"])
            if size == 1:
                codes = lang.dictionary_encode()
                n = np.bincount(codes.indices.to_numpy(zero_copy_only=False)[g.words.row], minlength=len(codes.dictionary))
                yield pa.RecordBatch.from_arrays([codes.dictionary, pa.array([""] * len(n), pa.string()), pa.array(n, pa.int64())], names=["lang", "phrase", "f"])
            release()

    return docs.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _filter(level: DataFrame, size: int) -> IdFilter:
    """A filter over the phrases of a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                g = _Grams(b.column(1), b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(g.keys(size)[g.words.first[:-1]].view(np.int64))], names=["id"])

    return IdFilter(level.select("lang", "phrase").mapInArrow(run, "id long"), FILTER_BITS)


def levels(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[DataFrame]]:
    """((lang, n), tables (lang, phrase, f) of frequent phrases by number of words), written."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    found, below, totals = [], None, None
    for size in range(1, max_words + 1):
        level = materialize(_counted(docs, size, below).where((F.col("f") >= min_count) | (F.col("phrase") == "")), f"phrases-{size}")
        if size == 1:
            totals = level.where("phrase = ''").select("lang", F.col("f").alias("n"))
            level = level.where("phrase <> ''")
        found.append(level)
        if size < max_words:
            below = _filter(level, size)
    return totals, found


def worst_cut(a: F.Column, cuts: list[tuple[F.Column, F.Column]]) -> F.Column:
    """The struct (score, k, l, r) of the lowest-scoring cut, the first of equal ones."""
    wide = a.cast("decimal(19,0)")

    def score(left: F.Column, right: F.Column) -> F.Column:
        # a / l and a / r are at most 1, so the quotient fits a long; the products fit 38 digits for counts up to 3e15
        over = (wide * wide).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
        under = left.cast("decimal(19,0)") * right.cast("decimal(19,0)")
        return F.call_function("div", over.cast("decimal(38,0)"), under.cast("decimal(38,0)"))

    return F.array_min(F.array(*(F.struct(score(left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")) for k, (left, right) in enumerate(cuts, 1))))


def scored(level: DataFrame, size: int, tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates of one level, by joins with the tables below."""
    words = F.split("phrase", " ")
    out = level.withColumnRenamed("f", "a")
    for k in range(1, size):
        out = out.withColumns({f"first{k}": F.array_join(F.slice(words, 1, k), " "), f"rest{k}": F.array_join(F.slice(words, k + 1, size - k), " ")})
    for k in range(1, size):
        for part, table, name in ((f"first{k}", tables[k - 1], f"l{k}"), (f"rest{k}", tables[size - k - 1], f"r{k}")):
            out = out.join(table.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    cut = worst_cut(F.col("a"), [(F.col(f"l{k}"), F.col(f"r{k}")) for k in range(1, size)])
    return out.withColumn("cut", cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def covered(tables: list[DataFrame]) -> DataFrame | None:
    """(lang, phrase, most): the largest count of a longer candidate that has the phrase inside."""
    found = None
    for size in range(3, len(tables) + 1):
        words = F.split("phrase", " ")
        inner = F.array_distinct(F.array(*(F.array_join(F.slice(words, i + 1, k), " ") for k in range(2, size) for i in range(size - k + 1))))
        part = tables[size - 1].select("lang", F.explode(inner).alias("phrase"), "f")
        found = part if found is None else found.unionByName(part)
    return None if found is None else found.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, inside: int = INSIDE, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first top phrases: (lang, rank, phrase, a, l, r, n, score)."""
    totals, tables = levels(docs, min_count, max_words, text, lang)
    found = None
    for size in range(2, max_words + 1):
        part = scored(tables[size - 1], size, tables)
        found = part if found is None else found.unionByName(part)
    longer = covered(tables)
    if longer is not None:
        found = found.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))).drop("most")
    # sub-lists are ranked first, so that no task sees more than SALTS * top phrases of a language at the end
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    within = Window.partitionBy("lang", "salt").orderBy(*order)
    found = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
