"""Removal of repeated passages by level-wise doubling.

A passage of ``window`` words is repeated only if its parts are.  Levels therefore look at
windows of doubling length, 13, 25 and 50 words for a ``window`` of 50, and only what some
other document repeats at one length alone is extended to twice that length, until the last
length or until no candidates survive.

* Every level but the last looks at one part of each full window that is still a candidate:
  the part of the level's length with the least hash inside the full window (ties: the
  first).  Which one depends on the words of the full window alone, so equal full windows
  select equal parts and no repeat is lost, while few positions travel (about 5 % of them at
  the first level, far fewer after it).
* Hashes that several documents have go on: to the next level as a filter of fixed size that
  lets all of them through, to the last one exactly, by document.
* The last level hashes the full windows around a repeated part (96 bits, with the bucket),
  keeps one entry for each block of documents and hash, and finds the smallest document of
  each.  A third of all documents with one passage is one entry a block, not one a document.
  The number of blocks follows the candidates' bytes.

Defined results: a null text has no words; texts with fewer than ``window`` words keep all;
windows repeated only inside one document stay; rows with an equal doc_id count as one
document in the comparison and are each returned; a row without a doc_id is compared with
nothing and keeps all; a text of any length is worked on whole; other columns are passed
through whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .idfilter import IdFilter, maybe_in
from .storage import materialize, parts, small_batches
from .textcore import Texts, Words, pack, release, run_starts, sliced, unpack, valid_windows, window_hashes

WINDOW = 50
#: Words of the shortest level at least; bytes of candidates that are worked on together.
SHORTEST, BLOCK_BYTES = 12, 4 << 20


def lengths(window: int) -> list[int]:
    """The levels' lengths: window and its halves, rounded up, down to SHORTEST words, shortest first."""
    out = [window]
    while out[0] // 2 >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def selected_parts(words: Words, inner: np.ndarray, window: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """For each full window inside one row: its start, and the position of its part with the least hash (inner, of all parts)."""
    ok = np.flatnonzero(valid_windows(words, window))
    if not len(ok):
        return ok, ok
    # least (hash, position) among the window - part + 1 parts of each full window, by doubling
    best, width = np.arange(len(inner)), 1
    out, done = None, 0
    todo = window - part + 1
    while todo:
        if todo & 1:
            if out is None:
                out = best
            else:
                n = min(len(out), len(best) - done)
                a, b = out[:n], best[done : done + n]
                out = np.where(inner[b] < inner[a], b, a)
            done += width
        todo >>= 1
        if todo:
            a, b = best[:-width], best[width:]
            best = np.where(inner[b] < inner[a], b, a)
            width *= 2
    return ok, out[ok]


def _scan(docs: DataFrame, window: int, part: int) -> DataFrame:
    """doc_id, n_words, the digest of the whole text's words, and the hashes of its selected parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            words = Words(Texts(b.column("text")))
            inner = window_hashes(words.hashes(), part)
            at = np.unique(selected_parts(words, inner, window, part)[1])
            bounds = np.searchsorted(words.row[at] if len(at) else at, np.arange(words.texts.n + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(words.count, pa.int64()),
                 pa.array([hashlib.sha256(words.joined(i)).hexdigest() for i in range(words.texts.n)], pa.string()),
                 pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(inner[at].view(np.int64)))],
                names=["doc_id", "text_hash", "n_words", "sha", "parts"],
            )
        release()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_words long, sha string, parts array<long>")


def _extended(docs: DataFrame, window: int, before: int, part: int, repeated: IdFilter) -> DataFrame:
    """(doc_id, h): the hashes of selected parts of the full windows whose selected part of the length before is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            words = Words(Texts(b.column("text")))
            h = words.hashes()
            inner = window_hashes(h, before)
            _, old = selected_parts(words, inner, window, before)
            # each position is asked for once
            asked = np.unique(old)
            alive = np.zeros(len(inner), dtype=bool)
            alive[asked[repeated.has(inner[asked])]] = True
            longer = window_hashes(h, part)
            at = np.unique(selected_parts(words, longer, window, part)[1][alive[old]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(words.row[at])), pa.array(longer[at].view(np.int64))], names=["doc_id", "h"])
        release()

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, h long")


def _in_blocks(candidates: DataFrame, window: int, part: int, buckets: int) -> DataFrame:
    """Full windows around repeated halves: for each block and bucket, the sorted hashes and the least document of each."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in sliced(iter(group.combine_chunks().to_batches())):
            _, _, start, h, g, row = _candidate_windows(b, window, part)
            docs = b.column("doc_id").to_numpy(zero_copy_only=False)
            got.append((h[start], g[start], docs[row[start]]))
        h, g, d = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        order = np.lexsort((d, g, h))
        h, g, d = h[order], g[order], d[order]
        first = _first_of_each(h, g)
        h, g, d = h[first], g[first], d[first]
        bucket = (h >> np.uint64(32)).astype(np.int64) * buckets >> 32
        at = np.searchsorted(bucket, np.arange(buckets + 1))
        full = [k for k in range(buckets) if at[k] < at[k + 1]]
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "block": pa.array([key[0].as_py()] * len(full), pa.int32()),
            "entries": pa.array([pack(h[at[k] : at[k + 1]], g[at[k] : at[k + 1]], d[at[k] : at[k + 1]]) for k in full], pa.binary()),
        })

    return candidates.groupBy("block").applyInArrow(run, "bucket int, block int, entries binary")


def _first_of_each(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.int64)
    change = np.ones(len(h), dtype=bool)
    change[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return np.flatnonzero(change)


def _candidate_windows(b: pa.RecordBatch, window: int, part: int):
    """Words of a batch of candidates, and the starts of full windows whose selected part is repeated elsewhere."""
    words = Words(Texts(b.column("text")))
    h = words.hashes()
    inner = window_hashes(h, part)
    start, half_at = selected_parts(words, inner, window, part)
    repeated = b.column("repeated")
    values = repeated.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    owner = np.repeat(np.arange(b.num_rows), np.diff(repeated.offsets.to_numpy()))
    if len(start) and len(values):
        # (row, hash) membership by one sorted array of both
        order = np.lexsort((values, owner))
        lo = np.searchsorted(owner[order], np.arange(b.num_rows + 1))
        hit = np.zeros(len(start), dtype=bool)
        row = words.row[start]
        cut = np.searchsorted(row, np.arange(b.num_rows + 1))
        sorted_values = values[order]
        for i in range(b.num_rows):
            mine = sorted_values[lo[i] : lo[i + 1]]
            if len(mine) and cut[i] < cut[i + 1]:
                x = inner[half_at[cut[i] : cut[i + 1]]]
                k = np.minimum(np.searchsorted(mine, x), len(mine) - 1)
                hit[cut[i] : cut[i + 1]] = mine[k] == x
        start = start[hit]
    else:
        start = start[:0]
    full = window_hashes(h, window)
    second = (window_hashes(words.hashes(1), window, 1) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return words, h, start, full, second, words.row


def _smaller_elsewhere(group: pa.Table) -> pa.Table:
    """For each block, those of its hashes whose smallest document is smaller than the block's own, with that document."""
    blocks = group.column("block").to_pylist()
    got = [unpack(x.as_py()) for x in group.column("entries")]
    h, g, d = (np.concatenate(x) for x in zip(*got, strict=True))
    src = np.repeat(np.arange(len(got)), [len(x[0]) for x in got])
    order = np.lexsort((d, g, h))
    h, g, d, src = h[order], g[order], d[order], src[order]
    first = _first_of_each(h, g)
    run = np.diff(np.concatenate([first, [len(h)]]))
    least = np.repeat(d[first], run)
    # a window is kept for its block if documents there may not be the first: its block's least is larger, or equal
    # and then later documents of the block count, which the block sees itself
    tell = least < d
    out_block, out = [], []
    for i, block in enumerate(blocks):
        m = tell & (src == i)
        if m.any():
            out_block.append(block)
            out.append(pack(h[m], g[m]))
    return pa.table({"block": pa.array(out_block, pa.int32()), "elsewhere": pa.array(out, pa.binary())})


def _removed(window: int, part: int, with_text: bool):
    def run(key: tuple[pa.Scalar, ...], candidates: pa.Table, answers: pa.Table) -> pa.Table:
        told = [unpack(x.as_py()) for x in answers.column("elsewhere")]
        th, tg = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        order = np.lexsort((tg, th))
        told_h = th[order] ^ (tg[order].astype(np.uint64) << np.uint64(13))
        told_h.sort()
        table, done = [], set()
        batches = list(sliced(iter(candidates.combine_chunks().to_batches())))
        found = []
        for b in batches:
            words, _, start, h, g, row = _candidate_windows(b, window, part)
            docs = b.column("doc_id").to_numpy(zero_copy_only=False)
            found.append((start, h[start] ^ (g[start].astype(np.uint64) << np.uint64(13)), docs[row[start]] if len(start) else docs[:0]))
        # within the block: the least document of each window
        keys = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.uint64)
        owner = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
        order = np.lexsort((owner, keys))
        first = run_starts(keys[order])
        least = np.empty(len(keys), dtype=np.int64)
        least[order] = np.repeat(owner[order][first], np.diff(np.concatenate([first, [len(keys)]])))
        at = 0
        for b, (start, k, d) in zip(batches, found, strict=True):
            n = len(start)
            bad = least[at : at + n] < d
            if len(told_h) and n:
                bad |= told_h[np.minimum(np.searchsorted(told_h, k), len(told_h) - 1)] == k
            at += n
            words = Words(Texts(b.column("text")))
            mark = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(mark, start[bad], 1)
            np.add.at(mark, start[bad] + window, -1)
            keep = np.cumsum(mark)[:-1] == 0
            gone = np.add.reduceat(np.concatenate([~keep, [False]]).astype(np.int64), np.minimum(words.first[:-1], len(words))) * (words.count > 0)
            for i in np.flatnonzero(gone).tolist():
                same = (b.column("doc_id")[i].as_py(), b.column("text_hash")[i].as_py())
                if same in done:
                    continue
                done.add(same)
                kept = words.joined(i, keep)
                table.append((*same, int(gone[i]), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        cols = list(zip(*table, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "text_hash", "n_removed", "kept_sha256", "kept_text"), cols, kinds, strict=True)})

    return run


def _repeated(parts_of_docs: DataFrame) -> DataFrame:
    """h: hashes that several documents have.  A table of its own, so a join with it shuffles both sides and a hot hash can be split."""
    several = parts_of_docs.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    return materialize(several.select("h"), "repeated")


def removals(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scan of all documents, the documents that lose words: doc_id, n_removed, kept_sha256, kept_text)."""
    spark = docs.sparkSession
    small_batches(spark)
    levels = lengths(window)
    levels = levels if len(levels) > 1 else [window, window]
    part = levels[0]
    scan = materialize(_scan(docs, window, part), "parts")
    alive = scan.where("doc_id is not null").select("doc_id", F.explode("parts").alias("h"))
    repeated = _repeated(alive)
    for longer in levels[1:-1]:
        if not repeated.take(1):
            break  # no candidate survives
        alive = materialize(_extended(docs, window, part, longer, IdFilter(repeated)), "parts")
        repeated, part = _repeated(alive), longer
    marks = materialize(alive.join(repeated, "h").groupBy("doc_id").agg(F.collect_set("h").alias("repeated")), "marks")
    rows = maybe_in(docs.select("doc_id", "text"), marks.select("doc_id")).join(marks, "doc_id")
    candidates = materialize(rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), "repeated"), "candidates")
    size = candidates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(parts(spark), size // BLOCK_BYTES)
    candidates = candidates.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    answers = _in_blocks(candidates, window, part, blocks).groupBy("bucket").applyInArrow(_smaller_elsewhere, "block int, elsewhere binary")
    told = "doc_id long, text_hash long, n_removed long, kept_sha256 string, kept_text string"
    return scan, candidates.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_removed(window, part, with_text), told)


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    scan, out = removals(docs, window)
    rows = scan.select("doc_id", "text_hash", "n_words", "sha").join(out.select("doc_id", "text_hash", "n_removed", "kept_sha256"), ["doc_id", "text_hash"], "left")
    return rows.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def strip(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages cut out of their texts (kept words joined by one space); other texts stay as they are.

    Only documents that may lose words are shuffled.
    """
    out = materialize(removals(docs, window, with_text=True)[1].select("doc_id", "text_hash", "kept_text"), "kept")
    maybe = IdFilter(out.select("doc_id"))
    rows = maybe.keep(docs).select(F.struct("*").alias("_row"))
    keys = out.select(F.col("doc_id").alias("_kept_doc"), F.col("text_hash").alias("_kept_hash"), F.col("kept_text").alias("_kept_text"))
    rows = rows.join(keys, (F.col("_row.doc_id") == F.col("_kept_doc")) & (F.xxhash64("_row.text") == F.col("_kept_hash")), "left")
    text = F.coalesce("_kept_text", "_row.text").alias("text")
    return rows.select(*[text if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]).union(maybe.drop(docs))
