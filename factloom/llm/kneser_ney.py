"""Interpolated modified Kneser-Ney language model, counted in Spark.

Words are 63-bit hashes; a context is the hash of the words before.  Counting is one
exchange for each order, of packed arrays: each task sorts and sums its own n-grams, and a
bucket is all n-grams of some contexts, so totals of a context need no further exchange.
Heavy contexts (at least a share ``HEAVY`` of all tokens follow them, so they are at most
1 / HEAVY for each order, counted beforehand) are dealt by context and word instead, and
their totals, a row for each bucket, are summed in a second exchange.  The number of buckets
follows the text's bytes.  The lower orders count distinct left neighbours (continuation
counts), which buckets of the order above give as partial sums.

The model is a folder of sorted hash arrays, one file for each order and bucket, in the
shared folder.  Scoring tasks memory-map them and look up sorted queries, so a model may
be larger than memory.  Discounts come from the counts of counts of each order (a few
numbers, the only thing that reaches the driver).

Defined results: a null or empty text is the end token alone; words unknown in training
share the unigram's uniform part; with an empty training set all scores are those of a
uniform distribution over the one unknown word (0); repeated rows count and are scored each, rows
without a doc_id too; a text of any length is worked on whole; other columns are not looked
at.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, new_path, parts
from .textcore import Texts, Words, joined_hash, mix, pack, release, run_starts, sliced, unpack

ORDER = 2
#: Share of the tokens from which a context is heavy; text bytes for each bucket.
HEAVY, BUCKET_BYTES = 0.001, 8 << 20
_U = np.uint64
END, BEGIN = _U(1), _U(2)
LOG10 = float(np.log(10))


def token_ids(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens, each row's words and then the end token, and the offset of each row."""
    words = Words(texts)
    ids = words.hashes(lower=True) | _U(4)
    at = words.first + np.arange(texts.n + 1)
    out = np.full(len(ids) + texts.n, END, dtype=_U)
    out[np.arange(len(ids)) + words.row] = ids
    return out, at


def contexts(ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hash of the length tokens before each token; before a row's first stand begin tokens."""
    n = len(ids)
    place = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    h = np.zeros(n, dtype=_U)
    for back in range(length, 0, -1):
        word = np.full(n, BEGIN, dtype=_U)
        has = place >= back
        word[has] = ids[np.flatnonzero(has) - back]
        h = joined_hash(h, word)
    return h


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _sum_equal(cols: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows equal in all cols put together, sorted by the first col, then the next."""
    order = np.lexsort(tuple(reversed(cols)))
    cols, counts = [c[order] for c in cols], counts[order]
    if not len(counts):
        return cols, counts
    new = np.zeros(len(counts), dtype=bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return [c[first] for c in cols], np.add.reduceat(counts, first)


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint8 if not len(counts) or counts.max() < 256 else np.uint32 if counts.max() < 1 << 32 else np.uint64)


def _halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h & _U(0xFFFFFFFF), h >> _U(32)


def _whole(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return lo.astype(_U) | hi.astype(_U) << _U(32)


def _dealt_by(ctx: np.ndarray, word: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """What decides an n-gram's bucket: its context, or where that is heavy, context and word."""
    return np.where(_find(heavy, ctx)[1], joined_hash(ctx, word), ctx)


def _emit(cols: list[np.ndarray], extra: list[np.ndarray], buckets: int, heavy: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed run of it) of rows sorted by their first column, which is a context or, for unigrams, a mixed word."""
    bucket = _bucket(_dealt_by(cols[0], cols[-1], heavy), buckets)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(at)).tolist():
        s = order[at[k] : at[k + 1]]
        ctx = cols[0][s]
        first = run_starts(ctx)
        run = np.diff(np.concatenate([first, [len(ctx)]]))
        planes = [p.astype(np.uint32) for c in cols[1:] for p in _halves(c[s])]
        yield k, pack(ctx[first], _small(run), *planes, *(_small(e[s]) for e in extra))


def _absorb(blobs: list[bytes], words: int, extras: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    got: list[list[np.ndarray]] = []
    for blob in blobs:
        a = unpack(blob)
        got.append([np.repeat(a[0], a[1].astype(np.int64)), *(_whole(a[2 + 2 * k], a[3 + 2 * k]) for k in range(words)), *(x.astype(_U) for x in a[2 + 2 * words :])])
    cols = [np.concatenate(x) for x in zip(*got, strict=True)]
    return cols[: 1 + words], cols[1 + words :]


def open_shared(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_shard(folder: str, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Arrays end to end in one file of the shared folder, under a name no other attempt of the task uses."""
    store, base = open_shared(folder)
    store.create_dir(base, recursive=True)
    name = f"{name}-{uuid.uuid4().hex[:12]}"
    at, head = 0, []
    with store.open_output_stream(f"{base}/{name}") as f:
        for key, a in arrays.items():
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(bytes(-a.nbytes % 8))
            head.append(f"{key},{a.dtype.str},{len(a)},{at}")
            at += a.nbytes + -a.nbytes % 8
    return name + "|" + ";".join(head)


#: Shards a worker keeps mapped, and bytes of copies of those that are not on a mounted file system.
MAPPED, COPIED_BYTES = 4096, 1 << 30
_copies: dict[str, tuple[int, dict[str, np.ndarray]]] = {}


def map_shard(folder: str, entry: str) -> dict[str, np.ndarray]:
    """The arrays of a shard, memory-mapped.

    Where the shared folder is no mounted file system, the file is copied beside the worker, mapped and at once unlinked, so
    that nothing stays behind; of such copies the latest are kept, up to COPIED_BYTES.
    """
    store, base = open_shared(folder)
    if isinstance(store, pafs.LocalFileSystem):
        return _mapped(base, entry)
    if entry not in _copies:
        import tempfile

        with tempfile.NamedTemporaryFile() as g:
            with store.open_input_stream(f"{base}/{entry.partition('|')[0]}") as f:
                while block := f.read(8 << 20):
                    g.write(block)
            g.flush()
            _copies[entry] = g.tell(), _arrays(g.name, entry)
        while len(_copies) > 1 and sum(n for n, _ in _copies.values()) > COPIED_BYTES:
            del _copies[next(iter(_copies))]
    return _copies[entry][1]


@functools.lru_cache(maxsize=MAPPED)
def _mapped(base: str, entry: str) -> dict[str, np.ndarray]:
    return _arrays(f"{base}/{entry.partition('|')[0]}", entry)


def _arrays(path: str, entry: str) -> dict[str, np.ndarray]:
    out = {}
    for part in entry.partition("|")[2].split(";"):
        key, kind, n, at = part.split(",")
        out[key] = np.memmap(path, dtype=np.dtype(kind), mode="r", offset=int(at), shape=(int(n),)) if int(n) else np.zeros(0, np.dtype(kind))
    return out


@dataclass
class Model:
    """A trained model: order, buckets, the folder of its shards, and what the driver knows of each order.

    files[k][b] is the shard of order k and bucket b; discounts[k] the three discounts of order k; total the
    continuation count of the unigram; tokens and vocabulary those of the training tokens; heavy[k] the heavy contexts
    of order k, sorted, with their totals.
    """

    folder: str
    order: int
    buckets: int
    files: dict[int, dict[int, str]]
    discounts: dict[int, tuple[float, float, float]]
    total: int
    gamma: float
    tokens: int
    vocabulary: int
    heavy: dict[int, dict[str, np.ndarray]]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2, D3+ from the numbers of n-grams seen once to four times; where they don't exist, 0.5, 1, 1.5."""
    if min(n[:3]) == 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return tuple(min(max(x, 0.05), k) for k, x in zip((1, 2, 3), d, strict=True))


def heavy_contexts(docs: DataFrame, order: int, share: float = HEAVY) -> tuple[dict[int, np.ndarray], int]:
    """Contexts that at least a share of all tokens follow, at most 1 / share of each length, by order; and the text's bytes.

    Which contexts are found only decides how n-grams are dealt out, never a count: a task holds at most 8 / share of each
    length at a time, and sends those with at least half the share of its own tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {k: (np.zeros(0, _U), np.zeros(0, _U)) for k in range(2, order + 1)}
        tokens = size = 0
        for b in sliced(batches):
            texts = Texts(b.column("text"))
            ids, at = token_ids(texts)
            tokens, size = tokens + len(ids), size + len(texts.buf)
            for k in seen:
                ctx, n = np.unique(contexts(ids, at, k - 1), return_counts=True)
                (held,), count = _sum_equal([np.concatenate([seen[k][0], ctx])], np.concatenate([seen[k][1], n.astype(_U)]))
                seen[k] = held, count
            for k, (ctx, n) in seen.items():
                if len(ctx) > 8 / share:
                    keep = n >= _U(max(1, int(tokens * share / 8)))
                    seen[k] = ctx[keep], n[keep]
        rows = [(k, int(c), int(n)) for k, (ctx, count) in seen.items() for c, n in zip(ctx.view(np.int64), count, strict=True) if n >= tokens * share / 2]
        rows.append((0, size, tokens))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["k", "ctx", "n"])

    told = docs.select("text").mapInArrow(run, "k int, ctx long, n long")
    told = told.groupBy("k", F.when(F.col("k") > 0, F.col("ctx")).alias("ctx")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("k") == 0, F.col("ctx"))).alias("size"))
    told = materialize(told, "heavy")
    all_ = told.where("k = 0").first()
    if all_ is None:
        return {k: np.zeros(0, _U) for k in range(2, order + 1)}, 0
    rows = told.where((F.col("k") > 0) & (F.col("n") >= all_["n"] * share * 0.75)).collect()  # at most 4 / (3 share) for each k
    return {k: np.sort(np.array([r["ctx"] for r in rows if r["k"] == k], dtype=np.int64).view(_U)) for k in range(2, order + 1)}, all_["size"] or 0


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Counts all of docs."""
    spark = docs.sparkSession
    heavy, size = heavy_contexts(docs, order)
    buckets, folder = max(parts(spark), size // BUCKET_BYTES), new_path(spark, "lm")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            cols, n = _sum_equal([np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held]))
            rows = list(_emit(cols, [n], buckets, heavy[order] if order > 1 else _NONE))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], names=["bucket", "entries"])

        for b in sliced(batches):
            ids, at = token_ids(Texts(b.column("text")))
            cols = [contexts(ids, at, order - 1)]
            cols += [x for length in range(order - 2, 0, -1) for x in _halves(contexts(ids, at, length))]
            held.append(_sum_equal([*cols, ids], np.ones(len(ids), dtype=_U)))
            if sum(len(h[1]) for h in held) > 1_500_000:
                held[:] = [_sum_equal([np.concatenate(x) for x in zip(*(h[0] for h in held), strict=True)], np.concatenate([h[1] for h in held]))]
                if len(held[0][1]) > 3_000_000:
                    yield flush()
        if held:
            yield flush()
        release()

    raw = docs.select("text").mapInArrow(count, "bucket int, entries binary")
    files: dict[int, dict[int, str]] = {}
    seen: dict[int, list[int]] = {}
    totals: dict[str, int] = {}
    heavy_totals: dict[int, dict[str, np.ndarray]] = {}
    for k in range(order, 0, -1):
        step = _reduce(k, order, buckets, folder, heavy.get(k, _NONE), heavy.get(k - 1, _NONE))
        reduced = materialize(raw.groupBy("bucket").applyInArrow(step, "kind string, bucket int, entries binary, file string, stats array<long>"), f"lm{k}")
        s = F.col("stats")
        parts_ = reduced.where("kind = 'heavy'").groupBy(s[0].alias("ctx")).agg(*[F.sum(s[i + 1]).alias(f) for i, f in enumerate(_TOTALS)]).collect()  # the heavy contexts
        known = {r["ctx"]: r for r in parts_}
        mine = [c for c in heavy.get(k, _NONE).view(np.int64).tolist() if c in known]
        heavy_totals[k] = {"context": np.array(mine, dtype=np.int64).view(_U), **{f: np.array([known[c][f] for c in mine], dtype=np.float64) for f in _TOTALS}}
        files[k], seen[k] = {}, [0] * 4
        for r in reduced.where("kind = 'file'").select("bucket", "file", "stats").collect():  # one row for each bucket
            files[k][r["bucket"]] = r["file"]
            seen[k] = [x + y for x, y in zip(seen[k], r["stats"][:4], strict=True)]
            for name, x in zip(("types", "total", "tokens", "n1", "n2", "n3"), r["stats"][4:], strict=True):
                totals[name] = totals.get(name, 0) + x if k == 1 else 0
        raw = reduced.where("kind = 'lower'").select("bucket", "entries")
    d = {k: discounts(n) for k, n in seen.items()}
    total = totals.get("total", 0)
    gamma = sum(x * totals.get(n, 0) for x, n in zip(d[1], ("n1", "n2", "n3"), strict=True)) / total if total else 1.0
    return Model(folder, order, buckets, files, d, total, gamma, totals.get("tokens", 0), totals.get("types", 0), heavy_totals)


_NONE = np.zeros(0, dtype=_U)
#: Of a context: its tokens (continuation counts below the top), and how many words follow it once, twice, more often.
_TOTALS = ("sum", "n1", "n2", "n3")


def _reduce(k: int, order: int, buckets: int, folder: str, heavy: np.ndarray, heavy_below: np.ndarray):
    """Of one bucket of order k: its file, and its partial counts for order k - 1.

    Entries have the context, for order k > 2 the shorter contexts (in halves), and the word; the unigram's context
    is its mixed word;
    the top order carries counts, lower ones (continuation count, tokens) with tokens kept to the unigram.
    """

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        words = 2 * (max(k, 2) - 2) + 1
        cols, extras = _absorb([x.as_py() for x in group.column("entries")], words, 1)
        if k == order:
            cols, n = _sum_equal(cols, extras[0])
            tokens = n
        else:
            _, tokens = _sum_equal(cols, extras[1])
            cols, n = _sum_equal(cols, extras[0])
        ctx, word = cols[0], cols[-1]
        stats = [int((n == j).sum()) for j in (1, 2, 3, 4)]
        rows: list[tuple] = []
        shared: list[list[int]] = []
        if k == 1:
            arrays = {"key": word, "count": n.astype(np.uint32), "tokens": tokens.astype(np.uint64)}
            order_ = np.argsort(word)
            arrays = {a: v[order_] for a, v in arrays.items()}
            stats += [len(word), int(n.sum()), int(tokens.sum()), *(int((n == j).sum()) for j in (1, 2)), int((n >= 3).sum())]
        else:
            h = joined_hash(ctx, word)
            o = np.argsort(h)
            big = n[o] >= 255
            first = run_starts(ctx)
            by_context = {"context": ctx[first], "sum": np.add.reduceat(n, first)} | {f"n{j}": np.add.reduceat((n == j if j < 3 else n >= 3).astype(np.uint32), first) for j in (1, 2, 3)}
            parted = _find(heavy, by_context["context"])[1]
            shared = [[int(by_context["context"][i].view(np.int64)), *(int(by_context[f][i]) for f in _TOTALS)] for i in np.flatnonzero(parted)]
            arrays = {
                "key": h[o], "count": np.minimum(n[o], 255).astype(np.uint8), "big": h[o][big], "big_count": n[o][big], **{f: v[~parted] for f, v in by_context.items()},
            }
            stats += [0] * 6
            # distinct left neighbours of (shorter context, word), and the tokens behind them
            lower = [mix(word), word] if k == 2 else [_whole(*cols[1:3]), *cols[3:]]
            both, left = _sum_equal(lower, np.ones(len(word), dtype=_U))
            _, behind = _sum_equal(lower, tokens)
            rows = list(_emit(both, [left, behind], buckets, heavy_below))
        entry = write_shard(folder, f"{k}-{bucket}", arrays)
        more, told = [None] * len(rows), [None] * len(shared)
        return pa.table({
            "kind": pa.array(["file"] + ["lower"] * len(rows) + ["heavy"] * len(shared)), "bucket": pa.array([bucket] + [b for b, _ in rows] + told, pa.int32()),
            "entries": pa.array([None] + [e for _, e in rows] + told, pa.binary()), "file": pa.array([entry] + more + told, pa.string()), "stats": pa.array([stats] + more + shared, pa.list_(pa.int64())),
        })

    return run


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, whether found) of wanted (sorted) in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return i, sorted_[i] == wanted


def _lookup(model: Model, k: int, by: np.ndarray, keys: np.ndarray, fields: dict[str, tuple[str, str]]) -> dict[str, np.ndarray]:
    """Values of keys in the shards of order k; by decides the bucket.  fields: name -> (array of keys, array of values)."""
    out = {f: np.zeros(len(keys), dtype=np.float64) for f in fields}
    order = np.lexsort((keys, _bucket(by, model.buckets)))
    by, keys = by[order], keys[order]
    at = np.searchsorted(_bucket(by, model.buckets), np.arange(model.buckets + 1))
    for b, entry in model.files[k].items():
        if at[b] == at[b + 1]:
            continue
        shard, mine = map_shard(model.folder, entry), keys[at[b] : at[b + 1]]
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for f, (where, what) in fields.items():
            if where not in found:
                found[where] = _find(shard[where], mine)
            i, ok = found[where]
            value = np.zeros(len(mine))
            value[ok] = shard[what][i[ok]]
            out[f][order[at[b] : at[b + 1]]] = value
    return out


def _less(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    cut = np.where(count >= 3, d[2], np.where(count == 2, d[1], np.where(count == 1, d[0], 0.0)))
    return np.maximum(count - cut, 0.0)


def log_probabilities(model: Model, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token, and its raw training count."""
    unique, inverse = np.unique(ids, return_inverse=True)
    uni = _lookup(model, 1, mix(unique), unique, {"cont": ("key", "count"), "raw": ("key", "tokens")})
    low = (_less(uni["cont"], model.discounts[1]) / model.total if model.total else 0.0) + model.gamma / (model.vocabulary + 1)
    p, raw = np.broadcast_to(low, unique.shape)[inverse], uni["raw"][inverse]
    for k in range(2, model.order + 1):
        ctx = contexts(ids, at, k - 1)
        uctx, back = np.unique(ctx, return_inverse=True)
        c = _lookup(model, k, uctx, uctx, {f: ("context", f) for f in _TOTALS})
        place, is_heavy = _find(model.heavy[k]["context"], uctx)
        for f in _TOTALS:
            c[f][is_heavy] = model.heavy[k][f][place[is_heavy]]
        h = joined_hash(ctx, ids)
        _, first, hback = np.unique(h, return_index=True, return_inverse=True)
        g = _lookup(model, k, _dealt_by(ctx[first], ids[first], model.heavy[k]["context"]), h[first], {"count": ("key", "count"), "big": ("big", "big_count")})
        count = np.maximum(g["count"], g["big"])[hback]
        total = c["sum"][back]
        d = model.discounts[k]
        gamma = (d[0] * c["n1"] + d[1] * c["n2"] + d[2] * c["n3"])[back]
        known = total > 0
        p = p.copy()
        p[known] = (_less(count[known], d) + gamma[known] * p[known]) / total[known]
    return np.log(p) / LOG10, raw


def score(model: Model, docs: DataFrame) -> DataFrame:
    """doc_id, held_out (passed through), n_tokens, n_known, train_tokens, base_score, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        denominator = np.log10(model.tokens + model.vocabulary + 1)
        for b in sliced(batches):
            ids, at = token_ids(Texts(b.column("text")))
            p, raw = log_probabilities(model, ids, at)
            base = np.log10(raw + 1) - denominator
            add = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  every row has its end token
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(np.diff(at)), pa.array(add((raw > 0).astype(np.int64))), pa.array(np.full(len(at) - 1, model.tokens, np.int64)), pa.array(add(base)), pa.array(add(p))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """scored with the perplexity of each text."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
