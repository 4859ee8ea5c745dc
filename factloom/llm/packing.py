"""Best-fit packing of tokenised documents into fixed-length sequences (best-two-fit).

Only lengths decide a packing, and there are at most ``capacity`` different ones, so the
plan is made from the histogram of lengths: a list of (pattern of lengths, how many
sequences follow it).  It is as small for a trillion pieces as for a thousand.  Pieces are
then numbered within their length (block-wise counts, no global sort) and look their place
up in the plan.

Defined results: a null or empty text is one piece that holds the end id alone; equal
documents are packed as often as they occur; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize, small_batches
from .textcore import Texts, Words, mix, release, sliced, span_hashes

CAPACITY = 1024
END_ID = 2

#: White space other than ASCII's: where a text has any, it is encoded in one piece.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]|<\|")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, nth long"


class UnitEncoder:
    """Ids of whole texts, encoding each different unit (a white-space run and the word after it) of a chunk once.

    The byte-level pre-tokenizer never joins a word with what follows it, and looks ahead only
    from white space, so units encode independently.  Units of plain ASCII and Latin-1 letters go
    through tiktoken with the same vocabulary, which is about four times as fast; all others, and
    texts with other white space or special strings, through tokenizers itself.
    """

    def __init__(self, tokenizer_file: str, ranks_file: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer_file)
        self.fast = None
        self._clear()
        if ranks_file:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            self.token_bytes[list(ranks.values())] = [len(k) for k in ranks]

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def units(self, units: list[bytes], variants: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids, and how many each unit has; units have one variant here.  Units that begin with white space and end with a word are
        encoded end to end, as no token crosses such a boundary, and told apart by the bytes of their tokens."""
        joint, alone = [], []
        for i, u in enumerate(units):
            (joint if self.fast is not None and u[0] in _SPACES and u[-1] not in _SPACES and (u.isascii() or _LATIN.fullmatch(u)) else alone).append(i)
        sizes = np.zeros(len(units), dtype=np.int64)
        found = [x.ids for x in self.slow.encode_batch([units[i].decode() for i in alone], add_special_tokens=False)]
        sizes[alone] = [len(x) for x in found]
        mine = np.zeros(0, dtype=np.uint32)
        if joint:
            mine = self.fast.encode_to_numpy(b"".join([units[i] for i in joint]).decode(), disallowed_special=()).astype(np.uint32)
            ends = np.searchsorted(np.cumsum(self.token_bytes[mine]), np.cumsum([len(units[i]) for i in joint])) + 1
            sizes[joint] = np.diff(np.concatenate([[0], ends]))
        at = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), dtype=np.uint32)
        if joint:
            n = sizes[joint]
            ids[np.repeat(at[joint] - (np.cumsum(n) - n), n) + np.arange(len(mine))] = mine
        for i, x in zip(alone, found, strict=True):
            ids[at[i] : at[i] + len(x)] = x
        return ids, sizes

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and size in the pool of each unit's ids; row and place say where it stands, which doesn't matter here."""
        return self._look_up(buf, starts, ends, np.zeros(len(row), dtype=np.uint64))

    def encode(self, texts: Texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each followed by end_id, and the offset of each row."""
        if self.used > self.POOL:
            self._clear()
        words = Words(texts)
        n = texts.n
        last_end = np.where(words.count > 0, words.ends[np.maximum(words.first[1:] - 1, 0)] if len(words) else 0, texts.offsets[:-1])
        trail = last_end < texts.offsets[1:]
        per_row = words.count + trail
        unit_at = np.concatenate([[0], np.cumsum(per_row)])
        ends = np.empty(unit_at[-1], dtype=np.int64)
        ends[unit_at[words.row] + np.arange(len(words)) - words.first[words.row]] = words.ends
        ends[unit_at[1:][trail] - 1] = texts.offsets[1:][trail]
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        row = np.repeat(np.arange(n), per_row)
        from_, size = self.find(texts.buf, starts, ends, row, np.arange(len(row)) - unit_at[row])
        # each row's units, then the end id, which is the pool's first entry
        where = np.arange(unit_at[-1]) + row
        pool_at, pool_len = np.zeros(unit_at[-1] + n, dtype=np.int64), np.ones(unit_at[-1] + n, dtype=np.int64)
        pool_at[where], pool_len[where] = from_, size
        self.pool[0] = end_id
        at = np.cumsum(pool_len) - pool_len
        gather = np.repeat(pool_at - at, pool_len)
        gather += np.arange(len(gather))
        total = np.concatenate([at, [len(gather)]])
        return self.pool[gather], total[np.concatenate([[0], np.cumsum(per_row + 1)])]

    def _clear(self) -> None:
        self.key = np.zeros(1 << self.BITS, dtype=np.uint64)
        self.value = np.zeros(1 << self.BITS, dtype=np.int64)
        self.pool, self.used = np.zeros(1 << 20, dtype=np.uint32), 1

    def _look_up(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, variant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and size in the pool of each unit's ids.  A direct-mapped table of fixed size remembers units; what
        it doesn't hold is encoded and takes its slot."""
        h = mix(span_hashes(buf, starts, ends) + variant)
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        value = self.value[slot]
        miss = np.flatnonzero((self.key[slot] != h) | (value == 0))
        if len(miss):
            _, example, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            new = miss[example]
            raw = buf.tobytes()
            ids, sizes = self.units([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], variant[new].tolist())
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), 2 * len(ids)), dtype=np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            got = (self.used + np.cumsum(sizes) - sizes << 24) + sizes
            self.used += len(ids)
            self.key[slot[new]], self.value[slot[new]] = h[new], got
            value[miss] = got[inverse]
        return value >> 24, value & ((1 << 24) - 1)

    #: Slots of the table (2 ** BITS), and ids kept before all is forgotten: about 100 MB together.
    BITS, POOL = 21, 16 << 20


_SPACES = frozenset(b" \t\n\x0b\x0c\r")
_LATIN = re.compile(rb"(?:[\x00-\x7f]|\xc3[\x80-\xbf])+")


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all are full but, where it doesn't divide, the first."""
    if n_ids <= capacity:
        return [(0, n_ids)]
    first = n_ids % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def pieces(docs: DataFrame, tokenizer_file: str, ranks_file: str | None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document, numbered within its block and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(tokenizer_file, ranks_file)
        block = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in sliced(batches):
            texts = Texts(batch.column("text"))
            buf = texts.buf.tobytes()
            if _WIDE_SPACE.search(buf):
                rows = [np.append(encoder.whole(texts.raw(i).decode()), np.uint32(end_id)) for i in range(texts.n)]
                ids = np.concatenate(rows).astype(np.uint32)
                at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            else:
                ids, at = encoder.encode(texts, end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            out: list[tuple] = []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for piece, (start, length) in enumerate(cut(b - a, capacity)):
                    out.append((doc_id, piece, start, length, zlib.crc32(raw[4 * (a + start) : 4 * (a + start + length)]), block, seen[length]))
                    seen[length] += 1
            cols = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"])
        # vocabularies of a hundred megabytes are not left to a worker that goes on to other tasks
        del encoder
        gc.collect()
        release()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns and how many sequences follow each.

    A bin is filled greedily, each time with the largest piece that fits.  Then its smallest
    piece goes if two unpacked ones fit the expanded gap more tightly than it did.  The
    choice depends only on which lengths are left, so as many bins as the counts allow are
    made of one pattern at once.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    plan: list[tuple[list[int], int]] = []
    largest = capacity
    while True:
        while largest and not left[largest]:
            largest -= 1
        if not largest:
            return plan
        free = left.copy()
        bin_, gap = [], capacity

        def fill() -> None:
            nonlocal gap
            while gap:
                fits = np.flatnonzero(free[1 : gap + 1])
                if not len(fits):
                    return
                take = int(fits[-1]) + 1
                bin_.append(take)
                free[take] -= 1
                gap -= take

        fill()
        if gap and len(bin_) > 1:
            smallest = min(bin_)
            pair = tightest_pair(free, gap + smallest, smallest)
            if pair:
                bin_.remove(smallest)
                free[smallest] += 1
                gap += smallest
                for x in pair:
                    bin_.append(x)
                    free[x] -= 1
                    gap -= x
                fill()
        lengths, uses = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= uses * times
        plan.append((sorted(bin_, reverse=True), times))


def tightest_pair(free: np.ndarray, gap: int, more_than: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (more_than, gap]; of ties the more even pair."""
    have = np.flatnonzero(free[: gap + 1] > 0)
    best, found = more_than, None
    i, j = 0, len(have) - 1
    while i <= j:
        x, y = int(have[i]), int(have[j])
        if x + y > gap or (i == j and free[x] < 2):
            j -= 1
            continue
        if x + y >= best and x + y > more_than:
            best, found = x + y, (x, y)
        i += 1
    return found


def _slots(plan: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For each length and run of ranks within it: the first sequence and the offset there."""
    used = [0] * (capacity + 1)
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return (table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def pack(docs: DataFrame, tokenizer_file: str, ranks_file: str | None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence_id and offset there.

    Cost: one pass over the texts, then shuffles of 60-byte rows.  To the driver come at most
    ``capacity`` histogram rows.
    """
    small_batches(docs.sparkSession)
    table = materialize(pieces(docs, tokenizer_file, ranks_file, capacity, end_id), "pieces")
    counts = table.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, rank_from, sequence, offset = _slots(best_two_fit(histogram, capacity), capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence[k] + rank - rank_from[k]), pa.array(offset[k])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = table.join(bases, ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
