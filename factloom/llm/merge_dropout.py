"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text's merges never cross from a word to the white space after it, so each unit (white
space and the word it leads to) runs its own agenda: of all adjacent pairs that make a
piece, the one with the best score (ties: the leftmost) comes first; step k of the agenda
skips it where a keyed hash of (seed, doc_id, the unit's place in the text, k) falls below
the dropout rate, and then it comes again only with another neighbour.  Every occurrence of
a unit has draws of its own.  What the agenda gives depends on the unit and on which steps
skip alone, so a worker remembers results by (unit, steps skipped), within a fixed size, and
works an agenda out only where it has not seen that combination.  Agendas of units of up to
WIDE characters are worked out many at a time: step k of all of them is one round over arrays.

Blanks become U+2581 and a text begins with one more, as in the model; a U+2581 of the text
itself and characters without a piece become byte pieces.  So decoding gives the very text.

Defined results: a null or empty text is the end id alone; with rate 0 the ids are the
model's own; repeated rows with equal doc_id get equal ids; a null doc_id counts as -1 in the
draws; a unit of any length is worked on whole, in time proportional to its length times the
logarithm of it; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import gc
import heapq
import hashlib
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packing import UnitEncoder
from .textcore import Texts, mix, sliced

RATE, SEED = 0.1, 17
END_ID = 2
_BLANK = "▁"
#: Units of up to this many bytes have at most 60 steps: each of up to 20 pairs, and two more for each merge.
SHORT = 20
#: Characters of a unit whose agenda is worked out beside others', and how many of them at a time.
WIDE, ABREAST = 64, 4096
_FIRST = np.uint64(1 << 63)
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def draw_keys(seed: int, doc_ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The key of each unit's draws."""
    return mix(mix(doc_ids.view(np.uint64) + np.uint64(seed * _STEP & _MASK)) + place.astype(np.uint64))


def _draw(key: int, step: int) -> int:
    """16 bits for a step of a unit's agenda: four steps share a splitmix64 of the key and their number."""
    x = key + (step >> 2) * _STEP & _MASK
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return (x ^ x >> 31) >> 16 * (step & 3) & 0xFFFF


_BASE = np.uint64(0x9FB21C651E98DF25)
_NO_PAIR = np.int32(2**31 - 1)


class Pieces:
    """A model's pieces by the hashes of their characters: a table of open addresses, looked up for many spans at once."""

    BITS = 18

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.power = np.ones(WIDE + 2, dtype=np.uint64)
        self.power[1:] = np.cumprod(np.full(WIDE + 1, _BASE))
        rank = np.unique([cost for _, cost in pieces.values()], return_inverse=True)[1]
        # longer pieces are never found among spans of up to WIDE characters and a blank
        found = [(int(self.prefixes(np.array([[ord(x) for x in p]], dtype=np.uint32))[0, -1]), i, r) for (p, (i, _)), r in zip(pieces.items(), rank.tolist(), strict=True) if len(p) <= WIDE + 1]
        if len({h for h, _, _ in found}) < len(found):
            raise ValueError("two pieces of the model have one hash")
        self.hash, self.id, self.rank = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32), np.zeros(1 << self.BITS, np.int32)
        if 2 * len(found) > len(self.id):
            raise ValueError("the model has too many pieces")
        for h, i, r in found:
            at = int(self._slot(np.array([h], np.uint64))[0])
            while self.id[at] >= 0:
                at = at + 1 & len(self.id) - 1
            self.hash[at], self.id[at], self.rank[at] = h, i, r

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(_STEP) >> np.uint64(64 - self.BITS)).astype(np.int64)

    @staticmethod
    def prefixes(chars: np.ndarray) -> np.ndarray:
        """Hashes of the first 0, 1, 2, ... characters of each row."""
        out = np.zeros((len(chars), chars.shape[1] + 1), dtype=np.uint64)
        for k in range(chars.shape[1]):
            out[:, k + 1] = out[:, k] * _BASE + (chars[:, k] + np.uint64(1))
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place in the table of each hash, -1 where no piece has it."""
        at = self._slot(h)
        out = np.where(self.hash[at] == h, at, -1)
        out[self.id[at] < 0] = -1
        left = np.flatnonzero((out < 0) & (self.id[at] >= 0))
        while len(left):
            at[left] = at[left] + 1 & len(self.id) - 1
            left = left[self.id[at[left]] >= 0]
            hit = self.hash[at[left]] == h[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
        return out

    def order(self, h: np.ndarray, a: np.ndarray) -> np.ndarray:
        """What a pair that begins at a is sorted by in its agenda: its score, then its place; _NO_PAIR if it makes no piece."""
        at = self.find(h)
        return np.where(at >= 0, self.rank[at] << 7 | a.astype(np.int32), _NO_PAIR)


class DropoutEncoder(UnitEncoder):
    """Encodes and decodes by one model, seed and rate."""

    def __init__(self, model_file: str, rate: float, seed: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.piece: dict[str, tuple[int, float]] = {}
        self.byte = [0] * 256
        table: list[bytes] = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                table.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                table.append(b"")
            else:
                self.piece[p] = (i, -sp.get_score(i))
                table.append(p.replace(_BLANK, " ").encode())
        self.table = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.size = np.array([len(x) for x in table])
        self.at = np.cumsum(self.size) - self.size
        self.pieces = Pieces(self.piece)
        self.bytes = np.array(self.byte, dtype=np.uint32)
        self.limit, self.seed = round(rate * 65536), seed
        self.doc_ids = np.zeros(0, dtype=np.int64)
        self._clear()

    def skips(self, key: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bit k: whether step k skips, for units of up to SHORT bytes; of a unit of n bytes 3 n steps at most count."""
        out = np.zeros(len(key), dtype=np.uint64)
        some = np.arange(len(key))
        for four in range(15):
            some = some[3 * size[some] > 4 * four]
            if not len(some) or not self.limit:
                break
            word = mix(key[some] + np.uint64(four * _STEP & _MASK))
            for k in range(4):
                skip = (word >> np.uint64(16 * k) & np.uint64(0xFFFF)) < self.limit
                out[some] |= skip.astype(np.uint64) << np.uint64(4 * four + k)
        return out

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, first = ends - starts, np.where(place == 0, _FIRST, np.uint64(0))
        key = draw_keys(self.seed, self.doc_ids[row], place)
        short = size <= SHORT
        skips = np.zeros(len(row), dtype=np.uint64)
        skips[short] = self.skips(key[short], size[short])
        # units of short length begin as if no step skipped; where one of the steps taken does, they are looked up again with it
        variant = np.where(short, first, key >> np.uint64(1) | first)
        at, n = np.empty(len(row), dtype=np.int64), np.empty(len(row), dtype=np.int64)
        todo = np.arange(len(row))
        known = np.zeros(len(row), dtype=np.uint64)  # steps decided so far
        while len(todo):
            at[todo], n[todo] = self._look_up(buf, starts[todo], ends[todo], variant[todo])
            todo = todo[short[todo]]
            taken = (np.uint64(1) << self.pool[at[todo]].astype(np.uint64)) - np.uint64(1)
            left = skips[todo] & taken & ~known[todo]
            todo, left = todo[left > 0], left[left > 0]
            lowest = left & (~left + np.uint64(1))
            variant[todo] |= lowest
            known[todo] = lowest | lowest - np.uint64(1)
        return at + 1, n - 1  # the pool has each unit's number of steps before its ids

    def units(self, units: list[bytes], variants: list[int]) -> tuple[np.ndarray, np.ndarray]:
        # very many small lists and no cycles: nothing for the collector to look for
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._units(units, variants)
        finally:
            if collects:
                gc.enable()

    def _units(self, units: list[bytes], variants: list[int]) -> tuple[np.ndarray, np.ndarray]:
        n_bytes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        variant = np.array(variants, dtype=np.uint64)
        first, rest = variant >= _FIRST, variant & (_FIRST - np.uint64(1))
        chars = np.frombuffer(b"".join(units).decode().encode("utf-32-le"), dtype=np.uint32)
        starts = (np.frombuffer(b"".join(units), dtype=np.uint8) & 0xC0) != 0x80
        upto = np.concatenate([[0], np.cumsum(starts)])[np.concatenate([[0], np.cumsum(n_bytes)])]
        n_chars = np.diff(upto)
        sizes, parts = np.zeros(len(units), dtype=np.int64), []
        order = np.argsort(n_chars, kind="stable")
        wide = int(np.searchsorted(n_chars[order], WIDE, side="right"))
        for i in range(0, wide, ABREAST):
            x = order[i : min(i + ABREAST, wide)]
            ids, sizes[x] = self.agendas(chars, upto[x], n_chars[x], first[x], rest[x], n_bytes[x] <= SHORT)
            parts.append((x, ids))
        for i in order[wide:].tolist():
            m = int(rest[i]) << 1
            ids, steps = self.agenda(units[i].decode(), bool(first[i]), lambda k, m=m: _draw(m, k) < self.limit)
            sizes[i] = len(ids) + 1
            parts.append((np.array([i]), np.array([steps & 0xFFFFFFFF, *ids], dtype=np.uint32)))
        at = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), dtype=np.uint32)
        for x, ids in parts:
            n = sizes[x]
            out[np.repeat(at[x] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, sizes

    def agendas(self, chars: np.ndarray, at: np.ndarray, size: np.ndarray, first: np.ndarray, rest: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of steps and the ids of each unit, end to end, and how many values it has: what agenda gives for each of them.

        Unit i is the size[i] characters from at[i] on; rest: bit k says whether step k skips if short, else the key of the draws.
        """
        n = size + first
        w = max(int(n.max()), 1)
        col = np.arange(w)
        from_ = at[:, None] + col - first[:, None]
        text = chars[np.clip(from_, 0, len(chars) - 1)]
        text = np.where(text == ord(_BLANK), np.uint32(ord(_ITSELF)), np.where(text == 32, np.uint32(ord(_BLANK)), text))
        text[first, 0] = ord(_BLANK)
        hashes, power = self.pieces.prefixes(text).ravel(), self.pieces.power
        # symbols are spans of text, linked; a span is named by where it begins; rows are laid end to end
        end, before = np.tile(col + 1, (len(n), 1)).ravel(), np.tile(col - 1, (len(n), 1)).ravel()
        agenda = np.full((len(n), w), _NO_PAIR)
        row, a = np.nonzero(col + 2 <= n[:, None])
        p = row * (w + 1) + a
        agenda[row, a] = self.pieces.order(hashes[p + 2] - hashes[p] * power[2], a)
        pair = agenda.ravel()
        steps, key = np.zeros(len(n), dtype=np.int64), np.where(short, rest, rest << np.uint64(1))
        rows, k = np.arange(len(n)), 0
        while True:
            now = agenda[rows]
            a = now.argmin(axis=1)
            some = now[np.arange(len(rows)), a] != _NO_PAIR
            rows, a = rows[some], a[some]
            if not len(rows):
                break
            steps[rows] = k + 1
            pair[rows * w + a] = _NO_PAIR
            bits = key[rows] >> np.uint64(k) if k < 63 else np.zeros(len(rows), dtype=np.uint64)
            skip = (bits & np.uint64(1)) > 0
            drawn = np.flatnonzero(~short[rows])
            if len(drawn):
                word = mix(key[rows[drawn]] + np.uint64((k >> 2) * _STEP & _MASK))
                skip[drawn] = (word >> np.uint64(16 * (k & 3)) & np.uint64(0xFFFF)) < self.limit
            k += 1
            r, a = rows[~skip], a[~skip]
            line, mark = r * w, r * (w + 1)
            b = end[line + a]
            c = end[line + b]
            end[line + a], end[line + b] = c, 0
            pair[line + b] = _NO_PAIR
            more = np.flatnonzero(c < n[r])
            ra, rc = a[more], c[more]
            before[line[more] + rc] = ra
            d = end[line[more] + rc]
            pair[line[more] + ra] = self.pieces.order(hashes[mark[more] + d] - hashes[mark[more] + ra] * power[d - ra], ra)
            p = before[line + a]
            more = np.flatnonzero(p >= 0)
            p, rc = p[more], c[more]
            pair[line[more] + p] = self.pieces.order(hashes[mark[more] + rc] - hashes[mark[more] + p] * power[rc - p], p)
        row, a = np.nonzero((end.reshape(-1, w) > 0) & (col < n[:, None]))
        c = end[row * w + a]
        found = self.pieces.find(hashes[row * (w + 1) + c] - hashes[row * (w + 1) + a] * power[c - a])
        # what is no piece is one character: its bytes
        char = text[row, a]
        char = np.where(char == ord(_ITSELF), np.uint32(ord(_BLANK)), char)
        spread = np.where(found >= 0, 1, 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000))
        sizes = 1 + np.bincount(row, weights=spread, minlength=len(n)).astype(np.int64)
        out = np.empty(int(sizes.sum()), dtype=np.uint32)
        out[np.cumsum(sizes) - sizes] = steps
        to = np.cumsum(spread) - spread + row + 1
        hit = found >= 0
        out[to[hit]] = self.pieces.id[found[hit]]
        lost = np.flatnonzero(~hit)
        if len(lost):
            raw = np.frombuffer(char[lost].tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
            m = spread[lost]
            out[np.repeat(to[lost] - (np.cumsum(m) - m), m) + np.arange(len(raw))] = self.bytes[raw]
        return out, sizes

    def agenda(self, unit: str, first: bool, skips) -> tuple[list[int], int]:
        """Ids of one unit and how many steps its agenda took; first: it begins a text; skips: a number, bit k of which says whether step k skips, or a function of k."""
        text = unit.replace(_BLANK, _ITSELF).replace(" ", _BLANK)
        if first:
            text = _BLANK + text
        n, get = len(text), self.piece.get
        # symbols are spans of text, linked; a span is named by where it begins
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(hit[1], a, a + 1, a + 2) for a, hit in enumerate(map(get, map(operator.add, text, text[1:]))) if hit is not None]
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        step, bits = 0, skips if isinstance(skips, int) else None
        while heap:
            _, a, b, c = pop(heap)
            if end[a] != b or end[b] != c:
                continue  # one of the two has been merged since
            k, step = step, step + 1
            if bits is None:
                if skips(k):
                    continue
            elif bits:
                skip, bits = bits & 1, bits >> 1
                if skip:
                    continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
                d = end[c]
                hit = get(text[a:d])
                if hit is not None:
                    push(heap, (hit[1], a, c, d))
            p = before[a]
            if p >= 0:
                hit = get(text[p:c])
                if hit is not None:
                    push(heap, (hit[1], p, a, c))
        out: list[int] = []
        a = 0
        while a < n:
            c = end[a]
            p = text[a:c]
            hit = get(p)
            if hit is not None:
                out.append(hit[0])
            else:
                out += [self.byte[x] for x in p.replace(_ITSELF, _BLANK).encode()]
            a = c
        return out, step

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The text of each row of ids."""
        size = self.size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        gather = np.repeat(self.at[ids] - total[:-1], size) + np.arange(int(total[-1]))
        raw = self.table[gather].tobytes()
        return [raw[a + 1 : b] if b > a else b"" for a, b in zip(total[at[:-1]].tolist(), total[at[1:]].tolist(), strict=True)]


#: Stands for a U+2581 of the text itself, within agenda only: half a surrogate pair, which no text has.
_ITSELF = "\ud800"


@functools.cache
def encoder(model_file: str, rate: float, seed: int) -> DropoutEncoder:
    return DropoutEncoder(model_file, rate, seed)


def encode(docs: DataFrame, model_file: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id and the ids of its text, the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_file, rate, seed)
        for b in sliced(batches):
            ids, at = _encode(e, b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def _encode(e: DropoutEncoder, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    e.doc_ids = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return e.encode(Texts(b.column("text")), END_ID)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_file, 0.0, 0)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                col = part.column("ids")
                at = col.offsets.to_numpy().astype(np.int64)
                texts = e.decode(col.flatten().to_numpy(zero_copy_only=False), at - at[0])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t.decode() for t in texts], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def report(docs: DataFrame, model_file: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_ids, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 (of the text that the ids decode to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_file, rate, seed)
        for b in sliced(batches):
            texts = Texts(b.column("text"))
            ids, at = _encode(e, b)
            raw = memoryview(ids.astype("<u4").tobytes())
            sha = [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            back = [hashlib.sha256(t).hexdigest() for t in e.decode(ids, at)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(texts.offsets)), pa.array(np.diff(at)), pa.array(sha), pa.array(back)], names=["doc_id", "n_bytes", "n_ids", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_ids long, ids_sha256 string, decoded_sha256 string")
