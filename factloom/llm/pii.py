"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans they miss.

Base kinds are found leftmost and without overlap, each by itself, in time linear in the text:
email, ip (parts up to 255), card (12 to 19 digits that pass Luhn) and phone (9 to 15 digits).  The
field looks at the stretches of text between them that could hold one written otherwise (numbers
in groups, addresses spelled out).  It scores whole candidate segments, of at most MAX_TOKENS tokens, by
features of the span as one thing (its shape, digit groups, checksum, what stands beside it), and
a dynamic program over positions picks boundaries and kinds together.  Base spans stay as they are.

It is fitted on distinct windows of the corpus: around base spans, the same spans in other
spellings, damaged ones (a wrong checksum, a part over 255, too few digits) and numbers that are no
personal data.  At most PER_KIND windows of each sort are taken, by smallest hash, so a fit costs the
same whatever the input; its result depends on the set of windows, not on how rows are dealt out.

Results for odd input:

* Null and empty texts have no span.  Every row gets its result, equal rows the same; a null doc_id is kept.
* Texts are read whole, of any length: patterns never rescan a run, and segments are bounded.
* Without any window the field adds nothing.  An empty table gives no row.
* ``find`` keeps all columns of its input; one with the name of its result is replaced.
* Places are code points, the end exclusive; ties go to the earlier kind in KINDS.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .storage import small_batches
from .textcore import release, sliced

KINDS = ("email", "ip", "card", "phone")
#: Windows of each sort that a fit takes, longest segment, features of a kind, rounds and step of the fit, penalty.
PER_KIND, MAX_TOKENS, WIDTH, ROUNDS, STEP, DECAY = 60, 24, 4096, 15, 0.5, 1e-4
#: Code points kept at both sides of a span in a window.
BESIDE = 24

_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def digits_of(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Runs before each @ from the end of the last match on: the leftmost start of each is its first character."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and _LOCAL.match(text[begin - 1]):
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        done = m.end() if m else at + 1
        if m:
            yield begin, done
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        # more than three digits after leading zeros are over 255 in any case
        if all(len(p) < 4 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = digits_of(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(out)


# Where the field looks: groups of digits with marks between, and words around a written-out "at".
_NUMBERS = re.compile(r"(?<![A-Za-z0-9])\(?[0-9](?:[0-9]|[ .()\[\]/-]{1,4}(?=[0-9])|(?: dot |\(dot\)|\[dot\]|\(\.\)|\[\.\])(?=[0-9]))++")
_SPELLED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:@| ?[(\[{](?:at|AT|At|@)[)\]}] ?| at | AT )[A-Za-z0-9-]{1,63}(?:(?:\.| dot | DOT | ?[(\[{](?:dot|DOT|\.)[)\]}] ?)[A-Za-z0-9-]{1,63}){1,6}(?![A-Za-z0-9])")
_TOKENS = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
_SHAPE = re.compile(r"[0-9]+|[A-Za-z]+")
_AT = re.compile(r"(?i)@|(?<![a-z])at(?![a-z])")
_DOT = re.compile(r"(?i)\.|(?<![a-z])dot(?![a-z])")


def islands(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches outside of the spans taken that could hold personal data, in order and without overlap."""
    found = [m.span() for m in _NUMBERS.finditer(text) if sum(c.isdigit() for c in m.group()) >= 7]
    found += [m.span() for m in _SPELLED.finditer(text)] if "@" in text or "at" in text or "AT" in text or "At" in text else []
    out, last = [], 0
    marks, reach = [], 0  # of spans taken: starts, and the furthest end up to each
    for s, _, e in taken:
        reach = max(reach, e)
        marks.append((s, reach))
    for a, b in sorted(found):
        before = bisect.bisect_left(marks, (b, -1)) - 1
        if a >= last and (before < 0 or marks[before][1] <= a):
            out.append((a, b))
            last = b
    return out


def _side(c: str) -> str:
    return "." if not c else "0" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


#: Features of a span, and what stands behind or before one that was cut short.
SLOTS = 16
_ON = re.compile(r"(?i)[.@-][a-z0-9]| ?[(\[{]?(?:at|dot|@|\.)[)\]}]? ?[a-z0-9]")
_FROM = re.compile(r"(?i)[a-z0-9][.@-]$|[ (\[{](?:at|dot|@|\.)[)\]} ] ?$")


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % WIDTH


def features(text: str, a: int, b: int) -> list[int]:
    """Slots of a span's features; all look at the span as a whole, or at what stands beside it."""
    s = text[a:b]
    groups, d = re.findall("[0-9]+", s), digits_of(s)
    n, letters = len(d), sum(c.isalpha() for c in s)
    shape = _SHAPE.sub(lambda m: "9" * min(len(m.group()), 5) if m.group()[0].isdigit() else "a", s)
    marks = "".join(sorted(set(_SHAPE.sub("", s))))
    at, dot = len(_AT.findall(s)), len(_DOT.findall(s))
    octets = len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)
    beside = [f"ends {_side(s[0])} {_side(s[-1])}", f"before {_side(text[a - 1 : a])}", f"after {_side(text[b : b + 1])}", f"goes on {bool(_ON.match(text, b))}", f"comes from {bool(_FROM.search(text[max(0, a - 8) : a]))}"]
    if letters:  # of an address spelled out, digits say nothing
        tail = re.search("[A-Za-z]*$", s).group().lower()
        names = [f"spelled {min(at, 2)} {min(dot, 3)}", f"at {min(at, 2)}", f"dots {min(dot, 3)}", f"brackets {''.join(c for c in marks if c in '()[]{}@ ')}", f"address {bool(_SPELLED.fullmatch(s))} {at == 1} {dot > 0}", f"tail {2 <= len(tail) <= 6 and tail not in ('at', 'dot')}", f"both {at == 1} {dot > 0}", f"writing {' at ' in s.lower()} {'dot' in s.lower()}"]
    else:
        names = [
            f"digits {min(n, 20)}", f"groups {min(len(groups), 8)}", f"sizes {'-'.join(str(min(len(g), 9)) for g in groups[:8])}", f"shape {shape}", f"marks {marks}", f"check {12 <= n <= 19 and luhn(d)} {12 <= n <= 19}", f"octets {octets} {len(groups) == 4}",
            f"octets {octets} marks {marks}", f"check {12 <= n <= 19 and luhn(d)} groups {min(len(groups), 8)}", f"digits {min(n, 20)} groups {min(len(groups), 8)}",
        ]
    names += beside
    return [_slot(x) for x in (f"letters {letters > 0}", *names, *(["none"] * (SLOTS - 1 - len(names))))]


class Lattice:
    """The segments of one island: token edges, and (first edge, last edge, slots) of each candidate by its end."""

    def __init__(self, text: str, a: int, b: int):
        self.edges = [m.start() for m in _TOKENS.finditer(text, a, b)] + [b]
        e = self.edges
        opens = [k for k in range(len(e) - 1) if (text[e[k]].isascii() and text[e[k]].isalnum()) or text[e[k]] in "+("]
        self.first, self.last, slots = [], [], []
        for k in opens:
            # no segment cuts a word or number in two
            if text[e[k] - 1 : e[k]].isalnum() and e[k] > 0 and text[e[k]].isalnum():
                continue
            for j in range(k + 1, min(k + MAX_TOKENS, len(e) - 1) + 1):
                end = text[e[j] - 1]
                if not (end.isalnum() or end == ")") or (end.isalnum() and text[e[j] : e[j] + 1].isalnum()):
                    continue
                s = text[e[k] : e[j]]
                if sum(c.isdigit() for c in s) < 7 and not _AT.search(s):
                    continue
                self.first.append(k)
                self.last.append(j)
                slots.append(features(text, e[k], e[j]))
        self.slots = np.array(slots, dtype=np.int64).reshape(len(slots), SLOTS)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return weights[:, self.slots].sum(axis=2) if len(self.first) else np.zeros((len(KINDS), 0))

    def best(self, weights: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the segmentation with the highest score; what is in no segment scores nothing."""
        if not self.first:
            return []
        scores, m = self.scores(weights), len(self.edges) - 1
        top, kind = scores.max(axis=0), scores.argmax(axis=0)
        value, came = [0.0] * (m + 1), [-1] * (m + 1)
        ends: list[list[int]] = [[] for _ in range(m + 1)]
        for c, j in enumerate(self.last):
            ends[j].append(c)
        for j in range(1, m + 1):
            value[j] = value[j - 1]
            for c in ends[j]:
                v = value[self.first[c]] + top[c]
                if v > value[j]:
                    value[j], came[j] = v, c
        out, j = [], m
        while j:
            c = came[j]
            if c >= 0:
                out.append((self.edges[self.first[c]], int(kind[c]), self.edges[j]))
            j = self.first[c] if c >= 0 else j - 1
        return out[::-1]

    def gradient(self, weights: np.ndarray, gold: list[tuple[int, int, int]], into: np.ndarray) -> float:
        """Adds the gradient of the log-likelihood of the gold segmentation, and returns that."""
        scores, m = self.scores(weights), len(self.edges) - 1
        whole = np.logaddexp.reduce(scores, axis=0) if len(self.first) else np.zeros(0)
        first, last = np.array(self.first, dtype=np.int64), np.array(self.last, dtype=np.int64)
        ahead, behind = np.zeros(m + 1), np.zeros(m + 1)
        for j in range(1, m + 1):
            c = np.flatnonzero(last == j)
            ahead[j] = np.logaddexp.reduce(np.append(ahead[first[c]] + whole[c], ahead[j - 1])) if len(c) else ahead[j - 1]
        for j in range(m - 1, -1, -1):
            c = np.flatnonzero(first == j)
            behind[j] = np.logaddexp.reduce(np.append(behind[last[c]] + whole[c], behind[j + 1])) if len(c) else behind[j + 1]
        total, wanted = 0.0, {(a, b): k for a, k, b in gold}
        shares = np.exp(ahead[first] + scores + behind[last] - ahead[m])
        for c, (i, j) in enumerate(zip(self.first, self.last, strict=True)):
            kind = wanted.get((self.edges[i], self.edges[j]))
            if kind is not None:
                total += scores[kind, c]
                shares[kind, c] -= 1
        for k in range(len(KINDS)):
            np.subtract.at(into[k], self.slots, shares[k][:, None])
        return total - ahead[m]


def _spellings(kind: int, s: str) -> list[str]:
    """Other ways to write a base span."""
    d = digits_of(s)
    if kind == 0:
        name, _, host = s.partition("@")
        ways = ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" (at) ", "."), ("(at)", "(dot)"), ("[at]", "."), ("(at)", "."), (" [at] ", " [dot] "))
        short = host.split(".", 1)[1] if host.count(".") > 1 else host
        return [who + at + where.replace(".", dot) for at, dot in ways for who, where in ((name, host), (name.replace(".", ""), host), (name, short), (name.replace(".", ""), short), (name.replace(".", "_"), "my-" + short))]
    if kind == 1:
        return [s.replace(".", x) for x in ("[.]", "(.)", " dot ", "[dot]")]
    if kind == 2:
        fours = [d[i : i + 4] for i in range(0, len(d), 4)]
        return [x.join(fours) for x in (".", "  ", "/", " - ")]
    # of a phone number: without its plus, the last ten digits grouped
    a, b, c = d[-10:-7], d[-7:-4], d[-4:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00{d[:-10] or 1} {a} {b} {c}"] if len(d) >= 10 else []


def _damaged(kind: int, s: str) -> list[str]:
    """Writings like those of a span that are no personal data."""
    d = digits_of(s)
    if kind == 1:
        return [re.sub("^[0-9]+", "999", s), re.sub("[0-9]+$", "512", s).replace(".", "[.]")]
    if kind == 2:
        wrong = d[:-1] + str((int(d[-1]) + 1) % 10)
        fours = [wrong[i : i + 4] for i in range(0, len(wrong), 4)]
        return [wrong, " ".join(fours), ".".join(fours), "-".join(fours)]
    if kind == 3:
        return [d[-10:], d[:8], f"20{d[-2:]}-{d[:2]}-{d[2:4]} {d[4:6]}", f"{d[:3]} {d[3:6]} {d[6:9]}", f"{d[:4]}/{d[4:8]}", f"{d[:2]}.{d[2:4]}.20{d[-2:]}", f"{d[:4]}-{d[4:8]}"]
    name, _, host = s.partition("@")
    return [f"{name} at {host.split('.')[0]}", f"{name} at {host}", f"look at {host.split('.')[0]}.Then"]


def examples(windows: list[tuple[int, str, int, int]]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, segments) from (kind or -1, window, start, end)."""
    out = []
    for kind, text, a, b in windows:
        if kind < 0:
            out.append((text, []))
            continue
        left, s, right = text[:a], text[a:b], text[b:]
        for x in [s, *_spellings(kind, s)]:
            out.append((left + x + right, [(a, kind, a + len(x))]))
        out += [(left + x + right, []) for x in _damaged(kind, s)]
    return out


_WINDOWS = "kind int, text string, first int, last int"


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind or -1, window, first, last): what stands around base spans and around other numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            seen = set()
            for s in b.column(0).to_pylist():
                if not s:
                    continue
                base = base_spans(s)
                for a, kind, e in [*base, *((a, -1, e) for a, e in islands(s, base))]:
                    if e - a <= 100 and not any(x < e + BESIDE and a - BESIDE < z and (x, z) != (a, e) for x, _, z in base):
                        low = max(0, a - BESIDE)
                        seen.add((kind, s[low : e + BESIDE], a - low, e - low))
            columns = list(zip(*sorted(seen), strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["kind", "text", "first", "last"])

    return docs.select(F.col(text).alias("text")).where("text is not null").mapInArrow(run, _WINDOWS)


def train(docs: DataFrame, per_kind: int = PER_KIND, text: str = "text") -> np.ndarray:
    """Weights (kind, slot), fitted on at most per_kind distinct windows of each sort; those alone come to the driver."""
    small_batches(docs.sparkSession)
    # of a sort, the smallest hashes; those of each sub-list first, so that no task ranks all windows of a sort
    keyed = windows(docs, text).distinct().withColumn("h", F.xxhash64("text", "first", "last"))
    for by in (["kind", F.pmod("h", F.lit(64))], ["kind"]):
        keyed = keyed.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "text", "first"))).where(F.col("r") <= per_kind)
    rows = sorted((r["kind"], r["text"], r["first"], r["last"]) for r in keyed.collect())
    weights = np.zeros((len(KINDS), WIDTH))
    lattices = []
    for s, gold in examples(rows):
        places = islands(s, [] if gold else base_spans(s))
        if gold and not any(a <= gold[0][0] and gold[0][2] <= b for a, b in places):
            places = [(gold[0][0], gold[0][2])]
        lattices += [(Lattice(s, a, b), [g for g in gold if a <= g[0] and g[2] <= b]) for a, b in places]
    if not lattices:
        return weights
    squares = np.full_like(weights, 1e-8)
    for _ in range(ROUNDS):
        slope = -DECAY * len(lattices) * weights
        for lattice, gold in lattices:
            lattice.gradient(weights, gold, slope)
        squares += slope * slope
        weights += STEP * slope / np.sqrt(squares)
    return weights


def spans(text: str | None, weights: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, added) of one text, in order."""
    if not text:
        return []
    base = base_spans(text)
    found = [(*x, False) for x in base]
    if weights.any():
        for a, b in islands(text, base):
            found += [(*x, True) for x in Lattice(text, a, b).best(weights)]
    return sorted(found)


_FOUND = "array<struct<kind:string,first:int,last:int,added:boolean>>"


def find(docs: DataFrame, weights: np.ndarray, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with a column of all spans."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("added", pa.bool_())]))
    kept = docs.drop(into) if text != into else docs
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # len(KINDS) * WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            values = [[{"kind": KINDS[k], "first": a, "last": e, "added": x} for a, k, e, x in spans(s, shared.value)] for s in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, kind)], names=[*b.schema.names, into])
        release()

    schema = StructType([*kept.schema, StructField(into, docs.sparkSession.createDataFrame([], f"x {_FOUND}").schema["x"].dataType)])
    return kept.mapInArrow(run, schema)


def _is_kind(kind: str) -> Callable[[F.Column], F.Column]:
    return lambda s: s["kind"] == kind


def report(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Per document: counts of base spans by kind, the digest of base spans, and all spans."""
    found = find(docs.select("doc_id", "text"), weights)
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["last"].cast("string"))), ",")
    base = F.filter("pii", lambda s: ~s["added"])
    counts = [F.size(F.filter(base, _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
