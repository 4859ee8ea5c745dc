"""Language identification in two steps: the family, then the language within it.

A text's features are relative frequencies of hashed byte 1- to 4-grams of its letters
(case folded; runs of other bytes count as one blank).  A linear classifier picks the
family (one against the rest); within a family of several languages every pair has its own
linear support vector machine, and the language with the most votes wins (ties: the
larger summed margin).

Training uses at most ``PER_LANGUAGE`` texts of each language, those with the least hash of
their doc_id, and at most ``TRAIN_BYTES`` of each; this bound is a parameter of ``train``.
Prediction reads whole texts; a text's score is one sum of table look-ups, so cost is
linear and memory constant.

Defined results: a null text, or one without a letter, is ``und`` with score 0; where
nothing could be learned every text is ``und``; a single learned language is predicted with
score 1; repeated rows get equal rows; at most ``MAX_LANGUAGES`` labels are learned; lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .textcore import Texts, lane, release, sliced

UNKNOWN = "und"
PER_LANGUAGE = 400
#: Labels that are learned at most: the commonest.
MAX_LANGUAGES = 200
TRAIN_BYTES = 3000
BITS = 13
GRAMS = (1, 2, 3, 4)

# Language families of common ISO 639-1 codes.  Any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi mr ne bn pa gu",
    "semitic": "ar he mt",
    "celtic": "ga cy gd br",
}

_FOLD = np.full(256, 32, dtype=np.uint8)
for _c in range(256):
    if 65 <= _c <= 90:
        _FOLD[_c] = _c + 32
    elif 97 <= _c <= 122 or _c >= 128:
        _FOLD[_c] = _c
_SALT = lane(8, 301).astype(np.uint32)


def family(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes.split()), f"only {lang}")


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter."""
    return any(97 <= c | 32 <= 122 for c in text[:64]) or any(c.isalpha() for c in text.decode("utf-8", "ignore"))


def folded(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case and blanks, at most one after another, with the offset of each row; each row begins and ends with a blank."""
    n = texts.n
    row = np.repeat(np.arange(n), np.diff(texts.offsets))
    x = _FOLD[texts.buf]
    # upper-case Latin-1 letters (C3 80-9E) to lower case
    after = np.zeros(len(x), dtype=bool)
    after[1:] = texts.buf[:-1] == 0xC3
    x[after & (x >= 0x80) & (x <= 0x9E)] += 32
    out = np.full(len(x) + 2 * n, 32, dtype=np.uint8)
    out[np.arange(len(x)) + 2 * row + 1] = x
    at = texts.offsets + 2 * np.arange(n + 1)
    blank = out == 32
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[at[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[at]


def gram_slots(x: np.ndarray) -> list[np.ndarray]:
    """For each n the slot of the n-gram that begins at each position; grams across rows are told apart by their blanks only."""
    out = []
    padded = np.concatenate([x, np.full(8, 32, np.uint8)]).astype(np.uint32)
    code = np.zeros(len(x), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        code = code | padded[n - 1 : n - 1 + len(x)] << np.uint32(8 * (n - 1))
        if n in GRAMS:
            h = (code ^ _SALT[n]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            out.append((h >> np.uint32(32 - BITS)).astype(np.int32))
    return out


def linear_scores(texts: Texts, weights: np.ndarray) -> np.ndarray:
    """(rows, machines): mean weight of each row's grams, plus nothing else.  weights: (slots, machines)."""
    x, at = folded(texts)
    total = np.zeros((texts.n, weights.shape[1]))
    slots = gram_slots(x)
    some = np.flatnonzero(np.diff(at))
    for m in range(weights.shape[1]):
        w = np.ascontiguousarray(weights[:, m])
        per = w[slots[0]]
        for s in slots[1:]:
            per += w[s]
        total[some, m] = np.add.reduceat(per, at[:-1][some], dtype=np.float64)
    return total / np.maximum(np.diff(at), 1)[:, None]


@dataclass
class Machines:
    """Learned tables: names, each family's languages, and the columns of weights."""

    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _features(texts: list[str]) -> np.ndarray:
    return np.concatenate([_some_features(texts[i : i + 100]) for i in range(0, len(texts), 100)])


def _some_features(texts: list[str]) -> np.ndarray:
    t = Texts(pa.array(texts, pa.string()))
    x, at = folded(t)
    row = np.repeat(np.arange(t.n, dtype=np.int64), np.diff(at)) << BITS
    out = sum(np.bincount(row + s, minlength=t.n << BITS) for s in gram_slots(x)).reshape(t.n, -1).astype(np.float32)
    return out / np.maximum(np.diff(at), 1)[:, None].astype(np.float32)


def svm(gram: np.ndarray, y: np.ndarray, rounds: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by gradients with momentum; y is +1 or -1, classes weigh the same.

    Its weights are a combination of the samples, so only their inner products (gram) are needed: returns the
    coefficient of each sample, and the bias.  Products are scaled to a mean square norm of 1."""
    scale = 1.0 / max(float(np.trace(gram)) / len(y), 1e-12)
    cost = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    k = gram * scale
    a, b = np.zeros(len(y)), 0.0
    va, vb, step = np.zeros(len(y)), 0.0, 0.4
    for _ in range(rounds):
        g = -2 * cost * y * np.maximum(0, 1 - y * (k @ a + b))
        va = 0.9 * va - step * (g + decay * a)
        vb = 0.9 * vb - step * float(g.sum())
        a, b = a + va, b + vb
    return a * scale, b


def fit(rows: list[tuple[str, str]]) -> Machines:
    """Machines from (text, lang) rows."""
    by: dict[str, list[str]] = defaultdict(list)
    for text, lang in rows:
        by[lang].append(text)
    langs = sorted(by)
    m = Machines()
    for lang in langs:
        m.members.setdefault(family(lang), []).append(lang)
    m.families = sorted(m.members)
    if not langs:
        return m
    x = _features([t for lang in langs for t in by[lang]])
    label = np.array([lang for lang in langs for _ in by[lang]])
    home = np.array([family(lang) for lang in label])
    gram = (x @ x.T).astype(np.float64)

    def machine(use: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        a, b = svm(gram[np.ix_(use, use)], y)
        return a.astype(np.float32) @ x[use], b

    cols = []
    if len(m.families) > 1:
        cols += [machine(np.arange(len(x)), np.where(home == f, 1.0, -1.0)) for f in m.families]
    for f in m.families:
        for a, b in combinations(m.members[f], 2):
            use = np.flatnonzero((label == a) | (label == b))
            m.pairs.append((a, b))
            cols.append(machine(use, np.where(label[use] == a, 1.0, -1.0)))
    if cols:
        m.weights = np.stack([c[0] for c in cols], axis=1)
        m.bias = np.array([c[1] for c in cols])
    return m


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, text_bytes: int = TRAIN_BYTES) -> Machines:
    """Machines from labelled docs (text, lang, doc_id): a sample of per_language texts of each language."""
    docs = docs.where("lang is not null and text is not null")
    whole = 1 << 62
    place = F.pmod(F.xxhash64("doc_id"), F.lit(whole))
    # the commonest labels only, as each pair of a family has a machine
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    if not counts:
        return Machines()
    limit = F.lit(0)  # a fifth more than wanted of each language, so what comes to the driver doesn't grow with the input
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(whole, whole * 12 * per_language // (10 * n)))).otherwise(limit)
    picked = docs.where(place < limit).select("lang", F.substring("text", 1, text_bytes).alias("text"), place.alias("place"), "doc_id").orderBy("place", "doc_id", "text").limit(4 * per_language * len(counts)).collect()
    taken: dict[str, int] = defaultdict(int)
    rows = []
    for r in picked:
        if taken[r["lang"]] < per_language and has_letter(r["text"].encode()):
            taken[r["lang"]] += 1
            rows.append((r["text"], r["lang"]))
    return fit(rows)


def decide(m: Machines, texts: Texts) -> tuple[list[str], list[float]]:
    if not m.families:
        return [UNKNOWN] * texts.n, [0.0] * texts.n
    s = linear_scores(texts, m.weights) + m.bias if m.weights.shape[1] else np.zeros((texts.n, 0))
    first = len(m.families) if len(m.families) > 1 else 0
    home = s[:, :first].argmax(axis=1) if first else np.zeros(texts.n, dtype=int)
    if first:
        ordered = np.sort(s[:, :first], axis=1)
        sure = 1 / (1 + np.exp(-2 * (ordered[:, -1] - ordered[:, -2])))
    else:
        sure = np.ones(texts.n)
    langs, scores = [UNKNOWN] * texts.n, [0.0] * texts.n
    pair_at = {p: first + i for i, p in enumerate(m.pairs)}
    for i in range(texts.n):
        if not has_letter(texts.raw(i)):
            continue
        names = m.members[m.families[home[i]]]
        votes = {x: [0, 0.0] for x in names}
        for a, b in combinations(names, 2):
            v = float(s[i, pair_at[a, b]])
            votes[a if v >= 0 else b][0] += 1
            votes[a][1] += v
            votes[b][1] -= v
        best = max(names, key=lambda x: (votes[x][0], votes[x][1], x))
        within = 1.0
        for a, b in combinations(names, 2):
            if best in (a, b):
                v = float(s[i, pair_at[a, b]]) * (1 if best == a else -1)
                within = min(within, 1 / (1 + np.exp(-2 * v)))
        langs[i], scores[i] = best, float(min(max(sure[i] * within, 0.0), 1.0))
    return langs, scores


def predict(docs: DataFrame, machines: Machines) -> DataFrame:
    """docs (its columns, but for any of the two names) with lang_pred and score.  The tables (a few MB at most) go with the code."""
    docs = docs.drop("lang_pred", "score")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machines)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, limit=1 << 20):
            langs, scores = decide(shared.value, Texts(b.column(names.index("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])
        release()

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def known(docs: DataFrame, machines: Machines) -> DataFrame:
    """The rows of docs that predict finds a language for, as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machines)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, limit=1 << 20):
            langs, _ = decide(shared.value, Texts(b.column(at)))
            yield b.filter(pa.array([x != UNKNOWN for x in langs]))
        release()

    return docs.mapInArrow(run, docs.schema)
