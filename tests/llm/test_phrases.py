"""Phrases against plain counting in Python, and against SQL on the small tables."""

import random
import re
import string
from collections import Counter

import pytest

from factloom.llm import idfilter, phrases, queries

from ..compare import connection, difference

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, f long, phrase string, rank int"


def naive(rows, min_count, max_words, top, inside=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= min_count}
    most = Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                most[lang, w[i : i + k]] = max(most[lang, w[i : i + k]], a)
    out = []
    for (lang, w), a in candidates.items():
        if 100 * most[lang, w] >= inside * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    seen, found = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            found.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(found)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    some = ["a", "b", "C", "é", "É", "日本", "x\x00y", "don't", "e-f", "😀", "(g)", "Ab c"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ? ", "\x0b", ": "]
    make = lambda n: "".join(r.choice(some) + r.choice(marks) for _ in range(n))
    out = [(None, "en"), ("", None), (" \n.,", "en"), ("a", None), ("a a a a a a a a a a a a", "de"), ("the end " * 3000, "fr"), ("one two three. " * 20, "und")]
    out += [(make(r.randint(1, 150)), r.choice(["en", "de", None])) for _ in range(150)]
    return out + out[20:40]


def found(df):
    return sorted(tuple(x) for x in df.collect())


@pytest.mark.parametrize(("least", "longest", "top"), [(10, 3, 2000), (3, 4, 17), (2, 2, 5)])
def test_collocations_are_those_counted_plainly(spark, rows, least, longest, top):
    docs = spark.createDataFrame([(0, t, g, 1, "x", 2) for t, g in rows], SCHEMA).repartition(5)
    got = phrases.collocations(docs, least, longest, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert found(got) == naive(rows, least, longest, top)


def test_full_filter_changes_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 15)
    monkeypatch.setattr(idfilter.IdFilter, "has", lambda self, ids: ids == ids)
    docs = spark.createDataFrame([(0, t, g, 1, "x", 2) for t, g in rows], SCHEMA)
    assert found(phrases.collocations(docs, 5)) == naive(rows, 5, 3, 2000)


def test_chunks_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 300)
    docs = spark.createDataFrame([(0, t, g, 1, "x", 2) for t, g in rows], SCHEMA).coalesce(1)
    assert found(phrases.collocations(docs, 5)) == naive(rows, 5, 3, 2000)


def test_long_text(spark):
    text = "Many words, " * 200_000
    docs = spark.createDataFrame([(1, text, "en", 1, "x", 2)], SCHEMA)
    assert found(phrases.collocations(docs)) == [("en", 1, "many words", 200_000, 200_000, 200_000, 400_000, 1_000_000)]


def test_products_beyond_64_bits(spark):
    big = 10**15 + 7
    got = spark.createDataFrame([(big, 3 * big + 1, 5 * big + 2, 2 * big, 7 * big + 3)], "a long, l1 long, r1 long, l2 long, r2 long")
    from pyspark.sql import functions as F

    cut = got.select(phrases.worst_cut(F.col("a"), [(F.col("l1"), F.col("r1")), (F.col("l2"), F.col("r2"))]).alias("c")).first()["c"]
    assert tuple(cut) == min((1000000 * big * big // (x * y), k, x, y) for k, (x, y) in enumerate([(3 * big + 1, 5 * big + 2), (2 * big, 7 * big + 3)], 1))


def test_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql(spark):
    at = "/root/testdata/sf0.001"
    assert difference(spark, connection(at), queries.QUERIES["op12_apriori"], queries.ORACLE_SQL["op12_apriori"], at) == ""
