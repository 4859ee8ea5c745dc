"""The pipeline's stages, each against a brute-force version over what its predecessor kept."""

import re
import string

import pytest

from .test_operators import naive_passages, near_pairs, roots, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def normal(line):
    return " ".join(re.sub(r"[0-9]", "0", re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", line.translate(LOW))).split())


@pytest.fixture(scope="module")
def steps(spark):
    """(documents before, rows after) of every stage, collected."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, rows = {}, docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        found = after.collect()
        out[name] = rows, found
        if k < len(corpus_pipeline.STAGES) - 1:
            docs, rows = spark.createDataFrame(found, docs.schema).repartition(3), found
    return out


def test_language(steps):
    before, after = steps["language_id"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if r["text"] and any(c.isalpha() for c in r["text"]))
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items()


def test_lines(steps):
    """Of every group of similar lines the first stays; pairs beyond 600 characters count where they are equal."""
    before, after = steps["line_dedup"]
    text = {r["doc_id"]: r["text"] for r in after}
    assert len(after) == len(before) and all(r["n_chars"] == len(r["text"]) for r in after)
    lines = [(r["doc_id"], k, normal(x)) for r in sorted(before, key=lambda r: r["doc_id"]) for k, x in enumerate(r["text"].split("\n"))]
    lines = [x for x in lines if len(x[2].encode()) >= 20]
    group = roots(near_pairs({x for _, _, x in lines if len(x) < 600}))
    seen, gone = set(), set()
    for doc_id, k, x in lines:
        g = group.get(x, x)
        if g in seen:
            gone.add((doc_id, k))
        seen.add(g)
    got = set()
    for r in before:
        left = iter(text[r["doc_id"]].split("\n"))
        now = next(left, None)
        for k, x in enumerate(r["text"].split("\n")):
            if x == now:
                now = next(left, None)
            else:
                got.add((r["doc_id"], k))
    short = {(d, k) for d, k, x in lines if len(x) < 600}
    assert len(gone) > 50 and len(got & gone) >= 0.97 * len(gone)
    assert (got & short) <= gone


def test_near(steps):
    before, after = steps["near_dedup"]
    sets = {}
    for r in before:
        w = words((r["text"] or "").translate(LOW))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    ids = sorted(sets)
    root = roots([(i, j) for i in ids for j in ids if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    assert sorted(r["doc_id"] for r in after) == [i for i in ids if root.get(i, i) == i]
    assert {r["doc_id"]: r["text"] for r in after}.items() <= {r["doc_id"]: r["text"] for r in before}.items()


def test_passages(steps):
    before, after = steps["substring_dedup"]
    gone = {i: n for i, _, n, _ in naive_passages([(r["doc_id"], r["text"]) for r in before], 50)}
    text = {r["doc_id"]: r["text"] for r in before}
    assert len(after) == len(before)
    for r in after:
        assert r["text"] == text[r["doc_id"]] if not gone[r["doc_id"]] else len(words(r["text"])) == len(words(text[r["doc_id"]])) - gone[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])


def test_packing(steps):
    before, after = steps["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    filled = {}
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 1024 and len(filled) < 1.05 * sum(filled.values()) / 1024 + 1


def test_odd_columns_and_rows(spark):
    """Columns with the operators' own names, null and equal rows, and rows without an id go through every stage."""
    text = "The house is on the hill and the river runs below it all the year.\nA second line that is long enough to be compared."
    given = [(None, text, "en", 1, 1.0), (1, text, "en", 2, 2.0), (1, text, "en", 2, 2.0), (2, None, "en", 3, 3.0), (3, "", "en", 4, 4.0), (4, "42 !", "en", 5, 5.0)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, n_chars int, score double")
    for name in ("lang_pred", "_id", "_hash", "_kept", "_row", "th", "_gone_doc", "_gone_th", "_gone_lines", "_kept_doc", "_kept_text"):
        docs = docs.selectExpr("*", f"'x' as {name}")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            assert sorted(str(r["doc_id"]) for r in after.select("doc_id").collect()) == ["1", "1", "None"]
            docs = spark.createDataFrame(after.collect(), docs.schema)
        else:
            assert after.count() == 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, "")
        assert after.count() == 0
        docs = docs if "sequence_id" in after.columns else after
