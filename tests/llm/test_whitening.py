"""Whitening against numpy on the same integers, exact in Python where the contract is exact."""

import math

import numpy as np
import pytest

from factloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, v0 int"


def table(spark, vectors, slices=5):
    return spark.createDataFrame([(k, v, "x", k) for k, v in enumerate(vectors)], SCHEMA).repartition(slices)


def check(found, vectors, most=32):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    exact = ((n * x - sums) ** 2).sum(axis=1)
    c = np.array([[float(int(v) * n - int(s)) / n for v, s in zip(row, sums)] for row in x])
    values = np.linalg.eigvalsh(c.T @ c / n)[::-1]
    k = min(most, int((values > 1e-13 * values[0]).sum()))
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(by) == n and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    z = np.array([[by[i][j]["whitened"] for j in range(1, k + 1)] for i in sorted(by)])
    assert [by[i][1]["deviation"] for i in sorted(by)] == [int(v) for v in exact]
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1
    assert abs(found[0]["identity_error"] - np.abs((z - z.mean(0)).T @ (z - z.mean(0)) / n - np.eye(k)).max()) < 1e-9 and found[0]["identity_error"] < 1e-9
    assert np.allclose([by[min(by)][j]["explained"] for j in range(1, k + 1)], values[:k] / values.sum(), rtol=1e-9)
    # each component is an eigenvector: V w = e w, where w is got back from the rows
    w = np.linalg.lstsq(c, z * np.sqrt(values[:k]), rcond=None)[0]
    assert np.allclose(c.T @ (c @ w) / n, w * values[:k], atol=1e-7 * values[0]) and np.allclose((w**2).sum(0), 1, atol=1e-7)


def test_report_is_that_of_numpy(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(400, 7)) @ r.normal(size=(7, 7))
    vectors = [v.tolist() for v in base] + [base[0].tolist()] * 150
    check(whitening.report(table(spark, vectors, 37)).collect(), vectors)
    check(whitening.report(table(spark, vectors, 2), most=3).collect(), vectors, 3)


def test_more_dimensions_than_rows(spark):
    vectors = np.random.default_rng(1).normal(size=(9, 40)).tolist()
    check(whitening.report(table(spark, vectors, 4)).collect(), vectors)


def test_odd_vectors(spark):
    good = np.random.default_rng(2).normal(size=(30, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [0.0, float("inf"), 0.0], [0.0, 0.0, -float("inf")], [1.0, 2.0]]
    assert sorted({r["vec_id"] for r in whitening.report(table(spark, bad + good)).collect()}) == list(range(len(bad), len(bad) + len(good)))
    check(whitening.report(table(spark, good)).collect(), good)
    assert whitening.report(table(spark, bad[:6])).collect() == [] and whitening.report(table(spark, [])).collect() == []
    assert whitening.report(table(spark, [[1.0, 2.0]] * 4)).collect() == [] and whitening.report(table(spark, [[1.0, 2.0]])).collect() == []
    assert whitening.report(table(spark, [])).dtypes == whitening.report(table(spark, good)).dtypes


def test_large_entries(spark):
    far = whitening.report(table(spark, [[3e38, 1.0], [-3e38, 2.0], [1.0, 7.0]])).collect()
    assert {r["deviation"] for r in far if r["vec_id"] < 2} == {None} and all(math.isfinite(r["whitened"]) for r in far)
    mid = [[1e6, 1.0], [-1e6, 2.0], [5e5, 3.0]]
    x = [[math.floor(64 * c) + 1000000 for c in v] for v in mid]
    want = {i: sum((3 * x[i][d] - sum(y[d] for y in x)) ** 2 for d in range(2)) for i in range(3)}
    assert {r["vec_id"]: r["deviation"] for r in whitening.report(table(spark, mid)).collect()} == want


def test_transform_keeps_rows_and_columns(spark):
    vectors = [None, *np.random.default_rng(2).normal(size=(300, 4)).tolist(), [1.0]]
    rows = table(spark, vectors)
    model = whitening.fit(rows)
    out = whitening.transform(rows, model)
    assert out.columns == [*rows.columns, "whitened"]
    found = {r["vec_id"]: r for r in out.collect()}
    assert len(found) == 302 and found[0]["whitened"] is None and found[301]["whitened"] is None and found[301]["embedding"] == [1.0]
    z = np.array([found[i]["whitened"] for i in range(1, 301)])
    assert np.abs(z.T @ z / 300 - np.eye(4)).max() < 1e-9
    want = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.report(rows).collect()}
    assert all(abs(want[i, j + 1] - z[i - 1, j]) < 1e-9 for i in range(1, 301) for j in range(4))


@pytest.mark.parametrize("count", [1, 16, 17, 300])
def test_tree(spark, count):
    parts = spark.range(count).selectExpr("id", "cast(cast(id as string) as binary) AS part")
    merged = whitening.tree(parts, count, lambda found: str(sum(int(x) for x in found)).encode())
    assert int(merged) == count * (count - 1) // 2
