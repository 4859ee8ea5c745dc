"""Running sums against plain sums, with a group that holds most rows, nulls and ties; no task sees all rows."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from factloom.operators import prefix


@pytest.mark.parametrize("groups", [["g"], []])
def test_running(spark, groups):
    r = random.Random(4)
    rows = [(r.choice(["a", "a", "a", "b", None]), i, r.choice([None, 1, 2, 10])) for i in range(3000)]
    r.shuffle(rows)
    got = prefix.running(spark.createDataFrame(rows, "g string, o int, v long"), groups, ["o"], {"n": F.lit(1), "total": F.col("v")})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    want = {}
    for g in {x[0] for x in rows} if groups else {0}:
        mine = sorted((x for x in rows if not groups or x[0] == g), key=lambda x: x[1])
        for k, (x, total) in enumerate(zip(mine, accumulate(x[2] or 0 for x in mine)), 1):
            want[x[1]] = (x[0], x[2], k, total)
    assert {x["o"]: (x["g"], x["v"], x["n"], x["total"]) for x in got.collect()} == want


def test_ties_and_nothing(spark):
    same = spark.createDataFrame([(1, 5)] * 7, "o int, v long")
    assert sorted(x["t"] for x in prefix.running(same, [], ["o"], {"t": F.col("v")}).collect()) == [5 * k for k in range(1, 8)]
    assert prefix.running(same.limit(0), [], ["o"], {"t": F.col("v")}).collect() == []
    assert prefix.running(same.limit(0), ["v"], ["o"], {"t": F.col("v")}).collect() == []
