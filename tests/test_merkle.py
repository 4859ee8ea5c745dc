"""Tree digests: equal trees are equal, and one changed file changes only its way to the root."""

import random

from factloom.operators import merkle


def test_digests(spark):
    r = random.Random(5)
    paths = sorted({"/".join(r.choices("abcé", k=r.randint(1, 6))) + f"/f{r.randrange(40)}" for _ in range(400)} | {"top", "é", "a"})
    rows = [("r", p, f"d{i % 7}") for i, p in enumerate(paths)] + [("r", "top", "d0"), ("other", "x/y", None)]
    tree = lambda x, n: merkle.digests(spark.createDataFrame(x, "repo string, path string, sha256 string").repartition(n), "repo")
    shuffled = rows[:]
    r.shuffle(shuffled)
    one = tree(rows, 3)
    assert merkle.changed(one, tree(shuffled, 7)).collect() == []
    at = next(i for i, x in enumerate(rows) if x[1].count("/") >= 4)
    edited = [(*x[:2], "new") if i == at else x for i, x in enumerate(rows)]
    steps = rows[at][1].split("/")
    want = {("/".join(steps[:k]), "changed") for k in range(len(steps) + 1)}
    assert {(x["path"], x["state"]) for x in merkle.changed(one, tree(edited, 3)).collect()} == want
    gone = {(x["path"], x["state"]) for x in merkle.changed(one, tree([x for i, x in enumerate(rows) if i != at], 3)).collect()}
    assert (rows[at][1], "removed") in gone and ("", "changed") in gone and len(gone) == len(want)
    assert tree([], 1).collect() == [] and len(one.collect()) == len({x["path"] for x in one.where("root = 'r'").collect() if not x["is_file"]}) + len(paths) + 3
