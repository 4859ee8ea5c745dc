"""Near duplicates where everything is nearly alike: pairs of twins over one template, against all pairs of full sets."""

import random
from collections import Counter, defaultdict

import numpy as np

from factloom.llm import near_dup


def twins(n, r):
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(5000)]
    template = r.choices(vocabulary, k=200)

    def edited(w):
        w = list(w)
        for i in r.sample(range(200), 5):
            w[i] = r.choice(vocabulary) + str(r.randrange(10**6))
        return w

    out = []
    for _ in range(n):
        first = edited(template)
        out += [first, edited(first)]
    return [" ".join(w) for w in out]


def expected(texts):
    sets = []
    for t in texts:
        w = t.split(" ")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    df = Counter(x for s in sets for x in s)
    common = {x: k for k, x in enumerate(x for x, n in df.items() if n > 30)}
    m = np.zeros((len(sets), len(common)), dtype=np.float32)
    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            if x in common:
                m[i, common[x]] = 1
            elif df[x] > 1:
                by[x].append(i)
    inter = m @ m.T
    for ids in by.values():
        for i in ids:
            for j in ids:
                inter[i, j] += 1
    size = np.array([len(s) for s in sets])
    a, b = np.nonzero(np.triu(100 * inter >= 75 * (size[:, None] + size[None, :] - inter), 1))
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in zip(a.tolist(), b.tolist()):
        i, j = sorted((root(i), root(j)))
        up[j] = i
    alike = set(zip(a.tolist(), b.tolist()))
    rare = {(i, j) for ids in by.values() for i in ids for j in ids if i < j}
    return [root(i) for i in range(len(sets))], alike & rare


def test_twins_over_one_template(spark):
    texts = twins(1200, random.Random(17))
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    texts = [texts[i] for i in order]
    want, linked = expected(texts)
    assert len(linked) > 900 and 900 < len(set(want)) < 1250
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.clusters(docs).collect()}
    # no link is lost between texts that have a shingle of their own in common, and nothing is joined without links;
    # those that share none but what hundreds have may be lost (README)
    assert [p for p in linked if got[p[0]] != got[p[1]]] == []
    assert all(len({want[i] for i in got if got[i] == c}) == 1 for c in set(got.values()))
    wrong = sum(got[i] != c for i, c in enumerate(want))
    print("rows with another component:", wrong)
    assert wrong < 0.05 * len(want)


def test_divided_regions_lose_no_link(spark):
    texts = twins(400, random.Random(7))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.clusters(docs).collect()}
    want, _ = expected(texts)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []
