"""Sets that share many rare shingles meet once or a few times, not once for each; and what is contracted already takes no round."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm import components, near_dup
from factloom.llm.textcore import Texts


def test_pairs_meet_few_times(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for t in range(4):
        base = r.choices(words, k=150)
        for _ in range(15):
            mine = list(base)
            for _ in range(r.randint(0, 5)):
                mine[r.randrange(len(mine))] = r.choice(words)
            texts.append(" ".join(mine[r.randint(0, 20) :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = docs.select("doc_id", F.col("doc_id").alias("root"))
    rows = [(x["a"], x["b"]) for x in near_dup._meetings(docs, root, 75).collect()]
    value, at = near_dup.shingle_sets(Texts(pa.array(texts)))
    sets = [set(value[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(alike) > 50 and alike <= set(rows)
    assert len(rows) <= 3 * len(set(rows))
    assert sorted((x["a"], x["b"]) for x in near_dup.prefix_meetings(docs, root, 75).collect()) == sorted(set(rows))


def test_small_components_take_no_round(spark, monkeypatch):
    rounds = []
    least = components._least
    monkeypatch.setattr(components, "_least", lambda edges: rounds.append(1) or least(edges))
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a % 100 <> 99").repartition(40)
    got = {(x["node"], x["root"]) for x in components.components(edges).collect()}
    assert got == {(k, k - k % 100) for k in range(3000)}
    assert not rounds
    monkeypatch.setattr(components, "HELD", 500)
    assert {(x["node"], x["root"]) for x in components.components(edges).collect()} == got
    assert components.components(edges.where("a < 0")).count() == 0


def test_order_needs_no_join_of_shingles(spark, monkeypatch):
    """Entries are put in order and cut to prefixes where they are made; slots that many shingles share change no result."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    bases = [r.choices(words, k=60) for _ in range(3)]
    texts = [" ".join(b[: r.randint(48, 60)] + r.choices(words, k=r.randint(0, 4))) for b in bases for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = docs.select("doc_id", F.col("doc_id").alias("root"))
    value, at = near_dup.shingle_sets(Texts(pa.array(texts)))
    sets = [set(value[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    alike = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    written = []
    write = near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", lambda df, tag: written.append(write(df, tag)) or written[-1])
    for slots in (20, 3, 1):
        assert alike and alike <= {(x["a"], x["b"]) for x in near_dup._meetings(docs, root, 75, slots).collect()}
    # at most n - ceil(3 n / 4) + 1 entries of a set are exchanged, and never all of them
    assert all(x.count() <= sum(len(s) - -(-75 * len(s) // 100) + 1 for s in sets) for x in written)
