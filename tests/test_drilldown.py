import random

import pytest

from factloom.operators import drilldown as dd

REFS = "target string, path string, start_line int, end_line int, confidence double"


def by_hand(refs, files, lim):
    """The same in plain Python: one target at a time, one range at a time."""
    out = {}
    for target in sorted({r[0] for r in refs if r[1]}):
        wins = {}
        for _, path, s, e, c in (r for r in refs if r[0] == target and r[1]):
            a = max(1, (1 if s is None else s) - lim.context_lines)
            wins.setdefault(path, []).append((a, max(a, (a if e is None else e) + lim.context_lines), c or 0.0))
        files_of = []
        for path, rows in wins.items():
            islands = []
            for a, e, c in sorted(rows):
                if islands and a <= islands[-1][1] + dd.NEAR:
                    i = islands[-1]
                    islands[-1] = (i[0], max(i[1], e), max(i[2], c), i[3] + 1)
                else:
                    islands.append((a, e, c, 1))
            files_of.append((path, islands))
        chosen = sorted(files_of, key=lambda f: (-len(f[1]), f[0]))[: lim.max_files]
        items = sorted((path, *i) for path, islands in chosen for i in islands)
        got, total, full, cut, clipped, missing, outside = [], 0, False, 0, 0, 0, 0
        for path, a, e, c, n in items[: lim.max_snippets]:
            if e - a + 1 > lim.max_lines:
                clipped, e = clipped + 1, a + lim.max_lines - 1
            lines = files[path].split("\n") if path in files else None
            text = "\n".join(lines[a - 1 : e]) if lines else ""
            if full or total + len(text) > lim.max_chars:
                full, cut = True, cut + 1
            elif lines is None:
                missing += 1
            elif a > len(lines):
                outside += 1
            else:
                total += len(text)
                got.append((path, a, min(e, len(lines)), c, n, text))
        trace = (sum(len(w) for w in wins.values()), sum(len(i) for _, i in files_of), len(chosen), len(files_of) - len(chosen), max(0, len(items) - lim.max_snippets), clipped, cut, missing, outside, len(got), total)
        out[target] = (got, trace)
    return out


@pytest.mark.parametrize("lim", [dd.Limits(2, 3, 4, 6, 90), dd.Limits(0, 9, 99, 99, 9999), dd.Limits(1, 1, 1, 1, 5)])
def test_packs(spark, lim):
    rng = random.Random(3)
    files = {f"f{i}": "\n".join("é" * rng.randrange(9) for _ in range(rng.randrange(1, 60))) for i in range(6)}
    refs = [(f"t{rng.randrange(9)}", f"f{rng.randrange(8)}", s := rng.randrange(0, 70), s + rng.randrange(-3, 9), rng.random()) for _ in range(150)]
    refs += [("t1", "f1", None, None, None), ("t1", "f1", 3, None, 0.5), ("t2", "", 1, 2, 0.1), ("only", None, 1, 2, 0.1), ("hot", "f2", 5, 6, 0.2)] + [("hot", "f2", 5, 6, 0.2)] * 400
    got = dd.packs(spark.createDataFrame(refs, REFS), spark.createDataFrame(list(files.items()), "path string, content string"), lim).collect()
    assert {r["target"]: ([tuple(s) for s in r["snippets"]], tuple(r["trace"])) for r in got} == by_hand(refs, files, lim)


def test_no_refs(spark):
    none = spark.createDataFrame([], REFS)
    files = spark.createDataFrame([("a", "x")], "path string, content string")
    assert dd.packs(none, files).count() == 0
    items = spark.createDataFrame([("r", "high", "suspected"), ("s", "low", "suspected"), ("t", "high", "confirmed")], "risk_id string, severity string, status string")
    got = {r["risk_id"]: (r["drilled"], r["snippets"]) for r in dd.with_packs(items, none, files).collect()}
    assert got == {"r": (True, None), "s": (False, None), "t": (False, None)}


def test_risks_get_packs_where_needed(spark):
    items = spark.createDataFrame([(f"r{i}", "medium", "suspected") for i in range(8)] + [("z", "high", "suspected")], "risk_id string, severity string, status string")
    refs = spark.createDataFrame([(f"r{i}", "a", 1, 1, 0.5) for i in range(8)] + [("r1", "a", 1, 1, 0.5)], REFS)
    files = spark.createDataFrame([("a", "x\ny")], "path string, content string")
    told = {r["risk_id"]: r for r in dd.with_packs(items, refs, files, most=4).collect()}
    assert sorted(k for k, r in told.items() if r["drilled"]) == ["r0", "r2", "r3", "r4"]
    assert told["r0"]["snippets"][0]["snippet"] == "x\ny" and told["r1"]["snippets"] is None
    assert sum(r["drilled"] for r in dd.with_packs(items, refs, files, always=True, most=99).collect()) == 9
