"""JSON trees, imports between files, entry points by section and routes from snippets, on small fixtures."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import entrypoints, extract, jsontree, modules, surface


def redacted(value, counts):
    if isinstance(value, str):
        for name, regex, token in jsontree.CLASSES:
            value, n = re.subn(regex, token, value)
            counts[name] += n
        return value
    if isinstance(value, dict):
        return {k: redacted(v, counts) for k, v in value.items()}
    return [redacted(x, counts) for x in value] if isinstance(value, list) else value


def test_redaction_of_any_json(spark):
    r = random.Random(2)
    leaves = ["/home/ann/x", "C:\\Users\\bob\\f.txt", "D:\\data\\x y", "see /tmp/a1 and /var/tmp/b/c", 'a "quote" é \n\t\u2028 😀', "", 1, 2.5, True, None, "a: b", "/HOME/x/y"]

    def tree(depth):
        kind = r.random()
        if depth == 0 or kind < 0.3:
            return r.choice(leaves)
        return {r.choice(["k/home/u", 'q"k', "k:", "z"]) + str(i): tree(depth - 1) for i in range(r.randint(0, 3))} if kind < 0.65 else [tree(depth - 1) for _ in range(r.randint(0, 3))]

    values = [tree(6) for _ in range(150)]
    docs = [(i, json.dumps(v, ensure_ascii=bool(i % 2))) for i, v in enumerate(values)] + [(1000, None), (1001, "no json /home/me/x {"), (1002, "")]
    rows = spark.createDataFrame(docs, "id long, doc string")
    got = {x["id"]: x for x in jsontree.redact(rows, "doc").collect()}
    for i, v in enumerate(values):
        counts = {"home": 0, "abs": 0}
        assert json.loads(got[i]["doc"]) == redacted(v, counts)
        assert {"home": got[i]["n_home"], "abs": got[i]["n_abs"]} == counts
    assert got[1000]["doc"] is None and got[1000]["n_home"] == 0 and got[1001]["doc"] == "no json <HOME>/x {" and got[1001]["n_home"] == 1 and got[1002]["doc"] == ""
    again = {x["id"]: x for x in jsontree.redact(spark.createDataFrame([(x["id"], x["doc"]) for x in got.values()], "id long, doc string"), "doc").collect()}
    assert all(again[i]["doc"] == got[i]["doc"] and again[i]["n_home"] == 0 for i in got)


def pointers(value, at=""):
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else []
    for k, v in items:
        here = f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}"
        yield here
        yield from pointers(v, here)


def test_walk(spark):
    values = [{"a/b": [1, {"c~": []}], "d": {"e": {"f": {"g": [[["x"]]]}}}}, [], 3, "x", {"": None}]
    docs = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(8, "{bad"), (9, None)], "id long, doc string")
    got = [(x["key"], x["pointer"]) for x in jsontree.walk(docs, "id", "doc").collect()]
    assert sorted(got) == sorted((i, p) for i, v in enumerate(values) for p in pointers(v))
    assert jsontree.walk(docs.where("id > 7"), "id", "doc").collect() == []


def test_modules(spark):
    files = [
        ("src/app.ts", "import users from './routes/users'\nimport up from '../lib'\nimport gone from './gone'\nimport ex from 'express'\napp.use('/u', users)\napp.use( \"/lib/\" , up )\napp.use('/x', gone)\napp.use('/y', ex)"),
        ("other.ts", "import a from './src/routes/users.ts'\nimport a from './src/./routes/../routes/users'\napp.use('/a', a)"),
        ("src/routes/users.ts", "router.get('/', h)\nrouter.get('/:id', h)"), ("lib/index.tsx", "router.get('/z', h)"), ("lib.txt", ""), ("top.ts", "import t from '../../outside'\napp.use('/t', t)"), ("outside.ts", ""),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    lines = extract.lines_of(df)
    mounts = modules.mounted(lines, df)
    assert sorted(map(tuple, mounts.collect())) == [("lib/index.tsx", "/lib"), ("src/routes/users.ts", "/a"), ("src/routes/users.ts", "/u")]
    got = modules.with_prefixes(extract.express_routes(lines), mounts, "path", "route")
    assert sorted((r["path"], r["route"]) for r in got.collect()) == [("lib/index.tsx", "/lib/z"), ("src/routes/users.ts", "/a"), ("src/routes/users.ts", "/a/{id}")]


def test_scripts_by_section(spark):
    files = [
        ("pyproject.toml", "[project]\nname = \"n\"\n[project.scripts]\nrun = \"p:main\"\r\n\"quoted-one\" = 'p:b'\n[tool.x]\nlater = \"no\"\n"),
        ("a/setup.cfg", "[metadata]\nname = n\n[options.entry_points]\nconsole_scripts =\n    job = p:main\n    two-b = p:b\ngui_scripts =\n    gui = p:g\n[options]\nzip_safe = no\n"),
        ("b/setup.py", "setup(entry_points={}, console_scripts=['one = p:a', \"two=p:b\",], other=['x=y'])"),
        ("c/compose.yaml", "version: '3'\nservices:\n    web:\n        image: x\n    db:\n        environment:\n            deep:\nvolumes:\n  data:\n"), ("d/docker-compose.yml", "version: 3\n"),
        (".github/workflows/x.yml", "on: push\nname:  Build: all \njobs:\n"), ("r/.github/workflows/y.yaml", "jobs:\n"), (".github/workflows/deep/z.yml", "name: no\n"),
    ]
    got = entrypoints.find(spark.createDataFrame(files, "path string, content string")).collect()
    assert sorted((r["path"], r["title"]) for r in got) == sorted([
        ("pyproject.toml", "console script run"), ("pyproject.toml", "console script quoted-one"), ("a/setup.cfg", "console script job"), ("a/setup.cfg", "console script two-b"), ("b/setup.py", "console script one"),
        ("b/setup.py", "console script two"), ("c/compose.yaml", "Compose up (web, db)"), ("d/docker-compose.yml", "Compose up"), (".github/workflows/x.yml", "Build: all"), ("r/.github/workflows/y.yaml", "y"),
    ])


@pytest.mark.parametrize(("snippet", "want"), [
    ('@app.get("/a")', ("GET", "/a")), ("@auth\n@router.patch( '/b/{id}', tags=['x'])\nasync def f():", ("PATCH", "/b/{id}")), ('@bp.route("/c", methods = ["put", "GET"])', ("PUT", "/c")), ("@app.route('/d')", ("GET", "/d")),
    ("delete /e now", ("DELETE", "/e")), ("@app.get(PATH)", (None, None)), ("@other.get('/f')", (None, None)), ("@app.get('/g", (None, None)), ("", (None, None)), (None, (None, None)), ("mail a@b.c x", ("MAIL", "a@b.c")),
])
def test_route_of_a_snippet(spark, snippet, want):
    rows = spark.createDataFrame([(snippet, None, None)], "s string, m string, r string")
    got = rows.select(*surface.recovered(F.col("m"), F.col("r"), F.coalesce("s", F.lit("")))).first()
    assert tuple(got) == want
