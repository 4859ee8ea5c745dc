"""Queries over documents of unknown shape (JSON at any depth) and over imports between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, jsontree, merkle, modules
from . import bindings as b
from .registry import query

# A document for each event, four levels deep, in SQL that both engines run; {0} and {1} stand for what is redacted.
_NESTED = """concat('{{"home":"key stays","props":', props, ',"who":{{"at":["', {0}, '",', user_id, ',null,{{"deep":{{"log":"', {1}, ' end","n":1.50,"more":[[true,"', {1}, '"],[]]}}}}]}},"say":"q\\"uo\\\\te ', event_type, '"}}')"""
_PLAIN = "concat('/home/u', user_id, '/notes.txt')", "concat('/tmp/run_', event_id)"
_TOKEN = "'<HOME>/notes.txt'", "'<ABS_PATH>'"


@query(f"SELECT event_id, {_NESTED.format(*_TOKEN)} AS doc, CAST(1 AS BIGINT) AS n_home, CAST(2 AS BIGINT) AS n_abs FROM events")
def json_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String leaves of nested documents redacted at any depth; keys, numbers and blanks stay."""
    docs = b.table(spark, sf_dir, "events").select("event_id", F.expr(_NESTED.format(*_PLAIN).replace("\\", "\\\\")).alias("doc"))
    return jsontree.redact(docs, "doc")


# A view for each page with lists of evidence at three depths; ids are order keys, some of them of no order.
_VIEW = """concat('{"views":{"a/b":[{"evidence":["E', page_id, '",', page_id * 3 + 1, ']},{"name":"x","evidence":[]}],"c":{"evidence":["none"],"evidence_count":7}},"evidence":["E', page_id + 1, '"],"tags":["E0"]}')"""


@query(
    """WITH e AS (SELECT page_id, '/views/a~1b/0/evidence/0' AS pointer, concat('E', page_id) AS value, page_id AS id FROM pages
    UNION ALL SELECT page_id, '/views/a~1b/0/evidence/1', CAST(page_id * 3 + 1 AS VARCHAR), page_id * 3 + 1 FROM pages
    UNION ALL SELECT page_id, '/views/c/evidence/0', 'none', NULL FROM pages UNION ALL SELECT page_id, '/evidence/0', concat('E', page_id + 1), page_id + 1 FROM pages)
    SELECT page_id, pointer, value FROM e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = e.id)"""
)
def view_dangling_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of evidence in nested views that no evidence has, with their JSON pointer."""
    views = b.table(spark, sf_dir, "pages").select("page_id", F.expr(_VIEW).alias("view"))
    known = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return jsontree.dangling(views, known, "page_id", "view").withColumnRenamed("key", "page_id")


# For each page a folder: an app that mounts a router under another name, by one of four ways to write its module.
_MODULE = "CASE page_id % 4 WHEN 0 THEN './routes/users' WHEN 1 THEN '../p{0}/routes/users.ts' WHEN 2 THEN './routes/../lib' ELSE 'express' END"
_APP = f"""concat_ws(chr(10), concat('import api from "', {_MODULE.replace("'../p{0}/routes/users.ts'", "concat('../p', page_id, '/routes/users.ts')")}, '"'), 'import other from "./none"', concat('app.use("/v', page_id % 3, '/", api)'), 'app.use("/x", other)')"""


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 3 THEN '/users/{id}' WHEN 2 THEN CASE WHEN lib THEN concat('/v', page_id % 3, '/users/{id}') ELSE '/users/{id}' END
    ELSE CASE WHEN lib THEN '/users/{id}' ELSE concat('/v', page_id % 3, '/users/{id}') END END AS route, CASE WHEN lib THEN 'lib' ELSE 'routes' END AS part
    FROM (SELECT page_id, unnest([true, false]) AS lib FROM pages)"""
)
def module_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of routers that other files import under another name, below the prefix they are mounted at."""
    pages = b.table(spark, sf_dir, "pages")
    route = F.lit('router.get("/users/:id", show)')
    at = lambda tail: F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(tail))
    files = pages.select("page_id", F.explode(F.array(F.struct(at("/app.ts").alias("path"), F.expr(_APP).alias("content")), F.struct(at("/routes/users.ts").alias("path"), route.alias("content")), F.struct(at("/lib/index.ts").alias("path"), route.alias("content")))).alias("f")).select("page_id", "f.*")
    lines = extract.lines_of(files)
    found = modules.with_prefixes(extract.express_routes(lines), modules.mounted(lines, files), "path", "route")
    page = F.regexp_extract("path", "^p([0-9]+)/", 1).cast("bigint")
    return found.select(page.alias("page_id"), "route", F.split("path", "/")[1].alias("part"))


# Documents as files in folders by source and language; in the second tree some have another name or text.
_TREE = "concat(source, '/', coalesce(lang, 'none'), '/', doc_id, '.txt')"
_MOVED = "concat(source, '/', coalesce(lang, 'none'), '/', doc_id, CASE WHEN doc_id % 60 = 2 THEN '.md' ELSE '.txt' END)"
_LEAF = "SELECT {path} AS path, min({digest}) AS digest FROM documents GROUP BY 1"
_TEXT, _OTHER = "sha256(coalesce(text, ''))", "CASE WHEN doc_id % 40 = 3 THEN sha256('other') ELSE sha256(coalesce(text, '')) END"
_FOLDERS = """{n}1 AS (SELECT regexp_replace(path, '/[^/]*$', '') AS path, left(sha256(regexp_extract(path, '[^/]*$')), 3) AS b, string_agg(concat('file ', regexp_extract(path, '[^/]*$'), ' ', digest), chr(10) ORDER BY encode(regexp_extract(path, '[^/]*$'))) AS t FROM {n}0 GROUP BY 1, 2),
{n}2 AS (SELECT path, sha256(string_agg(concat(b, ' ', sha256(t)), chr(10) ORDER BY b)) AS digest FROM {n}1 GROUP BY path),
{n}3 AS (SELECT split_part(path, '/', 1) AS path, left(sha256(split_part(path, '/', 2)), 3) AS b, string_agg(concat('folder ', split_part(path, '/', 2), ' ', digest), chr(10) ORDER BY split_part(path, '/', 2)) AS t FROM {n}2 GROUP BY 1, 2),
{n}4 AS (SELECT path, sha256(string_agg(concat(b, ' ', sha256(t)), chr(10) ORDER BY b)) AS digest FROM {n}3 GROUP BY path),
{n}5 AS (SELECT left(sha256(path), 3) AS b, string_agg(concat('folder ', path, ' ', digest), chr(10) ORDER BY path) AS t FROM {n}4 GROUP BY 1),
{n} AS (SELECT path, true AS is_file, digest FROM {n}0 UNION ALL SELECT path, false, digest FROM {n}2 UNION ALL SELECT path, false, digest FROM {n}4 UNION ALL SELECT '', false, sha256(string_agg(concat(b, ' ', sha256(t)), chr(10) ORDER BY b)) FROM {n}5)"""
_OLD = f"o0 AS ({_LEAF.format(path=_TREE, digest=_TEXT)}), {_FOLDERS.format(n='o')}"
_NEW = f"n0 AS ({_LEAF.format(path=_MOVED, digest=_OTHER)}), {_FOLDERS.format(n='n')}"


def _tree(spark: SparkSession, sf_dir: str, text: str, path: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    return merkle.digests(docs.select(F.lit("").alias("top"), F.expr(path).alias("path"), F.sha2(F.expr(text).cast("binary"), 256).alias("sha256")), "top").drop("root")


@query(f"WITH {_OLD} SELECT path, is_file, digest FROM o")
def tree_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of every folder, from its children's, and of the whole tree."""
    return _tree(spark, sf_dir, "coalesce(text, '')", _TREE)


@query(f"""WITH {_OLD}, {_NEW} SELECT coalesce(o.path, n.path) AS path, coalesce(o.is_file, n.is_file) AS is_file, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' ELSE 'changed' END AS state
    FROM o FULL JOIN n ON o.path = n.path AND o.is_file = n.is_file WHERE o.digest IS DISTINCT FROM n.digest""")
def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and folders that differ between two trees."""
    old = _tree(spark, sf_dir, "coalesce(text, '')", _TREE)
    new = _tree(spark, sf_dir, "CASE WHEN doc_id % 40 = 3 THEN 'other' ELSE coalesce(text, '') END", _MOVED)
    top = F.lit("").alias("root")
    return merkle.changed(old.select(top, "*"), new.select(top, "*")).drop("root")
