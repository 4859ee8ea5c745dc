"""Queries over files: the walk, skip reasons, text rules, scoring, redaction, line structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import files as ff
from ..functions import paths as fp
from ..operators import extract, walk
from . import bindings as b
from .registry import query

# Rules over the words that the documents have.
RULES = [
    walk.Rule("en_prose", ["the", "and"], ["of", "with"], ["license", "token"], ["the"], ["token"], 0.02, 0.01, 0.05, 0.35),
    walk.Rule("fr_prose", ["les", "des"], ["que", "pour"], ["license"], ["les"], [], 0.03, 0.01, 0.05, 0.35),
    walk.Rule("de_prose", ["der", "und"], ["mit", "nicht"], ["license"], ["und"], ["license"], 0.03, 0.02, 0.05, 0.4),
    walk.Rule("es_prose", ["los", "de la"], ["que"], ["the"], ["de la"], [], 0.03, 0.01, 0.05, 0.3),
]


SKIP = """CASE WHEN regexp_matches(path, '(^|/)(src0|src7)(/)') THEN 'ignored_dir' WHEN regexp_extract(path, '(\\.[^./]*)$', 1) IN ('.es') THEN 'ignored_ext'
 WHEN size > 5000 THEN 'too_large'
 WHEN length(substr(content, 1, 8192)) > 0 AND length(regexp_replace(substr(content, 1, 8192), '[^\\t\\n\\r\\x20-\\x7e]', '', 'g')) < length(substr(content, 1, 8192)) * 0.9 THEN 'binary' END"""


def _reason() -> Column:
    return walk.skip_reason(F.col("path"), F.col("size"), F.col("content"), dirs=["src0", "src7"], extensions=[".es"], max_bytes=5000, printable=0.9)


@query(f"WITH {b.FILES} SELECT path, size, {SKIP} AS reason FROM files")
def skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered classification of every file; null keeps it."""
    return b.files(spark, sf_dir).select("path", "size", _reason().alias("reason"))


@query(
    f"""WITH {b.FILES}, r AS (SELECT path, {SKIP} AS reason FROM files WHERE size >= 0), s AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY path) AS n FROM r WHERE reason IS NOT NULL)
    SELECT reason, count(*) AS n_files, string_agg(path, ',' ORDER BY path) FILTER (n <= 20) AS samples FROM s GROUP BY reason"""
)
def skip_counts_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipped files by reason, with the first twenty of each."""
    return walk.skip_counts(b.files(spark, sf_dir).select("path", _reason().alias("reason")))


@query(
    f"""WITH {b.FILES}, w AS (SELECT path, source, size, count(*) OVER p AS n, sum(size) OVER p AS total FROM files WINDOW p AS (PARTITION BY source ORDER BY path ROWS UNBOUNDED PRECEDING))
    SELECT path, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, n <= 30 AND total <= 60000 AS included FROM w"""
)
def walk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count and bytes of each root's walk against its budgets."""
    return walk.within_budget(b.files(spark, sf_dir), "source", max_files=30, max_bytes=60000).select("path", "n", "total", "included")


@query(
    f"""WITH {b.FILES} SELECT path, CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) WHEN '.py' THEN 'python' ELSE 'text' END AS lang, size, sha256(content) AS sha256,
    CAST(len(string_split(rtrim(content, chr(10)), chr(10))) AS BIGINT) AS n_lines FROM files"""
)
def file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("content")
    return b.files(spark, sf_dir).select("path", ff.language(F.col("path")).alias("lang"), "size", F.sha2(text, 256).alias("sha256"), F.size(F.split(F.regexp_replace(text, "\n+$", ""), "\n")).cast("bigint").alias("n_lines"))


@query(f"WITH {b.FILES} SELECT source, sha256(string_agg(concat(path, ':', sha256(content), chr(10)), '' ORDER BY path)) AS content_id, count(*) AS n FROM files GROUP BY source")
def content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of each root over its files' digests in path order."""
    return walk.content_id(b.files(spark, sf_dir), "source")


@query(
    f"""WITH {b.FILES}, t AS (SELECT path, string_split(content, chr(10)) AS l FROM files)
    SELECT path, array_to_string(l[1:3], chr(10)) AS head, len(l) > 3 AS truncated FROM t"""
)
def read_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of each file and whether more followed."""
    lines = F.split("content", "\n")
    return b.files(spark, sf_dir).select("path", F.array_join(F.slice(lines, 1, 3), "\n").alias("head"), (F.size(lines) > 3).alias("truncated"))


@query(
    f"""WITH {b.FILES}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files)
    SELECT path, CAST(line_no AS BIGINT) AS line_no, CAST(len(regexp_extract_all(lower(line), 'thth|ouou')) AS BIGINT) AS hits FROM l WHERE len(regexp_extract_all(lower(line), 'thth|ouou')) > 0"""
)
def text_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a text rule by line, case aside."""
    return extract.line_hits(extract.lines_of(b.files(spark, sf_dir)), "thth|ouou").select("path", "line_no", "hits")


def _scored_sql() -> str:
    """Counts words by cutting texts into words, and phrases as runs of them, line by line for the first place."""
    said, need, stop = [], [], []
    for r in RULES:
        weights = [(w, r.weight_strong) for w in r.strong] + [(w, r.weight_medium) for w in r.medium] + [(w, -r.penalty) for w in r.negative]
        said += [f"('{r.rule_id}', '{w}', {x}, {k}, {r.base})" for k, (w, x) in enumerate(weights)]
        need += [f"('{r.rule_id}', '{w}')" for w in r.required]
        stop += [f"('{r.rule_id}', '{w}')" for w in r.blocking if w in r.negative]
    gap = r"[^\pL\pN_]"
    return f"""WITH {b.FILES}, said AS (SELECT * FROM (VALUES {', '.join(said)}) AS t(rule_id, word, weight, k, base)),
    need AS (SELECT * FROM (VALUES {', '.join(need)}) AS t(rule_id, word)), stop AS (SELECT * FROM (VALUES {', '.join(stop)}) AS t(rule_id, word)),
    lines AS (SELECT path, unnest(string_split(lower(content), chr(10))) AS line, generate_subscripts(string_split(lower(content), chr(10)), 1) AS n FROM files),
    tokens AS (SELECT path, n, unnest(regexp_split_to_array(line, '{gap}+')) AS word FROM lines),
    phrases AS (SELECT path, n, word FROM (SELECT path, n, unnest(regexp_extract_all(concat(' ', regexp_replace(line, '({gap})', '\\1\\1', 'g'), ' '), '{gap}(de  la){gap}', 1)) AS word FROM lines)),
    words AS (SELECT path, n, word FROM tokens UNION ALL SELECT path, n, 'de la' FROM phrases),
    counts AS (SELECT path, word, count(*) AS c, min(n) AS n FROM words WHERE word IN (SELECT word FROM said) GROUP BY path, word),
    hits AS (SELECT path, rule_id, sum(c * weight) AS total, min(base) AS base, arg_min(n, k) AS start_line, list(word) AS found FROM counts JOIN said USING (word) GROUP BY path, rule_id),
    kept AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM need WHERE need.rule_id = h.rule_id AND NOT list_contains(h.found, need.word))
        AND NOT EXISTS (SELECT 1 FROM stop WHERE stop.rule_id = h.rule_id AND list_contains(h.found, stop.word)))
    SELECT path, rule_id, round(CAST(greatest(0, least(1, total)) AS DOUBLE), 6) AS score, CAST(greatest(round(greatest(0, least(1, total)), 6), base) AS DOUBLE) AS confidence,
        CAST(start_line AS INTEGER) AS start_line FROM kept"""


@query(_scored_sql())
def signal_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted signals with required and blocking markers: at most one finding for each file and rule, at its first signal."""
    return walk.score_rules(b.files(spark, sf_dir), RULES)


@query(
    f"""WITH {b.FILES}, r AS (SELECT path, regexp_replace(content, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<mail>', 'g') AS a, len(regexp_extract_all(content, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) AS n_mail FROM files)
    SELECT path, sha256(regexp_replace(a, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}', '<ip>', 'g')) AS redacted_sha, CAST(n_mail AS BIGINT) AS n_mail,
    CAST(len(regexp_extract_all(a, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')) AS BIGINT) AS n_ip FROM r"""
)
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered replacements with a count of each class before its step."""
    classes = [("mail", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<mail>"), ("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<ip>")]
    return walk.redact(b.files(spark, sf_dir), "content", classes).select("path", F.sha2("content", 256).alias("redacted_sha"), "n_mail", "n_ip")


@query(
    f"""WITH {b.FILES}, t AS (SELECT path, doc_id, string_split(content, chr(10)) AS l FROM files), s AS (SELECT *, doc_id % 5 + 2 AS a, doc_id % 5 + 3 AS e FROM t)
    SELECT path, array_to_string(l[greatest(1, a - 2):least(len(l), e + 2)], chr(10)) AS snippet FROM s"""
)
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("doc_id") % 5 + 2).cast("int")
    return b.files(spark, sf_dir).select("path", ff.snippet(F.split("content", "\n"), a, a + 1, 2).alias("snippet"))


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*(.*)$', 1) AS raw FROM pages),
    c AS (SELECT page_id, raw, regexp_replace(regexp_replace(trim(raw), '/{2,}', '/', 'g'), ':([A-Za-z_][A-Za-z0-9_]*)', '{\\1}', 'g') AS api,
          regexp_replace(regexp_replace(raw, '[?#].*$', ''), '/{2,}', '/', 'g') AS link FROM p)
    SELECT page_id, CASE WHEN regexp_replace(api, '(.)/+$', '\\1') = '' THEN '/' WHEN starts_with(regexp_replace(api, '(.)/+$', '\\1'), '/') THEN regexp_replace(api, '(.)/+$', '\\1') ELSE concat('/', regexp_replace(api, '(.)/+$', '\\1')) END AS api_path,
    CASE WHEN regexp_replace(link, '(.)/+$', '\\1') = '' THEN '/' ELSE regexp_replace(link, '(.)/+$', '\\1') END AS link_path,
    CAST(len(list_filter(string_split(regexp_replace(link, '(.)/+$', '\\1'), '/'), lambda x: x <> '')) AS BIGINT) AS n_segments FROM c"""
)
def path_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both normal forms of a path, and how many segments it has."""
    pages = b.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*(.*)$", 1).alias("raw"))
    return pages.select("page_id", fp.api_path(F.col("raw")).alias("api_path"), fp.link_path(F.col("raw")).alias("link_path"), F.size(fp.segments(fp.link_path(F.col("raw")))).cast("bigint").alias("n_segments"))


@query("""SELECT page_id, lower(h) AS href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages) GROUP BY ALL""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct link targets of each page."""
    hrefs = b.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("h"))
    return hrefs.groupBy("page_id", F.lower("h").alias("href")).agg(F.count("*").alias("n"))


@query(
    """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'licen|wh') THEN 'evidence' WHEN regexp_matches(lower(text), 'que|ung') THEN 'risk' WHEN regexp_matches(lower(text), 'ción|ment') THEN 'flow'
    WHEN regexp_matches(lower(text), 'and|der') THEN 'summary' ELSE 'unsupported' END AS class FROM conversations"""
)
def question_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first class, in order of priority, of which a question has a keyword."""
    classes = [("evidence", ["licen", "wh"]), ("risk", ["que", "ung"]), ("flow", ["ción", "ment"]), ("summary", ["and", "der"])]
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", walk.classify(F.col("text"), classes).alias("class"))


@query(
    f"""WITH {b.FILES}, l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files),
    k AS (SELECT doc_id, n, line, CASE WHEN regexp_matches(line, '^[A-Z]{{3,}}') THEN n END AS head FROM l)
    SELECT doc_id, CAST(n AS BIGINT) AS line_no, CAST(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS current_head FROM k"""
)
def forward_fill_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the last heading at or before it: the state that line parsers carry."""
    rows = extract.lines_of(b.files(spark, sf_dir), "doc_id")
    head = F.when(F.col("line").rlike("^[A-Z]{3,}"), F.col("line_no"))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("doc_id", "line_no", F.last(head, ignorenulls=True).over(order).alias("current_head"))


@query(
    f"""WITH {b.FILES}, l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files),
    k AS (SELECT doc_id, n, CASE WHEN regexp_matches(line, '^[A-Z]{{3,}}') THEN n END AS head FROM l)
    SELECT doc_id, CAST(n AS BIGINT) AS line_no, CAST(first_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS BIGINT) AS next_head FROM k"""
)
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the first heading among the six lines after it."""
    rows = extract.lines_of(b.files(spark, sf_dir), "doc_id")
    head = F.when(F.col("line").rlike("^[A-Z]{3,}"), F.col("line_no"))
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, 6)
    return rows.select("doc_id", "line_no", F.first(head, ignorenulls=True).over(order).alias("next_head"))


@query(
    """SELECT item_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)"""
)
def known_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a known snippet verbatim: joined on the hash of its first words, then confirmed."""
    return extract.contains_snippet(b.table(spark, sf_dir, "documents").select("doc_id", "text"), b.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("snippet")))
