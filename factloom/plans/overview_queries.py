"""Queries behind overviews: coverage, capabilities, architecture views, explanations, and checks of libraries and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import spans, walk
from . import bindings as b
from .registry import query


@query(f"WITH {b.FILES}, r AS (SELECT CASE WHEN size > 5000 THEN 'too_large' WHEN path LIKE '%.es' THEN 'ignored_ext' WHEN path LIKE 'src7/%' THEN 'ignored_dir' ELSE 'included' END AS reason FROM files) SELECT reason, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM r GROUP BY reason ORDER BY n DESC, reason LIMIT 5")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Included files and the commonest reasons to skip, with their shares."""
    p = F.col("path")
    reason = F.when(F.col("size") > 5000, "too_large").when(p.endswith(".es"), "ignored_ext").when(p.startswith("src7/"), "ignored_dir").otherwise("included")
    n = b.files(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.crossJoin(total).select("reason", "n", F.round(F.col("n") / F.col("total"), 6).alias("share")).orderBy(F.desc("n"), "reason").limit(5)


@query(f"WITH {b.EVENTS}, a AS (SELECT unnest(['python', 'sql', 'openapi', 'typescript', 'java']) AS adapter) SELECT adapter, count(event_id) AS observed, count(event_id) FILTER (kind LIKE 'db%') AS db, count(event_id) FILTER (kind LIKE 'queue%') AS queue, count(event_id) FILTER (kind LIKE 'cache%') AS cache, count(event_id) FILTER (kind = 'api.route') AS api FROM a LEFT JOIN ev ON language = adapter GROUP BY adapter")
def language_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each adapter was seen to emit, zero where nothing."""
    adapters = spark.createDataFrame([(x,) for x in ("python", "sql", "openapi", "typescript", "java")], "adapter string")
    kind = F.col("kind")
    seen = b.events(spark, sf_dir).groupBy(F.col("language").alias("adapter")).agg(
        F.count("*").alias("observed"), F.count_if(kind.startswith("db")).alias("db"), F.count_if(kind.startswith("queue")).alias("queue"), F.count_if(kind.startswith("cache")).alias("cache"), F.count_if(kind == "api.route").alias("api")
    )
    return adapters.join(seen, "adapter", "left").select("adapter", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("observed", "db", "queue", "cache", "api")])


@query(f"WITH {b.EVIDENCE}, f AS (SELECT fid, min(eid) AS eid FROM evd GROUP BY fid), n AS (SELECT f.fid, path FROM f JOIN evd USING (eid)), v AS (SELECT path AS component, count(*) AS n FROM n GROUP BY path) SELECT component, n, row_number() OVER (ORDER BY n DESC, component) AS place FROM v ORDER BY n DESC, component LIMIT 15")
def architecture_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by the path of their first evidence: the fifteen largest components."""
    e = b.evidence(spark, sf_dir)
    first = e.groupBy("fid").agg(F.min_by("path", "eid").alias("component"))
    top = first.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(15)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "component")).cast("bigint"))  # over fifteen rows


@query(f"WITH {b.FINDINGS}, {b.EVIDENCE}, g AS (SELECT fid, count(*) AS n FROM evd GROUP BY fid) SELECT fd.fid, CASE WHEN n >= 2 AND confidence >= 0.5 THEN 'confirmed' WHEN n >= 1 THEN 'inferred' ELSE 'unknown' END AS claim, concat(concept, ' at ', path, ':', start_line) AS because, CASE WHEN n >= 2 THEN NULL ELSE 'more evidence' END AS missing FROM fd LEFT JOIN g USING (fid)")
def explain_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A templated claim for each finding, by how much supports it."""
    n = b.evidence(spark, sf_dir).groupBy("fid").agg(F.count("*").alias("n"))
    rows = b.findings(spark, sf_dir).join(n, "fid", "left")
    claim = F.when((F.col("n") >= 2) & (F.col("confidence") >= 0.5), "confirmed").when(F.col("n") >= 1, "inferred").otherwise("unknown")
    return rows.select("fid", claim.alias("claim"), F.concat("concept", F.lit(" at "), "path", F.lit(":"), F.col("start_line").cast("string")).alias("because"), F.when(F.col("n") >= 2, F.lit(None).cast("string")).otherwise("more evidence").alias("missing"))


@query(f"WITH {b.EVENTS}, {b.FINDINGS}, s AS (SELECT 'events_by_kind' AS section, kind AS key, count(*) AS n FROM ev GROUP BY kind UNION ALL SELECT 'events_by_language', language, count(*) FROM ev GROUP BY language UNION ALL SELECT 'findings_by_level', level, count(*) FROM fd GROUP BY level UNION ALL SELECT 'findings_by_concept', concept, count(*) FROM fd GROUP BY concept) SELECT * FROM s")
def backend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the backend report: one pass over each table."""
    ev, fd = b.events(spark, sf_dir), b.findings(spark, sf_dir)

    def sections(df: DataFrame, names: dict[str, str]) -> DataFrame:
        cols = [F.col(c) for c in names]
        sets = df.groupingSets([[c] for c in cols], *cols).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
        section, key, width = F.lit(None), F.lit(None), len(names)
        for i, (c, name) in enumerate(names.items()):
            own = F.col("g") == (1 << width) - 1 - (1 << width - 1 - i)
            section, key = F.when(own, name).otherwise(section), F.when(own, F.col(c)).otherwise(key)
        return sets.select(section.alias("section"), key.alias("key"), "n")

    return sections(ev, {"kind": "events_by_kind", "language": "events_by_language"}).union(sections(fd, {"level": "findings_by_level", "concept": "findings_by_concept"}))


@query("SELECT 'dangling' AS problem, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1) UNION ALL SELECT 'duplicate', p_name FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT 'no_category', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0")
def concept_graph_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling references, duplicate names, and missing categories."""
    t = lambda n: b.table(spark, sf_dir, n)
    dangling = t("customer").join(t("nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_anti").select(F.lit("dangling").alias("problem"), F.col("c_custkey").cast("string").alias("id"))
    twice = t("part").groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate"), "p_name")
    bare = t("supplier").where("s_acctbal < 0").select(F.lit("no_category"), F.col("s_suppkey").cast("string"))
    return dangling.union(twice).union(bare)


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no_text' WHEN lang IS NULL THEN 'no_lang' WHEN n_chars < 50 THEN 'too_short' ELSE 'ok' END AS state FROM documents")
def case_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first required field that a case lacks."""
    text = F.col("text")
    state = F.when(text.isNull() | (F.trim(text) == ""), "no_text").when(F.col("lang").isNull(), "no_lang").when(F.col("n_chars") < 50, "too_short").otherwise("ok")
    return b.table(spark, sf_dir, "documents").select("doc_id", state.alias("state"))


_KEYED = f"{b.EVENTS}, k AS (SELECT DISTINCT kind, language FROM ev WHERE k < 10), o AS (SELECT DISTINCT kind, language FROM ev WHERE k >= 10 AND language <> 'go')"


@query(f"WITH {_KEYED} SELECT substr(sha1(concat(kind, ':', language)), 1, 12) AS event_id, kind, language FROM k WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.kind = k.kind AND o.language = k.language)")
def missing_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes that the store doesn't have yet."""
    ev = b.events(spark, sf_dir).select("kind", "language", "k")
    keys = ["kind", "language"]
    rows = ev.where("k < 10").select(keys).distinct().join(ev.where("k >= 10 and language <> 'go'").select(keys), keys, "left_anti")
    return rows.withColumn("event_id", F.substring(F.sha1(F.concat("kind", F.lit(":"), "language").cast("binary")), 1, 12))


@query("WITH n AS (SELECT s_suppkey AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + s_nationkey * 1000 AS node_id FROM supplier), e AS (SELECT DISTINCT l_suppkey AS a, l_suppkey % 7 + 1 AS b FROM lineitem) SELECT x.node_id AS from_id, y.node_id AS to_id FROM e JOIN n x ON x.key = e.a JOIN n y ON y.key = e.b")
def edges_with_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by the stored ids of their nodes: two equi-joins."""
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    n = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.row_number().over(order) + F.col("s_nationkey") * 1000).cast("bigint").alias("node_id"))
    e = b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") % 7 + 1).alias("b")).distinct()
    return e.join(n.select(F.col("key").alias("a"), F.col("node_id").alias("from_id")), "a").join(n.select(F.col("key").alias("b"), F.col("node_id").alias("to_id")), "b").select("from_id", "to_id")


@query(f"WITH {b.ENDPOINTS}, m AS (SELECT page_id AS id, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method, concat('api/', page_id % 40, '.py') AS file, length(html) AS size FROM pages WHERE page_id % 2 = 1), x AS (SELECT method, file, max(size) AS meta FROM m GROUP BY ALL) SELECT endpoint_id, method, path, meta FROM ep LEFT JOIN x USING (method, file)")
def endpoint_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints with what the graph says of them, by a composite key."""
    ids = b.table(spark, sf_dir, "pages").select(F.col("page_id").alias("endpoint_id"), F.length("html").cast("bigint").alias("size"))
    ep = b.endpoints(spark, sf_dir)
    meta = ep.join(ids.where("endpoint_id % 2 = 1"), "endpoint_id").groupBy("method", "file").agg(F.max("size").alias("meta"))
    return ep.join(meta, ["method", "file"], "left").select("endpoint_id", "method", "path", "meta")


@query(f"WITH {b.EVENTS}, a AS (SELECT path, kind, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM ev GROUP BY ALL), x AS (SELECT path, kind, CAST(unnest(string_split(ids, ',')) AS BIGINT) AS target FROM a) SELECT target, kind, path FROM x WHERE target % 100 = 0")
def related_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups whose lists of ids contain a target: the lists are exploded and joined."""
    ev = b.events(spark, sf_dir)
    groups = ev.groupBy("path", "kind").agg(F.collect_list("event_id").alias("ids"))
    targets = ev.where("event_id % 100 = 0").select(F.col("event_id").alias("target"))
    return groups.select("path", "kind", F.explode("ids").alias("target")).join(targets, "target").select("target", "kind", "path")


@query(f"WITH {b.EVIDENCE}, d AS (SELECT DISTINCT flag, path, start_line, end_line FROM evd), r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY path, start_line, end_line) AS n FROM d) SELECT flag, path, start_line, end_line FROM r WHERE n <= 30")
def evidence_refs_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct references, thirty of each kind."""
    cols = ["flag", "path", "start_line", "end_line"]
    return spans.first_of(b.evidence(spark, sf_dir).select(cols).distinct(), ["flag"], ["path", "start_line", "end_line"], 30)


@query(f"WITH {b.FINDINGS}, q AS (SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'que|ung') THEN '1-URGENT' WHEN regexp_matches(lower(text), 'the|der') THEN '5-LOW' ELSE 'none' END AS concept FROM conversations), t AS (SELECT concept, fid, row_number() OVER (PARTITION BY concept ORDER BY confidence DESC, fid) AS n FROM fd) SELECT conv_id, turn, q.concept AS topic, fid FROM q LEFT JOIN (SELECT * FROM t WHERE n = 1) b ON b.concept = q.concept")
def ask_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the strongest finding of their topic."""
    q = b.table(spark, sf_dir, "conversations").select("conv_id", "turn", walk.classify(F.col("text"), [("1-URGENT", ["que", "ung"]), ("5-LOW", ["the", "der"])], "none").alias("topic"))
    best = b.findings(spark, sf_dir).groupBy(F.col("concept").alias("topic")).agg(F.max_by("fid", F.struct("confidence", F.negative("fid").alias("f"))).alias("fid"))
    return q.join(F.broadcast(best.where("topic in ('1-URGENT', '5-LOW')")), "topic", "left").select("conv_id", "turn", "topic", "fid")  # two rows at most
