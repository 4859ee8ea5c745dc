"""Queries behind the reports: refs, neighbours, drilldown, exports, run lists and libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import gate, reports, risks, spans
from . import bindings as b
from .registry import query


@query(f"WITH {b.FINDINGS} SELECT count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS mid, count(*) FILTER (confidence < 0.5) AS low FROM fd")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.bands(b.findings(spark, sf_dir))


@query(f"WITH {b.FINDINGS}, {b.EVIDENCE}, s AS (SELECT fid, unnest([primary_eid, primary_eid + 1]) AS ref FROM fd) SELECT s.fid, ref, path, start_line FROM s JOIN evd ON s.ref = evd.eid")
def pattern_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence that a pattern's array of ids names."""
    p = b.findings(spark, sf_dir).select("fid", F.array("primary_eid", F.col("primary_eid") + 1).alias("ids"))
    return reports.exploded_refs(p, "ids", b.evidence(spark, sf_dir).select("eid", "path", "start_line"), "eid").select("fid", "ref", "path", "start_line")


@query("SELECT DISTINCT * FROM (SELECT l_suppkey AS id, 'out' AS direction, l_partkey AS neighbour FROM lineitem UNION ALL SELECT l_partkey, 'in', l_suppkey FROM lineitem)")
def event_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.neighbours(b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))


@query(f"WITH {b.FILES}, r AS (SELECT source, path, size, sum(size) OVER (PARTITION BY source ORDER BY size, path ROWS UNBOUNDED PRECEDING) AS running FROM files) SELECT source, path, CAST(running AS BIGINT) AS running FROM r WHERE running <= 12000")
def drilldown_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of each root, smallest first, within a total of characters."""
    return reports.take_while(b.files(spark, sf_dir).select("source", "path", "size"), ["source"], ["size", "path"], "size", 12000).select("source", "path", "running")


@query(
    f"""WITH {b.EVIDENCE}, g AS (SELECT flag, path, start_line, end_line FROM evd), c AS (SELECT flag, path, count(*) AS n_ranges FROM g GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY n_ranges DESC, path) AS file_rank FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY flag, path ORDER BY start_line, end_line) AS range_rank FROM g)
    SELECT flag, path, start_line, end_line, n_ranges, file_rank FROM r JOIN f USING (flag, path) WHERE file_rank <= 5 AND range_rank <= 8"""
)
def drilldown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few ranges of the files that have the most."""
    rows = b.evidence(spark, sf_dir).select("flag", "path", "start_line", "end_line")
    return reports.capped_files(rows, "flag", 5, 8).select("flag", "path", "start_line", "end_line", "n_ranges", F.col("file_rank").cast("bigint").alias("file_rank"))


@query("SELECT coalesce(n.k, o.k) AS run_id, coalesce(n.v, o.v) AS status, coalesce(n.p, o.p) AS total FROM (SELECT o_custkey AS k, min(o_orderstatus) AS v, round(max(o_totalprice), 2) AS p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) o FULL JOIN (SELECT o_custkey AS k, max(o_orderstatus) AS v, round(max(o_totalprice), 2) AS p FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) n ON o.k = n.k")
def run_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persisted runs overlaid by those in memory."""
    o = b.table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("run_id")).agg(F.min("o_orderstatus").alias("status"), F.round(F.max("o_totalprice"), 2).alias("total"))
    new = o.where("o_orderkey % 2 = 1").groupBy(F.col("o_custkey").alias("run_id")).agg(F.max("o_orderstatus").alias("status"), F.round(F.max("o_totalprice"), 2).alias("total"))
    return reports.overlay(old, new, "run_id", ["status", "total"])


@query(f"WITH {b.FINDINGS}, c AS (SELECT path AS case_id, concept, fid AS version FROM fd), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY version DESC) AS n FROM c) SELECT case_id, concept, version FROM r WHERE n = 1")
def library_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest case of each id after two libraries are merged."""
    f = b.findings(spark, sf_dir).select(F.col("path").alias("case_id"), "concept", F.col("fid").alias("version"))
    return reports.upsert(f.where("version % 2 = 0"), f.where("version % 2 = 1"), "case_id", "version")


@query(
    f"""WITH {b.FINDINGS} SELECT sha1(concat(rule_id, '|', path, '|', start_line, '|', end_line)) AS fp, concat('{{"ruleId":"', rule_id, '","level":"', CASE WHEN confidence * 100 >= 80 THEN 'error' WHEN confidence * 100 >= 50 THEN 'warning' ELSE 'note' END,
    '","message":{{"text":"', concept, '"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"', path, '"}},"region":{{"startLine":', start_line, ',"endLine":', end_line, '}}}}}}],"fingerprints":{{"primary":"', sha1(concat(rule_id, '|', path, '|', start_line, '|', end_line)), '"}}}}') AS result FROM fd"""
)
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as SARIF results."""
    f = b.findings(spark, sf_dir).withColumn("severity", risks.sarif_level(F.col("confidence"))).withColumn("fp", gate.fingerprint("rule_id", "path", "start_line", "end_line"))
    return reports.sarif(f)


@query(f"WITH {b.FILES} SELECT CASE WHEN path LIKE '%.en' THEN 'report' ELSE 'other' END AS kind, path, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM files")
def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.manifest(b.files(spark, sf_dir), {".en": "report"})


@query(
    """SELECT p_brand AS spec_id, p_kind AS kind, string_agg(concat('\\b', regexp_replace(w, '([^A-Za-z0-9_ ])', '\\\\\\1', 'g'), '\\b'), '|' ORDER BY concat('\\b', regexp_replace(w, '([^A-Za-z0-9_ ])', '\\\\\\1', 'g'), '\\b')) AS pattern,
    CASE p_kind WHEN 'text' THEN 'L1' WHEN 'sql_tx' THEN 'L2' ELSE 'L3' END AS parse_level, CASE p_kind WHEN 'python_ast' THEN '**/*.py' WHEN 'sql_tx' THEN '**/*.sql' ELSE '**/*' END AS glob
    FROM (SELECT DISTINCT p_brand, CASE ascii(right(p_brand, 1)) % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'sql_tx' ELSE 'python_ast' END AS p_kind, p_type AS w FROM part) GROUP BY p_brand, p_kind"""
)
def compiled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules compiled from keyword lists."""
    last = F.ascii(F.right("p_brand", F.lit(1))) % 3
    kind = F.when(last == 0, "text").when(last == 1, "sql_tx").otherwise("python_ast")
    specs = b.table(spark, sf_dir, "part").select(F.col("p_brand").alias("spec_id"), kind.alias("kind"), "p_type").groupBy("spec_id", "kind").agg(F.collect_set("p_type").alias("keywords"))
    return reports.rule_patterns(specs)


@query("SELECT n_name AS service, r_name AS infra, count(*) AS n_customers, round(sum(c_acctbal), 2) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def service_infra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services with the infrastructure they declare, weighted."""
    t = lambda n: b.table(spark, sf_dir, n)
    services = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # both dimensions have a fixed size
    by = t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("w"))
    rows = services.join(by, "n_nationkey", "left").groupBy(F.col("n_name").alias("service"), F.col("r_name").alias("infra"))
    return rows.agg(F.sum(F.coalesce("n", F.lit(1))).alias("n_customers"), F.round(F.sum("w"), 2).alias("weight"))


@query(
    f"""WITH {b.EVENTS}, runs AS (SELECT user_id AS run_id, count(*) AS n_events, count(*) FILTER (kind = 'db.transaction') AS n_errors, max(ts) AS last FROM ev GROUP BY user_id)
    SELECT run_id, n_events, n_errors, epoch_us(last) // 1000 AS last_ms FROM runs ORDER BY last DESC, run_id LIMIT 50"""
)
def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with a summary, newest first."""
    errors = F.count_if(F.col("kind") == "db.transaction").alias("n_errors")
    runs = b.events(spark, sf_dir).groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("n_events"), errors, F.max("ts").alias("last"))
    newest = runs.orderBy(F.desc("last"), "run_id").limit(50)
    return newest.select("run_id", "n_events", "n_errors", F.unix_millis(F.col("last").cast("timestamp")).alias("last_ms"))


@query(f"WITH {b.FINDINGS}, g AS (SELECT path, bool_or(concept LIKE '1%') AS has_tx, bool_or(concept LIKE '5%') AS has_queue FROM fd GROUP BY path) SELECT fid, CASE WHEN concept LIKE '1%' AND has_queue THEN 3 WHEN has_tx OR level = 'L3' THEN 2 ELSE 1 END AS case_level FROM fd LEFT JOIN g USING (path)")
def case_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's level from its concept and what else its file has."""
    f, c = b.findings(spark, sf_dir), F.col("concept")
    signals = f.groupBy("path").agg(F.bool_or(c.startswith("1")).alias("has_tx"), F.bool_or(c.startswith("5")).alias("has_queue"))
    return f.join(signals, "path", "left").select("fid", F.when(c.startswith("1") & F.col("has_queue"), 3).when(F.col("has_tx") | (F.col("level") == "L3"), 2).otherwise(1).alias("case_level"))


@query(f"WITH {b.FINDINGS} SELECT concept, level, count(*) AS n_cases, count(*) FILTER (confidence >= 0.5) AS n_sure, grouping(concept) AS all_concepts FROM fd GROUP BY GROUPING SETS ((concept, level), (level))")
def library_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by concept and level, and by level alone."""
    c, lv = F.col("concept"), F.col("level")
    return b.findings(spark, sf_dir).groupingSets([[c, lv], [lv]], c, lv).agg(F.count("*").alias("n_cases"), F.count_if(F.col("confidence") >= 0.5).alias("n_sure"), F.grouping("concept").cast("int").alias("all_concepts"))


@query(f"WITH {b.FINDINGS}, w AS (SELECT rule_id, path, count(*) AS n FROM fd GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, path) AS k FROM w) SELECT rule_id, path, n FROM r WHERE k <= 2")
def brief_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two busiest files of each section of a brief."""
    rows = b.findings(spark, sf_dir).groupBy("rule_id", "path").agg(F.count("*").alias("n"))
    return spans.first_of(rows, ["rule_id"], [F.desc("n"), "path"], 2)


@query(
    f"""WITH {b.ENDPOINTS}, pf AS (SELECT file, min(path) AS prefix FROM ep WHERE endpoint_id % 4 = 0 GROUP BY file) SELECT endpoint_id, method, ep.path AS path, coalesce(prefix, '') AS prefix, concat(coalesce(prefix, ''), ep.path) AS full_path FROM ep LEFT JOIN pf USING (file)"""
)
def endpoint_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints with the router prefix of their file, the smallest of several."""
    ep = b.endpoints(spark, sf_dir)
    prefixes = ep.where("endpoint_id % 4 = 0").groupBy("file").agg(F.min("path").alias("prefix"))
    p = F.coalesce("prefix", F.lit(""))
    return ep.join(prefixes, "file", "left").select("endpoint_id", "method", "path", p.alias("prefix"), F.concat(p, "path").alias("full_path"))


@query(f"WITH {b.FINDINGS} SELECT fid, substr(sha1(concat_ws('|', 'dd', concept, rule_id, path)), 1, 12) AS request_id, substr(sha1(concat(fid, ':E', primary_eid, ':supported_by:', primary_eid)), 1, 12) AS edge_id FROM fd")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request and edge ids from contents alone."""
    eid = F.col("primary_eid").cast("string")
    request = F.sha1(F.concat_ws("|", F.lit("dd"), "concept", "rule_id", "path").cast("binary"))
    edge = F.sha1(F.concat(F.col("fid").cast("string"), F.lit(":E"), eid, F.lit(":supported_by:"), eid).cast("binary"))
    return b.findings(spark, sf_dir).select("fid", F.substring(request, 1, 12).alias("request_id"), F.substring(edge, 1, 12).alias("edge_id"))


@query(f"WITH {b.EVENTS}, w AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM ev), s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM w) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY ALL")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, numbered; an extension beside the stream form."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(order)
    rows = b.events(spark, sf_dir).withColumn("new", F.when(before.isNull() | (F.col("ts") >= before + F.expr("interval 6 hours")), 1).otherwise(0))
    rows = rows.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"))
