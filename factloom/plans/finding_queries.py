"""Queries over findings, evidence, endpoints and callers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import gate, learn, linking, risks, spans
from . import bindings as b
from .registry import query

_SEV = "CASE WHEN confidence * 100 >= 80 THEN 'error' WHEN confidence * 100 >= 50 THEN 'warning' ELSE 'note' END"


@query(f"WITH {b.FINDINGS}, {b.EVIDENCE} SELECT fd.fid, concept, evd.path AS path, evd.start_line AS start_line, evd.end_line AS end_line FROM fd JOIN evd ON fd.primary_eid = evd.eid")
def finding_primary_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding with its primary evidence."""
    e = b.evidence(spark, sf_dir).select("eid", "path", "start_line", "end_line")
    return b.findings(spark, sf_dir).select("fid", "concept", F.col("primary_eid").alias("eid")).join(e, "eid").drop("eid")


@query(f"WITH {b.FINDINGS}, {b.EVIDENCE}, g AS (SELECT fid, count(*) AS n, string_agg(CAST(eid AS VARCHAR), ',' ORDER BY eid) AS eids FROM evd WHERE flag <> 'N' GROUP BY fid) SELECT fd.fid, coalesce(n, 0) AS n_refs, coalesce(eids, CAST(primary_eid AS VARCHAR)) AS eids FROM fd LEFT JOIN g USING (fid)")
def evidence_of_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence of a finding; its primary where the bridge has none."""
    g = b.evidence(spark, sf_dir).where("flag <> 'N'").groupBy("fid").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("eid")), ",").alias("eids"))
    return b.findings(spark, sf_dir).join(g, "fid", "left").select("fid", F.coalesce("n", F.lit(0)).alias("n_refs"), F.coalesce("eids", F.col("primary_eid").cast("string")).alias("eids"))


@query(f"WITH {b.FINDINGS} SELECT concept, count(*) AS n, count(DISTINCT rule_id) AS n_rules, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, round(max(confidence), 6) AS top FROM fd GROUP BY concept")
def concept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.findings(spark, sf_dir).groupBy("concept")
    return f.agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("n_rules"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"), F.round(F.max("confidence"), 6).alias("top"))


@query(f"WITH {b.FINDINGS} SELECT {_SEV} AS severity, level, count(*) AS n FROM fd GROUP BY ALL")
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.findings(spark, sf_dir).groupBy(risks.sarif_level(F.col("confidence")).alias("severity"), "level").agg(F.count("*").alias("n"))


@query(f"WITH {b.FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY rule_id, path, start_line, end_line ORDER BY fid) AS n FROM fd) SELECT fid, rule_id, path, start_line FROM r WHERE n = 1")
def findings_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.first_of(b.findings(spark, sf_dir), ["rule_id", "path", "start_line", "end_line"], ["fid"]).select("fid", "rule_id", "path", "start_line")


@query(f"WITH {b.FINDINGS}, k AS (SELECT * FROM fd WHERE level <> 'L1' AND confidence >= 0.2 AND fid % 50 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY fid) AS nth FROM k) SELECT fid, concept, nth FROM r WHERE nth > 100")
def policy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings beyond a concept's threshold under a policy."""
    f = b.findings(spark, sf_dir)
    allow = f.where("fid % 50 = 0").select("fid")
    return gate.beyond_threshold(f, allow, 2, 0.2, 100).select("fid", "concept", F.col("nth").cast("bigint").alias("nth"))


_RULES = [("n_findings", "<=", 1000.0, "warn"), ("error_share", "<=", 0.05, "fail"), ("l1_share", "<", 0.5, "warn"), ("n_concepts", "==", 5.0, "fail")]
_METRICS = f"""m AS (SELECT count(*) AS n, count(*) FILTER (confidence * 100 >= 80) AS e, count(*) FILTER (level = 'L1') AS l, count(DISTINCT concept) AS c FROM fd),
 x AS (SELECT 'n_findings' AS metric, CAST(n AS DOUBLE) AS actual FROM m UNION ALL SELECT 'error_share', CAST(e AS DOUBLE) / nullif(n, 0) FROM m UNION ALL SELECT 'l1_share', CAST(l AS DOUBLE) / nullif(n, 0) FROM m UNION ALL SELECT 'n_concepts', CAST(c AS DOUBLE) FROM m),
 v AS (SELECT * FROM (VALUES {", ".join(str(r) for r in _RULES)}) AS r(metric, op, value, level) JOIN x USING (metric) WHERE NOT CASE op WHEN '<=' THEN actual <= value WHEN '<' THEN actual < value WHEN '==' THEN actual = value ELSE false END)"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = b.findings(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") * 100 >= 80).alias("e"), F.count_if(F.col("level") == "L1").alias("l"), F.countDistinct("concept").alias("c"))
    pairs = [("n_findings", F.col("n").cast("double")), ("error_share", F.try_divide("e", "n")), ("l1_share", F.try_divide("l", "n")), ("n_concepts", F.col("c").cast("double"))]
    return m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("actual")) for k, v in pairs])).alias("x")).select("x.*")


@query(f"WITH {b.FINDINGS}, {_METRICS} SELECT metric, op, CAST(value AS DOUBLE) AS value, level, round(actual, 6) AS actual FROM v")
def gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate rules that the metrics break."""
    rules = spark.createDataFrame(_RULES, "metric string, op string, value double, level string")
    return gate.violations(_metrics(spark, sf_dir), rules).select("metric", "op", "value", "level", F.round("actual", 6).alias("actual"))


@query(f"WITH {b.FINDINGS}, {_METRICS} SELECT CASE max(CASE level WHEN 'fail' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status, count(*) AS n_violations FROM v")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "metric string, op string, value double, level string")
    return gate.worst(gate.violations(_metrics(spark, sf_dir), rules))


_DIFF = f"""o AS (SELECT sha1(concat(rule_id, '|', path, '|', fid)) AS fp, {_SEV} AS s FROM fd WHERE fid % 10 < 9),
 n AS (SELECT sha1(concat(rule_id, '|', path, '|', fid)) AS fp, CASE WHEN fid % 4 = 0 THEN 'error' ELSE {_SEV} END AS s FROM fd WHERE fid % 10 > 0),
 d AS (SELECT coalesce(o.fp, n.fp) AS fp, o.s AS old_severity, n.s AS new_severity, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' WHEN o.s = n.s THEN 'same'
   WHEN n.s = 'error' OR (n.s = 'warning' AND o.s = 'note') THEN 'upgraded' ELSE 'downgraded' END AS state FROM o FULL JOIN n ON o.fp = n.fp)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.findings(spark, sf_dir).withColumn("fp", gate.fingerprint("rule_id", "path", "fid")).withColumn("severity", risks.sarif_level(F.col("confidence")))
    new = f.where("fid % 10 > 0").withColumn("severity", F.when(F.col("fid") % 4 == 0, "error").otherwise(F.col("severity")))
    return gate.baseline_diff(f.where("fid % 10 < 9"), new)


@query(f"WITH {b.FINDINGS}, {_DIFF} SELECT * FROM d")
def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' findings by fingerprint."""
    return _diff(spark, sf_dir)


@query(f"WITH {b.FINDINGS}, {_DIFF} SELECT count(*) FILTER (state = 'added' AND new_severity = 'error') AS added_error, count(*) FILTER (state = 'added' AND new_severity = 'warning') AS added_warning, count(*) FILTER (state = 'upgraded') AS upgrades, count(*) FILTER (state = 'removed') AS removed FROM d")
def baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("state"), F.col("new_severity")
    return _diff(spark, sf_dir).agg(
        F.count_if((s == "added") & (n == "error")).alias("added_error"), F.count_if((s == "added") & (n == "warning")).alias("added_warning"), F.count_if(s == "upgraded").alias("upgrades"), F.count_if(s == "removed").alias("removed")
    )


@query(
    """SELECT 'nation_region' AS "check", count(*) AS n_missing FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT 'order_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'line_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'line_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'document_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each table refer to nothing."""
    t = lambda n: b.table(spark, sf_dir, n)
    checks = [("nation", "n_regionkey", "region", "r_regionkey", "nation_region"), ("orders", "o_custkey", "customer", "c_custkey", "order_customer"), ("lineitem", "l_orderkey", "orders", "o_orderkey", "line_order"), ("lineitem", "l_partkey", "part", "p_partkey", "line_part"), ("documents", "doc_id", "labels", "doc_id", "document_label")]
    out = None
    for rows, key, parents, parent_key, name in checks:
        one = gate.orphans(t(rows), key, t(parents), parent_key, name)
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT p_brand, coalesce(n, 0) AS n_hits FROM (SELECT DISTINCT p_brand FROM part) LEFT JOIN (SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY p_brand) USING (p_brand)")
def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule group with its hits, zero where it has none."""
    part = b.table(spark, sf_dir, "part")
    hits = b.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).join(part.where("p_size < 10").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand").agg(F.count("*").alias("n"))
    return part.select("p_brand").distinct().join(hits, "p_brand", "left").select("p_brand", F.coalesce("n", F.lit(0)).alias("n_hits"))


@query(f"WITH {b.FINDINGS}, h AS (SELECT path, count(*) AS n FROM fd GROUP BY path UNION ALL SELECT concat('src/', l_partkey % 97, '.py'), count(*) FROM lineitem GROUP BY 1) SELECT path, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY path ORDER BY n DESC, path LIMIT 20")
def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by findings and evidence together."""
    rows = b.findings(spark, sf_dir).select("path").unionByName(b.evidence(spark, sf_dir).select("path"))
    return rows.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(20)


@query(f"WITH {b.FINDINGS} SELECT fid, concept, round(confidence, 6) AS confidence FROM fd ORDER BY fd.confidence DESC, CASE level WHEN 'L3' THEN 0 WHEN 'L2' THEN 1 ELSE 2 END, fid LIMIT 50")
def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = F.when(F.col("level") == "L3", 0).when(F.col("level") == "L2", 1).otherwise(2)
    return b.findings(spark, sf_dir).orderBy(F.desc("confidence"), strength, "fid").limit(50).select("fid", "concept", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {b.FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY level DESC, confidence DESC, fid) AS n FROM fd) SELECT concept, fid, n FROM r WHERE n <= 3")
def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest findings of each concept."""
    order = Window.partitionBy("concept").orderBy(F.desc("level"), F.desc("confidence"), "fid")
    return b.findings(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n <= 3").select("concept", "fid", F.col("n").cast("bigint").alias("n"))


@query(f"WITH {b.FINDINGS}, {b.EVIDENCE}, c AS (SELECT fid, count(*) AS n, count(DISTINCT path) AS np FROM evd GROUP BY fid) SELECT fd.fid, substr(sha1(concat(fd.fid, '|', concept, '|', level)), 1, 12) AS case_id, CASE WHEN n >= 5 AND np > 1 THEN 3 WHEN n >= 3 OR level = 'L3' THEN 2 ELSE 1 END AS difficulty FROM fd JOIN c USING (fid)")
def case_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn.difficulty(b.findings(spark, sf_dir), b.evidence(spark, sf_dir))


@query(
    f"WITH {b.FINDINGS}, t AS (SELECT fid, unnest(list_filter([CASE WHEN concept LIKE '1%' OR concept LIKE '2%' THEN 'urgency' END, CASE WHEN rule_id = 'rule.F' THEN 'finished' END, CASE WHEN level = 'L3' THEN 'ast' END], lambda x: x IS NOT NULL)) AS tag FROM fd) SELECT fid, tag FROM t UNION ALL SELECT fid, concept FROM fd WHERE fid NOT IN (SELECT fid FROM t)"
)
def concept_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three tags for each finding, its own concept where none applies."""
    c = F.col("concept")
    tags = F.array_compact(F.array(F.when(c.startswith("1") | c.startswith("2"), "urgency"), F.when(F.col("rule_id") == "rule.F", "finished"), F.when(F.col("level") == "L3", "ast")))
    return b.findings(spark, sf_dir).select("fid", F.explode(F.when(F.size(tags) > 0, tags).otherwise(F.array(c))).alias("tag"))


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS c, (n_nationkey - 1) // 2 AS p FROM nation WHERE n_nationkey > 0), w AS (SELECT CAST(n_nationkey AS BIGINT) AS start, CAST(n_nationkey AS BIGINT) AS node, 0 AS depth FROM nation
    UNION ALL SELECT w.start, CAST(e.p AS BIGINT), depth + 1 FROM w JOIN e ON w.node = e.c WHERE depth < 4) SELECT start, node, min(depth) AS depth FROM w GROUP BY start, node"""
)
def learning_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisites of each concept to a depth of four."""
    n = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("concept"))
    return learn.prerequisites(n, n.where("concept > 0").select("concept", F.expr("(concept - 1) div 2").alias("needs")), 4)


@query(f"WITH {b.FINDINGS} SELECT path, count(*) FILTER (fid % 10 < 9 AND fid % 10 > 0) AS unchanged, count(*) FILTER (fid % 10 = 9) AS fresh FROM fd WHERE fid % 10 > 0 GROUP BY path")
def incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the current findings, those the base run has unchanged and those it lacks."""
    f = b.findings(spark, sf_dir)
    now, base = f.where("fid % 10 > 0"), f.where("fid % 10 < 9").select("fid", F.lit(1).alias("known")).distinct()
    return now.join(base, "fid", "left").groupBy("path").agg(F.count_if(F.col("known") == 1).alias("unchanged"), F.count_if(F.col("known").isNull()).alias("fresh"))


@query(f"WITH {b.FINDINGS}, {_DIFF} SELECT fp, s FROM o EXCEPT SELECT fp, s FROM n")
def pack_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one context pack has and another lacks."""
    d = _diff(spark, sf_dir).where("old_severity is not null and (new_severity is null or old_severity <> new_severity)")
    return d.select("fp", F.col("old_severity").alias("s")).distinct()


_LINKS = f"""{b.ENDPOINTS}, {b.CALLERS}, x AS (SELECT ca.caller_id, min(ep.endpoint_id) AS endpoint_id FROM ca JOIN ep USING (method, path) GROUP BY ca.caller_id),
 es AS (SELECT *, list_filter(string_split(path, '/'), lambda v: v <> '') AS t FROM ep), cs AS (SELECT *, list_filter(string_split(path, '/'), lambda v: v <> '') AS s FROM ca WHERE caller_id NOT IN (SELECT caller_id FROM x)),
 tp AS (SELECT caller_id, endpoint_id, row_number() OVER (PARTITION BY caller_id ORDER BY es.path, endpoint_id) AS n FROM cs JOIN es ON cs.method = es.method AND len(t) = len(s) AND es.path LIKE '%{{%}}%'
   AND len(list_filter(range(1, len(t) + 1), lambda i: NOT (t[i] = s[i] OR regexp_matches(t[i], '^\\{{[^{{}}]+\\}}$')))) = 0 AND len(list_filter(t, lambda v: regexp_matches(v, '^\\{{[^{{}}]+\\}}$'))) > 0),
 lk AS (SELECT caller_id, endpoint_id, 'exact' AS match_type FROM x UNION ALL SELECT caller_id, endpoint_id, 'template' FROM tp WHERE n = 1)"""


@query(f"WITH {_LINKS} SELECT caller_id, endpoint_id, match_type, sha1(concat(caller_id, '|', endpoint_id, '|', match_type)) AS link_id FROM lk")
def caller_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers linked to endpoints, exactly or by template."""
    return linking.links(b.callers(spark, sf_dir), b.endpoints(spark, sf_dir)).select("caller_id", "endpoint_id", "match_type", "link_id")


@query(f"WITH {_LINKS} SELECT (SELECT count(*) FROM ca WHERE caller_id NOT IN (SELECT caller_id FROM lk)) AS unmatched_callers, (SELECT count(*) FROM ep WHERE endpoint_id NOT IN (SELECT endpoint_id FROM lk)) AS unmatched_endpoints, (SELECT count(*) FROM lk WHERE match_type = 'exact') AS exact, (SELECT count(*) FROM lk WHERE match_type = 'template') AS template")
def link_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, e = b.callers(spark, sf_dir), b.endpoints(spark, sf_dir)
    lk = linking.links(c, e)
    flags = [c.join(lk.select("caller_id"), "caller_id", "left_anti").select(F.lit("c").alias("k")), e.join(lk.select("endpoint_id"), "endpoint_id", "left_anti").select(F.lit("e").alias("k")), lk.select(F.col("match_type").alias("k"))]
    rows = flags[0].union(flags[1]).union(flags[2])
    return rows.agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in (("c", "unmatched_callers"), ("e", "unmatched_endpoints"), ("exact", "exact"), ("template", "template"))])


@query(f"WITH {b.ENDPOINTS}, {b.CALLERS} SELECT method, path, 'missing_in_spec' AS side FROM (SELECT method, path FROM ca EXCEPT SELECT method, path FROM ep) UNION ALL SELECT method, path, 'missing_in_code' FROM (SELECT method, path FROM ep EXCEPT SELECT method, path FROM ca)")
def surface_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, spec = b.callers(spark, sf_dir), b.endpoints(spark, sf_dir)
    keys = ["method", "path"]
    return linking.missing(code, spec, keys).withColumn("side", F.lit("missing_in_spec")).unionByName(linking.missing(spec, code, keys).withColumn("side", F.lit("missing_in_code")))


@query(f"WITH {b.ENDPOINTS}, {b.CALLERS}, c AS (SELECT path, string_agg(DISTINCT method, ',' ORDER BY method) AS code_methods FROM ca GROUP BY path), s AS (SELECT path, string_agg(DISTINCT method, ',' ORDER BY method) AS spec_methods FROM ep GROUP BY path) SELECT * FROM c JOIN s USING (path) WHERE code_methods <> spec_methods")
def method_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.method_mismatches(b.callers(spark, sf_dir), b.endpoints(spark, sf_dir))


@query(f"WITH {b.ENDPOINTS}, {b.CALLERS}, c AS (SELECT DISTINCT method, path FROM ca), s AS (SELECT DISTINCT method, path FROM ep) SELECT c.method, c.path, min(s.path) AS spec_path FROM c JOIN s ON c.method = s.method AND c.path <> s.path AND (starts_with(c.path, s.path) OR starts_with(s.path, c.path)) WHERE s.path <> '' AND c.path <> '' GROUP BY ALL")
def suspect_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.suspect_paths(b.callers(spark, sf_dir).where("path <> ''"), b.endpoints(spark, sf_dir).where("path <> ''"))


@query(f"WITH {b.ENDPOINTS} SELECT method, path, count(*) AS n, min(file) AS file FROM ep GROUP BY method, path HAVING count(*) > 1")
def duplicate_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.endpoints(spark, sf_dir).groupBy("method", "path").agg(F.count("*").alias("n"), F.min("file").alias("file")).where("n > 1")


@query("SELECT p_type, p_brand, count(*) AS n_parts, round(avg(p_retailprice), 4) AS mean_price FROM part WHERE contains(lower(p_name), 'a') AND p_size > 10 GROUP BY ALL")
def concept_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by part of a name with a second filter, grouped by category."""
    rows = b.table(spark, sf_dir, "part").where(F.lower("p_name").contains("a") & (F.col("p_size") > 10))
    return rows.groupBy("p_type", "p_brand").agg(F.count("*").alias("n_parts"), F.round(F.avg("p_retailprice"), 4).alias("mean_price"))
