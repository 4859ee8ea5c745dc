"""Queries over events: kinds, patterns, risks, spans, and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import events as fe
from ..operators import patterns as op
from ..operators import risks, spans
from ..streaming import incremental
from . import bindings as b
from .registry import query

_ID = "substr(sha1(concat('{0}||', path)), 1, 12)"
_FLAGS = """fl AS (SELECT path, max(CASE WHEN kind = 'api.route' THEN 1 ELSE 0 END) AS api, max(CASE WHEN kind = 'db.write' THEN 1 ELSE 0 END) AS dbw, max(CASE WHEN kind = 'db.transaction' THEN 1 ELSE 0 END) AS tx,
    max(CASE WHEN kind = 'queue.dispatch' THEN 1 ELSE 0 END) AS qd, max(CASE WHEN kind = 'cache.write' THEN 1 ELSE 0 END) AS cw,
    min(event_id) FILTER (kind = 'api.route') AS fapi, min(event_id) FILTER (kind = 'db.write') AS fdbw, min(event_id) FILTER (kind = 'queue.dispatch') AS fqd, min(event_id) FILTER (kind = 'cache.write') AS fcw FROM ev GROUP BY path)"""
_EV = b.EVENTS.replace("WHEN 'view' THEN 'cache.read'", "WHEN 'view' THEN CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 THEN 'cache.write' ELSE 'cache.read' END")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which a third of the cache reads count as writes, so that all kinds occur."""
    return b.events(spark, sf_dir).withColumn("kind", F.when((F.col("kind") == "cache.read") & (F.col("k") % 3 == 0), "cache.write").otherwise(F.col("kind")))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled conversations as findings on event paths: path from conv and turn, text as it is."""
    return b.table(spark, sf_dir, "labels").select(
        F.concat((F.col("doc_id") % 150).cast("string"), F.lit("/2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("path"),
        F.when(F.col("toxic") == 1, "queue").when(F.col("quality") == 1, "db").otherwise("other").alias("concept"), F.when(F.col("quality") == 0, "Unique guard").otherwise("plain").alias("text"),
    )


_FIND = """fi AS (SELECT concat(doc_id % 150, '/2024-01-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')) AS path, CASE WHEN toxic = 1 THEN 'queue' WHEN quality = 1 THEN 'db' ELSE 'other' END AS concept,
    CASE WHEN quality = 0 THEN 'Unique guard' ELSE 'plain' END AS text FROM labels)"""


def _pattern_sql(kind: str, severity: str, conf: str, status: str, support: str, rows: str) -> str:
    return f"SELECT {_ID.format(kind)} AS pattern_id, '{kind}' AS pattern_type, '{severity}' AS severity, CAST({conf} AS DOUBLE) AS confidence, {status} AS status, path, {support} AS support FROM {rows}"


_TX = _pattern_sql("transaction_missing", "high", "0.84", "'confirmed'", "concat(fapi, ',', fdbw)", "fl WHERE api = 1 AND dbw = 1 AND tx = 0")
_OUT = _pattern_sql("db_write_outside_tx", "high", "0.9", "'confirmed'", "CAST(fdbw AS VARCHAR)", "fl WHERE dbw = 1 AND tx = 0")
_GUARD = _pattern_sql(
    "api_write_without_idempotency_guard", "medium", "0.68", "'suspected'", "concat(fapi, ',', least(coalesce(fdbw, fqd), coalesce(fqd, fdbw)))",
    "fl WHERE api = 1 AND (dbw = 1 OR qd = 1) AND path NOT IN (SELECT path FROM fi WHERE regexp_matches(lower(text), 'idempot|dedup|setnx|exists|unique|guard|cache key|request key'))",
)
_HOT = _pattern_sql(
    "hot_write_path", "medium", "CASE WHEN dbw = 1 AND qd = 1 AND cw = 1 THEN 0.78 ELSE 0.64 END", "CASE WHEN dbw = 1 AND qd = 1 AND cw = 1 THEN 'confirmed' ELSE 'suspected' END", "concat_ws(',', fapi, fdbw, fqd, fcw)",
    "fl LEFT JOIN (SELECT path, count(*) AS nh FROM fi WHERE concept IN ('transaction', 'queue', 'db', 'cache') GROUP BY path) h USING (path) WHERE api = 1 AND ((dbw = 1 AND qd = 1 AND cw = 1) OR nh >= 2)",
)
_QUEUE = f"""SELECT substr(sha1(concat('queue_without_consumer||', path)), 1, 12) AS pattern_id, 'queue_without_consumer' AS pattern_type, 'medium' AS severity, CAST(CASE WHEN q IS NOT NULL THEN 0.8 ELSE 0.62 END AS DOUBLE) AS confidence,
    CASE WHEN q IS NOT NULL THEN 'confirmed' ELSE 'suspected' END AS status, path, CAST(event_id AS VARCHAR) AS support
    FROM (SELECT *, CASE WHEN k % 10 <> 0 THEN CAST(k AS VARCHAR) END AS q FROM ev WHERE kind = 'queue.dispatch') d
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT framework, CASE WHEN k % 10 <> 0 THEN CAST(k AS VARCHAR) END AS q FROM ev WHERE kind = 'db.transaction' AND k < 50) c WHERE c.framework = d.framework AND c.q IS NOT DISTINCT FROM d.q)"""


@query(f"WITH {_EV}, {_FLAGS} {_OUT}")
def pattern_db_write_outside_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.db_write_outside_tx(_events(spark, sf_dir))


@query(f"WITH {_EV}, {_FLAGS} {_TX}")
def pattern_transaction_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.transaction_missing(_events(spark, sf_dir))


@query(f"WITH {_EV} {_QUEUE}")
def pattern_queue_without_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir).withColumn("queue_name", F.when(F.col("k") % 10 != 0, F.col("k").cast("string")))
    return op.queue_without_consumer(ev.where("kind = 'queue.dispatch'"), ev.where("kind = 'db.transaction' and k < 50"))


@query(f"WITH {_EV}, {_FIND}, {_FLAGS} {_GUARD}")
def pattern_write_without_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.write_without_guard(_events(spark, sf_dir), _findings(spark, sf_dir))


@query(f"WITH {_EV}, {_FIND}, {_FLAGS} {_HOT}")
def pattern_hot_write_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.hot_write_path(_events(spark, sf_dir), _findings(spark, sf_dir))


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, fi = _events(spark, sf_dir), _findings(spark, sf_dir)
    return op.transaction_missing(ev).unionByName(op.db_write_outside_tx(ev)).unionByName(op.write_without_guard(ev, fi)).unionByName(op.hot_write_path(ev, fi))


_ALL = f"pt AS ({_TX} UNION ALL {_OUT} UNION ALL {_GUARD} UNION ALL {_HOT})"


@query(f"WITH {_EV}, {_FIND}, {_FLAGS}, {_ALL} SELECT pattern_type, severity, status, count(*) AS n FROM (SELECT DISTINCT * FROM pt) GROUP BY GROUPING SETS ((pattern_type), (severity), (status))")
def pattern_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.summary(_patterns(spark, sf_dir)).select("pattern_type", "severity", "status", "n")


_SCORE = """CASE severity WHEN 'high' THEN 30 WHEN 'medium' THEN 20 ELSE 10 END + CASE status WHEN 'confirmed' THEN 20 ELSE 10 END
    + CASE pattern_type WHEN 'transaction_missing' THEN 12 WHEN 'db_write_outside_tx' THEN 12 WHEN 'api_write_without_idempotency_guard' THEN 8 WHEN 'hot_write_path' THEN 7 ELSE 4 END
    + least(10, 2 * len(string_split(support, ','))) + floor(confidence * 10) + 5"""


@query(f"WITH {_EV}, {_FIND}, {_FLAGS}, {_ALL} SELECT pattern_id AS risk_id, pattern_type, severity, status, CAST({_SCORE} AS DOUBLE) AS priority_score FROM pt ORDER BY priority_score DESC, severity, status, risk_id LIMIT 100")
def risk_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred risks of highest priority under a gate that warns."""
    p = _patterns(spark, sf_dir).withColumn("risk_id", F.col("pattern_id")).withColumn("seq", F.lit(0))
    refs = F.size(F.split("support", ","))
    p = risks.rank(p.withColumn("priority_score", risks.score(F.col("severity"), F.col("status"), F.col("pattern_type"), refs, F.col("confidence"), F.lit("warn"))))
    return p.select("risk_id", "pattern_type", "severity", "status", "priority_score").orderBy(F.desc("priority_score"), "severity", "status", "risk_id").limit(100)


@query(f"WITH {_EV}, {_FIND}, {_FLAGS}, {_ALL} SELECT status, severity, count(*) AS n FROM pt GROUP BY status, severity")
def risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patterns(spark, sf_dir).groupBy("status", "severity").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_EV}, {_FIND}, {_FLAGS}, {_ALL}, c AS (SELECT *, len(string_split(support, ',')) AS refs FROM pt)
    SELECT pattern_id, pattern_type, CASE WHEN status = 'suspected' THEN 'suspected' WHEN refs < 2 THEN 'few_refs' WHEN pattern_type IN ('transaction_missing', 'db_write_outside_tx') THEN 'boundary' ELSE 'none' END AS reason FROM c"""
)
def drilldown_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a pattern needs its source read, and why."""
    refs = F.size(F.split("support", ","))
    why = F.when(F.col("status") == "suspected", "suspected").when(refs < 2, "few_refs").when(F.col("pattern_type").isin("transaction_missing", "db_write_outside_tx"), "boundary").otherwise("none")
    return _patterns(spark, sf_dir).select("pattern_id", "pattern_type", why.alias("reason"))


@query(
    f"""WITH {b.EVENTS}, t AS (SELECT event_id, CASE k % 7 WHEN 0 THEN ' API ' WHEN 1 THEN 'tx_boundary' WHEN 2 THEN 'db_op' WHEN 3 THEN 'queue_dispatch' WHEN 4 THEN 'queue_consume' WHEN 5 THEN 'cache_op' ELSE 'service' END AS t,
    CASE k % 4 WHEN 0 THEN 'db.read' WHEN 1 THEN 'cache.invalidate' END AS d, CASE k % 5 WHEN 0 THEN 'get' WHEN 1 THEN 'find' WHEN 2 THEN 'del' WHEN 3 THEN 'hget' ELSE 'set' END AS o FROM ev), n AS (SELECT event_id, o, d, lower(trim(t)) AS t FROM t),
    u AS (SELECT event_id, CASE t WHEN 'api' THEN 'api.route' WHEN 'tx_boundary' THEN 'db.transaction' WHEN 'queue_dispatch' THEN 'queue.dispatch' WHEN 'queue_consume' THEN 'queue.consume'
      WHEN 'db_op' THEN CASE WHEN d = 'db.read' THEN d WHEN o IN ('find') THEN 'db.read' ELSE 'db.write' END WHEN 'cache_op' THEN CASE WHEN d = 'cache.invalidate' THEN d WHEN o = 'get' THEN 'cache.read' WHEN o = 'del' THEN 'cache.invalidate' ELSE 'cache.write' END END AS kind,
     CASE WHEN t LIKE '%api%' THEN 'api.route' WHEN t LIKE '%tx%' THEN 'db.transaction' WHEN t LIKE '%queue_consume%' THEN 'queue.consume' WHEN t LIKE '%queue%' THEN 'queue.dispatch' WHEN t LIKE '%db%' THEN CASE WHEN d = 'db.read' THEN 'db.read' ELSE 'db.write' END
      WHEN t LIKE '%cache%' THEN CASE WHEN d = 'cache.invalidate' THEN d ELSE 'cache.read' END ELSE 'unknown' END AS report_kind,
     CASE t WHEN 'api' THEN 'api.route' WHEN 'tx_boundary' THEN 'db.transaction' WHEN 'queue_dispatch' THEN 'queue.dispatch' WHEN 'queue_consume' THEN 'queue.consume' WHEN 'cache_op' THEN CASE WHEN o IN ('get', 'hget') THEN 'cache.read' WHEN o = 'del' THEN 'cache.invalidate' ELSE 'cache.write' END
      WHEN 'db_op' THEN CASE WHEN o = 'find' THEN 'db.read' ELSE 'db.write' END ELSE 'other' END AS catalog_kind FROM n)
    SELECT event_id, kind, report_kind, catalog_kind, CASE WHEN kind IS NULL THEN 'unknown' ELSE string_split(kind, '.')[1] END AS family FROM u"""
)
def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three mappings of a raw node to an event kind, and the family of the first."""
    k = F.col("k")
    t = F.element_at(F.array(*map(F.lit, [" API ", "tx_boundary", "db_op", "queue_dispatch", "queue_consume", "cache_op", "service"])), (k % 7 + 1).cast("int"))
    d = F.when(k % 4 == 0, "db.read").when(k % 4 == 1, "cache.invalidate")
    o = F.element_at(F.array(*map(F.lit, ["get", "find", "del", "hget", "set"])), (k % 5 + 1).cast("int"))
    rows = b.events(spark, sf_dir).select("event_id", t.alias("t"), d.alias("d"), o.alias("o"))
    kind = fe.event_kind(F.col("t"), F.col("d"), F.col("o"))
    return rows.select("event_id", kind.alias("kind"), fe.event_kind_for_report(F.col("t"), F.col("d"), F.col("d")).alias("report_kind"), fe.event_kind_for_catalog(F.col("t"), F.col("o")).alias("catalog_kind"), fe.family(kind).alias("family"))


@query(
    f"""WITH {_EV}, u AS (SELECT event_id, kind, CASE user_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN ' PY ' WHEN 3 THEN NULL WHEN 4 THEN 'cobol' ELSE 'typescript' END AS lang, CASE k % 5 WHEN 0 THEN 'spring_boot2' WHEN 1 THEN 'Django-REST' WHEN 2 THEN 'bull' ELSE '' END AS fw FROM ev),
    l AS (SELECT event_id, kind, fw, CASE WHEN lower(trim(lang)) IN ('python', 'java', 'typescript') THEN lower(trim(lang)) WHEN lower(trim(lang)) = 'py' THEN 'python' WHEN lower(fw) = 'bull' THEN 'typescript' ELSE 'python' END AS language FROM u)
    SELECT event_id, language, CASE WHEN lower(fw) = 'bull' THEN 'bull' WHEN lower(fw) LIKE 'django%' THEN 'django' WHEN lower(fw) LIKE 'spring%' THEN 'spring'
      WHEN kind LIKE 'api%' THEN CASE language WHEN 'typescript' THEN 'express' WHEN 'java' THEN 'spring' ELSE 'fastapi' END WHEN kind LIKE 'queue%' THEN CASE language WHEN 'java' THEN 'spring_kafka' WHEN 'typescript' THEN 'bullmq' ELSE 'celery' END
      WHEN kind LIKE 'db%' THEN CASE language WHEN 'java' THEN 'spring' ELSE 'django' END ELSE CASE language WHEN 'typescript' THEN 'redis' ELSE 'django' END END AS framework FROM l"""
)
def unified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and framework of events, declared or inferred."""
    lang = F.element_at(F.array(*map(F.lit, ["python", "java", " PY ", None, "cobol", "typescript"])), (F.col("user_id") % 6 + 1).cast("int"))
    fw = F.element_at(F.array(*map(F.lit, ["spring_boot2", "Django-REST", "bull", "", ""])), (F.col("k") % 5 + 1).cast("int"))
    none = F.lit(None).cast("string")
    rows = _events(spark, sf_dir).select("event_id", "kind", lang.alias("lang"), fw.alias("fw"))
    rows = rows.withColumn("language", fe.unified_language(F.col("lang"), F.col("kind"), none, F.col("fw"), none))
    return rows.select("event_id", "language", fe.unified_framework(F.col("fw"), F.col("kind"), F.col("language"), none, none, none, none, none).alias("framework"))


@query(f"WITH {_EV} SELECT kind, language, framework, count(*) AS n FROM ev GROUP BY GROUPING SETS ((kind), (language), (framework))")
def verifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind, by language and by framework in one pass."""
    c = [F.col(x) for x in ("kind", "language", "framework")]
    return _events(spark, sf_dir).groupingSets([[x] for x in c], *c).agg(F.count("*").alias("n"))


@query(f"""WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, language, framework ORDER BY event_id) AS n FROM ev) SELECT kind, language, framework, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (n <= 5) AS samples FROM r GROUP BY ALL""")
def event_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind, language and framework, with the first five of each."""
    keys = ["kind", "language", "framework"]
    ev = _events(spark, sf_dir).select(*keys, "event_id")
    first = ev.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("event_id"))).where("r <= 5").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("event_id")), ",").alias("samples"))
    return ev.groupBy(*keys).agg(F.count("*").alias("n")).join(first, keys)


@query(
    f"""WITH {_EV}, c AS (SELECT path, count(*) FILTER (kind = 'api.route') AS api, count(*) FILTER (kind = 'db.write') AS db, count(*) FILTER (kind = 'queue.dispatch') AS queue, count(*) FILTER (kind = 'cache.write') AS cache FROM ev GROUP BY path)
    SELECT path, api, db, queue, cache, CAST((api > 0)::INT + (db > 0)::INT + (queue > 0)::INT + (cache > 0)::INT AS BIGINT) AS complexity FROM c ORDER BY complexity DESC, api DESC, path LIMIT 20"""
)
def side_effect_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty paths with the most kinds of side effect."""
    kinds = {"api": "api.route", "db": "db.write", "queue": "queue.dispatch", "cache": "cache.write"}
    rows = _events(spark, sf_dir).groupBy("path").agg(*[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()])
    rows = rows.withColumn("complexity", sum((F.col(n) > 0).cast("bigint") for n in kinds))
    return rows.orderBy(F.desc("complexity"), F.desc("api"), "path").limit(20)


@query(f"WITH {_EV} SELECT path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n FROM ev GROUP BY path")
def kinds_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n"))


@query(f"WITH {_EV} SELECT path, bool_or(kind LIKE 'db%') AS has_db, bool_or(kind LIKE 'queue%') AS has_queue, bool_or(kind = 'api.route') AS has_api, bool_or(kind = 'db.transaction') AS has_tx FROM ev GROUP BY path")
def file_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("kind")
    flags = {"has_db": k.startswith("db"), "has_queue": k.startswith("queue"), "has_api": k == "api.route", "has_tx": k == "db.transaction"}
    return _events(spark, sf_dir).groupBy("path").agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])


@query(f"WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, path ORDER BY ts, event_id) AS n FROM ev) SELECT kind, path, event_id FROM r WHERE n = 1")
def first_event_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep-first by (type, key)."""
    return spans.first_of(_events(spark, sf_dir), ["kind", "path"], ["ts", "event_id"]).select("kind", "path", "event_id")


@query(
    f"""WITH {_EV}, g AS (SELECT substr(sha1(concat(kind, ':', language)), 1, 12) AS node_id, kind, language, max(k / 100.0) AS confidence, count(*) AS n_evidence, min(event_id) AS first_evidence FROM ev GROUP BY kind, language)
    SELECT * FROM g"""
)
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph nodes by (type, key): the largest confidence, and how much evidence."""
    rows = _events(spark, sf_dir).groupBy("kind", "language").agg(F.max(F.col("k") / 100.0).alias("confidence"), F.count("*").alias("n_evidence"), F.min("event_id").alias("first_evidence"))
    return rows.withColumn("node_id", F.substring(F.sha1(F.concat("kind", F.lit(":"), "language").cast("binary")), 1, 12))


_SPAN = f"{_EV}, sp AS (SELECT event_id, path, kind, k AS a, k + CASE WHEN kind = 'db.transaction' THEN 40 WHEN kind = 'api.route' THEN 30 ELSE 5 END AS e FROM ev)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = F.when(F.col("kind") == "db.transaction", 40).when(F.col("kind") == "api.route", 30).otherwise(5)
    return _events(spark, sf_dir).select("event_id", "path", "kind", F.col("k").alias("a"), (F.col("k") + width).alias("e"))


@query(
    f"""WITH {_SPAN} SELECT t.event_id AS outer_id, o.event_id AS inner_id, o.kind AS kind, CASE WHEN o.kind LIKE 'cache%' THEN 'cache_within_tx' ELSE 'dispatch_within_tx' END AS edge,
    substr(sha1(concat(t.event_id, ':', o.event_id, ':', o.kind)), 1, 12) AS edge_id FROM sp t JOIN sp o ON t.path = o.path AND t.a <= o.a AND t.e >= o.e WHERE t.kind = 'db.transaction' AND (o.kind LIKE 'cache%' OR o.kind = 'queue.dispatch')"""
)
def contained_in_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache operations and dispatches inside a transaction's span, in the same path."""
    sp = _spans(spark, sf_dir)
    rows = spans.contained(sp.where("kind = 'db.transaction'"), sp.where("kind like 'cache%' or kind = 'queue.dispatch'"), ["path"])
    edge = F.when(F.col("kind").startswith("cache"), "cache_within_tx").otherwise("dispatch_within_tx")
    return rows.select("outer_id", "inner_id", "kind", edge.alias("edge"), F.substring(F.sha1(F.concat(F.col("outer_id").cast("string"), F.lit(":"), F.col("inner_id").cast("string"), F.lit(":"), "kind").cast("binary")), 1, 12).alias("edge_id"))


@query(
    f"""WITH {_SPAN}, m AS (SELECT o.event_id AS inner_id, t.event_id AS outer_id, row_number() OVER (PARTITION BY o.event_id ORDER BY t.e - t.a, t.a DESC, t.event_id) AS n FROM sp o JOIN sp t ON t.path = o.path AND t.a <= o.a AND t.e >= o.e WHERE t.kind IN ('db.transaction', 'api.route') AND o.kind LIKE 'cache%')
    SELECT inner_id, outer_id FROM m WHERE n = 1"""
)
def innermost_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest span that contains each cache operation."""
    sp = _spans(spark, sf_dir)
    return spans.innermost(sp.where("kind in ('db.transaction', 'api.route')"), sp.where("kind like 'cache%'"), ["path"])


@query(
    f"""WITH {_SPAN}, w AS (SELECT path, a, e, max(e) OVER (PARTITION BY path ORDER BY a, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sp),
    f AS (SELECT path, a, e, sum(CASE WHEN before IS NULL OR a > before + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY a, e ROWS UNBOUNDED PRECEDING) AS island FROM w)
    SELECT path, min(a) AS start_line, max(e) AS end_line, count(*) AS n FROM f GROUP BY path, island"""
)
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a path merged where they are at most five lines apart."""
    return spans.merged(_spans(spark, sf_dir).withColumnRenamed("event_id", "seq"), ["path"], 5)


@query(f"WITH {_EV} SELECT kind, path, count(*) AS n FROM ev GROUP BY kind, path QUALIFY row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, path) <= 3")
def top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).groupBy("kind", "path").agg(F.count("*").alias("n"))
    return spans.first_of(rows, ["kind"], [F.desc("n"), "path"], 3).select("kind", "path", "n")


@query(
    f"""WITH {b.EVENTS} SELECT d.event_id AS dispatch_id, d.user_id, c.event_id AS consume_id FROM ev d LEFT JOIN ev c ON d.user_id = c.user_id AND c.kind = 'db.transaction' AND c.ts BETWEEN d.ts AND d.ts + INTERVAL 6 HOUR WHERE d.kind = 'queue.dispatch'"""
)
def handled_dispatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatches with what consumed them within six hours, or nothing."""
    ev = b.events(spark, sf_dir)
    rows = incremental.handled(ev.where("kind = 'queue.dispatch'"), ev.where("kind = 'db.transaction'"), ["user_id"], within=6 * 3600)
    return rows.select("dispatch_id", "user_id", "consume_id")
