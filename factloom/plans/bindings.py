"""The engine's record types bound to the tables at hand.

Files are documents, findings are orders with line items as evidence, events are the event
stream keyed by user and day, endpoints and callers are page urls.  Each binding is given
twice: as a DataFrame and as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILES = "files AS (SELECT concat(source, '/', doc_id, '.', lang) AS path, text AS content, n_chars AS size, doc_id, source FROM documents)"
EVENTS = """ev AS (SELECT event_id, user_id, ts, concat(user_id, '/', CAST(CAST(ts AS DATE) AS VARCHAR)) AS path, event_type,
    CASE event_type WHEN 'view' THEN 'cache.read' WHEN 'click' THEN 'queue.dispatch' WHEN 'signup' THEN 'api.route' WHEN 'purchase' THEN 'db.write' ELSE 'db.transaction' END AS kind,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE user_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'typescript' WHEN 3 THEN 'sql' ELSE 'go' END AS language,
    CASE user_id % 4 WHEN 0 THEN 'celery' WHEN 1 THEN 'bullmq' WHEN 2 THEN 'spring_kafka' ELSE 'redis' END AS framework FROM events)"""
FINDINGS = """fd AS (SELECT o_orderkey AS fid, o_orderpriority AS concept, concat('rule.', o_orderstatus) AS rule_id, o_totalprice / 500000.0 AS confidence,
    concat('src/', o_custkey % 50, '.py') AS path, o_orderkey % 997 + 1 AS start_line, o_orderkey % 997 + 1 + o_orderkey % 7 AS end_line,
    CASE o_orderkey % 3 WHEN 0 THEN 'L1' WHEN 1 THEN 'L2' ELSE 'L3' END AS level, o_orderkey * 100 + 1 AS primary_eid FROM orders)"""
EVIDENCE = """evd AS (SELECT l_orderkey AS fid,
    l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS eid,
    concat('src/', l_partkey % 97, '.py') AS path, l_linenumber * 10 AS start_line, l_linenumber * 10 + CAST(floor(l_quantity) AS BIGINT) AS end_line, l_returnflag AS flag FROM lineitem)"""
_PATH = r"regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
ENDPOINTS = f"""ep AS (SELECT page_id AS endpoint_id, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method,
    CASE WHEN page_id % 2 = 0 THEN regexp_replace({_PATH}, '[0-9]+', '{{id}}', 'g') ELSE {_PATH} END AS path, concat('api/', page_id % 40, '.py') AS file FROM pages)"""
CALLERS = f"""ca AS (SELECT page_id AS caller_id, CASE (page_id + page_id // 7) % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method,
    {_PATH} AS path, concat('web/', page_id % 30, '.ts') AS file FROM pages)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("size"), "doc_id", "source")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("ts").cast("date").cast("string")).alias("path"), "event_type",
        F.when(kind == "view", "cache.read").when(kind == "click", "queue.dispatch").when(kind == "signup", "api.route").when(kind == "purchase", "db.write").otherwise("db.transaction").alias("kind"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.element_at(F.array(*map(F.lit, "python java typescript sql go".split())), (F.col("user_id") % 5 + 1).cast("int")).alias("language"),
        F.element_at(F.array(*map(F.lit, "celery bullmq spring_kafka redis".split())), (F.col("user_id") % 4 + 1).cast("int")).alias("framework"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("fid"), F.col("o_orderpriority").alias("concept"), F.concat(F.lit("rule."), "o_orderstatus").alias("rule_id"), (F.col("o_totalprice") / 500000.0).alias("confidence"),
        F.concat(F.lit("src/"), (F.col("o_custkey") % 50).cast("string"), F.lit(".py")).alias("path"), (key % 997 + 1).alias("start_line"), (key % 997 + 1 + key % 7).alias("end_line"),
        F.when(key % 3 == 0, "L1").when(key % 3 == 1, "L2").otherwise("L3").alias("level"), (key * 100 + 1).alias("primary_eid"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    start = F.col("l_linenumber").cast("bigint") * 10
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("fid"), (F.col("l_orderkey") * 100 + F.row_number().over(order)).alias("eid"), F.concat(F.lit("src/"), (F.col("l_partkey") % 97).cast("string"), F.lit(".py")).alias("path"),
        start.alias("start_line"), (start + F.floor("l_quantity")).alias("end_line"), F.col("l_returnflag").alias("flag"),
    )


def _url_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1).alias("path"))


def _method(n: F.Column) -> F.Column:
    return F.when(n % 3 == 0, "GET").when(n % 3 == 1, "POST").otherwise("PUT")


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    return _url_path(spark, sf_dir).select(
        n.alias("endpoint_id"), _method(n).alias("method"), F.when(n % 2 == 0, F.regexp_replace("path", "[0-9]+", "{id}")).otherwise(F.col("path")).alias("path"), F.concat(F.lit("api/"), (n % 40).cast("string"), F.lit(".py")).alias("file")
    )


def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    return _url_path(spark, sf_dir).select(n.alias("caller_id"), _method(n + F.expr("page_id div 7")).alias("method"), "path", F.concat(F.lit("web/"), (n % 30).cast("string"), F.lit(".ts")).alias("file"))
