"""Queries over stored runs, which are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import UNLIMITED
from ..storage import shared_dir
from . import bindings as b
from . import source_queries as s
from .registry import ORACLE_SQL, query


def _stored(spark: SparkSession, sf_dir: str, root: str, run_id: str, parts: list) -> None:
    from .. import runs  # the engine knows the catalog, which this module is a part of
    from ..engine import Engine

    files = None
    for part in parts:
        rows = s.files(spark, sf_dir, part).select("path", "content")
        files = rows if files is None else files.union(rows)
    files = files.select("path", "content", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    runs.save(Engine(spark, budget=UNLIMITED).scan_files(files), root, run_id)


def _rows(name: str, state: str) -> str:
    return f"SELECT '{state}' AS state FROM ({ORACLE_SQL[name]})"


@query(f"SELECT state, count(*) AS n FROM ({_rows('source_sql_tx', 'removed')} UNION ALL {_rows('source_workflows', 'same')} UNION ALL {_rows('source_compose', 'added')}) GROUP BY state")
def stored_run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans kept as runs, read back, and told apart."""
    from .. import runs

    root = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    _stored(spark, sf_dir, root, "base", [s.TX, s.CI])
    _stored(spark, sf_dir, root, "now", [s.CI, s.COMPOSE])
    return runs.load(spark, root, "now").diff(runs.load(spark, root, "base")).groupBy("state").agg(F.count("*").alias("n"))


@query(
    """SELECT o_orderkey AS start_line, concat('src/', o_custkey % 50, '.py') AS path, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS confidence, CAST(NULL AS VARCHAR) AS framework, true AS has_id, CAST(2 AS BIGINT) AS versions FROM orders"""
)
def upgraded_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of version 1 (confidence in hundredths, no ids, fewer columns), upgraded twice, read as the present version."""
    from .. import runs

    root, key = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}", F.col("o_orderkey")
    old = b.table(spark, sf_dir, "orders").select(F.concat(F.lit("src/"), (F.col("o_custkey") % 50).cast("string"), F.lit(".py")).alias("path"), F.col("o_orderpriority").alias("concept"), F.lit("text").alias("kind"), key.cast("int").alias("start_line"), (key % 101).cast("int").alias("confidence"))
    runs.write(spark, root, "old", {"findings": old}, version=1)
    for _ in range(2):
        runs.upgrade(spark, root, "old")
    versions = spark.read.parquet(f"{root}/manifest").agg(F.countDistinct("seq").alias("versions"))
    found = runs.load(spark, root, "old").findings
    return found.select(F.col("start_line").cast("long").alias("start_line"), "path", "confidence", "framework", (F.length("fid") > 0).alias("has_id")).join(versions)
