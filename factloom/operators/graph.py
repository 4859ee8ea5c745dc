"""The event graph: nodes by (type, key), and edges between nodes, and from nodes to their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import union_all

# Node types by kind of find, and edges from an api to what its function does.
NODE_TYPES = {
    "api.route": "api", "db.transaction": "tx_boundary", "db.read": "db_op", "db.write": "db_op", "queue.dispatch": "queue_dispatch", "queue.consume": "queue_consume",
    "cache.read": "cache_op", "cache.write": "cache_op", "cache.invalidate": "cache_op", "schema.table": "table", "schema.index": "index", "infra.service": "service", "ci.step": "workflow",
}
API_EDGES = {"tx_boundary": "encloses_tx", "cache_op": "uses_cache", "queue_dispatch": "dispatches_job"}
TX_EDGES = {"cache_op": "cache_within_tx", "queue_dispatch": "dispatch_within_tx"}
WORKFLOW_ITEMS = ["Scheduling", "Cache", "Concurrency"]
INFRA_TYPES = {"KV/Storage": "kv_storage", "Queue": "queue_infra", "Cache": "cache_infra"}


def short_sha(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", *parts).cast("binary")), 1, 12)


def _choose(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def placed(findings: DataFrame) -> DataFrame:
    """The node of each find: type, key and event_id beside the find's own columns.  A compose line makes two, a CI step up to two."""
    kind, scope = F.col("kind"), F.concat_ws(":", F.when(F.col("scope").isNull(), "module").otherwise("function"), F.coalesce("scope", F.lit("")))
    place = F.concat_ws(":", "path", scope, F.coalesce("op", "framework", F.lit("")), F.coalesce("name", F.lit("")), F.col("start_line").cast("string"))
    type_ = _choose(kind, NODE_TYPES)
    key = (
        F.when(kind == "api.route", F.concat_ws(" ", "method", "route")).when(kind == "schema.table", F.concat(F.lit("table:"), "name")).when(kind == "schema.index", F.concat(F.lit("index:"), "name"))
        .when(kind == "infra.service", F.concat(F.lit("service:"), "name")).when(kind == "ci.step", F.concat(F.lit("workflow:"), "path")).otherwise(place)
    )
    first = findings.withColumn("type", type_).withColumn("key", key).where("type is not null")
    infra = findings.where("kind = 'infra.service'").withColumn("type", _choose(F.col("concept"), INFRA_TYPES)).withColumn("key", F.concat_ws(":", "type", "op")).where("type is not null")
    items = findings.where((kind == "ci.step") & F.col("concept").isin(WORKFLOW_ITEMS)).withColumn("type", F.lit("workflow_item")).withColumn("key", F.lower("concept"))
    return first.unionByName(infra).unionByName(items).withColumn("event_id", short_sha(F.col("type"), F.col("key")))


def nodes(placed_rows: DataFrame) -> DataFrame:
    """One node for each type and key of placed finds, in order of event_id: largest confidence, all evidence, and its first place."""
    rows = placed_rows.groupBy("event_id", "type", "key")
    at = F.min(F.struct("path", "start_line", "end_line", "language", "framework"))
    return rows.agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("primary_eid")).alias("evidence"), at.alias("at")).select("event_id", "type", "key", "confidence", "evidence", "at.*").orderBy("event_id")


def edges(rows: DataFrame) -> DataFrame:
    """All edges between placed finds, in order of edge_id: edge_id, from_id, to_id, type.

    A node is supported_by its evidence; an api and what is seen in its function (same function, or lines inside it) are
    observed_in_same_scope, and by the other's type encloses_tx, uses_cache or dispatches_job; a transaction has the
    cache and queue operations inside its lines; workflows declare items, services declare_dependency on what they stand for.
    """
    out = [rows.select(F.col("event_id").alias("from_id"), F.col("primary_eid").alias("to_id"), F.lit("supported_by").alias("type"))]
    inner = rows.where(F.col("type").isin("tx_boundary", "db_op", "queue_dispatch", "queue_consume", "cache_op"))
    inner = inner.select("path", F.col("event_id").alias("to_id"), F.col("type").alias("to_type"), F.col("scope").alias("s2"), F.col("start_line").alias("a2"), F.col("end_line").alias("z2"))
    # only apis and transactions, which are few in a file, meet the file's other finds
    api = rows.where("type = 'api'").select("path", F.col("event_id").alias("from_id"), F.col("scope").alias("s1"), F.col("scope_start").alias("a1"), F.col("scope_end").alias("z1"))
    same = api.join(inner, "path").where((F.col("s1") == F.col("s2")) | ((F.col("a2") >= F.col("a1")) & (F.col("z2") <= F.col("z1"))))
    out.append(same.select("from_id", "to_id", F.lit("observed_in_same_scope").alias("type")))
    out.append(same.select("from_id", "to_id", _choose(F.col("to_type"), API_EDGES).alias("type")).where("type is not null"))
    tx = rows.where("type = 'tx_boundary'").select("path", F.col("event_id").alias("from_id"), F.col("start_line").alias("a1"), F.col("end_line").alias("z1"))
    within = tx.join(inner.where(F.col("to_type").isin(list(TX_EDGES))), "path").where("a2 >= a1 and z2 <= z1")
    out.append(within.select("from_id", "to_id", _choose(F.col("to_type"), TX_EDGES).alias("type")))
    flow = rows.where("type = 'workflow'").select("path", F.col("event_id").alias("from_id")).distinct()
    items = rows.where("type = 'workflow_item'").select("path", F.col("event_id").alias("to_id")).distinct()
    out.append(flow.join(items, "path").select("from_id", "to_id", F.lit("declares").alias("type")))
    service = rows.where("type = 'service'").select("primary_eid", F.col("event_id").alias("from_id"))
    infra = rows.where(F.col("type").isin(list(INFRA_TYPES.values()))).select("primary_eid", F.col("event_id").alias("to_id"))
    out.append(service.join(infra, "primary_eid").select("from_id", "to_id", F.lit("declares_dependency").alias("type")))
    every = union_all(out).where("from_id <> to_id").distinct()
    return every.select(short_sha(F.col("from_id"), F.col("to_id"), F.col("type")).alias("edge_id"), "from_id", "to_id", "type").orderBy("edge_id")
