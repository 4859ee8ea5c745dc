"""Event kinds, families, languages and frameworks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Event kinds and their families.
FAMILY_OF = {
    "api.route": "api",
    "db.transaction": "db",
    "db.read": "db",
    "db.write": "db",
    "queue.dispatch": "queue",
    "queue.consume": "queue",
    "cache.read": "cache",
    "cache.write": "cache",
    "cache.invalidate": "cache",
    "job.schedule": "job",
    "job.execute": "job",
}
LANGUAGES = "python sql openapi typescript java go".split()
FRAMEWORKS = (
    "fastapi flask django celery express nestjs prisma typeorm bull bullmq openapi sql redis ioredis "
    "spring spring_mvc spring_boot spring_kafka spring_rabbit jpa mybatis"
).split()
READ_OPS = ["read", "exists", "find", "select"]
CACHE_READ_OPS = ["get", "read", "mget"]
CACHE_DROP_OPS = ["delete", "del", "invalidate", "evict", "unlink", "hdel"]


def clean(value: Column) -> Column:
    """Trimmed lower case; missing becomes ''."""
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def event_kind(raw_type: Column, kind: Column, op: Column) -> Column:
    """The kind of a graph node from its type, declared kind and operation; null for other types."""
    t, k, o = clean(raw_type), F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(op, F.lit("")))
    db = F.when(k.isin("db.read", "db.write"), k).when(o.isin(READ_OPS), "db.read").otherwise("db.write")
    cache = F.when(k.isin("cache.read", "cache.write", "cache.invalidate"), k).when(o.isin(CACHE_READ_OPS), "cache.read").when(o.isin(CACHE_DROP_OPS), "cache.invalidate").otherwise("cache.write")
    return (
        F.when(t == "api", "api.route").when(t == "tx_boundary", "db.transaction").when(t == "db_op", db).when(t == "queue_dispatch", "queue.dispatch").when(t == "queue_consume", "queue.consume").when(t == "cache_op", cache)
    )


def event_kind_for_report(raw_type: Column, db_kind: Column, cache_kind: Column) -> Column:
    """The backend report's mapping: parts of the type, then the declared kinds."""
    t, d, c = clean(raw_type), clean(db_kind), clean(cache_kind)
    return (
        F.when(t.contains("api"), "api.route").when(t.contains("tx"), "db.transaction").when(t.contains("queue_consume"), "queue.consume").when(t.contains("queue"), "queue.dispatch")
        .when(t.contains("db"), F.when(d == "db.read", "db.read").otherwise("db.write"))
        .when(t.contains("cache"), F.when(c.isin("cache.write", "cache.invalidate"), c).otherwise("cache.read"))
        .otherwise("unknown")
    )


def event_kind_for_catalog(raw_type: Column, op: Column) -> Column:
    """The context pack's mapping: equal types, and operation lists that know hash reads."""
    t, o = clean(raw_type), clean(op)
    cache = F.when(o.isin("get", "mget", "hget", "read"), "cache.read").when(o.isin(CACHE_DROP_OPS), "cache.invalidate").otherwise("cache.write")
    db = F.when(o.isin(READ_OPS), "db.read").otherwise("db.write")
    return F.when(t == "api", "api.route").when(t == "tx_boundary", "db.transaction").when(t == "queue_dispatch", "queue.dispatch").when(t == "queue_consume", "queue.consume").when(t == "cache_op", cache).when(t == "db_op", db).otherwise("other")


def family(kind: Column) -> Column:
    return F.when(kind.isin(list(FAMILY_OF)), F.substring_index(kind, ".", 1)).otherwise("unknown")


def language(value: Column) -> Column:
    v = clean(value)
    return F.when(v.isin(LANGUAGES), v).when(v == "py", "python").otherwise("unknown")


def framework(value: Column) -> Column:
    v = clean(value)
    return F.when(v.isin(FRAMEWORKS), v).when(v.startswith("django"), "django").when(v.startswith("spring"), "spring").otherwise("unknown")


def unified_language(lang: Column, kind: Column, tx_kind: Column, framework_: Column, source: Column) -> Column:
    """Language of a graph event: as declared, else from transaction kind, framework and source."""
    known, tx, fw = language(lang), F.coalesce(tx_kind, F.lit("")), clean(framework_)
    return (
        F.when(known != "unknown", known).when((kind == "db.transaction") & tx.startswith("sql"), "sql").when(tx == "java_transactional", "java")
        .when(tx.startswith("ts_") | fw.isin("express", "nestjs", "prisma", "typeorm", "bull", "bullmq", "redis", "ioredis"), "typescript")
        .when((kind == "api.route") & (F.coalesce(source, F.lit("")) == "openapi"), "openapi").otherwise("python")
    )


def unified_framework(framework_: Column, kind: Column, lang: Column, tx_kind: Column, queue_kind: Column, queue_system: Column, db_style: Column, cache_backend: Column) -> Column:
    """Framework of a graph event: as declared, else what the kind and language suggest."""
    known, tx, qk = framework(framework_), F.coalesce(tx_kind, F.lit("")), clean(queue_kind)
    style, backend = clean(db_style), clean(cache_backend)
    api = F.when(lang == "openapi", "openapi").when(lang == "typescript", "express").when(lang == "java", "spring").otherwise("fastapi")
    queue = F.when(qk.contains("bull"), F.when(qk.contains("mq"), "bullmq").otherwise("bull")).when(lang == "java", F.when(clean(queue_system) == "rabbitmq", "spring_rabbit").otherwise("spring_kafka")).when(lang == "typescript", "bullmq").otherwise("celery")
    java_db = F.when(style.contains("mybatis") | style.contains("sql_session"), "mybatis").when(style.contains("jpa") | style.contains("entity_manager"), "jpa").otherwise("spring")
    db = F.when(lang == "sql", "sql").when((lang == "typescript") & tx.contains("prisma"), "prisma").when((lang == "typescript") & tx.contains("typeorm"), "typeorm").when(lang == "java", java_db).otherwise("django")
    cache = F.when(backend.isin("redis", "ioredis"), backend).when(lang == "typescript", "redis").otherwise("django")
    fam = family(kind)
    return F.when(known != "unknown", known).when(fam == "api", api).when(fam == "queue", queue).when(fam == "db", db).when(fam == "cache", cache).otherwise("unknown")
