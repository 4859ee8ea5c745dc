"""Operators that turn text into rows: lines and what matches in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.let import let


def lines_of(files: DataFrame, *keys: str) -> DataFrame:
    """A row for each line of content, numbered from 1, with path and other key columns."""
    keys = keys or ("path",)
    return files.select(*keys, F.posexplode(F.split("content", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint") + 1)


def line_hits(lines: DataFrame, regex: str) -> DataFrame:
    """Lines with a match of regex, case aside, and how many they have."""
    return lines.withColumn("hits", F.regexp_count(F.lower("line"), F.lit(regex)).cast("bigint")).where("hits > 0")


def contains_snippet(docs: DataFrame, snippets: DataFrame) -> DataFrame:
    """(item_id, doc_id) where a document contains a snippet.

    The second to fourth words of a contained snippet are whole words of the document, so runs of three words meet
    by equality, and only such meetings are confirmed.  Snippets of fewer than five words meet by their empty key.
    """

    def runs(text: Column) -> Column:
        return let(F.split(text, r"\s+"), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - 3)), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    words = F.split("snippet", r"\s+")
    key = F.when(F.size(words) >= 5, F.xxhash64(F.get(words, F.lit(1)), F.get(words, F.lit(2)), F.get(words, F.lit(3)))).otherwise(F.lit(0).cast("bigint"))
    met = docs.select("doc_id", F.explode(F.array_distinct(F.array_append(runs(F.col("text")), F.lit(0).cast("bigint")))).alias("h")).join(snippets.select("item_id", key.alias("h")), "h").select("doc_id", "item_id").distinct()
    return met.join(docs, "doc_id").join(snippets, "item_id").where(F.contains("text", "snippet")).select("item_id", "doc_id")


# ---- detectors that look at single lines; each gives path, line_no and what it found ----


def sql_ddl(lines: DataFrame) -> DataFrame:
    """CREATE TABLE as Storage (.6), CREATE INDEX as Index (.65); at most one of each for a line."""
    name = r"""["`\[]?([A-Za-z_][A-Za-z0-9_.]*)"""
    table = F.regexp_extract("line", rf"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?{name}", 1)
    index = F.regexp_extract("line", rf"(?i)create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?{name}", 1)
    both = F.array(F.when(table != "", F.struct(F.lit("Storage").alias("concept"), table.alias("name"), F.lit(0.6).alias("confidence"))), F.when(index != "", F.struct(F.lit("Index").alias("concept"), index.alias("name"), F.lit(0.65).alias("confidence"))))
    rows = lines.select("path", "line_no", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("f"))
    return rows.select("path", "line_no", "f.concept", "f.name", "f.confidence")


def sql_tx(lines: DataFrame) -> DataFrame:
    """For each file from the first BEGIN to the last COMMIT, where they come in this order."""
    head = F.upper(F.trim("line"))
    spans = lines.groupBy("path").agg(F.min(F.when(head.startswith("BEGIN"), F.col("line_no"))).alias("start_line"), F.max(F.when(head.startswith("COMMIT"), F.col("line_no"))).alias("end_line"))
    return spans.where("start_line <= end_line").withColumn("confidence", F.lit(0.8))


def express_routes(lines: DataFrame) -> DataFrame:
    """Routes of app and router with a literal path; app.use('/x', router) prefixes those of the symbol router."""
    quoted = r"""\s*['"`]([^'"`]+)['"`]"""
    call = rf"\b(app|router)\.(get|post|put|delete|patch|options|head)\({quoted}"
    prefix = F.regexp_extract("line", rf"\bapp\.use\({quoted}\s*,\s*router\b", 1)
    prefixes = lines.where(prefix != "").groupBy("path").agg(F.min_by(prefix, "line_no").alias("prefix"))
    rows = lines.select("path", "line_no", F.regexp_extract("line", call, 1).alias("symbol"), F.upper(F.regexp_extract("line", call, 2)).alias("method"), F.regexp_extract("line", call, 3).alias("raw")).where("symbol <> ''")
    rows = rows.join(prefixes, "path", "left")
    route = F.when((F.col("symbol") == "router") & F.col("prefix").isNotNull(), F.concat("prefix", "raw")).otherwise(F.col("raw"))
    return rows.select("path", "line_no", "method", F.regexp_replace(F.regexp_replace(route, "/{2,}", "/"), ":([A-Za-z_][A-Za-z0-9_]*)", "{$1}").alias("route"), F.lit(0.82).alias("confidence"))


def http_callers(lines: DataFrame) -> DataFrame:
    """fetch and axios calls with a literal url: GET unless declared (then surer); an instance made by axios.create prefixes its base."""
    quoted = r"""\s*['"`]([^'"`$]+)['"`]"""
    made = F.regexp_extract("line", r"\b(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*axios\.create\(", 1)
    base = F.regexp_extract("line", rf"baseURL\s*:{quoted}", 1)
    instances = lines.where(made != "").groupBy("path", made.alias("symbol")).agg(F.min_by(base, "line_no").alias("base"))
    call = rf"\b([A-Za-z_]\w*)\.(get|post|put|delete|patch)\({quoted}"
    fetched = F.regexp_extract("line", rf"\bfetch\({quoted}", 1)
    declared = F.upper(F.regexp_extract("line", r"method\s*:\s*['\"]([A-Za-z]+)['\"]", 1))
    rows = lines.select(
        "path", "line_no", F.regexp_extract("line", call, 1).alias("symbol"), F.upper(F.regexp_extract("line", call, 2)).alias("verb"), F.regexp_extract("line", call, 3).alias("url"), fetched.alias("fetched"), declared.alias("declared")
    )
    rows = rows.where("symbol <> '' or fetched <> ''").join(instances, ["path", "symbol"], "left")
    axios = (F.col("symbol") == "axios") | F.col("base").isNotNull()
    rows = rows.where(axios | (F.col("fetched") != ""))
    out = rows.select(
        "path", "line_no", F.when(axios, "axios").otherwise("fetch").alias("client"), F.when(axios, F.col("verb")).when(F.col("declared") != "", F.col("declared")).otherwise("GET").alias("method"),
        F.when(axios, F.concat(F.coalesce("base", F.lit("")), "url")).otherwise(F.col("fetched")).alias("raw"), (~axios & (F.col("declared") == "")).alias("inferred"),
    )
    return out.withColumn("confidence", F.when(F.col("client") == "axios", 0.88).when(F.col("inferred"), 0.8).otherwise(0.86))


def unsupported_callers(lines: DataFrame) -> DataFrame:
    """fetch and axios calls whose url is computed."""
    client = F.when(F.col("line").rlike(r"\bfetch\(\s*[^'\"`\s)]"), "fetch").when(F.col("line").rlike(r"\baxios\.(get|post|put|delete|patch)\(\s*[^'\"`\s)]"), "axios")
    return lines.select("path", "line_no", client.alias("client"), F.lit("computed_url").alias("reason")).where("client is not null")


# Redis operations by what they do.
REDIS_READS, REDIS_WRITES, REDIS_DROPS = ["get", "mget", "hget"], ["set", "setex", "hset", "setnx"], ["del", "hdel", "unlink", "expire"]


def cache_operations(lines: DataFrame) -> DataFrame:
    """Redis calls of a symbol that is named for redis, a cache or a client."""
    call = r"\b([A-Za-z_][A-Za-z0-9_.]*)\.(get|mget|hget|set|setex|hset|setnx|del|hdel|unlink|expire)\("
    rows = lines.select("path", "line_no", F.regexp_extract("line", call, 1).alias("symbol"), F.regexp_extract("line", call, 2).alias("op"))
    rows = rows.where(F.lower("symbol").rlike("redis|cache|client"))
    uses = lines.groupBy("path").agg(F.bool_or(F.col("line").rlike(r"\bfrom\s+['\"]ioredis['\"]|require\(['\"]ioredis['\"]\)")).alias("ioredis"))
    return rows.join(uses, "path").withColumn("kind", F.when(F.col("op").isin(REDIS_READS), "cache.read").when(F.col("op").isin(REDIS_DROPS), "cache.invalidate").otherwise("cache.write"))


def queue_operations(lines: DataFrame) -> DataFrame:
    """.add( of a symbol named for a queue dispatches; new Worker('q' and .process( consume."""
    add = F.regexp_extract("line", r"\b([A-Za-z_][A-Za-z0-9_.]*)\.add\(", 1)
    worker = F.regexp_extract("line", r"""new\s+Worker\(\s*['"`]([^'"`]+)""", 1)
    process = F.regexp_extract("line", r"\b([A-Za-z_][A-Za-z0-9_.]*)\.process\(", 1)
    kind = F.when(F.lower(add).rlike("queue|bull"), "queue.dispatch").when((worker != "") | (process != ""), "queue.consume")
    return lines.select("path", "line_no", kind.alias("kind"), F.when(worker != "", worker).when(process != "", process).otherwise(add).alias("queue")).where("kind is not null")


def dockerfile(lines: DataFrame) -> DataFrame:
    """Instructions that touch files, the network, or configuration."""
    op = F.upper(F.regexp_extract("line", r"^\s*([A-Za-z]+)\s", 1))
    low = F.lower("line")
    kinds = F.array(
        F.when(op.isin("COPY", "ADD", "VOLUME", "WORKDIR"), "FileSystem"), F.when((op.isin("RUN", "ADD", "EXPOSE")) & low.rlike("http|curl|wget|expose"), "External IO"), F.when(op.isin("ENV", "ARG") & low.rlike("secret|token|key|password|env|arg"), "Secrets/Config")
    )
    return lines.select("path", "line_no", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("concept"))


def compose_services(lines: DataFrame) -> DataFrame:
    """Lines of a compose file with the service they belong to: the last key at the services' own indent."""
    indent = F.length(F.regexp_extract("line", "^( *)", 1))
    key = F.regexp_extract("line", r"^ *([A-Za-z0-9_.-]+):\s*$", 1)
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("indent", indent).withColumn("key", key)
    rows = rows.withColumn("top", F.last(F.when((F.col("indent") == 0) & (F.col("line") != ""), F.col("key")), ignorenulls=True).over(order)).where("top = 'services'")
    depth = F.min(F.when((F.col("indent") > 0) & (F.col("key") != ""), F.col("indent"))).over(Window.partitionBy("path"))
    rows = rows.withColumn("depth", depth)
    return rows.withColumn("service", F.last(F.when((F.col("indent") == F.col("depth")) & (F.col("key") != ""), F.col("key")), ignorenulls=True).over(order))


# Images and what they are for.
INFRA = {"redis": ["Cache", "KV/Storage"], "rabbitmq": ["Queue"], "kafka": ["Queue"], "postgres": ["KV/Storage"], "mysql": ["KV/Storage"], "mongo": ["KV/Storage"]}


def compose_infra(lines: DataFrame) -> DataFrame:
    """Infrastructure that a service's image stands for."""
    rows = compose_services(lines).withColumn("image", F.lower(F.regexp_extract("line", r"^ *image:\s*['\"]?([^'\"\s]+)", 1))).where("image <> ''")
    kinds: list[Column] = [F.when(F.col("image").contains(name), F.array(*[F.struct(F.lit(k).alias("concept"), F.lit(name).alias("infra")) for k in concepts])) for name, concepts in INFRA.items()]
    found = F.explode(F.flatten(F.filter(F.array(*kinds), lambda x: x.isNotNull())))
    return rows.select("path", "line_no", "service", found.alias("f")).select("path", "line_no", "service", "f.concept", "f.infra")


def requirements(lines: DataFrame) -> DataFrame:
    """Dependencies of a requirements file: what stands before the first of < > = ! ~."""
    name = F.trim(F.regexp_extract("line", r"^\s*([^<>=!~#;\s]+)", 1))
    return lines.where(name != "").select("path", "line_no", name.alias("dependency"), F.lit("Config").alias("concept"))


def go_mod(lines: DataFrame) -> DataFrame:
    """Required modules of go.mod files, of single lines and of blocks."""
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.when(F.col("line").rlike(r"^\s*require\s*\("), True).when(F.col("line").rlike(r"^\s*(\)|\w+\s*\()"), False)
    rows = lines.withColumn("inside", F.last(edge, ignorenulls=True).over(order))
    of = F.when(F.col("line").rlike(r"^\s*require\s+[^(\s]"), F.regexp_replace("line", r"^\s*require\s+", "")).when(F.coalesce("inside", F.lit(False)), F.col("line"))
    rows = rows.select("path", "line_no", F.regexp_extract(of, r"^\s*([^\s/(][^\s(]*)\s+(v\S+)", 1).alias("dependency"), F.regexp_extract(of, r"^\s*([^\s/(][^\s(]*)\s+(v\S+)", 2).alias("version"))
    return rows.where("dependency <> ''").withColumn("concept", F.lit("Config"))


def package_json(files: DataFrame) -> DataFrame:
    """Dependencies and scripts of package.json files."""
    kind = "map<string,string>"
    parsed = files.select("path", F.from_json("content", f"struct<dependencies:{kind},devDependencies:{kind},scripts:{kind}>").alias("j"))
    rows = [parsed.select("path", F.lit(k).alias("section"), F.explode(f"j.{k}").alias("name", "value")) for k in ("dependencies", "devDependencies", "scripts")]
    return rows[0].union(rows[1]).union(rows[2])


def openapi_json(files: DataFrame) -> DataFrame:
    """(method, route) of OpenAPI documents in JSON."""
    paths = files.select("path", F.explode(F.from_json(F.get_json_object("content", "$.paths"), "map<string,map<string,string>>")).alias("route", "verbs"))
    rows = paths.select("path", "route", F.explode(F.map_keys("verbs")).alias("verb"))
    return rows.where(F.lower("verb").isin("get", "post", "put", "delete", "patch", "options", "head")).select("path", "route", F.upper("verb").alias("method"), F.lit(0.85).alias("confidence"))


def openapi_yaml(lines: DataFrame) -> DataFrame:
    """The same from YAML, by indent: routes under paths, verbs deeper than their route."""
    indent = F.length(F.regexp_extract("line", "^( *)", 1))
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(F.trim("line") != "").withColumn("indent", indent)
    top = F.last(F.when(F.col("indent") == 0, F.regexp_extract("line", "^([^:]+):", 1)), ignorenulls=True).over(order)
    rows = rows.withColumn("top", top).where("top = 'paths'")
    route = F.regexp_extract("line", r"^ +['\"]?(/[^'\":]*)['\"]?:\s*$", 1)
    rows = rows.withColumn("route", F.last(F.when(route != "", F.struct(route.alias("r"), F.col("indent").alias("i"))), ignorenulls=True).over(order))
    verb = F.lower(F.regexp_extract("line", r"^ +([A-Za-z]+):", 1))
    return rows.where(verb.isin("get", "post", "put", "delete", "patch", "options", "head") & (F.col("indent") > F.col("route.i"))).select("path", "line_no", F.col("route.r").alias("route"), F.upper(verb).alias("method"))


def workflow_steps(lines: DataFrame) -> DataFrame:
    """Signals in CI workflow files."""
    found = F.array(
        F.when(F.col("line").rlike(r"^\s*-?\s*cron:"), "Scheduling"), F.when(F.col("line").rlike(r"secrets\."), "Secrets/Config"), F.when(F.col("line").rlike(r"actions/cache"), "Cache"),
        F.when(F.col("line").rlike(r"^\s*concurrency:"), "Concurrency"), F.when(F.col("line").rlike(r"curl |wget |https?://"), "External IO"),
    )
    rows = lines.select("path", "line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("concept"))
    return rows.withColumn("confidence", F.when(F.col("concept") == "External IO", 0.65).otherwise(0.6))
