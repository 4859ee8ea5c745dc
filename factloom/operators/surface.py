"""The API surface: endpoints that code and specifications declare, and where the two disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as fp
from . import linking

# How sure an endpoint of each kind of source is.
CONFIDENCE_OF = {"openapi": 1.0, "python_ast": 0.9, "typescript_l2": 0.85, "java_l2": 0.85}
VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH"]


def source_kind(strength: Column, level: Column) -> Column:
    """What an endpoint was read from: its own word, else by the level of parsing."""
    return F.coalesce(F.when(strength != "", strength), F.when(level == "L2", "openapi").when(level == "L3", "python_ast").otherwise("text"))


def confidence(kind: Column) -> Column:
    out = F.lit(0.6)
    for k, v in CONFIDENCE_OF.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


# The names that routes are declared on.
VERB_OWNERS, ROUTE_OWNERS = ["app", "router"], ["app", "bp"]


def _decorator(snippet: Column, callees: list[str]) -> Column:
    """(callee, args) of the first decorator of a snippet that calls one of callees; null without."""
    parts = F.transform(F.slice(F.split(snippet, "@"), 2, 1 << 30), lambda p: F.struct(F.trim(F.substring_index(p, "(", 1)).alias("callee"), F.ltrim(F.substr(p, F.instr(p, "(") + 1)).alias("args")))
    return F.get(F.filter(parts, lambda p: p["callee"].isin(callees) & (p["args"] != "")), 0)


def _literal(args: Column) -> Column:
    """The quoted text that args begin with; null where they do not."""
    parts = lambda mark: F.split(F.substr(args, F.lit(2)), mark)
    return F.coalesce(*(F.when(args.startswith(mark) & (F.size(parts(mark)) > 1), F.get(parts(mark), 0)) for mark in ("'", '"')))


def recovered(method: Column, route: Column, snippet: Column) -> tuple[Column, Column]:
    """Method and route of a find, or, where it lacks one, of its snippet.

    A decorator named after a verb gives both; a route decorator gives the first verb of its list of methods, or GET;
    else the snippet's first two words are taken.
    """
    by_verb = _decorator(snippet, [f"{o}.{v.lower()}" for o in VERB_OWNERS for v in VERBS])
    by_route = _decorator(snippet, [f"{o}.route" for o in ROUTE_OWNERS])
    verb_at, route_at = _literal(by_verb["args"]), _literal(by_route["args"])
    listed = F.substring_index(F.substring_index(F.get(F.split(by_route["args"], r"methods\s*="), 1), "]", 1), "[", -1)
    verbs = F.filter(F.transform(F.split(listed, ","), lambda x: F.upper(F.btrim(x, F.lit(" \t\n'\"")))), lambda x: x.isin(VERBS))
    words = F.split(F.trim(snippet), r"\s+")
    have = (F.coalesce(method, F.lit("")) != "") & (F.coalesce(route, F.lit("")) != "")
    two = F.size(words) >= 2
    m = F.when(have, F.upper(method)).when(verb_at != "", F.upper(F.substring_index(by_verb["callee"], ".", -1))).when(route_at != "", F.coalesce(F.get(verbs, 0), F.lit("GET"))).when(two, F.upper(F.get(words, 0))).otherwise(F.upper(method))
    r = F.when(have, route).when(verb_at != "", verb_at).when(route_at != "", route_at).when(two, F.get(words, 1)).otherwise(route)
    return m, r


def endpoints(findings: DataFrame) -> DataFrame:
    """API findings (with a snippet where they lack method or route) as endpoints in order of path, method, source."""
    snippet = F.col("snippet") if "snippet" in findings.columns else F.lit("")
    method, route = recovered(F.col("method"), F.col("route"), F.coalesce(snippet, F.lit("")))
    kind = source_kind(F.col("strength"), F.col("parse_level"))
    rows = findings.where("concept = 'API'").select(method.alias("method"), fp.api_path(route).alias("path"), kind.alias("source_kind"), F.col("path").alias("file"), "start_line", "end_line")
    rows = rows.where("method <> '' and path <> ''").withColumn("confidence", confidence(F.col("source_kind")))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("method", "path", "source_kind", "file", "start_line", "end_line")]
    return rows.withColumn("endpoint_id", F.sha1(F.concat_ws("|", *parts).cast("binary"))).distinct().orderBy("path", "method", "source_kind", "file", "start_line")


def mismatches(surface: DataFrame) -> DataFrame:
    """(side, method, path): what only code or only a specification has, and what is declared several times."""
    code, spec, keys = surface.where("source_kind <> 'openapi'"), surface.where("source_kind = 'openapi'"), ["method", "path"]
    several = code.groupBy("method", "path").agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    out = linking.missing(code, spec, keys).withColumn("side", F.lit("missing_in_spec"))
    out = out.unionByName(linking.missing(spec, code, keys).withColumn("side", F.lit("missing_in_code")))
    return out.unionByName(several.withColumn("side", F.lit("duplicate"))).select("side", *keys).orderBy("side", "path", "method")


def callers(findings: DataFrame) -> DataFrame:
    """HTTP calls in the form that links are made from."""
    rows = findings.where("kind = 'api.call'").select(F.col("fid").alias("caller_id"), "method", fp.link_path(F.col("route")).alias("path"), F.col("path").alias("file"), "start_line")
    return rows.where("path <> ''")
