"""Scan rules: which detector runs on which files, and what its findings are called."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import files as ff
from ..storage import union_all
from . import extract, parsed, walk

FOUND = (
    "path string, language string, framework string, kind string, concept string, rule_id string, parse_level string, strength string, name string, method string, route string, op string, "
    "start_line int, end_line int, scope string, scope_start int, scope_end int, confidence double"
)


@dataclass(frozen=True)
class ScanRule:
    """kind names a detector; globs and exclude say which paths it sees; patterns or signals are those of a text rule."""

    rule_id: str
    kind: str
    concept: str = ""
    globs: Sequence[str] = ("**/*",)
    exclude: Sequence[str] = ()
    base: float = 0.3
    level: str = "L1"
    patterns: Sequence[str] = ()
    signals: walk.Rule | None = field(default=None)


DEFAULT_RULES = [
    ScanRule("api.openapi", "openapi", "API", ("**/*.json", "**/*.yaml", "**/*.yml"), level="L2"),
    ScanRule("db.sql_tx", "sql_tx", "Transaction", ("**/*.sql",), level="L2"),
    ScanRule("db.sql_ddl", "sql_ddl", "Storage", ("**/*.sql",), level="L2"),
    ScanRule("ci.workflow", "gha", "Scheduling", ("*.github/workflows/*",), level="L2"),
    ScanRule("infra.dockerfile", "dockerfile", "FileSystem", ("*Dockerfile*",), level="L2"),
    ScanRule("infra.compose", "compose", "Queue", ("*docker-compose*.yml", "*docker-compose*.yaml", "*compose.yaml"), level="L2"),
    ScanRule("deps.manifest", "deps", "Config", ("*requirements*.txt", "*package.json", "*go.mod"), level="L2"),
    ScanRule("source.parsed", "source", "", ("**/*.py", "**/*.java", "**/*.ts", "**/*.tsx"), level="L3"),
    ScanRule("source.script", "script", "", ("**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx"), level="L2"),
]


def glob_regex(glob: str) -> str:
    """A regular expression for a whole path: * is anything, ? one character, [...] a set."""
    out = ""
    for part in re.findall(r"\[!?[^\]]+\]|.", glob, re.DOTALL):
        if part == "*":
            out += ".*"
        elif part == "?":
            out += "."
        elif len(part) > 1:
            out += "[^" + part[2:] if part[1] == "!" else part
        else:
            out += re.escape(part)
    return f"(?s)^(?:{out})$"


def sees(path: Column, globs: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Whether a rule sees a path: '**/*' sees all, '**/*.x' all of that extension."""
    p = F.regexp_replace(path, r"\\", "/")
    one_of = lambda some: F.lit(False) if not some else F.coalesce(p.rlike("|".join(glob_regex(g) for g in some)), F.lit(False))
    if not globs or "**/*" in globs:
        seen = F.lit(True)
    else:
        extensions = [f".{g.split('.')[-1].lower()}" for g in globs if g.startswith("**/*.")]
        seen = ff.extension(path).isin(extensions) | one_of(globs) if extensions else one_of(globs)
    return seen & ~one_of(exclude)


def seen_by(path: Column, rules: Sequence[ScanRule]) -> Column:
    """The places of the rules that see a path, as in _0_7_; _ where none does."""
    return F.concat(F.lit("_"), *(F.when(sees(path, r.globs, r.exclude), f"{k}_").otherwise("") for k, r in enumerate(rules)))


# What a kind of event is called as a concept.
CONCEPT_OF = {"api": "API", "db.transaction": "Transaction", "db": "DB", "queue": "Queue", "cache": "Cache"}


def concept_of(kind: Column) -> Column:
    family = F.substring_index(kind, ".", 1)
    return F.when(kind == "db.transaction", "Transaction").when(family == "api", "API").when(family == "db", "DB").when(family == "queue", "Queue").when(family == "cache", "Cache")


def _as_found(rows: DataFrame, rule: ScanRule, **named: Column | str | float | None) -> DataFrame:
    """rows in the form of FOUND: columns of rows, overlaid by named ones (a text is a value, a Column an expression)."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    have = {c: F.col(c) for c in rows.columns} | {k: col(v) for k, v in named.items()}
    have.setdefault("start_line", have.get("line_no", F.lit(1)))
    have.setdefault("end_line", have["start_line"])
    have |= {"rule_id": F.lit(rule.rule_id), "parse_level": have.get("parse_level", F.lit(rule.level))}
    out = []
    for part in FOUND.split(", "):
        name, kind = part.split(" ")
        out.append(have.get(name, F.lit(None)).cast(kind).alias(name))
    return rows.select(*out)


def _raised(base: float, confidence: Column | float) -> Column:
    return F.greatest(F.lit(base), confidence if isinstance(confidence, Column) else F.lit(confidence))


def _openapi(files: DataFrame, r: ScanRule) -> list[DataFrame]:
    yaml = extract.openapi_yaml(extract.lines_of(files.where(F.lower("path").rlike(r"\.ya?ml$"))))
    json = extract.openapi_json(files.where(F.lower("path").endswith(".json")))
    same = {"language": "openapi", "framework": "openapi", "kind": "api.route", "concept": r.concept, "strength": "openapi", "confidence": _raised(r.base, 0.85), "start_line": 1, "end_line": 1}
    return [_as_found(x, r, **same) for x in (json, yaml)]


def _sql_tx(files: DataFrame, r: ScanRule) -> list[DataFrame]:
    rows = extract.sql_tx(extract.lines_of(files))
    return [_as_found(rows, r, language="sql", framework="sql", kind="db.transaction", concept=r.concept, strength="text", op="sql_begin_commit", confidence=_raised(r.base, 0.8))]


def _sql_ddl(files: DataFrame, r: ScanRule) -> list[DataFrame]:
    rows = extract.sql_ddl(extract.lines_of(files))
    return [_as_found(rows, r, language="sql", framework="sql", kind=F.when(F.col("concept") == "Index", "schema.index").otherwise("schema.table"), strength="sql_ddl", confidence=_raised(r.base, F.col("confidence")))]


def _workflow(files: DataFrame, r: ScanRule) -> list[DataFrame]:
    return [_as_found(extract.workflow_steps(extract.lines_of(files)), r, kind="ci.step", strength="gha", confidence=_raised(r.base, F.col("confidence")))]


def _dockerfile(files: DataFrame, r: ScanRule) -> list[DataFrame]:
    return [_as_found(extract.dockerfile(extract.lines_of(files)), r, kind="infra.file", strength="dockerfile", confidence=_raised(r.base, 0.6))]


def _compose(files: DataFrame, r: ScanRule) -> list[DataFrame]:
    return [_as_found(extract.compose_infra(extract.lines_of(files)), r, kind="infra.service", name=F.col("service"), op=F.col("infra"), strength="compose", confidence=_raised(r.base, 0.6))]


def _dependencies(files: DataFrame, r: ScanRule) -> list[DataFrame]:
    base = F.col("path")
    lines = extract.lines_of(files.where(base.endswith(".txt") | base.endswith("go.mod")))
    confidence = F.least(_raised(r.base, 0.5), F.lit(0.65))
    same = {"kind": "dependency", "concept": r.concept, "strength": "deps", "confidence": confidence}
    package = extract.package_json(files.where(base.endswith("package.json"))).where("section <> 'scripts'")
    return [
        _as_found(extract.requirements(lines.where(base.endswith(".txt"))), r, name=F.col("dependency"), language="python", **same),
        _as_found(extract.go_mod(lines.where(base.endswith("go.mod"))), r, name=F.col("dependency"), language="go", op=F.col("version"), **same),
        _as_found(package, r, language="node", op=F.col("value"), **same),
    ]


def _source(files: DataFrame, r: ScanRule) -> list[DataFrame]:
    strength = F.when(F.col("language") == "python", "python_ast").otherwise(F.concat("language", F.lit("_l2")))
    level = F.when(F.col("language") == "python", "L3").otherwise("L2")
    return [_as_found(parsed.structure(files), r, concept=concept_of(F.col("kind")), strength=strength, parse_level=level)]


def _script(files: DataFrame, r: ScanRule) -> list[DataFrame]:
    lines = extract.lines_of(files)
    same = {"language": "typescript", "strength": "typescript_l2"}
    cache = extract.cache_operations(lines)
    return [
        _as_found(extract.express_routes(lines), r, framework="express", kind="api.route", concept="API", **same),
        _as_found(cache, r, framework=F.when(F.col("ioredis"), "ioredis").otherwise("redis"), concept="Cache", name=F.col("symbol"), confidence=0.8, **same),
        _as_found(extract.queue_operations(lines), r, framework="bullmq", concept="Queue", name=F.col("queue"), confidence=0.81, **same),
        _as_found(extract.http_callers(lines), r, framework=F.col("client"), kind="api.call", concept="External IO", route=F.col("raw"), **same),
    ]


def _text(files: DataFrame, r: ScanRule) -> list[DataFrame]:
    """A finding for each match of a pattern, case aside; or one for each file that a rule's signals reach."""
    if r.signals is not None:
        rows = walk.score_rules(files, [r.signals])
        return [_as_found(rows, r, kind="text", concept=r.concept, strength="text", confidence=_raised(r.base, F.col("score")))]
    out = []
    for k, p in enumerate(r.patterns):
        hits = extract.lines_of(files).withColumn("n", F.regexp_count("line", F.lit(f"(?i){p}"))).where("n > 0")
        hits = hits.select("path", "line_no", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))
        out.append(_as_found(hits, r, kind="text", concept=r.concept, strength="text", op=F.col("nth").cast("string") if not k else F.concat(F.lit(f"{k}."), F.col("nth")), confidence=r.base))
    return out


DETECTORS = {
    "openapi": _openapi, "sql_tx": _sql_tx, "sql_ddl": _sql_ddl, "gha": _workflow, "dockerfile": _dockerfile, "compose": _compose, "deps": _dependencies, "source": _source, "script": _script, "text": _text,
}


def detect(files: DataFrame, rules: Sequence[ScanRule] = DEFAULT_RULES) -> DataFrame:
    """What all rules find in files (path, content), in the form of FOUND.  Where files have seen_by of the same rules, as a column seen, that is taken."""
    own = lambda k, r: F.col("seen").contains(f"_{k}_") if "seen" in files.columns else sees(F.col("path"), r.globs, r.exclude)
    out = [rows for k, r in enumerate(rules) for rows in DETECTORS[r.kind](files.where(own(k, r)).select("path", "content"), r)]
    return union_all(out) if out else files.sparkSession.createDataFrame([], FOUND)
