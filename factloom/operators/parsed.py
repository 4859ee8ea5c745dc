"""Detectors that need a file's structure: Python by its syntax tree, Java and TypeScript by blocks and annotations.

``structure(files)`` parses each file once, in Arrow batches next to its rows, and gives one
table of everything found.  A file that can't be parsed gives one row of kind ``parse_error``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

FIELDS = ["path", "language", "framework", "kind", "name", "method", "route", "op", "start_line", "end_line", "scope", "scope_start", "scope_end", "confidence"]
SCHEMA = "path string, language string, framework string, kind string, name string, method string, route string, op string, start_line int, end_line int, scope string, scope_start int, scope_end int, confidence double"
_TYPES = [pa.string()] * 8 + [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.float64()]
VERBS = ("get", "post", "put", "delete", "patch", "options", "head")

# Constructors that make an object a framework's, and operations of caches.
MAKERS = {"FastAPI": "fastapi", "APIRouter": "fastapi", "Flask": "flask", "Blueprint": "flask", "Celery": "celery", "Redis": "redis", "StrictRedis": "redis", "from_url": "redis"}
DJANGO_CACHE_OPS = {"get", "set", "add", "delete", "incr", "decr"}
REDIS_OPS = {"get", "set", "setnx", "hget", "hset", "lpush", "rpush", "publish", "xadd"}


class PythonFacts(ast.NodeVisitor):
    """Walks a module with the stack of scopes at hand; a decorator's scope is the function that it decorates."""

    def __init__(self, tree: ast.Module):
        self.rows: list[dict] = []
        self.made: dict[str, str] = {}
        self.text: dict[str, str] = {}
        self.scopes: list[tuple[str, int, int]] = [("", 1, max((getattr(n, "end_lineno", 1) or 1 for n in tree.body), default=1))]
        for node in tree.body:
            if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
                literal = self.string(node.value)
                if literal is not None:
                    self.text[node.targets[0].id] = literal
        for node in ast.walk(tree):
            if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call):
                maker = self.called(node.value)[1]
                if maker in MAKERS:
                    self.made.update({t.id: MAKERS[maker] for t in node.targets if isinstance(t, ast.Name)})
        self.visit(tree)

    def string(self, node: ast.AST | None) -> str | None:
        """A literal, a module constant, or a sum of such."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return node.value
        if isinstance(node, ast.Name):
            return self.text.get(node.id)
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            parts = self.string(node.left), self.string(node.right)
            return None if None in parts else "".join(parts)
        return None

    @staticmethod
    def called(call: ast.Call) -> tuple[str, str]:
        """(object, name) of what is called; the object is '' for a plain name."""
        f = call.func
        if isinstance(f, ast.Attribute):
            return (f.value.id if isinstance(f.value, ast.Name) else "", f.attr)
        return "", f.id if isinstance(f, ast.Name) else ""

    def add(self, node: ast.AST, framework: str, kind: str, confidence: float = 0.86, **more: str | None) -> None:
        name, a, e = self.scopes[-1]
        self.rows.append({"framework": framework, "kind": kind, "start_line": node.lineno, "end_line": node.end_lineno, "scope": name, "scope_start": a, "scope_end": e, "confidence": confidence} | more)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.inside(node)

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self.function(node)

    def visit_AsyncFunctionDef(self, node: ast.AsyncFunctionDef) -> None:
        self.function(node)

    def inside(self, node: ast.AST) -> None:
        self.scopes.append((node.name, node.lineno, node.end_lineno))
        self.generic_visit(node)
        self.scopes.pop()

    def function(self, node: ast.AST) -> None:
        self.scopes.append((node.name, node.lineno, node.end_lineno))
        for d in node.decorator_list:
            self.decorator(node, d)
        self.scopes.pop()
        self.inside(node)

    def decorator(self, function: ast.AST, d: ast.AST) -> None:
        call = d if isinstance(d, ast.Call) else None
        base, attr = self.called(call) if call else self.called(ast.Call(func=d, args=[], keywords=[]))
        made = self.made.get(base)
        words = {k.arg: k.value for k in call.keywords} if call else {}
        if call and made == "fastapi" and attr in VERBS:
            route = (self.string(call.args[0]) if call.args else None) or self.string(words.get("path"))
            if route:
                self.add(d, "fastapi", "api.route", name=function.name, method=attr.upper(), route=route)
        elif call and made == "flask" and attr == "route":
            route = self.string(call.args[0]) if call.args else None
            listed = words.get("methods")
            methods = [m for m in map(self.string, getattr(listed, "elts", [])) if m] or ["GET"]
            for m in methods if route else ():
                self.add(d, "flask", "api.route", name=function.name, method=m.upper(), route=route)
        elif base == "transaction" and attr == "atomic":
            self.add(d, "django", "db.transaction", name=function.name)
        elif (base == "" and attr == "shared_task") or (made == "celery" and attr == "task"):
            self.add(function, "celery", "queue.consume", name=function.name)

    def visit_With(self, node: ast.With) -> None:
        if any(isinstance(i.context_expr, ast.Call) and self.called(i.context_expr) == ("transaction", "atomic") for i in node.items):
            self.add(node, "django", "db.transaction")
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        base, name = self.called(node)
        if isinstance(node.func, ast.Attribute) and name in ("delay", "apply_async"):
            self.add(node, "celery", "queue.dispatch", name=base or None, op=name)
        elif base == "cache" and name in DJANGO_CACHE_OPS:
            self.add(node, "django", "cache.read" if name == "get" else "cache.invalidate" if name == "delete" else "cache.write", op=name)
        elif base and (self.made.get(base) == "redis" or "redis" in base.lower()) and name in REDIS_OPS:
            self.add(node, "redis", "cache.read" if name in ("get", "hget") else "cache.write", op=name)
        self.generic_visit(node)


class Blocks:
    """A brace language's source with comments and strings blanked, its classes, and its annotations with what they stand on."""

    _DULL = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)

    def __init__(self, source: str):
        self.source = source
        self.clean = self._DULL.sub(lambda m: m[0] if m[0][0] in "\"'`" and len(m[0]) < 2 else re.sub(r"[^\n]", " ", m[0]), source)
        self.depth = list(accumulate((1 if c == "{" else -1 if c == "}" else 0 for c in self.clean), initial=0))
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.classes = []
        for m in re.finditer(r"\bclass\s+([A-Za-z_]\w*)[^{;]*\{", self.clean):
            self.classes.append((m[1], m.start(), self.closing(m.end() - 1, "{", "}")))

    def closing(self, at: int, opens: str, closes: str) -> int:
        level = 0
        for i in range(at, len(self.clean)):
            level += (self.clean[i] == opens) - (self.clean[i] == closes)
            if not level:
                return i
        return len(self.clean)

    def line(self, at: int) -> int:
        lo, hi = 0, len(self.starts)
        while lo + 1 < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= at else (lo, mid)
        return lo + 1

    def around(self, at: int) -> tuple[str, int, int] | None:
        """The innermost class at a place."""
        return min((c for c in self.classes if c[1] <= at <= c[2]), key=lambda c: c[2] - c[1], default=None)

    def annotations(self) -> Iterator[tuple[str, str, int, str, str]]:
        """(name, arguments as written, place, 'class' or 'method', the name of what it stands on)."""
        for m in re.finditer(r"@([A-Za-z_]\w*)", self.clean):
            at, args = m.end(), ""
            opened = re.compile(r"\s*\(").match(self.clean, at)
            if opened:
                end = self.closing(opened.end() - 1, "(", ")")
                args, at = self.source[opened.end() : end], end + 1
            on = self.target(at)
            if on:
                yield m[1], args, m.start(), *on

    def target(self, at: int) -> tuple[str, str] | None:
        while True:
            more = re.compile(r"\s*@[A-Za-z_]\w*").match(self.clean, at)
            if not more:
                break
            at = more.end()
            opened = re.compile(r"\s*\(").match(self.clean, at)
            at = self.closing(opened.end() - 1, "(", ")") + 1 if opened else at
        head = re.compile(r"[^;{}=(]*").match(self.clean, at)[0]
        named = re.search(r"\bclass\s+([A-Za-z_]\w*)", head)
        if named:
            return "class", named[1]
        method = re.search(r"([A-Za-z_]\w*)\s*$", head)
        return ("method", method[1]) if method and self.clean[at + len(head) : at + len(head) + 1] == "(" else None


def _literal(args: str, *keys: str) -> str | None:
    """The first string of an annotation's arguments ('' for none), or of one of its keys; None where it is computed."""
    named = next((m for k in keys for m in [re.search(rf"\b{k}\s*=\s*", args)] if m), None)
    rest = args[named.end() :] if named else args
    if not named and re.match(r"\s*\w+\s*=", rest):
        return ""
    m = re.match(r"\s*[{\[]?\s*(['\"])(.*?)\1\s*(\+)?", rest)
    if m:
        return None if m[3] else m[2]
    return "" if not rest.strip() else None


def _join(prefix: str, path: str) -> str:
    p = re.sub("/{2,}", "/", f"/{prefix}/{path}")
    p = re.sub(r":([A-Za-z_]\w*)", r"{\1}", p)
    return p.rstrip("/") or "/"


# Methods of data access by what they do, and the confidence of each style.
REPOSITORY = {"save": "db.write", "saveAll": "db.write", "deleteById": "db.write", "delete": "db.write", "findById": "db.read", "findAll": "db.read", "existsById": "db.read"}
ENTITY_MANAGER = {"persist": "db.write", "merge": "db.write", "remove": "db.write", "find": "db.read"}
SESSION = {"insert": "db.write", "update": "db.write", "delete": "db.write", "selectOne": "db.read", "selectList": "db.read"}
STYLES = [
    (r"\w*Repository", "repository", REPOSITORY, "jpa", 0.82), (r"EntityManager", "entityManager", ENTITY_MANAGER, "jpa", 0.84),
    (r"\w+Mapper", "mapper", SESSION | {"select": "db.read"}, "mybatis", 0.8), (r"SqlSession(?:Template)?", "sqlSession", SESSION, "mybatis", 0.82),
]
MAPPINGS = {f"{v.title()}Mapping": v.upper() for v in ("get", "post", "put", "delete", "patch")}


def java_facts(source: str) -> list[dict]:
    b, rows = Blocks(source), []

    def add(at: int, framework: str, kind: str, confidence: float, **more: str | None) -> None:
        c = b.around(at)
        rows.append({"framework": framework, "kind": kind, "start_line": b.line(at), "end_line": b.line(at), "scope": c and c[0], "scope_start": c and b.line(c[1]), "scope_end": c and b.line(c[2]), "confidence": confidence} | more)

    found = list(b.annotations())
    prefixes = {on: _literal(args, "value", "path") or "" for name, args, _, where, on in found if name == "RequestMapping" and where == "class"}
    for name, args, at, where, on in found:
        if where == "method" and (name in MAPPINGS or name == "RequestMapping"):
            declared = re.search(r"RequestMethod\.([A-Z]+)", args)
            path, c = _literal(args, "value", "path"), b.around(at)
            if path is not None:
                add(at, "spring", "api.route", 0.85, name=on, method=MAPPINGS.get(name) or (declared[1] if declared else "GET"), route=_join(prefixes.get(c[0], "") if c else "", path))
        elif name == "Transactional":
            add(at, "spring", "db.transaction", 0.84, name=on, op=where)
        elif name in ("KafkaListener", "RabbitListener"):
            add(at, "spring_kafka" if name[0] == "K" else "spring_rabbit", "queue.consume", 0.84, name=_literal(args, "topics", "queues"))
    for kind, default, verb, framework in (("KafkaTemplate", "kafkaTemplate", "send", "spring_kafka"), ("RabbitTemplate", "rabbitTemplate", "convertAndSend", "spring_rabbit")):
        for symbol in _symbols(b.clean, kind) | {default}:
            for m in re.finditer(rf"\b{symbol}\.{verb}\s*\(", b.clean):
                args = source[m.end() : b.closing(m.end() - 1, "(", ")")]
                literals = re.findall(r"\"([^\"]*)\"", args)
                add(m.start(), framework, "queue.dispatch", 0.82, name=literals[0] if literals else None, route=literals[1] if framework == "spring_rabbit" and len(literals) > 1 else None)
    for kind, default, methods, framework, confidence in STYLES:
        for symbol in _symbols(b.clean, kind) | {default}:
            for m in re.finditer(rf"\b{symbol}\.(\w+)\s*\(", b.clean):
                op = m[1] if m[1] in methods else next((k for k in sorted(methods, key=len, reverse=True) if framework == "mybatis" and "Mapper" in kind and m[1].startswith(k)), None)
                if op:
                    add(m.start(), framework, methods[op], confidence, name=symbol, op=m[1])
    return rows


def _symbols(clean: str, kind: str) -> set[str]:
    """Names declared with a type, generics or not."""
    return set(re.findall(rf"\b{kind}(?:<[^;=()]*>)?\s+([A-Za-z_]\w*)\s*[;=,)]", clean))


def nest_facts(source: str) -> list[dict]:
    b, rows = Blocks(source), []
    found = list(b.annotations())
    prefixes = {on: _literal(args) or "" for name, args, _, where, on in found if name == "Controller" and where == "class"}
    for name, args, at, where, on in found:
        c = b.around(at)
        if where == "method" and name.upper() in ("GET", "POST", "PUT", "DELETE", "PATCH") and c and c[0] in prefixes:
            path = _literal(args)
            if path is not None:
                rows.append({"framework": "nestjs", "kind": "api.route", "name": on, "method": name.upper(), "route": _join(prefixes[c[0]], path), "start_line": b.line(at), "end_line": b.line(at), "scope": c[0], "scope_start": b.line(c[1]), "scope_end": b.line(c[2]), "confidence": 0.84})
    for pattern, framework in ((r"\$transaction\s*\(", "prisma"), (r"(?i:\b\w*(?:datasource|manager|connection)\w*)\.transaction\s*\(", "typeorm")):
        for m in re.finditer(pattern, b.clean):
            rows.append({"framework": framework, "kind": "db.transaction", "start_line": b.line(m.start()), "end_line": b.line(m.start()), "confidence": 0.83})
    return rows


def facts(path: str, source: str) -> list[dict]:
    """Everything found in one file, by its extension."""
    if path.endswith(".py"):
        try:
            rows, language = PythonFacts(ast.parse(source)).rows, "python"
        except (SyntaxError, ValueError, RecursionError):
            rows, language = [{"kind": "parse_error", "confidence": 0.0}], "python"
    elif path.endswith(".java"):
        rows, language = java_facts(source), "java"
    elif path.endswith((".ts", ".tsx", ".mts", ".cts")):
        rows, language = nest_facts(source), "typescript"
    else:
        return []
    out = [{"path": path, "language": language} | r for r in rows]
    return sorted(out, key=lambda r: (r.get("start_line") or 0, r["kind"], r.get("method") or "", r.get("op") or ""))


def structure(files: DataFrame) -> DataFrame:
    """facts of all files (path, content); one parse for each file, whatever the number of detectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, s in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) if p and s for r in facts(p, s)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], t) for f, t in zip(FIELDS, _TYPES, strict=True)], names=FIELDS)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
