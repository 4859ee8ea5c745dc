"""URL path normal forms, templates and joins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _template(path: Column) -> Column:
    """Backslashes and repeated slashes straightened; <x>, <type:x> and :x as {x}; blanks inside braces dropped."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "/{2,}", "/")
    p = F.regexp_replace(p, "<(?:[^<>:/]+:)?([^<>/]+)>", "{$1}")
    p = F.regexp_replace(p, ":([A-Za-z_][A-Za-z0-9_]*)", "{$1}")
    return F.regexp_replace(p, r"\{ *([^{}/]*[^{}/ ]) *\}", "{$1}")


def _framed(p: Column) -> Column:
    p = F.regexp_replace(p, "(.)/+$", "$1")
    return F.when(p == "", "/").when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def api_path(path: Column) -> Column:
    """Normal form of a declared route."""
    return _framed(_template(F.coalesce(path, F.lit(""))))


def link_path(path: Column) -> Column:
    """Normal form for matching callers: without query and fragment."""
    return _framed(_template(F.regexp_replace(F.coalesce(path, F.lit("")), "[?#].*$", "")))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def is_placeholder(segment: Column) -> Column:
    return segment.rlike(r"^\{[^{}]+\}$")
