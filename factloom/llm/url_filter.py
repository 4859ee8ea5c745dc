"""URL rules in a trie over reversed host labels, then path segments; the longest rule that fits wins.

A rule is (host, path, verdict).  It fits its host and all subdomains, where the url's path
starts with the rule's.  The more host labels, the longer a rule; of equal hosts the longer
path; of equal rules block.  What no rule fits gets the default verdict.

The trie is broadcast while there are at most ``max_rules`` rules (some 100 bytes each);
beyond that the same answer comes from an equi-join of url prefixes with the rules.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule
with a host and gets the default; repeated rows are each judged; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 500_000
DEFAULT = "allow"
OUT = "host string, path string, rule string, verdict string"

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST = re.compile(r"[^/?#]*")
_PATH = re.compile(r"[^?#]*")


def host_path(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host[0].translate(_UPPER), _PATH.match(url, host.end())[0]


class Trie:
    """Labels lead to hosts, segments to folders; a folder keeps the rest of its rules' paths, longest first."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in sorted(rules, key=lambda r: r[2] == "block"):
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            folder = node.setdefault(None, {})  # None is no label: the paths of this host
            whole, slash, rest = path.rpartition("/")
            for segment in (whole + slash).split("/")[:-1]:
                folder = folder.setdefault(segment, {})
            folder.setdefault(None, {})[rest] = (host + path, verdict)
        self._arrange(self.root, True)

    def _arrange(self, node: dict, hosts: bool) -> None:
        for key, child in node.items():
            if key is not None or hosts:
                self._arrange(child, hosts and key is not None)
        if not hosts and None in node:
            node[None] = sorted(node[None].items(), key=lambda x: -len(x[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        node = self.root
        labels = reversed(host.split(".")) if host else ()
        hit = self._below(node.get(None), path)
        for label in labels:
            node = node.get(label)
            if node is None:
                break
            hit = self._below(node.get(None), path) or hit
        return hit

    @staticmethod
    def _below(folder: dict | None, path: str) -> tuple[str, str] | None:
        hit, at = None, 0
        while folder is not None:
            for rest, told in folder.get(None, ()):
                if path.startswith(rest, at):
                    hit = told
                    break
            end = path.find("/", at)
            if end < 0:
                break
            folder = folder.get(path[at:end])
            at = end + 1
        return hit


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], key: str = "page_id", default: str = DEFAULT, max_rules: int = MAX_RULES) -> DataFrame:
    """key, host, path, rule, verdict of each row's url.  rules: rows (host, path, verdict) or a DataFrame of them."""
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        few = rules.select("host", "path", "verdict").limit(max_rules + 1).collect()
        if len(few) > max_rules:
            return judge_by_join(pages, rules, key, default)
        rules = [tuple(r) for r in few]
    rules = list(rules)
    if len(rules) > max_rules:
        return judge_by_join(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), key, default)
    shared = spark.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for b in batches:
            split = [host_path(u) for u in b.column("url").to_pylist()]
            told = [trie.find(*x) or (None, default) for x in split]
            cols = [[x[0] for x in split], [x[1] for x in split], [x[0] for x in told], [x[1] for x in told]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols)], names=[key, "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "url").mapInArrow(run, f"`{key}` {kind}, {OUT}")


def _host_path_columns(url: Column) -> tuple[Column, Column]:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, upper, lower), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)


def judge_by_join(pages: DataFrame, rules: DataFrame, key: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """The same as judge, for rules too many to broadcast: each different (host, path) meets rules by host suffix and folder."""
    host, path = _host_path_columns(F.coalesce("url", F.lit("")))
    rows = pages.select(key, host.alias("host"), path.alias("path"))
    one = rows.select("host", "path").distinct()
    labels, parts_ = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")), F.array(F.lit("")))
    folders = F.transform(F.sequence(F.lit(0), F.size(parts_) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts_, 1, i), "/"), F.lit("/"))))
    probes = one.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("h")).select("host", "path", "h", F.explode(folders).alias("f"))
    folder = F.regexp_extract("path", "^(?s:.*/)?", 0)
    table = rules.select(F.col("host").alias("h"), folder.alias("f"), F.col("path").alias("rule_path"), "verdict")
    fits = probes.join(table, ["h", "f"]).where(F.expr("startswith(path, rule_path)"))
    n_labels = F.when(F.col("h") == "", 0).otherwise(F.size(F.split("h", r"\.")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(n_labels.alias("n"), F.length("rule_path").alias("m"), (F.col("verdict") == "block").alias("b"), F.concat("h", "rule_path").alias("rule"), "verdict")).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
