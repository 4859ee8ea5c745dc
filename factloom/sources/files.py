"""File trees and archives as rows of (path, content, size, sha256)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import ScanRule
from ..operators.walk import Rule, skip_reason

ZIP_LIMITS = {"entries": 50_000, "entry_bytes": 8 << 20, "total_bytes": 1 << 30}


def read_tree(spark: SparkSession, root: str, glob: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """All files under a folder that Spark can read, their paths relative to it; of those over max_bytes the content is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = root.rstrip("/")
    base = base.split("://", 1)[-1].lstrip("/") if "://" in base else base.lstrip("/")
    relative = F.regexp_replace(F.regexp_extract("path", f"{base.replace('.', chr(92) + '.')}/(.*)$", 1), "%20", " ").alias("path")
    size = F.col("length").alias("size")
    read = df if max_bytes is None else df.where(F.col("length") <= max_bytes)
    rows = read.select(relative, F.decode("content", "UTF-8").alias("content"), size, F.sha2("content", 256).alias("sha256"))
    if max_bytes is None:
        return rows
    none = F.lit(None).cast("string")
    return rows.union(df.where(F.col("length") > max_bytes).select(relative, none.alias("content"), size, none.alias("sha256")))


def read_zips(spark: SparkSession, archives: str, limits: dict[str, int] = ZIP_LIMITS) -> DataFrame:
    """Members of ZIP archives; unsafe names and members beyond the limits come as rows with a reason instead of content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, raw in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, total = [], 0
                with zipfile.ZipFile(io.BytesIO(raw.as_buffer())) as z:
                    for n, info in enumerate(i for i in z.infolist() if not i.is_dir()):
                        name = info.filename.replace("\\", "/")
                        total += info.file_size
                        reason = "too_many" if n >= limits["entries"] else "traversal" if name.startswith("/") or ".." in name.split("/") else "too_large" if info.file_size > limits["entry_bytes"] else "total" if total > limits["total_bytes"] else None
                        rows.append((archive, name, None if reason else z.read(info).decode("utf-8", "replace"), info.file_size, reason))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()], strict=True)], names=["archive", "path", "content", "size", "reason"])

    return spark.read.format("binaryFile").load(archives).select("path", "content").mapInArrow(run, "archive string, path string, content string, size long, reason string")


def kept(files: DataFrame, max_bytes: int = 2 << 20) -> DataFrame:
    """files without those that are skipped."""
    return files.where(skip_reason(F.col("path"), F.col("size"), F.col("content"), max_bytes=max_bytes).isNull())


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A case library of JSON lines; lines that aren't JSON are dropped."""
    schema = "case_id string, concept string, level int, language string, label string, evidence array<struct<path:string,start_line:int,end_line:int>>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_rules(spark: SparkSession, path: str) -> list[ScanRule]:
    """Scan rules from JSON or, where PyYAML is installed, YAML: a list of records, or one under "rules"."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml

        rules = yaml.safe_load(text)
    except ImportError:
        import json

        rules = json.loads(text)
    if isinstance(rules, dict):
        rules = rules.get("rules")
    return [_rule(r) for r in rules or []]


def _rule(r: dict) -> ScanRule:
    patterns = [p if isinstance(p, str) else p.get("value") or p.get("regex") for p in r.get("patterns") or []]
    meta = r.get("meta") or {}
    said, gate, weigh = meta.get("signals") or {}, meta.get("gating") or {}, meta.get("scoring") or {}
    base, name = float(r.get("confidence_base") or 0.3), r.get("rule_id") or r.get("id")
    signals = None
    if said or gate or weigh:
        signals = Rule(
            name, list(said.get("strong") or []), list(said.get("medium") or []), list(said.get("negative") or []), list(gate.get("required_markers_all") or []), list(gate.get("anti_patterns_block_if") or []),
            float(weigh.get("weight_strong", 0.5)), float(weigh.get("weight_medium", 0.35)), abs(float(weigh.get("penalty_negative", 0.3))), base,
        )
    globs = tuple(r.get("globs") or r.get("include_globs") or ("**/*",))
    return ScanRule(name, r.get("kind") or "text", r.get("concept") or "", globs, tuple(r.get("exclude_globs") or ()), base, r.get("parse_level") or "L1", tuple(p for p in patterns if p), signals)
