"""Runs kept as tables: written with all or nothing, read back as scans, and brought up to the present version.

A run's parts are Parquet folders of their own; what makes it visible is one row in the manifest,
added when every part is there.  A write that dies before leaves folders that nothing names.
Writing a run again, or upgrading it, adds a row, and the last row of a run counts; so readers
of the old one are not disturbed, and a repeated upgrade finds nothing to do.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .engine import Scan
from .operators.evidence import Budget, with_ids
from .operators.rules import FOUND

#: Version of what save writes.
VERSION = 2
MANIFEST = "run_id string, seq long, version int, place string, parts array<string>, budget string, written timestamp"
_IDS = "fid string, primary_eid string"
#: The parts of a run and their columns; a part that a run lacks reads as an empty table of these.
PARTS = {
    "files": "path string, content string, size long, sha256 string",
    "findings": f"{FOUND}, {_IDS}",
    "walked": "path string, size long, reason string",
    "found": f"{FOUND}, {_IDS}",
}

Tables = dict[str, DataFrame]


def _from_1(tables: Tables) -> Tables:
    """Version 1 told confidence in hundredths, had no ids, and knew of no file but those scanned."""
    for name in ("findings", "found"):
        if name in tables:
            rows = tables[name].withColumn("confidence", F.col("confidence") / 100.0)
            tables[name] = with_ids(conformed(rows, FOUND)) if "fid" not in rows.columns else rows
    if "found" not in tables and "findings" in tables:
        tables["found"] = tables["findings"]
    if "walked" not in tables and "files" in tables:
        tables["walked"] = tables["files"].select("path", "size", F.lit(None).cast("string").alias("reason"))
    return tables


#: By version: what makes tables of that version tables of the next.
MIGRATIONS: dict[int, Callable[[Tables], Tables]] = {1: _from_1}


def conformed(rows: DataFrame, ddl: str) -> DataFrame:
    """rows with the columns of ddl: cast where there, null where not; others go."""
    wanted = StructType.fromDDL(ddl)
    return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The last row of each run; no row where nothing was written yet."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)
    last = Window.partitionBy("run_id").orderBy(F.desc("seq"), F.desc("place"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def _entry(spark: SparkSession, root: str, run_id: str):
    found = manifest(spark, root).where(F.col("run_id") == run_id).collect()
    return found[0] if found else None


def write(spark: SparkSession, root: str, run_id: str, tables: Tables, budget: Budget = Budget(), version: int = VERSION) -> None:
    """Writes all parts, then the row that names them."""
    before, place = _entry(spark, root, run_id), f"run-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{place}/{name}")
    row = (run_id, (before["seq"] if before else 0) + 1, version, place, sorted(tables), json.dumps(dataclasses.asdict(budget)))
    spark.createDataFrame([row], MANIFEST.rsplit(",", 1)[0]).withColumn("written", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def save(scan: Scan, root: str, run_id: str) -> None:
    """Keeps a scan as a run."""
    write(scan.files.sparkSession, root, run_id, {"files": scan.files, "findings": scan.findings, "walked": scan.walked, "found": scan.found}, scan.budget)


def _tables(spark: SparkSession, root: str, run_id: str) -> tuple[Tables, Budget, int]:
    entry = _entry(spark, root, run_id)
    if entry is None:
        raise KeyError(f"no such run: {run_id}")
    if entry["version"] > VERSION:
        raise ValueError(f"run {run_id} is of version {entry['version']}, and this reads up to {VERSION}")
    tables = {name: spark.read.parquet(f"{root}/{entry['place']}/{name}") for name in entry["parts"]}
    for version in range(entry["version"], VERSION):
        tables = MIGRATIONS[version](tables)
    known = {f.name for f in dataclasses.fields(Budget)}
    budget = Budget(**{k: v for k, v in json.loads(entry["budget"] or "{}").items() if k in known})
    whole = {name: conformed(tables[name], ddl) if name in tables else spark.createDataFrame([], ddl) for name, ddl in PARTS.items()}
    return whole, budget, entry["version"]


def load(spark: SparkSession, root: str, run_id: str) -> Scan:
    """A run as a scan, whatever version it was written in; KeyError where the manifest has none of that id."""
    t, budget, _ = _tables(spark, root, run_id)
    return Scan(t["files"], t["findings"], t["walked"], t["found"], budget)


def upgrade(spark: SparkSession, root: str, run_id: str) -> bool:
    """Writes a run again in the present version; says whether there was anything to do."""
    tables, budget, version = _tables(spark, root, run_id)
    if version == VERSION:
        return False
    write(spark, root, run_id, tables, budget)
    return True
