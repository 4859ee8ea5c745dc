"""Where intermediate tables live.

Lineage is cut only by Parquet tables in the folder that ``spark.checkpoint.dir`` names,
which every executor can read; a lost executor costs its running tasks, nothing else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  In local mode, where it is unset, a temporary folder of this machine is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Spark's own setting (4.1): an execution's shuffle files go when it ends, not when the driver's next garbage collection finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, and its lineage ends there.  Its shuffle files go with the run."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, tag: str, key: str, buckets: int) -> tuple[DataFrame, str]:
    """materialize, with the rows dealt to buckets by key: a join by it shuffles only its other side.  Meant for texts, so it is compressed more.

    Also returns the table's name in the catalog, to be dropped there when all that reads it has run.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.table(name), name


#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = "1000"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS, where it has Spark's own 10000: of whole texts, those are tens of
    megabytes on both sides of each worker.  It stays set, as what an operator returns is run later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle: the session's own measure of how large its data is."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
