"""Where intermediate tables live: Parquet in the folder that ``spark.checkpoint.dir`` names, which every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

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


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: computed once, and later plans start from it.

    by: a column of few values, none null or empty, each in a folder of its own; a filter on it reads only those that fit.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """The union of frames by name, paired up, so that no plan is analysed again for each of them."""
    frames = list(frames)
    while len(frames) > 1:
        frames = [frames[i].unionByName(frames[i + 1]) if i + 1 < len(frames) else frames[i] for i in range(0, len(frames), 2)]
    return frames[0]
