"""Intermediate tables in the folder that all executors share; what Python workers import."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from the path the driver uses."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":") + os.environ.get("PYTHONPATH", "").split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{known}:{root}".strip(":")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests, one machine) a temporary one."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="kinweave-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_roots: dict[str, None] = {}


class Stash:
    """Intermediate tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/kinweave-{uuid.uuid4().hex}"
        self.number = 0
        _roots[self.root] = None

    def __call__(self, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.number}"
        self.number += 1
        frame.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out.stash_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, frame: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        _delete(self.spark, frame.stash_path)  # type: ignore[attr-defined]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def roots() -> set[str]:
    """The folders that this driver has staged tables in."""
    return set(_roots)


def clear(spark: SparkSession, which: set[str] | None = None) -> None:
    """Delete the tables in these folders (all by default), once no result that reads them is needed any more."""
    for root in sorted(_roots if which is None else which):
        _delete(spark, root)
        _roots.pop(root, None)


def spread(rows: DataFrame) -> DataFrame:
    """Deals rows out if their input has fewer splits than there are cores; larger inputs stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
