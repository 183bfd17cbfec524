"""Run control: a log to screen and file, one run per output folder, restart by country."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def logger(path: str | None = None, name: str = "kinweave") -> logging.Logger:
    """Writes to standard error and, if path is given, appends to a file."""
    out = logging.getLogger(name)
    out.setLevel(logging.INFO)
    for h in list(out.handlers):
        out.removeHandler(h)
        h.close()
    form = logging.Formatter("%(asctime)s %(message)s")
    for h in [logging.StreamHandler(), *([logging.FileHandler(path)] if path else [])]:
        h.setFormatter(form)
        out.addHandler(h)
    return out


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


@contextmanager
def exclusive(folder: str) -> Iterator[None]:
    """Only one live process may write to a folder; a lock that a dead one left is taken over."""
    lock = Path(folder) / ".lock"
    lock.parent.mkdir(parents=True, exist_ok=True)
    while True:
        try:
            with open(lock, "x") as f:
                f.write(str(os.getpid()))
            break
        except FileExistsError:
            held = lock.read_text().strip()
            if held.isdigit() and _alive(int(held)):
                raise RuntimeError(f"{folder} is being written by process {held}") from None
            lock.unlink(missing_ok=True)
    try:
        yield
    finally:
        lock.unlink(missing_ok=True)


def countries_left(spark: SparkSession, records: DataFrame, path: str) -> DataFrame:
    """Records of the countries that an earlier run hasn't finished; a country's folder appears only when it is whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return records
    done = spark.read.schema("country_norm string").parquet(path).select(F.coalesce("country_norm", F.lit("")).alias("country_norm")).distinct()
    return records.join(done, "country_norm", "left_anti")
