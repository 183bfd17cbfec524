"""Outputs: id-list files, Parquet caches, JSON results, packages."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_list(roster: DataFrame, pairs: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """A row for every id of the roster, with its sorted, comma-joined ids; '' for none."""
    lists = pairs.groupBy("source1_entity_id").agg(F.concat_ws(",", F.array_sort(F.collect_set(F.trim("candidate_entity_id")))).alias(column))
    return roster.select("source1_entity_id").distinct().join(lists, "source1_entity_id", "left").select("source1_entity_id", F.coalesce(column, F.lit("")).alias(column))


def in_file_order(lists: DataFrame, records: DataFrame) -> DataFrame:
    """Lists in the order in which their ids come first in the records' file."""
    first = records.select(F.col("entity_id").alias("source1_entity_id"), F.monotonically_increasing_id().alias("_at")).groupBy("source1_entity_id").agg(F.min("_at").alias("_at"))
    return lists.join(first, "source1_entity_id").orderBy("_at").drop("_at")


def empty_lists(roster: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    return roster.select("source1_entity_id", F.lit("").alias(column))


def write_id_list(lists: DataFrame, path: str) -> None:
    """Tab-separated with a header; a row without ids ends in a tab."""
    lists.write.mode("overwrite").options(sep="\t", header=True, emptyValue="", quote="\u0000").csv(path)


def write_cache(rows: DataFrame, path: str) -> None:
    """By country; a rerun replaces the countries that it writes, so a restart can't repeat rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("country_norm").parquet(path)


def write_json(values: Mapping, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(values, indent=2, sort_keys=True))


def read_json(path: str) -> dict:
    return json.loads(Path(path).read_text())


def whole(path: str) -> bytes:
    """A file, or the part files of a folder of tables with headers as one file."""
    where = Path(path)
    if where.is_file():
        return where.read_bytes()
    parts = sorted(where.glob("part-*"))
    if not parts:
        raise FileNotFoundError(path)
    out = [parts[0].read_bytes()]
    for part in parts[1:]:
        out.append(part.read_bytes().partition(b"\n")[2])
    return b"".join(out)


def package(files: Mapping[str, str], path: str) -> None:
    """A ZIP of files by their names inside; a missing one is an error."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for inside, file in sorted(files.items()):
            out.writestr(inside, whole(file))
