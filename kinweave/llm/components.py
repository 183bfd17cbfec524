"""Connected components of a link table, distributed, by contraction.

In each round every node points at the smallest of itself and its neighbours, then at what that points at; links are
redrawn between the nodes pointed at, and those inside one node vanish. The links left shrink from round to round; when
at most FEW are left, one task unites them, so a handful of links doesn't cost rounds of shuffles. All tables are written
to the shared folder. Only joins, minima and distinct are used, so a node with very many links is combined before it is
moved, or split by the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.runtime import Stash, importable

#: Links that one task unites, about a megabyte.
FEW = 50_000


def _redrawn(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def united(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest reachable node of each node of the pairs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def _united(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = united([p for batch in batches for p in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["node", "component"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame, stash: Stash) -> DataFrame:
    """node and component (its smallest reachable node) of the links' columns a and b; nodes without links are absent."""
    importable(links.sparkSession)
    links = stash(_redrawn(links))
    found: DataFrame | None = None

    def then(step: DataFrame) -> DataFrame:
        if found is None:
            return step
        moved = step.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        return stash(found.join(moved, "component", "left").select("node", F.coalesce("higher", "component").alias("component")))

    while True:
        n = links.count()
        if n <= FEW:
            out = then(stash(_united(links))) if n or found is None else found
            stash.drop(links)
            return out
        sides = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).union(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("least")))
        points = stash(sides.groupBy("node").agg(F.min("least").alias("least")).select("node", F.least("node", "least").alias("label")))
        step = stash(points.join(points.select(F.col("node").alias("label"), F.col("label").alias("higher")), "label").select("node", F.col("higher").alias("component")))
        stash.drop(points)
        found = then(step)
        ends = [step.select(F.col("node").alias(c), F.col("component").alias(f"{c}_to")) for c in ("a", "b")]
        left = stash(_redrawn(links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))))
        stash.drop(links)
        links = left
