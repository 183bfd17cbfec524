"""What the operators share: staged tables and importable workers (from the library), range bounds, word counts, copies, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.sources.staging import Stash, importable, shared_dir

__all__ = ["Stash", "importable", "lookup", "numbered", "partitions", "range_index", "shared_dir", "word_count"]

#: Copies that are made of one row at once.
STEP = 4096
#: Rows of a lookup table up to which all of it is broadcast.
SMALL_TABLE = 100_000
#: Above that, keys of more than one in HOT rows are broadcast; there are fewer than HOT such keys.
HOT = 1000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_index(value: Column, bounds: list, low: int = 0) -> Column:
    """How many of the ascending bounds are at most value (null: none), as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(value >= F.lit(bounds[mid]), range_index(value, bounds[mid + 1 :], low + mid + 1)).otherwise(range_index(value, bounds[:mid], low))


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space characters; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(counted: DataFrame, n: str = "n", name: str = "copy") -> DataFrame:
    """Each row n times, numbered from 0 in `name` instead of n; rows of n below 1 vanish.

    A row of many copies is first cut into runs of STEP numbers, which are dealt out, so no task or array holds all.
    """
    last, zero = F.col(n) - 1, F.lit(0).cast("long")
    few = counted.where(F.col(n).between(1, STEP)).withColumn(name, F.explode(F.sequence(zero, last.cast("long"))))
    runs = counted.where(F.col(n) > STEP).withColumn("_run", F.explode(F.sequence(zero, F.floor(last / STEP))))
    runs = runs.repartition(partitions(counted.sparkSession), "_run", *[F.col(f"`{c}`") for c in counted.columns if c != n])
    first = F.col("_run") * STEP
    many = runs.withColumn(name, F.explode(F.sequence(first, F.least(last.cast("long"), first + (STEP - 1))))).drop("_run")
    return few.unionByName(many).drop(n)


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], n: str, how: str = "left") -> DataFrame:
    """rows with the other columns of a staged table whose keys (null counts as a value) are unique; how: left or inner.

    n is the table's column with the number of rows of each key. A table of at most SMALL_TABLE rows is broadcast. Of a
    larger one, the keys of more than a thousandth of all rows are (fewer than a thousand), and only rows of other keys
    are shuffled, so that no task gets all rows of a hot key.
    """
    names = {k: f"_key_{k}" for k in keys}
    side = table.withColumnsRenamed(names)

    def joined(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
        met = [left[k].eqNullSafe(right[v]) for k, v in names.items()]
        return left.join(right, met, kind).drop(*names.values())

    size, total = side.agg(F.count(F.lit(1)), F.sum(n)).first()
    if size <= SMALL_TABLE:
        return joined(rows, F.broadcast(side), how)
    hot = side.where(F.col(n) * HOT > total)
    rest = joined(rows, F.broadcast(hot), "left_anti")
    return joined(rows, F.broadcast(hot), "inner").unionByName(joined(rest, side.where(F.col(n) * HOT <= total), how))
