"""Mixing sources to target weights, in DataFrame functions only.

Sizes are summed per source; each source's target is its weight's share of all sizes, but at most
max_repeats times its own size, and what that leaves over is shared again by weight. In closed form: with
sources sorted by cap / weight, the first k are at their caps and the others get level * weight, where level
spreads the rest; k is the first for which no other source is above its cap. rate = target / size. A document
is taken floor(rate) times plus one copy if a number hashed from the seed, the whole row and its number among equal
rows is below the fraction; so rows draw apart, whether they share an id, a text or everything. Equal rows are
counted and the counts are numbered; no task sees them together.

Defined results: null text has size 0; the null source is a source, last in order; a source without words
has target 0 and its documents are taken floor(0) = 0 times; null ids draw by the rest of their row; a text of any
length is counted whole; extra columns take part in the draw and are kept, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.runtime import Stash, lookup, numbered, word_count

WEIGHTS = (5, 2, 1)
DRAWS = 16**13


def row_key(columns: list[str]) -> Column:
    """MD5 of the MD5 of every column as text, by name; of a null column, nothing."""
    parts = [F.coalesce(F.md5(F.col(f"`{c}`").cast("string").cast("binary")), F.lit("")) for c in sorted(columns)]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def draw(key: Column, number: Column, seed: int) -> Column:
    """A number in [0, 1) from MD5 of the seed, a row's key and its number among equal rows."""
    text = F.concat_ws(":", F.lit(str(seed)), key, number.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(DRAWS))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """source, source_size, n and target of each source of (source, size, n) rows; one row per source."""
    sums = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    place = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("long")
    rows = sums.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("free", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # the first source in this order that the level leaves below its cap fixes the level
    fits = F.col("cap") * F.col("free") >= F.col("weight") * (F.col("total") - F.col("capped"))
    level = F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("capped"), F.col("free")))).over(everything)
    rows = rows.withColumn("level", level)
    spread = (F.col("weight") * (F.col("total") - F.col("level.capped"))).cast("double") / F.col("level.free").cast("double")
    return rows.select("source", "source_size", "n", F.least(F.col("cap").cast("double"), spread).alias("target"))


class Mix:
    """A mix of docs: classes of equal rows (key, id, source, size and their number n) and the sources' targets, both staged."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, seed: int = 17, size: Column | None = None, id_column: str = "doc_id", text: str = "text", source: str = "source") -> None:
        self.docs, self.source, self.seed = docs, source, seed
        self.stash = Stash(docs.sparkSession)
        self.key = row_key(docs.columns)
        size = word_count(F.col(f"`{text}`")) if size is None else size
        rows = docs.select(self.key.alias("key"), F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"))
        self.classes = self.stash(rows.groupBy("key", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
        self.goals = self.stash(targets(self.classes, weights, max_repeats))

    def _copies(self, rows: DataFrame, number: Column) -> DataFrame:
        """Rows of key and source with source_size, target and copies."""
        rows = lookup(rows, self.goals.withColumnRenamed("n", "_rows"), ["source"], "_rows", "inner").drop("_rows")
        rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
        return rows.withColumn("copies", F.floor(rate) + (draw(F.col("key"), number, self.seed) < rate - F.floor(rate)).cast("long"))

    def shares(self) -> DataFrame:
        """doc_id, size, source_size, target and copies (times that it is taken) of every row."""
        rows = numbered(self.classes.select("key", "doc_id", "source", "size", "n"), "n", "number")
        return self._copies(rows, F.col("number")).select("doc_id", "size", "source_size", "target", "copies")

    def rows(self) -> DataFrame:
        """The rows that the mix takes, each as often as it is taken.

        Rows without an equal one stay where they are. Of equal ones, of which classes give the copies in all, one is
        kept by a grouping that combines them before they are moved.
        """
        again = self._copies(numbered(self.classes.where("n > 1").select("key", "source", "n"), "n", "number"), F.col("number"))
        again = self.stash(again.groupBy("key").agg(F.sum("copies").alias("all_copies"), F.count(F.lit(1)).alias("n_equal")))
        named = self.docs.select(F.struct(*[F.col(f"`{c}`") for c in self.docs.columns]).alias("row"), self.key.alias("key"), F.col(f"`{self.source}`").alias("source"))
        known = lookup(named, again, ["key"], "n_equal")
        single = self._copies(known.where("n_equal is null"), F.lit(0)).where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row"))
        equal = known.where("n_equal is not null").groupBy("key", "all_copies").agg(F.first("row").alias("row"))
        return single.unionByName(numbered(equal, "all_copies", "number").select("row")).select("row.*")
