"""Sharding by extendible hashing.

Every row has a 62-bit hash. A directory cell is a prefix of it; a bucket whose bytes exceed the limit is split
on its next bit, and no other is. The byte sums of all cells at a fine depth are made once; a cell's bucket is
its shortest prefix whose sum fits, which is where repeated splitting would end. Cells that exceed the limit
even there go through further rounds of more bits, alone.

Rows that agree in id, size and text share a hash, so they are counted first and each gets its number within
that count into its hash: however many copies of one row there are, they can be split, and their numbers are made in
many tasks. A single row above the limit can't be split and stays alone in its shard, marked oversize.

Defined results: null text has 0 bytes; null ids are hashed as such; a very long text is one row; repeated rows are
numbered in `copy`; extra columns are ignored by assign() and written by write_shards(), which names its folders
shard=, or shard_= and so on where the rows have a column of that name; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.runtime import Stash, numbered

BITS = 62


def prefix(column: Column, depth: Column | int) -> Column:
    """The first depth bits of the hash, with a leading 1, so that prefixes of all depths differ."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", column, (F.lit(BITS) - depth).cast("int")).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), depth.cast("int")))


def copies(docs: DataFrame, stash: Stash) -> DataFrame:
    """The rows as `row`, equal ones numbered from 0 in `copy`; they are counted, not ranked, so no task sees them together."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return numbered(stash(named.groupBy("row").agg(F.count(F.lit(1)).alias("n"))))


def _hash(*parts: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.xxhash64(*parts), F.lit(64 - BITS))


def items(docs: DataFrame, stash: Stash, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, copy and hash of every input row, without the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.xxhash64(body).alias("body"))
    return copies(rows, stash).select("row.doc_id", "row.n_bytes", "copy", _hash(F.col("row.doc_id"), F.col("row.body"), F.col("copy")).alias("hash"))


def directory(rows: DataFrame, limit: int, stash: Stash) -> DataFrame:
    """shard, depth, shard_bytes and shard_rows of every bucket that extendible hashing of (hash, n_bytes) ends with."""
    total, n = rows.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    if not n:
        return rows.limit(0).select(F.col("hash").alias("shard"), F.col("hash").cast("int").alias("depth"), F.col("hash").alias("shard_bytes"), F.col("hash").alias("shard_rows"))
    top, parts = 0, []
    left = rows.select("hash", "n_bytes")
    while True:
        fine = min(BITS, max(top + 4, math.ceil(math.log2(max(1.0, total / limit))) + 4))
        cells = left.groupBy(prefix(F.col("hash"), fine).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        above = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(top), F.lit(fine))).alias("depth"))
        buckets = above.groupBy("depth", F.call_function("shiftright", F.col("cell"), F.lit(fine) - F.col("depth")).alias("shard")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        buckets = stash(buckets)
        fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)
        whole = buckets.where(fits)
        # a bucket exists where its parent was split, that is, where the parent doesn't fit
        split = buckets.where(~fits).select(F.col("shard").alias("parent"))
        born = whole.where(F.col("depth") > top).join(split, F.call_function("shiftright", F.col("shard"), F.lit(1)) == F.col("parent"), "left_semi")
        parts.append(born.unionByName(whole.where(F.col("depth") == top)).select("shard", "depth", "shard_bytes", "shard_rows"))
        over = buckets.where(~fits & (F.col("depth") == fine))
        more = over.agg(F.max("shard_bytes")).first()[0]
        if more is None:
            break
        left = left.join(over.select("shard"), prefix(F.col("hash"), fine) == F.col("shard"), "left_semi")
        top, total = fine + 1, more * 2 ** (fine + 1)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def located(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """The rows (with hash) in their shards: one probe for each depth that occurs, of which exactly one meets."""
    depths = sorted(r.depth for r in shards.select("depth").distinct().collect())
    probes = F.array(*[prefix(F.col("hash"), d) for d in depths]) if depths else F.array().cast("array<bigint>")
    return rows.withColumn("shard", F.explode(probes)).join(shards, "shard")


def assign(docs: DataFrame, limit: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, copy, n_bytes, shard (prefix with a leading 1), depth, shard_bytes and oversize of every input row."""
    stash = Stash(docs.sparkSession)
    rows = items(docs, stash, id_column, text)
    found = located(rows, stash(directory(rows, limit, stash)))
    return found.select("doc_id", "copy", "n_bytes", "shard", "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize"))


def write_shards(docs: DataFrame, limit: int, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the rows as Parquet, one folder for each shard, and returns the directory.

    Rows that differ only outside id and text are numbered apart here, so a shard is measured on the rows written.
    """
    folder = "shard"
    while folder.lower() in {c.lower() for c in docs.columns}:
        folder += "_"
    stash = Stash(docs.sparkSession)
    body = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    rows = copies(docs, stash).select("row", F.octet_length(body).cast("long").alias("n_bytes"), _hash(F.col(f"row.{id_column}"), F.xxhash64("row"), F.col("copy")).alias("hash"))
    shards = stash(directory(rows.select("hash", "n_bytes"), limit, stash))
    found = located(rows, shards).select("row", F.col("shard").alias("_shard")).repartition("_shard")
    found.select("row.*", F.col("_shard").alias(folder)).write.mode("overwrite").partitionBy(folder).parquet(path)
    return shards
