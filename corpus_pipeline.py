"""A training corpus from raw documents: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and returns the columns
of documents; the last returns where each piece of each document lies. The quality model is fitted on the labelled
rows of sf_dir; near-duplicates are of five-word shingles at a similarity of 0.8 or more; secrets are replaced by
their kind and n_chars follows; mixing emits a document as often as it is taken.

In every stage extra columns of docs are dropped, texts of any length are handled whole, an empty table gives no rows,
and the result doesn't depend on the order of rows.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import mixing, neardup, packing, quality, secret_scan
from kinweave.llm.runtime import Stash, lookup
from kinweave.sources.staging import clear, roots

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier doesn't reject.

    Null, empty and word-less texts are rejected; nulls elsewhere don't matter; repeated rows are judged alike and each
    kept. Without labels every text with words stays.
    """
    grades = quality.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = quality.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), grades)
    return quality.select_good(docs.select(COLUMNS), model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, and of several rows of that id the one with the least hash.

    Null, empty and word-less texts are near nothing and stay, once for each id. Rows without an id can't be named by a
    group and stay, each.
    """
    docs, stash = docs.select(COLUMNS), Stash(spark)
    found = neardup.near_duplicates(docs, width=5, similarity=Fraction(4, 5)).where("doc_id is not null")
    changed = stash(found.groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1"))
    # small tables are broadcast, so the texts stay where they are
    known = lookup(docs, changed, ["doc_id"], "n")
    several = known.where("kept").select("doc_id", F.struct(*COLUMNS).alias("row"), F.xxhash64(*COLUMNS).alias("order"))
    one = several.groupBy("doc_id").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return known.where("n is null").select(COLUMNS).unionByName(one.select(COLUMNS))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced, and n_chars of what is left.

    Null texts stay null, with the n_chars they came with; empty texts and repeated rows stay as they are.
    """
    clean = secret_scan.redact(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    The null source is a source, the last in order. Null and empty texts have size 0 and are drawn like the others of
    their source. Repeated rows draw apart.
    """
    return mixing.Mix(docs.select(COLUMNS)).rows().select(COLUMNS)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and offset of every piece.

    Null, empty and word-less texts are one piece of no words; a null source conflicts with nothing; null ids are packed
    like others; repeated rows are numbered in `copy` and lie in different bins.
    """
    return packing.pack(docs.select(COLUMNS))


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("secrets", hide_secrets), ("mixing", mix_sources), ("packing", pack_bins)]

#: Sketches, a fitted model and best-fit packing are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage staged, and its input, is deleted when its own rows are written."""
    stash = Stash(spark)
    docs = raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = roots()
        kept = stash(stage(spark, docs, sf_dir))
        clear(spark, roots() - before)
        if docs is not raw:
            stash.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
