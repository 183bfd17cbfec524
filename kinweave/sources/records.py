"""Entity records made from the documents table: every text is cut into runs of 16 words, so all of it is used.

Six words are the name; the next ten, the document's length and its source are the address; the language is the
country. The document's id modulo 3 says which source (S1, S2, S3) a record belongs to. True links: an S2 or S3
record belongs to the S1 record with the smallest number that has the same country and the same 40 first characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.sources.staging import spread

RUN, NAME = 16, 6


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """number, entity_id, business_name, business_address, country, target_source of every record."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    runs = F.greatest(F.lit(1), F.ceil(F.size("words") / RUN).cast("int"))

    def run(i: Column) -> Column:
        return F.struct(i.alias("run"), _joined(F.slice("words", i * RUN + 1, NAME)).alias("name"), _joined(F.slice("words", i * RUN + NAME + 1, RUN - NAME)).alias("rest"))

    # runs are cut before they become rows, so no row carries the words of the whole text
    cut = docs.withColumn("words", words).select("doc_id", "n_chars", "source", "lang", F.inline(F.transform(F.sequence(F.lit(0), runs - 1), run)))
    source = F.concat(F.lit("S"), (F.pmod("doc_id", F.lit(3)) + 1).cast("string"))
    number = F.col("doc_id") * 1_000_000 + F.col("run")
    address = F.concat_ws(" ", "rest", F.coalesce(F.col("n_chars").cast("string"), F.lit("")), F.coalesce("source", F.lit("")))
    return cut.select(
        number.alias("number"),
        F.concat(source, F.lit("-"), number.cast("string")).alias("entity_id"),
        F.col("name").alias("business_name"),
        address.alias("business_address"),
        F.coalesce("lang", F.lit("")).alias("country"),
        source.alias("target_source"),
    )


def truth(recs: DataFrame) -> DataFrame:
    """source1_entity_id and candidate_entity_id of each true link."""
    head = F.substring(F.concat_ws(" ", "business_name", "business_address"), 1, 40)
    rows = recs.select("number", "entity_id", "country", "target_source", head.alias("head"))
    owners = rows.where("target_source = 'S1'").groupBy("country", "head").agg(F.min("number").alias("owner"))
    links = rows.where("target_source <> 'S1'").join(owners, ["country", "head"])
    return links.select(F.concat(F.lit("S1-"), F.col("owner").cast("string")).alias("source1_entity_id"), F.col("entity_id").alias("candidate_entity_id"))
