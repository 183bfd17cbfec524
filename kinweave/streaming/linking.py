"""Targets as a stream against a static index of S1 keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinweave.functions.text import normalize
from kinweave.operators.blocking import PAIR
from kinweave.operators.rules import EXACT_KEY, rule_links


def exact_stream(targets: DataFrame, s1: DataFrame) -> DataFrame:
    """Streaming targets joined to the S1 records that alone have their country, name and address."""
    owners = normalize(s1).where("name_norm <> '' and address_norm <> ''").groupBy(*EXACT_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("entity_id").alias(PAIR[0])).where("n = 1").drop("n")
    rows = normalize(targets).where("name_norm <> '' and address_norm <> ''").select(F.col("entity_id").alias(PAIR[1]), *EXACT_KEY)
    return rows.join(owners, EXACT_KEY).select(*PAIR)


def link_batches(targets: DataFrame, s1: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """The rule matcher on every micro-batch; sink gets the links and the batch number, and must be idempotent in it."""
    left = normalize(s1).persist()
    return targets.writeStream.foreachBatch(lambda batch, n: sink(rule_links(left, normalize(batch)), n)).option("checkpointLocation", checkpoint).start()
