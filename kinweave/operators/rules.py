"""Matchers without a model: exact and name-plus-number keys, and the weighted evidence matcher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.similarity import jaccard, overlap_count
from kinweave.functions.text import clean_address_tokens, clean_name_tokens, token_set, useful_numbers
from kinweave.operators import meetings
from kinweave.operators.blocking import PAIR
from kinweave.operators.postings import as_vectors, best_products

EXACT_KEY = ["country_norm", "name_norm", "address_norm"]


def _sides(s1: DataFrame, targets: DataFrame, *columns: Column | str) -> tuple[DataFrame, DataFrame]:
    left = s1.where("name_norm <> ''").select(F.trim("entity_id").alias(PAIR[0]), *columns)
    right = targets.where("name_norm <> ''").select(F.trim("entity_id").alias(PAIR[1]), *columns)
    return left, right


def exact_links(s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with the country, name and address of exactly one S1 record; empty names and addresses don't count."""
    left, right = _sides(s1, targets, *EXACT_KEY)
    left = left.where("address_norm <> ''")
    owners = left.groupBy(*EXACT_KEY).agg(F.count(F.lit(1)).alias("n"), F.min(PAIR[0]).alias(PAIR[0])).where("n = 1").drop("n")
    return right.join(owners, EXACT_KEY).select(*PAIR)


def number_links(s1: DataFrame, targets: DataFrame, at_most: int) -> DataFrame:
    """Pairs of equal country, name and an address number; numbers that more than at_most S1 records have with the name don't count."""
    key = ["country_norm", "name_norm", "num"]
    left, right = (x.withColumn("num", F.explode("nums")) for x in _sides(s1, targets, "country_norm", "name_norm", useful_numbers(F.col("address_numbers")).alias("nums")))
    clear = left.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= at_most).drop("n")
    return right.join(left.join(clear, key), key).select(*PAIR, "num")


def first_come(links: DataFrame, cap: int, order: list[str]) -> DataFrame:
    """At most cap targets of each S1 record, in a fixed order."""
    rank = F.row_number().over(Window.partitionBy(PAIR[0]).orderBy(*order))
    return links.withColumn("_turn", rank).where(F.col("_turn") <= cap).drop("_turn")


def address_overlap_ok(a: Column, b: Column) -> Column:
    shared, least = overlap_count(a, b), F.least(F.size(a), F.size(b))
    return (shared >= 2) & (F.try_divide(shared, least) >= 0.35)


def rule_links(s1: DataFrame, targets: DataFrame, cap: int = 8) -> DataFrame:
    """Exact keys, and name with number where the addresses overlap; at most cap per S1 record by target id."""
    left = s1.select(F.trim("entity_id").alias(PAIR[0]), F.col("address_norm").alias("_l"))
    right = targets.select(F.trim("entity_id").alias(PAIR[1]), F.col("address_norm").alias("_r"))
    numbered = number_links(s1, targets, 3).select(*PAIR).distinct().join(left, PAIR[0]).join(right, PAIR[1])
    numbered = numbered.where(address_overlap_ok(token_set(F.col("_l")), token_set(F.col("_r")))).select(*PAIR)
    return first_come(exact_links(s1, targets).union(numbered).distinct(), cap, [PAIR[1]])


def weighted_evidence(s1: DataFrame, targets: DataFrame, token_cap: int = 2500) -> DataFrame:
    """weight of each pair: 6 for the exact key, 4 for each shared name-and-number, 1 for each shared rare name token."""
    left, right = (x.withColumn("token", F.explode("tokens")).drop("tokens") for x in _sides(s1, targets, "country_norm", clean_name_tokens(F.col("name_norm")).alias("tokens")))
    rare = left.groupBy("country_norm", "token").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") <= token_cap).drop("freq")
    shared = right.join(left.join(rare, ["country_norm", "token"]), ["country_norm", "token"]).select(*PAIR)
    parts = ((exact_links(s1, targets), 6), (number_links(s1, targets, 4).select(*PAIR), 4), (shared, 1))
    rows = None
    for frame, weight in parts:
        part = frame.withColumn("w", F.lit(weight))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*PAIR).agg(F.sum("w").alias("weight"))


def most_evidence(s1: DataFrame, targets: DataFrame, per_target: int, token_cap: int) -> DataFrame:
    """The per_target pairs of each target with the highest weighted_evidence(); ties go to the smaller S1 id."""
    theirs, index = evidence(s1, targets, token_cap)
    met = best_products(as_vectors(theirs.select("id", "country_norm", F.explode("keys").alias("key"), F.lit(1.0).alias("w")), "id", "country_norm", "key", "w"), index, per_target)
    return met.select(F.col("right").alias(PAIR[0]), F.col("left").alias(PAIR[1]), F.col("score").cast("int").alias("weight"))


def evidence_sums(s1: DataFrame, targets: DataFrame, token_cap: int = 2500) -> DataFrame:
    """weight and n_pairs: how many pairs have each weighted_evidence(), where no id comes twice on a side."""
    theirs, index = evidence(s1, targets, token_cap)
    sides = (theirs.select(F.col("country_norm").alias("scope"), "id", F.transform("keys", lambda k: F.xxhash64(k)).alias("keys")), index.withColumn("weights", F.transform("weights", lambda w: w.cast("int"))))
    return meetings.sums(*sides)


def evidence(s1: DataFrame, targets: DataFrame, token_cap: int) -> tuple[DataFrame, DataFrame]:
    """(id, country_norm, keys) of the targets, and the S1 records as vectors.

    Every kind of evidence is a key with a weight on the S1 side, so the weight of a pair is the product of two sparse
    vectors, and no token is joined out into pairs.
    """
    columns = [F.col("country_norm"), F.col("name_norm"), F.col("address_norm"), useful_numbers(F.col("address_numbers")).alias("nums"), clean_name_tokens(F.col("name_norm")).alias("tokens")]

    def keyed(side: DataFrame, who: str) -> DataFrame:
        exact = F.when(F.col("address_norm") != "", F.array(F.concat_ws("\x01", F.concat(F.lit("exact\x02"), "name_norm"), "address_norm")))
        number = F.transform("nums", lambda x: F.concat(F.lit("number\x02"), "name_norm", F.lit("\x01"), x))
        token = F.transform("tokens", lambda x: F.concat(F.lit("token\x02"), x))
        return side.select(F.col(who).alias("id"), "country_norm", F.concat(F.coalesce(exact, F.array().cast("array<string>")), number, token).alias("keys"))

    left, right = _sides(s1, targets, *columns)
    mine = keyed(left, PAIR[0]).select("id", "country_norm", F.explode("keys").alias("key"))
    kind = F.substring_index("key", "\x02", 1)
    most = F.when(kind == "exact", 1).when(kind == "number", 4).otherwise(token_cap)
    common = mine.groupBy("country_norm", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("country_norm", "key")
    index = mine.join(common, ["country_norm", "key"], "left_anti").withColumn("w", F.when(kind == "exact", 6.0).when(kind == "number", 4.0).otherwise(1.0))
    return keyed(right, PAIR[1]), as_vectors(index, "id", "country_norm", "key", "w")


def fuzzy_scores(s1: DataFrame, targets: DataFrame, per_target: int = 25, token_cap: int = 2500) -> DataFrame:
    """weight, score, name_score, address_score and number_overlap of the per_target best pairs of each target."""
    top = most_evidence(s1, targets, per_target, token_cap)
    sets = [clean_name_tokens(F.col("name_norm")), clean_address_tokens(F.col("address_norm")), useful_numbers(F.col("address_numbers"))]
    left = s1.select(F.trim("entity_id").alias(PAIR[0]), *[x.alias(f"_l{i}") for i, x in enumerate(sets)])
    right = targets.select(F.trim("entity_id").alias(PAIR[1]), *[x.alias(f"_r{i}") for i, x in enumerate(sets)])
    rows = top.join(left, PAIR[0]).join(right, PAIR[1])
    name, address = jaccard(F.col("_l0"), F.col("_r0")), jaccard(F.col("_l1"), F.col("_r1"))
    number = F.arrays_overlap("_l2", "_r2")
    scored = rows.select(*PAIR, "weight", name.alias("name_score"), address.alias("address_score"), number.alias("number_overlap"))
    score = 0.68 * F.col("name_score") + 0.24 * F.col("address_score") + F.when(F.col("number_overlap"), 0.08).otherwise(0.0)
    return scored.withColumn("score", score)


def fuzzy_links(s1: DataFrame, targets: DataFrame, threshold: float = 0.64, per_target: int = 25, cap: int = 8, token_cap: int = 2500) -> DataFrame:
    rows = fuzzy_scores(s1, targets, per_target, token_cap)
    like_exact = (F.col("score") >= 0.82) & (F.col("name_score") >= 0.70)
    evidence = (F.col("address_score") >= 0.16) | F.col("number_overlap")
    likely = (F.col("score") >= threshold) & (F.col("name_score") >= 0.55) & (F.col("weight") >= 2) & evidence
    return first_come(rows.where(like_exact | likely).select(*PAIR), cap, [PAIR[1]])
