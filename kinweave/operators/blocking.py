"""Candidate pairs: keyed, by shared tokens, by TF-IDF of character n-grams; their union and ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.similarity import sorted_tokens, weighted_indel, weighted_jaccard
from kinweave.functions.text import token_set, word_ngrams
from kinweave.operators import cosines, keyed, meetings
from kinweave.operators.keys import capped_keys, frequent, token_frequency
from kinweave.operators.postings import DIGITS, as_vectors, best_products
from kinweave.schema import BlockingConfig
from kinweave.sources.staging import Stash

PAIR = ["source1_entity_id", "candidate_entity_id"]
#: The most telling column first: sorts compare its first bytes before anything else.
KEY = ["key", "key_type", "country_norm"]
Score = Callable[[Column, Column, Column, Column], Column]
#: What buckets of single keys are dealt by, and the pairs of a bucket that one task makes, about.
DEALT = ["country_norm", "key", "part"]
PART_PAIRS = 1 << 20


#: Scores that keyed.best_keyed() makes without rows of pairs.
INDEXED = {weighted_indel: keyed.Indel, weighted_jaccard: keyed.Jaccard}


def bucket_sizes(keys: DataFrame, cap: int) -> DataFrame:
    """Rows (repeats counted) and distinct records of each key, up to cap rows."""
    return keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("bucket_size"), F.countDistinct("entity_id").alias("bucket_records")).where(F.col("bucket_size") <= cap)


def key_join(left_keys: DataFrame, right_keys: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct pairs of records that share a key; keys of more than cap right rows don't count."""
    left = left_keys.select(*KEY, F.col("entity_id").alias(PAIR[0])).distinct()
    right = right_keys.select(*KEY, F.col("entity_id").alias(PAIR[1])).distinct()
    if cap is not None:
        left = left.join(bucket_sizes(right_keys, cap).select(*KEY), KEY)
    return left.join(right, KEY).select(*PAIR).distinct()


def parted(left: DataFrame, right: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with part, for sides of records that have one key each; keys of more than cap right rows are left out.

    The left rows of a large bucket are dealt into parts by id, and each part meets the bucket's right side. So all pairs
    of a left record are made in one task, where the texts are: dealing by DEALT moves records, never pairs. The table of
    large buckets is broadcast; such a bucket has more than cap right rows or PART_PAIRS / cap left ones.
    """
    bucket = DEALT[:2]
    counts = left.select(*bucket, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*bucket, F.lit(0).alias("l"), F.lit(1).alias("r")))
    sizes = counts.groupBy(*bucket).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).where((F.col("r") > cap) | (F.col("l") * F.col("r") > PART_PAIRS))
    large = F.broadcast(sizes.select(*bucket, F.when(F.col("r") <= cap, F.ceil(F.col("l") * F.col("r") / PART_PAIRS)).otherwise(0).alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    left, right = (side.join(large, bucket, "left").withColumn("parts", parts).where("parts > 0") for side in (left, right))
    left = left.withColumn("part", F.pmod(F.xxhash64("entity_id"), F.col("parts")))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return left.drop("parts"), right.drop("parts")


def dealt(left: DataFrame, right: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """parted(), each side by DEALT."""
    left, right = parted(left, right, cap)
    return left.repartition(*DEALT), right.repartition(*DEALT)


def dealt_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """DEALT, PAIR and the other columns of both sides, prefixed s1_ and cand_, of two sides by DEALT."""
    def named(side: DataFrame, who: str, prefix: str) -> DataFrame:
        return side.select(*DEALT, F.col("entity_id").alias(who), *[F.col(c).alias(f"{prefix}{c}") for c in side.columns if c not in ("entity_id", "key", "part")])

    return named(left, PAIR[0], "s1_").join(named(right, PAIR[1], "cand_"), DEALT)


def budgeted_pairs(left_keys: DataFrame, right_keys: DataFrame, bucket_cap: int, budget: int) -> DataFrame:
    """Per S1 record, whole buckets from the smallest on until budget candidates are reached.

    A bucket of budget records fills the budget alone, so buckets after the first such one are dropped before the
    join: at most that bucket and (keys * budget) rows are expanded for a record.
    """
    sizes = bucket_sizes(right_keys, bucket_cap)
    by_size = Window.partitionBy(PAIR[0]).orderBy("bucket_size", "ord")
    left = left_keys.withColumnRenamed("entity_id", PAIR[0]).join(sizes, KEY)
    full = F.coalesce(F.max((F.col("bucket_records") >= budget).cast("int")).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = left.withColumn("turn", F.row_number().over(by_size)).withColumn("_full", full).where("_full = 0").select(*KEY, PAIR[0], "turn")
    right = right_keys.select(*KEY, F.col("entity_id").alias(PAIR[1])).distinct()
    first = left.join(right, KEY).groupBy(*PAIR).agg(F.min("turn").alias("turn"))
    before = Window.partitionBy(PAIR[0]).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return first.withColumn("_seen", F.count(F.lit(1)).over(before)).where(F.col("_seen") < budget).select(*PAIR)


def with_texts(pairs: DataFrame, s1: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs with columns of both sides, prefixed s1_ and cand_."""
    left = s1.select(F.col("entity_id").alias(PAIR[0]), *[F.col(c).alias(f"s1_{c}") for c in columns])
    right = targets.select(F.col("entity_id").alias(PAIR[1]), *[F.col(c).alias(f"cand_{c}") for c in columns])
    return pairs.join(left, PAIR[0], "left").join(right, PAIR[1], "left")


def prepared_scores(pairs: DataFrame, s1: DataFrame, targets: DataFrame, score: Score, prepare: Callable[[Column], Column] = sorted_tokens) -> DataFrame:
    """The pairs with score of both names and addresses, each prepared once per record, not per pair."""
    sides = [x.select("entity_id", prepare(F.col("name_norm")).alias("n"), prepare(F.col("address_norm")).alias("a")) for x in (s1, targets)]
    texts = with_texts(pairs, *sides, ["n", "a"])
    return texts.select(*PAIR, score(F.col("s1_n"), F.col("cand_n"), F.col("s1_a"), F.col("cand_a")).alias("score"))


def top_k(scored: DataFrame, k: int, score: str, rank: str) -> DataFrame:
    """The k best of each S1 record; equal scores by candidate id."""
    best = Window.partitionBy(PAIR[0]).orderBy(F.desc(score), PAIR[1])
    return scored.withColumn(rank, F.row_number().over(best)).where(F.col(rank) <= k)


def keyed_candidates(s1: DataFrame, targets: DataFrame, config: BlockingConfig = BlockingConfig(), score: Score = weighted_indel, prepare: Callable[[Column], Column] = sorted_tokens, unique: bool = False) -> DataFrame:
    """keyed_score and keyed_rank of the top_k candidates of each S1 record, within its country.

    unique: no id comes twice on a side, so keys, pairs and scores are made where a country's targets are, without rows of pairs;
    only countries of more than keyed.MOST targets go by rows.
    """
    if unique and score in INDEXED:
        sizes = Stash(s1.sparkSession)(targets.groupBy("country_norm").agg(F.count(F.lit(1)).alias("n")))
        small = sizes.where(F.col("n") <= keyed.MOST)
        met = keyed.best_keyed(s1, targets, small, config, INDEXED[score], config.top_k)
        found = met.select(F.col("left").alias(PAIR[0]), F.col("right").alias(PAIR[1]), F.col("score").alias("keyed_score"), F.col("rank").alias("keyed_rank"), F.lit("keyed").alias("blocker"))
        large = sizes.where(F.col("n") > keyed.MOST).select("country_norm")
        if large.isEmpty():
            return found
        rest = (x.join(F.broadcast(large), "country_norm", "left_semi") for x in (s1, targets))
        return found.unionByName(keyed_candidates(*rest, config, score, prepare))
    frequency = frequent(token_frequency(targets), config.token_cap)
    pairs = budgeted_pairs(capped_keys(s1, frequency, config.token_cap), capped_keys(targets, frequency, config.token_cap), config.bucket_cap, config.budget)
    scored = prepared_scores(pairs, s1, targets, score, prepare).select(*PAIR, F.round("score", 9).alias("keyed_score"))
    return top_k(scored, config.top_k, "keyed_score", "keyed_rank").withColumn("blocker", F.lit("keyed"))


def _tokens(records: DataFrame, columns: list[str], numbers_whole: bool) -> DataFrame:
    """entity_id, country_norm and the token set of the columns; numbers are split at '|' unless numbers_whole."""
    parts = [F.col(c) if c != "address_numbers" or numbers_whole else F.replace(F.col(c), F.lit("|"), F.lit(" ")) for c in columns]
    return records.select("entity_id", "country_norm", token_set(F.concat_ws(" ", *parts)).alias("tokens"))


def token_candidates(s1: DataFrame, targets: DataFrame, columns: list[str], k: int, cap: int = BlockingConfig.block_token_cap, name: str = "token", numbers_whole: bool = False, unique: bool = False) -> DataFrame:
    """Two steps: the 20 k pairs with most shared tokens, then the k with the highest share of all their tokens.

    unique: no id comes twice on a side, so a record is one set, and both steps are made where the sets meet.
    """
    left, right = _tokens(s1, columns, numbers_whole), _tokens(targets, columns, numbers_whole)
    if unique:
        often = right.select("country_norm", F.explode("tokens").alias("token")).groupBy("country_norm", "token").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") > cap)
        sides = (x.select(F.col("country_norm").alias("scope"), F.col("entity_id").alias("id"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("keys")) for x in (left, right))
        met = meetings.likest(*sides, often.select(F.col("country_norm").alias("scope"), F.xxhash64("token").alias("key")), 20 * k, k)
        scored = met.select(F.col("left").alias(PAIR[0]), F.col("right").alias(PAIR[1]), F.col("score").alias(f"{name}_score"))
        return top_k(scored, k, f"{name}_score", f"{name}_rank").withColumn("blocker", F.lit(name))

    def rows(side: DataFrame) -> DataFrame:
        return side.select("entity_id", "country_norm", F.explode("tokens").alias("token"), F.lit(1.0).alias("one"))

    # tokens of more than cap right records aren't in the postings, so the left side needn't be filtered
    frequent = rows(right).groupBy("country_norm", "token").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") > cap).drop("freq")
    index = rows(right).join(frequent, ["country_norm", "token"], "left_anti")
    met = best_products(*(as_vectors(x, "entity_id", "country_norm", "token", "one") for x in (rows(left), index)), 20 * k)
    most = met.select(F.col("left").alias(PAIR[0]), F.col("right").alias(PAIR[1]), F.col("score").alias("shared"))
    both = most.join(left.select(F.col("entity_id").alias(PAIR[0]), F.col("tokens").alias("_l")), PAIR[0]).join(right.select(F.col("entity_id").alias(PAIR[1]), F.col("tokens").alias("_r")), PAIR[1])
    scored = both.select(*PAIR, (F.col("shared") / F.size(F.array_union("_l", "_r"))).alias(f"{name}_score"))
    return top_k(scored, k, f"{name}_score", f"{name}_rank").withColumn("blocker", F.lit(name))


def tfidf_vectors(left: DataFrame, right: DataFrame, column: str, min_df: int, max_features: int) -> tuple[DataFrame, DataFrame]:
    """(id, country_norm, gram, weight) of both sides: unit vectors over the right side's vocabulary and smoothed idf."""

    def counts(records: DataFrame) -> DataFrame:
        grams = records.select("entity_id", "country_norm", F.explode(word_ngrams(F.col(column))).alias("gram"))
        return grams.groupBy("entity_id", "country_norm", "gram").agg(F.count(F.lit(1)).alias("tf"))

    of_right = counts(right)
    n = right.groupBy("country_norm").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = of_right.groupBy("country_norm", "gram").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    # ranks are counted by frequency first, so no window sees a country's whole vocabulary at once
    levels = vocabulary.groupBy("country_norm", "total").agg(F.count(F.lit(1)).alias("at"))
    above = Window.partitionBy("country_norm").orderBy(F.desc("total"))
    kept = levels.withColumn("over", F.sum("at").over(above) - F.col("at")).where(F.col("over") < max_features).select("country_norm", "total")
    vocabulary = vocabulary.join(kept, ["country_norm", "total"])
    idf = vocabulary.join(n, "country_norm").select("country_norm", "gram", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def weights(rows: DataFrame) -> DataFrame:
        raw = rows.join(idf, ["country_norm", "gram"]).withColumn("w", F.col("tf") * F.col("idf"))
        norm = raw.groupBy("entity_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return raw.join(norm, "entity_id").select("entity_id", "country_norm", "gram", (F.col("w") / F.col("norm")).alias("weight"))

    return weights(counts(left)), weights(of_right)


def tfidf_candidates(s1: DataFrame, targets: DataFrame, column: str, k: int, config: BlockingConfig = BlockingConfig(), name: str = "name_tfidf", unique: bool = False) -> DataFrame:
    """The k targets of the same country with the highest cosine of character n-gram weights.

    unique: no id comes twice on a side, so vectors are made from the texts where both sides meet; only countries of more
    than cosines.MOST targets move vectors.
    """
    if unique:
        sizes = Stash(s1.sparkSession)(targets.groupBy("country_norm").agg(F.count(F.lit(1)).alias("n")))
        met = cosines.best_cosines(s1, targets, sizes.where(F.col("n") <= cosines.MOST), column, k, config.min_df, config.max_features)
        found = top_k(met.select(F.col("left").alias(PAIR[0]), F.col("right").alias(PAIR[1]), F.col("score").alias(f"{name}_score")), k, f"{name}_score", f"{name}_rank").withColumn("blocker", F.lit(name))
        large = sizes.where(F.col("n") > cosines.MOST).select("country_norm")
        if large.isEmpty():
            return found
        rest = (x.join(F.broadcast(large), "country_norm", "left_semi") for x in (s1, targets))
        return found.unionByName(tfidf_candidates(*rest, column, k, config, name))
    left, right = tfidf_vectors(s1, targets, column, config.min_df, config.max_features)
    met = best_products(*(as_vectors(x, "entity_id", "country_norm", "gram", "weight") for x in (left, right)), k)
    cosine = met.select(F.col("left").alias(PAIR[0]), F.col("right").alias(PAIR[1]), F.round("score", DIGITS).alias(f"{name}_score"))
    return top_k(cosine, k, f"{name}_score", f"{name}_rank").withColumn("blocker", F.lit(name))


def combine(frames: list[DataFrame], max_candidates: int | None = None) -> DataFrame:
    """One row per pair: the best of each *_score and *_rank (0 where absent), blockers joined, strength and rank."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    scores, ranks = ([c for c in out.columns if c.endswith(end)] for end in ("_score", "_rank"))
    merged = out.groupBy(*PAIR).agg(
        *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in scores],
        *[F.coalesce(F.min(c), F.lit(0)).alias(c) for c in ranks],
        F.array_join(F.array_sort(F.collect_set("blocker")), "|").alias("blocker"),
    )
    strength = F.greatest(*scores) if len(scores) > 1 else F.col(scores[0])
    ranked = merged.withColumn("candidate_strength", strength)
    order = Window.partitionBy(PAIR[0]).orderBy(F.desc("candidate_strength"), PAIR[1])
    ranked = ranked.withColumn("candidate_rank", F.row_number().over(order))
    return ranked if max_candidates is None else ranked.where(F.col("candidate_rank") <= max_candidates)


def union_candidates(s1: DataFrame, targets: DataFrame, config: BlockingConfig = BlockingConfig(), unique: bool = False) -> DataFrame:
    """TF-IDF on name, address and both, and shared tokens. unique: no id comes twice on a side."""
    k = config.top_k
    return combine(
        [
            tfidf_candidates(s1, targets, "name_norm", k, config, "name_tfidf"),
            tfidf_candidates(s1, targets, "address_norm", k, config, "address_tfidf"),
            tfidf_candidates(s1, targets, "combined_norm", k, config, "combined_tfidf"),
            token_candidates(s1, targets, ["name_norm", "address_norm", "address_numbers"], k, config.block_token_cap, unique=unique),
        ],
        config.max_candidates,
    )


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """Ids of each S1 record in the order of candidate_rank."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("candidate_rank", PAIR[1]))), lambda x: x[PAIR[1]])
    return candidates.groupBy(PAIR[0]).agg(F.array_distinct(ordered).alias("candidate_ids"))


def missed_pairs_shared_keys(missed: DataFrame, s1: DataFrame, targets: DataFrame, frequency: DataFrame, cap: int) -> DataFrame:
    """Why true pairs were missed: how many keys, and which key types, the two records share."""
    missed, frequency = Stash(missed.sparkSession)(missed.select(*PAIR)), frequent(frequency, cap)

    def keys(records: DataFrame, column: str) -> DataFrame:
        # only records of missed pairs: the keys of all would take many times the room of the texts
        asked = records.select("entity_id", "country_norm", "name_norm", "address_norm", "address_numbers").join(missed.select(F.col(column).alias("entity_id")).distinct(), "entity_id", "left_semi")
        return capped_keys(asked, frequency, cap).groupBy(F.col("entity_id").alias(column)).agg(F.collect_set(F.struct("key_type", "key")).alias(f"_{column}"))

    rows = missed.select(*PAIR).join(keys(s1, PAIR[0]), PAIR[0], "left").join(keys(targets, PAIR[1]), PAIR[1], "left")
    shared = F.coalesce(F.array_intersect(f"_{PAIR[0]}", f"_{PAIR[1]}"), F.array().cast("array<struct<key_type:string,key:string>>"))
    return rows.select(*PAIR, F.size(shared).cast("long").alias("n_shared"), F.array_join(F.array_sort(F.array_distinct(F.transform(shared, lambda k: k["key_type"]))), "|").alias("key_types"))
