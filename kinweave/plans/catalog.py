"""Queries over the records made from the driver tables; oracle.py has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.functions.similarity import sorted_tokens
from kinweave.functions.text import char_ngrams, clean_name_tokens, combined, normalize, soundex, split_words, strip_accents_exact, token_set, useful_numbers
from kinweave.operators import blocking as B
from kinweave.operators import buckets, decision, features, keys, learning, metrics, quality, rules
from kinweave.plans import oracle, pipeline
from kinweave.schema import BlockingConfig, DecisionRule, TrainingConfig
from kinweave.sources import records as R
from kinweave.sources import tables
from kinweave.sources.staging import Stash, importable

Query = Callable[[SparkSession, str], DataFrame]
PAIR = B.PAIR
CONFIG = BlockingConfig()
THRESHOLDS, CAPS = TrainingConfig.thresholds, TrainingConfig.caps


def micro(value: F.Column) -> F.Column:
    """Rounded to 6 places in binary arithmetic, so that halves go the same way on every engine."""
    return F.floor(value.cast("double") * 1e6 + 0.5) / 1e6


def hit() -> F.Column:
    """1 where the owner of a pair's target is its S1 record."""
    return F.coalesce((F.col("cand_owner") == F.col(PAIR[0])).cast("int"), F.lit(0))


def _r(column: str) -> F.Column:
    return micro(F.col(column)).alias(column)


def _long(column: str) -> F.Column:
    return F.col(column).cast("long").alias(column)


def sorted_texts() -> list[F.Column]:
    """n and a, which pairs are scored by."""
    return [sorted_tokens(F.col("name_norm")).alias("n"), sorted_tokens(F.col("address_norm")).alias("a")]


#: What is staged of a normalised record; the rest follows from it or is read again.
STAGED = ["entity_id", "target_source", "country", "name_norm", "legal_form", "address_norm", "address_numbers", "landmark_tokens", "country_norm"]


#: What is staged where close pairs of unique ids are compared by names and addresses alone.
NARROW = [c for c in STAGED if c not in ("legal_form", "address_numbers", "landmark_tokens")]


class Data:
    """Normalised records, both sides, truth and roster; staged: written once, where a query reads them several times.
    narrow: only NARROW is staged where ids are unique."""

    def __init__(self, spark: SparkSession, sf_dir: str, staged: bool = False, narrow: bool = False) -> None:
        importable(spark)
        self.documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
        self.raw = R.records(spark, sf_dir)
        self.all = normalize(self.raw)
        if staged:
            self.all = Stash(spark)(self.all.select(*(NARROW if narrow and self.unique else STAGED), keys.first2(F.col("name_norm")).alias("first2"))).withColumn("combined_norm", combined())
        self.s1, self.targets = self.all.where("target_source = 'S1'"), self.all.where("target_source <> 'S1'")
        self.truth = R.truth(self.raw)
        self.roster = self.all.where("target_source = 'S1'").select(F.col("entity_id").alias(PAIR[0]))

    @cached_property
    def unique(self) -> bool:
        """No two records have the same id, which they do where documents have."""
        return self.documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()

    @cached_property
    def staged_truth(self) -> DataFrame:
        return Stash(self.raw.sparkSession)(self.truth)

    def capped(self) -> tuple[DataFrame, DataFrame]:
        frequency = keys.frequent(keys.token_frequency(self.targets), CONFIG.token_cap)
        return keys.capped_keys(self.s1, frequency, CONFIG.token_cap), keys.capped_keys(self.targets, frequency, CONFIG.token_cap)

    def dealt(self, *columns: F.Column | str, labelled: bool = False, how: Callable = B.dealt) -> tuple[DataFrame, DataFrame]:
        """Both sides by their first two name tokens; labelled: with n_true of S1 records and the owner of targets. how: B.dealt or B.parted."""
        key = F.col("first2") if "first2" in self.all.columns else keys.first2(F.col("name_norm"))
        left, right = (x.select("entity_id", "country_norm", key.alias("key"), *columns).where("key IS NOT NULL") for x in (self.s1, self.targets))
        if labelled:
            truth = self.staged_truth
            true = truth.groupBy(F.col(PAIR[0]).alias("entity_id")).agg(F.count(F.lit(1)).alias("n_true"))
            left = left.join(true, "entity_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0).cast("long")))
            right = right.join(truth.select(F.col(PAIR[1]).alias("entity_id"), F.col(PAIR[0]).alias("owner")), "entity_id", "left")
        return how(left, right, CONFIG.bucket_cap)

    def close(self) -> DataFrame:
        """Pairs that share the first two name tokens, where no more targets than fit into a bucket do."""
        if self.unique:
            return B.dealt_pairs(*self.dealt()).select(*PAIR)
        left, right = (keys.explode_keys(x).where("key_type = 'name_first2'").drop("gate") for x in (self.s1, self.targets))
        return B.key_join(left, right, CONFIG.bucket_cap)

    def labelled(self) -> DataFrame:
        """The close pairs with label."""
        if self.unique:
            return B.dealt_pairs(*self.dealt(labelled=True)).select(*PAIR, hit().alias("label"))
        known = self.truth.withColumn("label", F.lit(1))
        return self.close().join(known, PAIR, "left").withColumn("label", F.coalesce("label", F.lit(0)))

    def close_texts(self) -> DataFrame:
        if self.unique:
            # sets are made where the records of a bucket have met, since they take more room than the texts
            sides = self.dealt(*[c for c in STAGED if c not in ("entity_id", "target_source", "country_norm")])
            return B.dealt_pairs(*(features.prepared(x.withColumn("combined_norm", combined()), ("key", "part")) for x in sides))
        return B.with_texts(self.close(), features.prepared(self.s1), features.prepared(self.targets), features.ATTRIBUTES)

    def scored(self, least: float = 0.0, labelled: bool = False) -> tuple[DataFrame, list[str]]:
        """The close pairs of at least that probability (the weighted Levenshtein score) with their ranks, and the columns they lie by.

        Ranks go by probability first, so they are the same with or without the pairs below. labelled: with hit and n_true.
        """
        if self.unique:
            more, within = ["s1_n_true AS n_true", hit().alias("hit")] if labelled else [], B.DEALT
            texts = B.dealt_pairs(*self.dealt(*sorted_texts(), labelled=labelled))
            rows = texts.select(*within, *PAIR, S.weighted_levenshtein(*map(F.col, ("s1_n", "cand_n", "s1_a", "cand_a")), least).alias("score"), *[F.expr(x) if isinstance(x, str) else x for x in more])
        else:
            more, within = [], []
            rows = B.prepared_scores(self.close(), self.s1, self.targets, S.weighted_levenshtein)
        rows = rows.withColumn("probability", micro(F.col("score"))).drop("score").where(F.col("probability") >= least)
        return decision.probability_rank(rows.withColumn("candidate_rank", F.lit(1)), within), within

    def ranked(self, least: float, cap: int) -> DataFrame:
        """The cap best close pairs of each S1 record of at least that probability, with prob_rank."""
        if self.unique:
            return buckets.ranked(*self.dealt(*sorted_texts(), how=B.parted), least, cap)
        return self.scored(least)[0].where(F.col("prob_rank") <= cap)

    def rule_pairs(self) -> DataFrame:
        return rules.rule_links(self.s1, self.targets)


QUERIES: dict[str, Query] = {}


def query(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir))
    return f


def staged_query(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir, True))
    return f


def narrow_query(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Data(spark, sf_dir, True, True))
    return f


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["topk_candidates"](spark, sf_dir)


@query
def record_scan(d: Data) -> DataFrame:
    return d.raw


@query
def norm_name(d: Data) -> DataFrame:
    return d.all.select("entity_id", "name_norm", "legal_form", "country_norm")


@query
def norm_address(d: Data) -> DataFrame:
    return d.all.select("entity_id", "address_norm", "address_numbers", "landmark_tokens", "combined_norm")


@query
def extract_numbers(d: Data) -> DataFrame:
    return d.all.select("entity_id", F.explode(useful_numbers(F.col("address_numbers"))).alias("num"))


@query
def soundex_keys(d: Data) -> DataFrame:
    tokens = d.all.select(F.explode(split_words(F.col("name_norm"))).alias("token")).distinct()
    return tokens.select("token", soundex(F.col("token")).alias("code"))


@query
def char3grams(d: Data) -> DataFrame:
    grams = char_ngrams(F.col("name_norm"))
    return d.all.select("entity_id", F.size(grams).cast("long").alias("n_grams"), F.array_join(F.array_sort(grams), "|").alias("grams"))


@query
def row_keys(d: Data) -> DataFrame:
    made = keys.key_array(F.col("name_norm"), F.col("address_norm"), F.col("address_numbers"))
    return d.all.select("entity_id", F.size(made).cast("long").alias("n_keys"), F.array_join(F.transform(made, lambda k: F.concat(k["key_type"], F.lit("="), k["key"])), ";").alias("keys"))


@query
def token_frequency(d: Data) -> DataFrame:
    return keys.token_frequency(d.targets)


@query
def bucket_sizes(d: Data) -> DataFrame:
    sizes = B.bucket_sizes(keys.explode_keys(d.targets), CONFIG.bucket_cap)
    return sizes.groupBy("country_norm", "key_type", "bucket_size", "bucket_records").agg(F.count(F.lit(1)).alias("n_buckets"))


@staged_query
def capped_keys(d: Data) -> DataFrame:
    _, right = d.capped()
    return right.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_keys"), F.countDistinct("key_type", "key").alias("n_distinct"))


@staged_query
def key_join_candidates(d: Data) -> DataFrame:
    return d.close().groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_candidates"), F.min(PAIR[1]).alias("first_id"), F.max(PAIR[1]).alias("last_id"))


@staged_query
def budgeted_candidates(d: Data) -> DataFrame:
    left, right = d.capped()
    pairs = B.budgeted_pairs(left, right, CONFIG.bucket_cap, CONFIG.budget)
    number = F.split(PAIR[1], "-")[1].cast("decimal(38,0)")
    return pairs.groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_candidates"), F.sum(number).cast("string").alias("id_sum"))


@staged_query
def topk_candidates(d: Data) -> DataFrame:
    return B.keyed_candidates(d.s1, d.targets, score=S.weighted_jaccard, prepare=token_set, unique=d.unique).select(*PAIR, _r("keyed_score"), "keyed_rank")


@staged_query
def scored_candidates(d: Data) -> DataFrame:
    return B.keyed_candidates(d.s1, d.targets, unique=d.unique).select(*PAIR, _r("keyed_score"), "keyed_rank")


@staged_query
def token_block_topk(d: Data) -> DataFrame:
    return B.token_candidates(d.s1, d.targets, ["name_norm", "address_norm", "address_numbers"], 5, CONFIG.block_token_cap, unique=d.unique).select(*PAIR, _r("token_score"), "token_rank")


@staged_query
def tfidf_cosine_topk(d: Data) -> DataFrame:
    return B.tfidf_candidates(d.s1, d.targets, "name_norm", 3, CONFIG, unique=d.unique).select(*PAIR, _r("name_tfidf_score"), "name_tfidf_rank")


@staged_query
def combine_blockers(d: Data) -> DataFrame:
    return B.union_candidates(d.s1, d.targets, unique=d.unique)


@staged_query
def candidate_lists(d: Data) -> DataFrame:
    return B.candidate_lists(B.union_candidates(d.s1, d.targets, unique=d.unique)).select(PAIR[0], F.array_join("candidate_ids", ",").alias("candidate_ids"))


@query
def truth_pairs(d: Data) -> DataFrame:
    return d.truth


@query
def truth_lists(d: Data) -> DataFrame:
    lists = d.truth.groupBy(PAIR[0]).agg(F.array_join(F.array_sort(F.collect_set(PAIR[1])), ",").alias("matched_entity_ids"))
    rows = d.roster.join(lists, PAIR[0], "left").select(PAIR[0], F.coalesce("matched_entity_ids", F.lit("")).alias("matched_entity_ids"))
    return rows.withColumn("n_matches", F.size(tables.parse_ids(F.col("matched_entity_ids"))).cast("long"))


@staged_query
def label_pairs(d: Data) -> DataFrame:
    rows = d.labelled()
    return rows.groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("label").alias("n_positive"))


@staged_query
def entity_fbeta(d: Data) -> DataFrame:
    return metrics.entity_fbeta(d.roster, d.close(), d.truth).select(PAIR[0], *map(_long, ("n_pred", "n_true", "n_hit")), _r("fbeta"))


@staged_query
def macro_fbeta(d: Data) -> DataFrame:
    return metrics.macro_fbeta(d.roster, d.rule_pairs(), d.truth).select(_r("macro_fbeta"))


@staged_query
def blocking_audit(d: Data) -> DataFrame:
    out = metrics.blocking_audit(d.roster, d.close(), d.truth)
    return out.select(*map(_r, out.columns))


@staged_query
def miss_breakdown(d: Data) -> DataFrame:
    return metrics.miss_breakdown(d.roster, d.close(), d.truth)


@staged_query
def non_empty_rate(d: Data) -> DataFrame:
    out = metrics.non_empty_rate(d.roster, d.rule_pairs())
    return out.select(*map(_r, out.columns))


def _native(d: Data, names: list[str]) -> DataFrame:
    made = features.native_features()
    return d.close_texts().select(*PAIR, *[micro(features.finite(made[n])).alias(n) for n in names])


JACCARDS = ["name_jaccard", "address_jaccard", "combined_jaccard", "name_char3gram_jaccard", "address_char3gram_jaccard"]
OVERLAPS = ["shared_name_tokens", "shared_address_tokens", "shared_numbers", "has_number_overlap", "number_conflict", "legal_form_overlap", "legal_form_conflict", "landmark_overlap", "name_overlap_coefficient", "address_overlap_coefficient"]
LEVENSHTEINS = ["name_levenshtein", "address_levenshtein"]
STRUCTURES = ["same_country", "candidate_is_s2", "candidate_is_s3", "name_length_diff", "address_length_diff", "s1_name_token_count", "candidate_name_token_count", "s1_address_token_count", "candidate_address_token_count", "name_exact_match", "address_exact_match", "name_length_ratio", "address_length_ratio", "address_presence", "exact_name_missing_addr"]
PREFIXES = ["name_prefix4_match", "address_prefix4_match"]


@narrow_query
def jaccard_features(d: Data) -> DataFrame:
    if not d.unique:
        return _native(d, JACCARDS)
    name, address = ["name_norm"], ["address_norm"]
    texts = dict(zip(JACCARDS, [(name, S.words_of), (address, S.words_of), (name + address + ["country"], S.words_of), (name, S.grams_of), (address, S.grams_of)], strict=True))
    return buckets.alike(*d.dealt("name_norm", "address_norm", "country", how=B.parted), texts).select(*PAIR, *map(_r, JACCARDS))


@staged_query
def overlap_features(d: Data) -> DataFrame:
    return _native(d, OVERLAPS)


@narrow_query
def levenshtein_features(d: Data) -> DataFrame:
    if d.unique:
        return _compared(d, "levenshtein", S.levenshtein_similarities)
    return _native(d, LEVENSHTEINS)


@staged_query
def structural_features(d: Data) -> DataFrame:
    return _native(d, STRUCTURES)


@staged_query
def prefix_features(d: Data) -> DataFrame:
    return _native(d, PREFIXES)


def _batched(d: Data, names: list[str]) -> DataFrame:
    made = features.batched_features()
    return d.close_texts().select(*PAIR, *[made[n].alias(n) for n in names]).select(*PAIR, *map(_r, names))


def _compared(d: Data, kind: str, f: buckets.Compare, scale: int = 1) -> DataFrame:
    """name_kind and address_kind of the close pairs: f over scale."""
    measures = {f"{k}_{kind}": (f"{k}_norm", f) for k in ("name", "address")}
    made = buckets.compared(*d.dealt("name_norm", "address_norm", how=B.parted), measures)
    return made.select(*PAIR, *[micro(F.col(c) / scale).alias(c) for c in measures])


@staged_query
def jaro_winkler(d: Data) -> DataFrame:
    if d.unique:
        return _compared(d, "jaro_winkler", S.jaro_winklers)
    return _batched(d, ["name_jaro_winkler", "address_jaro_winkler"])


@staged_query
def token_sort_ratio(d: Data) -> DataFrame:
    return _batched(d, ["name_token_sort_ratio", "address_token_sort_ratio"])


@staged_query
def token_set_ratio(d: Data) -> DataFrame:
    if d.unique:
        return _compared(d, "token_set_ratio", S.set_ratios, 100)
    return _batched(d, ["name_token_set_ratio", "address_token_set_ratio"])


@narrow_query
def sequence_ratio(d: Data) -> DataFrame:
    if d.unique:
        return _compared(d, "sequence_ratio", S.sequence_ratios)
    return _batched(d, ["name_sequence_ratio", "address_sequence_ratio"])


@staged_query
def pair_features(d: Data) -> DataFrame:
    return features.pair_features(B.union_candidates(d.s1, d.targets, unique=d.unique), d.s1, d.targets, d.truth)


@staged_query
def predict_threshold_cap(d: Data) -> DataFrame:
    rows = decision.predict(d.ranked(0.6, 3), DecisionRule(threshold=0.6, cap=3, bipartite=False))
    lists = decision.link_lists(d.roster, rows)
    return lists.select(PAIR[0], F.array_join("ids", ",").alias("ids"))


@staged_query
def predict_source_specific(d: Data) -> DataFrame:
    rows = decision.predict(d.ranked(0.5, 4), DecisionRule(None, 0.5, 0.8, 4, False))
    return rows.select(*PAIR, "probability", "prob_rank")


@staged_query
def exclusive_assignment(d: Data) -> DataFrame:
    if d.unique:
        best = buckets.owned(*d.dealt(*sorted_texts(), how=B.parted), 0.4)
    else:
        best = decision.predict(d.scored(0.4)[0], DecisionRule(threshold=0.4, cap=None, bipartite=True))
    return decision.exclusive(best).select(*PAIR, "probability")


@narrow_query
def tune_rule_grid(d: Data) -> DataFrame:
    if d.unique:
        sums = buckets.rated(*d.dealt(*sorted_texts(), how=B.parted), d.staged_truth, THRESHOLDS, CAPS)
        grid = decision.grid_means(sums, d.staged_truth, d.roster, THRESHOLDS, CAPS)
    else:
        rows, within = d.scored(min(THRESHOLDS), labelled=True)
        grid = decision.rule_grid(rows, d.truth, d.roster, THRESHOLDS, CAPS, within)
    return grid.select("threshold", F.coalesce("cap", F.lit(0)).alias("cap"), _r("macro_f05"))


@query
def exact_links(d: Data) -> DataFrame:
    return rules.exact_links(d.s1, d.targets)


@staged_query
def rule_matcher(d: Data) -> DataFrame:
    return d.rule_pairs()


@staged_query
def evidence_weights(d: Data) -> DataFrame:
    if d.unique:
        return rules.evidence_sums(d.s1, d.targets)
    return rules.weighted_evidence(d.s1, d.targets).groupBy("weight").agg(F.count(F.lit(1)).alias("n_pairs"))


@staged_query
def fuzzy_matcher(d: Data) -> DataFrame:
    return rules.fuzzy_links(d.s1, d.targets)


@query
def target_pool_sample(d: Data) -> DataFrame:
    pool = tables.target_pool(d.raw.where("target_source <> 'S1'").drop("number"), d.truth.select(F.col(PAIR[1]).alias("entity_id")), 7)
    return pool.select("entity_id", "target_source")


@query
def stratified_split(d: Data) -> DataFrame:
    counts = d.roster.join(d.truth.groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_matches")), PAIR[0], "left").select(PAIR[0], F.coalesce("n_matches", F.lit(0)).alias("n_matches"))
    return learning.three_way_split(counts)


@staged_query
def downsample_negatives(d: Data) -> DataFrame:
    return learning.downsample_negatives(d.labelled(), 2)


@query
def dup_rows_check(d: Data) -> DataFrame:
    keyed = d.all.select(F.concat_ws("|", "country_norm", "name_norm", "address_norm").alias("entity_id"))
    return features.duplicate_ids(keyed).select(F.col("entity_id").alias("record_key"), F.col("n").alias("n_rows"))


@staged_query
def subset_check(d: Data) -> DataFrame:
    return quality.outside_candidates(d.close(), d.rule_pairs())


@staged_query
def missing_ids(d: Data) -> DataFrame:
    return quality.missing_ids(d.roster, d.rule_pairs())


@query
def list_audit(d: Data) -> DataFrame:
    lists = d.truth.groupBy(PAIR[0]).agg(F.array_join(F.array_sort(F.collect_list(PAIR[1])), ",").alias("ids"))
    surplus = d.targets.groupBy("country").agg(F.min("entity_id").alias(PAIR[0])).select(PAIR[0], F.concat_ws(",", PAIR[0], PAIR[0], F.lit("S1-1"), F.lit("X-1")).alias("ids"))
    out = quality.list_audit(lists.unionByName(surplus), d.roster, d.targets)
    return out.select(*map(_long, out.columns))


@staged_query
def multi_owner_targets(d: Data) -> DataFrame:
    return quality.multi_owner_targets(d.close())


@query
def cross_country_links(d: Data) -> DataFrame:
    heads = d.raw.select("entity_id", "target_source", F.col("business_name").alias("n")).where("n <> ''")
    pairs = heads.where("target_source = 'S1'").groupBy("n").agg(F.min("entity_id").alias(PAIR[0])).join(heads.where("target_source <> 'S1'").select("n", F.col("entity_id").alias(PAIR[1])), "n")
    return quality.cross_country_links(pairs, d.raw, d.raw)


@query
def non_latin_audit(d: Data) -> DataFrame:
    return quality.non_latin_audit(d.raw)


@staged_query
def country_stats(d: Data) -> DataFrame:
    out = quality.country_summary(d.raw.where("target_source = 'S1'"), d.rule_pairs())
    return out.select("country", _long("n_records"), _long("n_linked"), _r("mean_links"))


@query
def country_spellings(d: Data) -> DataFrame:
    return quality.country_spellings(d.all)


@staged_query
def missed_pair_diagnosis(d: Data) -> DataFrame:
    missed = quality.outside_candidates(d.truth, d.rule_pairs())
    return B.missed_pairs_shared_keys(missed, d.s1, d.targets, keys.token_frequency(d.targets), CONFIG.token_cap)


@query
def strip_accents_full(d: Data) -> DataFrame:
    return d.raw.select("entity_id", F.lower(strip_accents_exact(F.col("business_name"))).alias("folded"))


@query
def clean_tokens(d: Data) -> DataFrame:
    return d.all.select("entity_id", F.array_join(F.array_sort(clean_name_tokens(F.col("name_norm"))), " ").alias("tokens"))


@staged_query
def gbt_scored_pairs(d: Data) -> DataFrame:
    rows = features.pair_features(d.close().withColumn("candidate_rank", F.lit(1)), d.s1, d.targets, d.truth)
    return learning.scored_pairs(rows, learning.train(rows, features.feature_names(), trees=5))


@staged_query
def infer_end_to_end(d: Data) -> DataFrame:
    """Training on the close pairs, then every S1 record against every target: keyed candidates, all features, model, rule."""
    rows = features.pair_features(d.close().withColumn("candidate_rank", F.lit(1)), d.s1, d.targets, d.truth)
    model = learning.train(learning.downsample_negatives(rows), features.feature_names(), trees=5)
    got = pipeline.infer_normalized(d.s1, d.targets, pipeline.Trained(model, DecisionRule(threshold=0.5, cap=8), {}))
    return got.select(PAIR[0], *[F.array_join(c, ",").alias(c) for c in ("ids", "candidate_ids")])


@staged_query
def stratified_sample(d: Data) -> DataFrame:
    counts = d.roster.join(d.truth.groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_matches")), PAIR[0], "left").select(PAIR[0], F.coalesce("n_matches", F.lit(0)).alias("n_matches"))
    return learning.stratified_sample(counts, 1000)


@staged_query
def list_offenders(d: Data) -> DataFrame:
    lists = d.close().groupBy(PAIR[0]).agg(F.array_join(F.array_sort(F.collect_list(PAIR[1])), ",").alias("ids"))
    surplus = d.targets.groupBy("country").agg(F.min("entity_id").alias(PAIR[0])).select(PAIR[0], F.concat_ws(",", PAIR[0], PAIR[0], F.lit("S1-1"), F.lit("X-1"), F.lit("S2-x")).alias("ids"))
    return quality.list_offenders(lists.unionByName(surplus), d.roster, d.targets)


@query
def country_targets(d: Data) -> DataFrame:
    return tables.in_countries(d.raw.where("target_source <> 'S1'"), ["en", "fr"]).select("entity_id", "target_source", "country")


@staged_query
def indel_ratio(d: Data) -> DataFrame:
    """Where ids repeat, by the functions as SQL functions."""
    if d.unique:
        return _compared(d, "ratio", S.indel_ratios)
    S.register(d.raw.sparkSession)
    texts = d.close_texts().select(*PAIR, "s1_name_norm", "cand_name_norm", "s1_address_norm", "cand_address_norm")
    return texts.selectExpr(*PAIR, *[f"indel_ratio(s1_{k}_norm, cand_{k}_norm) AS {k}_ratio" for k in ("name", "address")]).select(*PAIR, _r("name_ratio"), _r("address_ratio"))


@query
def country_id_lists(d: Data) -> DataFrame:
    return tables.country_ids(d.raw, "en").unionByName(tables.country_ids(d.raw, "fr"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.statements()
