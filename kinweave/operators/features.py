"""The 56 features of a candidate pair. Attributes, with their sets made once per record, are joined to narrow pairs; only
then do similarities run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.functions.text import char3gram_codes, pipe_set, split_words, token_set
from kinweave.operators.blocking import PAIR, with_texts

TEXTS = ["name_norm", "address_norm", "country_norm"]
#: Sets of a record: (column that they are made of, function, type of the elements).
SETS = {
    "name_set": ("name_norm", token_set, "string"),
    "address_set": ("address_norm", token_set, "string"),
    "combined_set": ("combined_norm", token_set, "string"),
    "number_set": ("address_numbers", pipe_set, "string"),
    "form_set": ("legal_form", pipe_set, "string"),
    "landmark_set": ("landmark_tokens", pipe_set, "string"),
    "name_grams": ("name_norm", char3gram_codes, "bigint"),
    "address_grams": ("address_norm", char3gram_codes, "bigint"),
}
ATTRIBUTES = [*TEXTS, *SETS]
SCORES = ["name_tfidf_score", "address_tfidf_score", "combined_tfidf_score", "token_score", "keyed_score"]
RANKS = ["candidate_rank", "keyed_rank"]
NO_RANK = 9999.0


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def _filled(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0)


def _overlap(a: Column, b: Column) -> Column:
    return _flag(_filled(a, b) & F.arrays_overlap(a, b))


def _conflict(a: Column, b: Column) -> Column:
    return _flag(_filled(a, b) & ~F.arrays_overlap(a, b))


def _sides(column: str) -> tuple[Column, Column]:
    return F.coalesce(f"s1_{column}", F.lit("")), F.coalesce(f"cand_{column}", F.lit(""))


def _set_sides(column: str) -> tuple[Column, ...]:
    return tuple(F.coalesce(f"{side}_{column}", F.array().cast(f"array<{SETS[column][2]}>")) for side in ("s1", "cand"))


def prepared(records: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """entity_id, ATTRIBUTES and more columns of normalised records; what a query doesn't use isn't made."""
    return records.select("entity_id", *more, *TEXTS, *[make(F.col(of)).alias(name) for name, (of, make, _) in SETS.items()])


def native_features() -> dict[str, Column]:
    """The features that need no Python, over columns s1_* and cand_* of ATTRIBUTES."""
    name, address = _sides("name_norm"), _sides("address_norm")
    nums, forms, marks = map(_set_sides, ("number_set", "form_set", "landmark_set"))
    nt, at, ct = map(_set_sides, ("name_set", "address_set", "combined_set"))
    grams = {k: _set_sides(f"{k}_grams") for k in ("name", "address")}
    country = _sides("country_norm")
    target = F.col(PAIR[1])

    def prefix4(x: tuple[Column, Column]) -> Column:
        return _flag((F.length(x[0]) >= 4) & (F.length(x[1]) >= 4) & (F.substring(x[0], 1, 4) == F.substring(x[1], 1, 4)))

    exact_name = _flag((name[0] != "") & (name[0] == name[1]))
    present = _flag(address[1] != "")
    return {
        "name_jaccard": S.jaccard(*nt),
        "address_jaccard": S.jaccard(*at),
        "combined_jaccard": S.jaccard(*ct),
        "shared_name_tokens": S.overlap_count(*nt).cast("double"),
        "shared_address_tokens": S.overlap_count(*at).cast("double"),
        "shared_numbers": S.overlap_count(*nums).cast("double"),
        "has_number_overlap": _overlap(*nums),
        "number_conflict": _conflict(*nums),
        "legal_form_overlap": _overlap(*forms),
        "legal_form_conflict": _conflict(*forms),
        "landmark_overlap": _overlap(*marks),
        "same_country": _flag(country[0] == country[1]),
        "candidate_is_s2": _flag(target.startswith("S2-")),
        "candidate_is_s3": _flag(target.startswith("S3-")),
        "name_length_diff": F.abs(F.length(name[0]) - F.length(name[1])).cast("double"),
        "address_length_diff": F.abs(F.length(address[0]) - F.length(address[1])).cast("double"),
        "s1_name_token_count": F.size(nt[0]).cast("double"),
        "candidate_name_token_count": F.size(nt[1]).cast("double"),
        "s1_address_token_count": F.size(at[0]).cast("double"),
        "candidate_address_token_count": F.size(at[1]).cast("double"),
        "name_exact_match": exact_name,
        "address_exact_match": _flag((address[0] != "") & (address[0] == address[1])),
        "name_levenshtein": S.levenshtein_similarity(*name),
        "address_levenshtein": S.levenshtein_similarity(*address),
        "name_overlap_coefficient": S.overlap_coefficient(*nt),
        "address_overlap_coefficient": S.overlap_coefficient(*at),
        "name_length_ratio": S.length_ratio(*name),
        "address_length_ratio": S.length_ratio(*address),
        "name_prefix4_match": prefix4(name),
        "address_prefix4_match": prefix4(address),
        "name_char3gram_jaccard": S.jaccard(*grams["name"]),
        "address_char3gram_jaccard": S.jaccard(*grams["address"]),
        "address_presence": present,
        "exact_name_missing_addr": exact_name * (1 - present),
    }


def batched_features() -> dict[str, Column]:
    """The features computed by Arrow-batched functions."""
    name, address = _sides("name_norm"), _sides("address_norm")
    return {
        "name_sequence_ratio": S.sequence_ratio_udf(*name),
        "address_sequence_ratio": S.sequence_ratio_udf(*address),
        "name_jaro_winkler": S.jaro_winkler_udf(*name),
        "address_jaro_winkler": S.jaro_winkler_udf(*address),
        "name_token_sort_ratio": S.token_sort_udf(*name) / 100,
        "name_token_set_ratio": S.token_set_udf(*name) / 100,
        "address_token_sort_ratio": S.token_sort_udf(*address) / 100,
        "address_token_set_ratio": S.token_set_udf(*address) / 100,
        "_first_ratio": S.ratio_udf(*(F.coalesce(F.get(split_words(x), F.lit(0)), F.lit("")) for x in name)) / 100,
    }


def _derived() -> dict[str, Column]:
    n, a = F.col("name_token_sort_ratio"), F.col("address_token_sort_ratio")
    both = F.size(F.filter(F.array(*(F.trim(x) for x in _sides("name_norm"))), lambda t: t != "")) == 2
    return {
        "name_first_token_match": _flag(both & (F.col("_first_ratio") >= 0.8)),
        "name_first_token_conflict": _flag(both & (F.col("_first_ratio") < 0.5)),
        "name_addr_sim_product": n * a,
        "name_addr_sim_sum": n + a,
        "name_addr_sim_max": F.greatest(n, a),
        "name_addr_sim_min": F.least(n, a),
    }


def feature_names() -> list[str]:
    return ["candidate_rank", "candidate_strength", *SCORES, "keyed_rank", *native_features(), *[k for k in batched_features() if k[0] != "_"], *_derived()]


def finite(value: Column) -> Column:
    """Infinite, not-a-number and null become 0."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def pair_features(candidates: DataFrame, s1: DataFrame, targets: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """All features of each candidate pair, and label where truth is given. Absent blockers score 0 and rank 9999."""
    scores = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in candidates.columns else F.lit(0.0).alias(c) for c in ["candidate_strength", *SCORES]]
    ranks = [F.coalesce(F.col(c).cast("double"), F.lit(NO_RANK)).alias(c) if c in candidates.columns else F.lit(NO_RANK).alias(c) for c in RANKS]
    rows = with_texts(candidates.select(*PAIR, *scores, *ranks), prepared(s1), prepared(targets), ATTRIBUTES)
    rows = rows.withColumns(batched_features()).withColumns(native_features()).withColumns(_derived())
    names = feature_names()
    out = rows.select(*PAIR, *[finite(F.col(c)).alias(c) for c in names])
    if truth is None:
        return out
    known = truth.select(*PAIR).distinct().withColumn("label", F.lit(1))
    return out.join(known, PAIR, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Ids that break a many-to-one join."""
    return records.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def aligned(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by name; missing ones are 0."""
    return rows.select(*PAIR, *[F.col(c) if c in rows.columns else F.lit(0.0).alias(c) for c in columns])
