"""Catalog queries against brute force, over documents where a cut of the targets or tokens would show."""

import math
import random
from collections import Counter

import pytest

from kinweave.plans import catalog


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """400 texts of one run each in a language (a third S1); two words are in every name, first words vary."""
    rnd = random.Random(7)
    words = ["amber", "brick", "cedar", "delta", "ember", "flint", "grove", "hazel", "ivory", "jolly", "karma", "lemon"]
    rows = []
    for i in range(402):
        name = rnd.sample(words, 4) + ["common", "shared"]
        rnd.shuffle(name)
        rows.append((i, " ".join(name + rnd.choices(words, k=6)), "en" if i < 400 else "fr", "web", 100 + i % 7))
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def sides(spark, docs):
    """Normalised S1 records and targets."""
    rows = catalog.Data(spark, docs).all.collect()
    return [r for r in rows if r.target_source == "S1"], [r for r in rows if r.target_source != "S1"]


def best(pairs, k):
    """The k best (s1, target, score) of each S1 record; equal scores by target id."""
    by_s1 = {}
    for s, t, score in pairs:
        by_s1.setdefault(s, []).append((-score, t))
    return {(s, t, round(-score, 6), i + 1) for s, found in by_s1.items() for i, (score, t) in enumerate(sorted(found)[:k])}


def tfidf_pairs(left, right, column):
    """(s1, target, cosine) of all pairs of a country with a common gram."""
    def grams(text):
        padded = [f" {w} " for w in text.split()]
        return Counter(w[i : i + n] for w in padded for n in (3, 4, 5) for i in range(len(w) - n + 1))

    left, right = ({r.entity_id: (r.country_norm, grams(r[column])) for r in rows} for rows in (left, right))
    n = Counter(c for c, _ in right.values())
    df = Counter((c, g) for c, tf in right.values() for g in tf)

    def unit(country, tf):
        w = {g: f * (math.log((1 + n[country]) / (1 + df[country, g])) + 1) for g, f in tf.items() if df[country, g] >= 2}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    left, right = ({e: (c, unit(c, tf)) for e, (c, tf) in side.items()} for side in (left, right))
    return [(s, t, round(score, 9)) for s, (c, a) in left.items() for t, (d, b) in right.items() if c == d and (score := sum(x * b[g] for g, x in a.items() if g in b)) > 0]


def token_pairs(left, right, k):
    """(s1, target, score) of the 20 k pairs of each S1 record with most shared tokens."""
    left, right = ({r.entity_id: (r.country_norm, set(f"{r.name_norm} {r.address_norm} {r.address_numbers.replace('|', ' ')}".split())) for r in rows} for rows in (left, right))
    pairs = []
    for s, (c, a) in left.items():
        most = sorted((-len(a & b), t) for t, (d, b) in right.items() if c == d and a & b)[: 20 * k]
        pairs += [(s, t, -shared / len(a | right[t][1])) for shared, t in most]
    return pairs


def test_tfidf_compares_all_targets_of_the_country(spark, docs, sides):
    got = {tuple(r) for r in catalog.QUERIES["tfidf_cosine_topk"](spark, docs).collect()}
    wanted = best(tfidf_pairs(*sides, "name_norm"), 3)
    assert len(wanted) == len(got) and {x[0] for x in got} == {x[0] for x in wanted}
    assert {(s, i): score for s, _, score, i in got} == pytest.approx({(s, i): score for s, _, score, i in wanted}, abs=2e-6)


def test_token_block_counts_common_tokens_and_addresses(spark, docs, sides):
    assert sum("common" in r.name_norm for r in sides[1] if r.country_norm == "en") > 250
    assert {tuple(r) for r in catalog.QUERIES["token_block_topk"](spark, docs).collect()} == best(token_pairs(*sides, 5), 5)


def clean(text):
    return {w for w in text.split() if len(w) >= 3 and not w.isdigit()}


def numbers(r):
    return {x for x in r.address_numbers.split("|") if len(x) >= 3}


def evidence(left, right):
    """Weight of every pair that has one."""
    of = Counter((r.country_norm, r.name_norm, r.address_norm) for r in left)
    of_number = Counter((r.country_norm, r.name_norm, x) for r in left for x in numbers(r))
    weights = {}
    for a in left:
        for b in right:
            if a.country_norm != b.country_norm:
                continue
            weight = len(clean(a.name_norm) & clean(b.name_norm))
            if a.name_norm == b.name_norm:
                weight += 4 * sum(of_number[a.country_norm, a.name_norm, x] <= 4 for x in numbers(a) & numbers(b))
                weight += 6 * (a.address_norm == b.address_norm and of[a.country_norm, a.name_norm, a.address_norm] == 1)
            if weight:
                weights[a, b] = weight
    return weights


def test_evidence_counts_tokens_of_more_than_50_records(spark, docs, sides):
    assert sum("common" in clean(r.name_norm) for r in sides[0]) > 50
    got = catalog.QUERIES["evidence_weights"](spark, docs).collect()
    assert {r.weight: r.n_pairs for r in got} == Counter(evidence(*sides).values())


def test_fuzzy_matcher_uses_tokens_of_more_than_50_records(spark, tmp_path):
    rnd = random.Random(3)
    words = ["amber", "brick", "cedar", "delta", "ember", "flint"]
    rows = [(i, " ".join(rnd.sample(words, 5) + ["common"] + rnd.sample(words, 4)), "en", "web", 1000 + i) for i in range(210)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    records = catalog.Data(spark, str(tmp_path)).all.collect()
    left, right = ([r for r in records if (r.target_source == "S1") == mine] for mine in (True, False))
    assert all(sum(w in r.name_norm for r in left) > 50 for w in words)

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 0.0

    by_target, links = {}, {}
    for (a, b), weight in evidence(left, right).items():
        by_target.setdefault(b, []).append((-weight, a.entity_id, a))
    for b, found in by_target.items():
        for weight, _, a in sorted(found, key=lambda x: x[:2])[:25]:
            name = jaccard(clean(a.name_norm), clean(b.name_norm))
            address = jaccard(*({w for w in r.address_norm.split() if len(w) >= 3} for r in (a, b)))
            number = bool(numbers(a) & numbers(b))
            score = 0.68 * name + 0.24 * address + (0.08 if number else 0.0)
            if (score >= 0.82 and name >= 0.70) or (score >= 0.64 and name >= 0.55 and -weight >= 2 and (address >= 0.16 or number)):
                links.setdefault(a.entity_id, []).append(b.entity_id)
    wanted = {(s, t) for s, found in links.items() for t in sorted(found)[:8]}
    assert wanted and {tuple(r) for r in catalog.QUERIES["fuzzy_matcher"](spark, str(tmp_path)).collect()} == wanted


@pytest.mark.parametrize("name", ["scored_candidates", "topk_candidates"])
def test_keyed_queries_keep_60_candidates(spark, docs, name):
    rows = catalog.QUERIES[name](spark, docs).collect()
    assert max(r.keyed_rank for r in rows) == max(Counter(r.source1_entity_id for r in rows).values()) == 60


def test_combine_blockers_unites_the_four_blockers(spark, docs):
    rows = catalog.QUERIES["combine_blockers"](spark, docs).collect()
    assert {b for r in rows for b in r.blocker.split("|")} == {"name_tfidf", "address_tfidf", "combined_tfidf", "token"}
    assert max(Counter(r.source1_entity_id for r in rows).values()) == 80
    assert max(r.name_tfidf_rank for r in rows) > 5 and all(0 <= r.name_tfidf_score <= 1 for r in rows)


def test_combine_blockers_equals_brute_force(spark, docs, sides):
    """Each blocker's 60 best, the best score of each pair, and the 80 strongest; candidate_lists names them in that order."""
    strength = {}
    for pairs in (*(tfidf_pairs(*sides, c) for c in ("name_norm", "address_norm", "combined_norm")), token_pairs(*sides, 60)):
        for s, t, score, _ in best(pairs, 60):
            strength[s, t] = max(score, strength.get((s, t), 0.0))
    wanted = {(s, i): score for s, _, score, i in best([(s, t, x) for (s, t), x in strength.items()], 80)}
    got = catalog.QUERIES["combine_blockers"](spark, docs).collect()
    assert {(r.source1_entity_id, r.candidate_rank): r.candidate_strength for r in got} == pytest.approx(wanted, abs=2e-6)
    lists = {r.source1_entity_id: r.candidate_ids.split(",") for r in catalog.QUERIES["candidate_lists"](spark, docs).collect()}
    assert {(r.source1_entity_id, r.candidate_rank): r.candidate_entity_id for r in got} == {(s, i + 1): t for s, ids in lists.items() for i, t in enumerate(ids)}
