import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import decision as D
from kinweave.operators import metrics as M
from kinweave.schema import DecisionRule, TrainingConfig

S1, C = "source1_entity_id", "candidate_entity_id"


def pairs(spark, rows):
    return spark.createDataFrame(rows, f"{S1} string, {C} string")


def roster(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], f"{S1} string")


@pytest.mark.parametrize(
    "predicted, true, score",
    [(["S2-00047", "S2-00193", "S3-00812"], ["S2-00047", "S3-00812"], 0.714286), ([], [], 1.0), (["S2-1"], [], 0.0), ([], ["S2-1"], 0.0), (["S2-1"], ["S2-1", "S2-2"], 0.833333)],
)
def test_entity_fbeta(spark, predicted, true, score):
    got = M.entity_fbeta(roster(spark, ["a"]), pairs(spark, [("a", x) for x in predicted]), pairs(spark, [("a", x) for x in true])).first()
    assert round(got.fbeta, 6) == score


def test_macro_of_an_empty_roster(spark):
    assert M.macro_fbeta(roster(spark, []), pairs(spark, []), pairs(spark, [])).first().macro_fbeta == 0.0


def scored(spark, rows):
    return D.probability_rank(spark.createDataFrame(rows, f"{S1} string, {C} string, probability double").withColumn("candidate_rank", F.lit(1)))


def test_exclusivity(spark):
    got = D.exclusive(scored(spark, [("a", "t1", 0.9), ("b", "t1", 0.8), ("b", "t2", 0.7)])).collect()
    assert {(r[0], r[1]) for r in got} == {("a", "t1"), ("b", "t2")}
    tie = D.exclusive(scored(spark, [("b", "t1", 0.9), ("a", "t1", 0.9)])).collect()
    assert [(r[0], r[1]) for r in tie] == [("a", "t1")]


def test_rule_json():
    rule = DecisionRule(None, 0.5, 0.6, 8, True)
    assert DecisionRule.from_json(rule.to_json()) == rule
    assert DecisionRule.from_json('{"threshold": 0.5, "cap": null}').bipartite is True
    assert DecisionRule.from_json(rule.to_json(), threshold=0.95, cap=4) == DecisionRule(threshold=0.95, cap=4)


def test_source_thresholds(spark):
    got = D.predict(scored(spark, [("a", "S2-1", 0.6), ("a", "S3-1", 0.6), ("a", "X-1", 0.9)]), DecisionRule(None, 0.5, 0.8, None, False)).collect()
    assert {r[1] for r in got} == {"S2-1", "X-1"}


def random_case(spark, seed):
    rnd = random.Random(seed)
    ids = [f"S1-{i}" for i in range(12)]
    rows = {(i, f"S{rnd.choice('23')}-{rnd.randrange(9)}"): round(rnd.random(), 1) for i in ids for _ in range(rnd.randrange(6))}
    truth = [(i, f"S2-{rnd.randrange(9)}") for i in ids if rnd.random() < 0.6]
    return scored(spark, [(a, b, p) for (a, b), p in rows.items()]), pairs(spark, sorted(set(truth))), roster(spark, ids)


def test_grid_equals_point_by_point(spark):
    ranked, truth, ids = random_case(spark, 3)
    thresholds, caps = (0.2, 0.5, 0.8), (1, 2, None)
    got = {(r.threshold, r.cap): r.macro_f05 for r in D.rule_grid(ranked, truth, ids, thresholds, caps).collect()}
    for t, c in itertools.product(thresholds, caps):
        assert got[t, c] == pytest.approx(D.evaluate(ranked, truth, ids, DecisionRule(threshold=t, cap=c, bipartite=False)), abs=1e-12)
    rule, value = D.tune(ranked, truth, ids, TrainingConfig(thresholds=thresholds, caps=caps))
    assert value == pytest.approx(max(got.values()))
    first = next((t, c) for t, c in itertools.product(thresholds, caps) if abs(got[t, c] - value) < 1e-12)
    assert (rule.threshold, rule.cap) == first


@pytest.mark.parametrize("bipartite", [True, False])
def test_source_grid_equals_point_by_point(spark, bipartite):
    ranked, truth, ids = random_case(spark, 4)
    fixed = DecisionRule(None, 0.5, 0.5, 2, bipartite)
    got = D.source_grid(ranked, truth, ids, fixed, "s2", (0.3, 0.9))
    for t, v in zip((0.3, 0.9), got, strict=True):
        assert v == pytest.approx(D.evaluate(ranked, truth, ids, DecisionRule(None, t, 0.5, 2, bipartite)), abs=1e-12)


def test_choose_rule_and_lists(spark):
    ranked, truth, ids = random_case(spark, 5)
    config = TrainingConfig(thresholds=(0.2, 0.6), caps=(1, None))
    rule, value = D.choose_rule(ranked, truth, ids, config)
    assert value >= D.tune(ranked, truth, ids, config)[1]
    links = D.decide(ranked, rule)
    assert links.groupBy(C).count().where("count > 1").count() == 0 or not rule.bipartite
    lists = D.link_lists(ids, links)
    assert lists.count() == 12 and lists.where("ids is null").count() == 0
