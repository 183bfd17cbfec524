import random
from collections import defaultdict

from pyspark.sql import functions as F

from kinweave.operators import blocking as B
from kinweave.operators import keys as K

SCHEMA = "entity_id string, country_norm string, name_norm string, address_norm string, address_numbers string"


def test_key_order(spark):
    rows = spark.createDataFrame([("S1-1", "in", "moon boards", "12 main street kanpur", "12|208001")], SCHEMA)
    got = [(r.key_type, r.key) for r in K.explode_keys(rows).orderBy("ord").collect()]
    assert got == [
        ("name_compact", "moonboards"), ("name_prefix", "moonb"), ("name_first_token", "moon"), ("name_sorted", "boards moon"), ("name_first2", "moon boards"),
        ("name_token", "moon"), ("name_soundex", "m500"), ("name_token", "boards"), ("name_soundex", "b632"),
        ("addr_token", "main"), ("addr_token", "street"), ("addr_token", "kanpur"), ("addr_num", "208001"), ("name_num", "moon_208001"),
        ("addr_num_street", "208001_main"), ("addr_num_street", "208001_street"), ("addr_num_street", "208001_kanpur"), ("name_city", "moon_kanpur"), ("num_city", "208001_kanpur"),
    ]


def test_empty_record_has_no_keys(spark):
    assert K.explode_keys(spark.createDataFrame([("S1-1", "in", "", "", "")], SCHEMA)).count() == 0


def test_frequency_counts_both_fields(spark):
    rows = spark.createDataFrame([("S2-1", "in", "moon moon", "moon road", ""), ("S2-2", "in", "sun", "", ""), ("S2-3", "fr", "moon", "", "")], SCHEMA)
    assert {(r.country_norm, r.token): r.freq for r in K.token_frequency(rows).collect()} == {("in", "moon"): 2, ("in", "road"): 1, ("in", "sun"): 1, ("fr", "moon"): 1}


def test_cap_is_inclusive_and_unseen_tokens_pass(spark):
    rows = spark.createDataFrame([("S2-1", "in", "moon", "", "")], SCHEMA)
    frequency = spark.createDataFrame([("in", "moon", 2)], "country_norm string, token string, freq long")
    kinds = lambda cap: {r.key_type for r in K.capped_keys(rows, frequency, cap).collect()}
    assert "name_token" in kinds(2) and "name_token" not in kinds(1) and "name_prefix" in kinds(1)
    assert "name_token" in {r.key_type for r in K.capped_keys(rows, frequency.limit(0), 1).collect()}


def sequential(left, right, cap, budget):
    """The definition: buckets from the smallest on, whole, until the budget is reached."""
    index = defaultdict(list)
    for entity, _, key in sorted(right, key=lambda r: (r[2], r[0])):
        index[key].append(entity)
    index = {k: v for k, v in index.items() if len(v) <= cap}
    out = set()
    for s in {l[0] for l in left}:
        asked = sorted((o, k) for e, o, k in left if e == s and k in index)
        found = set()
        for o, k in sorted(asked, key=lambda x: (len(index[x[1]]), x[0])):
            found |= set(index[k])
            if len(found) >= budget:
                break
        out |= {(s, c) for c in found}
    return out


def test_budget_equals_the_sequential_definition(spark):
    rnd = random.Random(5)
    left_rows, right_rows, wanted = [], [], {}
    for case in range(40):
        left = [(f"{case}-s{i}", o, f"k{rnd.randrange(7)}") for i in range(3) for o in range(rnd.randrange(6))]
        right = [(f"{case}-t{rnd.randrange(9)}", o, f"k{rnd.randrange(7)}") for o in range(rnd.randrange(25))]
        wanted[case] = sequential(left, right, 6, 3)
        left_rows += [(e, str(case), o, "t", k) for e, o, k in left]
        right_rows += [(e, str(case), o, "t", k) for e, o, k in right]
    schema = "entity_id string, country_norm string, ord int, key_type string, key string"
    for partitions in (1, 4):
        got = B.budgeted_pairs(spark.createDataFrame(left_rows, schema).repartition(partitions), spark.createDataFrame(right_rows, schema), 6, 3).collect()
        assert {tuple(r) for r in got} == set().union(*wanted.values())


def test_budget_takes_buckets_whole(spark):
    schema = "entity_id string, country_norm string, ord int, key_type string, key string"
    left = spark.createDataFrame([("s", "c", i, "t", k) for i, k in enumerate("abc")], schema)
    right = spark.createDataFrame([(e, "c", 0, "t", k) for k, es in {"a": "xy", "b": "yzw", "c": "q"}.items() for e in es], schema)
    assert {r[1] for r in B.budgeted_pairs(left, right, 10, 3).collect()} == set("qxy")


def test_combine(spark):
    a = spark.createDataFrame([("s", "t1", 0.5, 1, "x"), ("s", "t2", 0.5, 2, "x")], "source1_entity_id string, candidate_entity_id string, x_score double, x_rank int, blocker string")
    b = spark.createDataFrame([("s", "t1", 0.9, 1, "y")], "source1_entity_id string, candidate_entity_id string, y_score double, y_rank int, blocker string")
    got = {r.candidate_entity_id: r for r in B.combine([a, b]).collect()}
    assert (got["t1"].x_score, got["t1"].y_score, got["t1"].blocker, got["t1"].candidate_strength, got["t1"].candidate_rank) == (0.5, 0.9, "x|y", 0.9, 1)
    assert (got["t2"].y_score, got["t2"].y_rank, got["t2"].candidate_rank) == (0.0, 0, 2)
    assert B.combine([a, b], 1).count() == 1
    assert B.candidate_lists(B.combine([a, b])).first().candidate_ids == ["t1", "t2"]


def test_keyed_candidates_stay_in_their_country(spark):
    rows = [("S1-1", "in", "moon boards", "1 main", "1"), ("S2-1", "in", "moon boards", "1 main", "1"), ("S2-2", "fr", "moon boards", "1 main", "1")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = B.keyed_candidates(frame.where(F.col("entity_id").startswith("S1")), frame.where(F.col("entity_id").startswith("S2"))).collect()
    assert [(r.candidate_entity_id, r.keyed_score) for r in got] == [("S2-1", 1.0)]
