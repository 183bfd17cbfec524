import hashlib

import pytest
from pyspark.sql import functions as F

from kinweave.functions.text import normalize
from kinweave.operators import features, learning
from kinweave.operators.blocking import PAIR
from kinweave.plans import pipeline
from kinweave.schema import BlockingConfig, TrainingConfig
from kinweave.sources import tables
from kinweave.streaming import linking

RECORDS = "entity_id string, business_name string, business_address string, country string"
NAMES = "moon sun star river stone wood lake cloud wind fire snow rain sand leaf rock hill field sea bird wolf".split()


def world(spark, n=60):
    s1, targets, truth = [], [], []
    for i in range(n):
        name = f"{NAMES[i % 20]} {NAMES[(i * 7 + 3) % 20]} {NAMES[(i // 20 + i) % 20]} works {i}"
        address = f"{100 + i} {NAMES[(i * 3) % 20]} street town{i % 5} {10000 + 37 * i}"
        s1.append((f"S1-{i}", name, address, "in"))
        if i % 4:
            targets.append((f"S2-{i}", name.replace("works", "work"), address, "in"))
            truth.append((f"S1-{i}", f"S2-{i}"))
        targets.append((f"S3-{i}", f"{NAMES[(i * 11) % 20]} other {i * 3}", f"{i} lane town{i % 5} {50000 + i}", "in"))
    return spark.createDataFrame(s1, RECORDS), spark.createDataFrame(targets, RECORDS), spark.createDataFrame(truth, ", ".join(f"{c} string" for c in PAIR))


def test_fifty_six_features(spark):
    names = features.feature_names()
    assert len(names) == len(set(names)) == 56
    s1, targets, truth = world(spark, 12)
    left, right = normalize(s1), normalize(targets)
    rows = features.pair_features(pipeline.candidates(left, right, BlockingConfig()), left, right, truth)
    assert rows.columns == [*PAIR, *names, "label"]
    got = rows.where("label = 1").collect()
    assert len(got) == 9
    for r in got:
        assert r.has_number_overlap == 1 and r.number_conflict == 0 and r.address_exact_match == 1 and r.candidate_is_s2 == 1
        assert r.name_tfidf_score == 0 and r.keyed_rank >= 1 and 0 < r.name_sequence_ratio < 1 and r.name_first_token_match == 1
    assert rows.where(" or ".join(f"{n} is null or isnan({n})" for n in names)).count() == 0


def test_train_infer_measure(spark):
    s1, targets, truth = world(spark, 120)
    trained = pipeline.train(s1, targets, truth, training=TrainingConfig(thresholds=(0.3, 0.6, 0.9), caps=(1, None)), trees=5, depth=3)
    assert trained.metrics["holdout_macro_f05"] > 0.8
    lists = pipeline.infer(s1, targets, trained)
    assert lists.count() == s1.count()
    links = lists.select(PAIR[0], F.explode("ids").alias(PAIR[1]))
    assert links.groupBy(PAIR[1]).count().where("count > 1").count() == 0 or not trained.rule.bipartite
    assert links.join(truth, PAIR, "left_semi").count() > 0.8 * truth.count()
    measured = pipeline.measure_recall(s1, targets, truth)
    assert measured["pair_recall"] == 1.0 and measured["with_truth"] == 90


def test_model_round_trip(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias(PAIR[0]), F.lit("S2-1").alias(PAIR[1]), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("label"), F.lit(1).alias("candidate_rank"))
    model = learning.train(rows, ["x"], trees=2, depth=2)
    model.save(str(tmp_path / "m"))
    again = learning.MatchModel.load(str(tmp_path / "m"), ["x"], 3)
    assert [r.probability for r in learning.scored_pairs(rows, again).orderBy(PAIR[0]).collect()] == [r.probability for r in learning.scored_pairs(rows, model).orderBy(PAIR[0]).collect()]
    assert learning.scored_pairs(rows.drop("x"), model).count() == 200


def test_samples_and_splits(spark):
    truth = spark.range(100).select(F.concat(F.lit("S1-"), F.col("id").cast("string")).alias(PAIR[0]), F.when(F.col("id") < 10, 0).otherwise(2).alias("n_matches"))
    parts = {(r.split, r.single): r["count"] for r in learning.three_way_split(truth).withColumn("single", F.col("n_matches") == 0).groupBy("split", "single").count().collect()}
    assert parts == {("holdout", True): 2, ("tune", True): 2, ("fit", True): 6, ("holdout", False): 18, ("tune", False): 18, ("fit", False): 54}
    taken = learning.stratified_sample(truth, 50)
    assert taken.count() == 50 and taken.where("n_matches = 0").count() == 10
    pairs = truth.select(PAIR[0], F.lit("S2-1").alias(PAIR[1]), (F.col("n_matches") == 0).cast("int").alias("label"))
    down = learning.downsample_negatives(pairs, 3)
    assert down.where("label = 1").count() == 10 and down.where("label = 0").count() == 30
    assert learning.downsample_negatives(pairs, 0).count() == 100


def test_streams(spark, tmp_path):
    s1, targets, _ = world(spark, 20)
    exact = targets.limit(0).unionByName(s1.withColumn("entity_id", F.replace("entity_id", F.lit("S1-"), F.lit("S2-"))))
    exact.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(exact.schema).parquet(str(tmp_path / "in"))
    q = linking.exact_stream(stream, s1).writeStream.format("memory").queryName("links").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r[0][3:], r[1][3:]) for r in spark.table("links").collect()} == {(str(i), str(i)) for i in range(20)}
    got = []
    q = linking.link_batches(stream, s1, lambda rows, n: got.extend(rows.collect()), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert len(got) == 20


def test_ranks_without_a_window_over_a_stratum(spark, capsys):
    rows = spark.range(3000).select(F.format_string("S1-%d", "id").alias(PAIR[0]), (F.col("id") % 3).alias("n_matches"))
    got = learning.ranked(rows, F.col("n_matches") > 0, learning.hash_order(PAIR[0], 5))
    by = {}
    for r in got.collect():
        by.setdefault(r.n_matches > 0, []).append((r._r, hashlib.md5(f"5:{r[PAIR[0]]}".encode()).hexdigest(), r._n))
    for own in by.values():
        own.sort()
        assert [x[0] for x in own] == list(range(1, len(own) + 1)) and [x[1] for x in own] == sorted(x[1] for x in own) and {x[2] for x in own} == {len(own)}
    assert got.columns == [*rows.columns, "_n", "_r"]
    assert learning.stratified_sample(rows, 100).count() == 100


def test_guards_of_the_job(spark):
    s1, targets, truth = world(spark, 12)
    with pytest.raises(ValueError, match="S2-1"):
        pipeline.require_unique(targets.unionByName(targets.where("entity_id = 'S2-1'")), "S2")
    with pytest.raises(ValueError, match="1 true matches"):
        tables.require_positives(targets.where("entity_id <> 'S2-1'"), truth.select(F.col(PAIR[1]).alias("entity_id")))
    lists = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", ""), ("S1-1", "S2-9")], "source1_entity_id string, ids string")
    assert {tuple(r) for r in tables.id_list_rows(lists.coalesce(1)).collect()} == {("S1-1", 2, "S2-9"), ("S1-2", 1, "")}


def test_booster_settings(spark):
    rows = spark.range(400).select(F.format_string("S1-%d", "id").alias(PAIR[0]), F.lit("S2-1").alias(PAIR[1]), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"), (F.col("id") % 7 > 3).cast("int").alias("label"), F.lit(1).alias("candidate_rank"))
    model = learning.train(rows, ["x", "y"], trees=3, depth=4, row_share=0.7, column_share=0.5, min_rows=3, min_gain=0.001)
    trees = model.folds[0][0]
    assert trees.getNumTrees == 3 and trees.getOrDefault("maxDepth") == 4 and trees.getOrDefault("minInstancesPerNode") == 3
    assert trees.getOrDefault("featureSubsetStrategy") == "0.5" and trees.getOrDefault("subsamplingRate") == 0.7
