import pytest
from pyspark.sql import functions as F

from kinweave.operators import quality as Q
from kinweave.operators import rules
from kinweave.sources import sinks, staging, tables

S1, C = "source1_entity_id", "candidate_entity_id"


def test_scan_keeps_na_and_empty(spark, tmp_path):
    (tmp_path / "s2.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\tNA\t\tIN\nS2-2\ta, b "c\tx\tFR\n')
    got = [tuple(r) for r in tables.read_records(spark, str(tmp_path / "s2.tsv")).orderBy("entity_id").collect()]
    assert got == [("S2-1", "NA", "", "IN"), ("S2-2", 'a, b "c', "x", "FR")]
    assert tables.read_records(spark, str(tmp_path / "s2.tsv"), "S2").columns[-1] == "target_source"


def test_truth_and_round_trip(spark, tmp_path):
    (tmp_path / "t.tsv").write_text(f"{S1}\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    truth = tables.read_truth(spark, str(tmp_path / "t.tsv"))
    assert [r.n_matches for r in truth.orderBy(S1).collect()] == [2, 0]
    lists = sinks.id_list(truth, tables.truth_pairs(truth))
    sinks.write_id_list(lists.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert set(text.splitlines()) == {f"{S1}\tmatched_entity_ids", "S1-1\tS2-1,S3-2", "S1-2\t"}


def test_guards():
    with pytest.raises(ValueError):
        tables.assert_train_only_path("/data/TEST/x.tsv")
    assert tables.assert_train_only_path("/data/train/x.tsv") == "/data/train/x.tsv"
    assert tables.target_source_of("train_source2.tsv") == "S2"
    with pytest.raises(ValueError):
        tables.target_source_of("source1.tsv")


def test_modulo(spark):
    rows = spark.createDataFrame([("S2-14",), ("S2-15",), ("S2-x",), ("plain",)], "entity_id string")
    keep = lambda m: {r[0] for r in rows.where(tables.id_suffix_is_multiple(F.col("entity_id"), m)).collect()}
    assert keep(7) == {"S2-14"} and keep(1) == {"S2-14", "S2-15", "S2-x", "plain"}


def test_target_pool(spark):
    rows = spark.createDataFrame([("S2-1", "a", "S2"), ("S2-1", "b", "S2"), ("S2-7", "c", "S2"), ("S3-8", "d", "S3")], "entity_id string, business_name string, target_source string")
    wanted = spark.createDataFrame([("S3-8",), ("S3-9",)], "entity_id string")
    pool = tables.target_pool(rows, wanted, 7)
    assert {(r.entity_id, r.business_name) for r in pool.collect()} == {("S2-7", "c"), ("S3-8", "d")}
    assert [r.entity_id for r in tables.missing_positives(pool, wanted).collect()] == ["S3-9"]


def test_list_audit(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1,S1-9"), ("S1-1", ""), ("S1-5", "X-1,S2-7")], f"{S1} string, ids string")
    roster = spark.createDataFrame([("S1-1",), ("S1-2",)], f"{S1} string")
    known = spark.createDataFrame([("S2-1",)], "entity_id string")
    assert Q.list_audit(lists, roster, known).first().asDict() == {"n_rows": 3, "rows_with_repeats": 1, "s1_ids": 1, "other_ids": 1, "repeated_rows": 1, "missing_rows": 1, "surplus_rows": 1, "unknown_ids": 3}
    assert Q.header_errors(f"{S1},matched_entity_ids", [S1, "matched_entity_ids"]) == ["the file is separated by commas, not tabs"]
    assert Q.header_errors("a\tb", ["a", "b"]) == [] and len(Q.header_errors("a", ["a", "b"])) == 1


NORM = "entity_id string, country_norm string, name_norm string, address_norm string, address_numbers string"


def test_rule_links(spark):
    s1 = spark.createDataFrame([("S1-1", "in", "moon", "1 main road", "123"), ("S1-2", "in", "twin", "x", ""), ("S1-3", "in", "twin", "x", ""), ("S1-4", "in", "", "y", "")], NORM)
    targets = spark.createDataFrame([("S2-1", "in", "moon", "1 main road", "123"), ("S2-2", "in", "moon", "main road 9", "123"), ("S2-3", "in", "moon", "far away", "123"), ("S2-4", "in", "twin", "x", ""), ("S2-5", "in", "", "y", "")], NORM)
    assert {tuple(r) for r in rules.rule_links(s1, targets).collect()} == {("S1-1", "S2-1"), ("S1-1", "S2-2")}
    assert {tuple(r) for r in rules.rule_links(s1, targets, cap=1).collect()} == {("S1-1", "S2-1")}
    weights = {tuple(r)[:2]: r.weight for r in rules.weighted_evidence(s1, targets).collect()}
    assert weights["S1-1", "S2-1"] == 11 and weights["S1-1", "S2-3"] == 5 and weights["S1-2", "S2-4"] == 1


def test_cache_and_package(spark, tmp_path):
    sinks.write_cache(spark.createDataFrame([("a", "in"), ("b", "fr")], "id string, country_norm string"), str(tmp_path / "c"))
    sinks.write_cache(spark.createDataFrame([("c", "in")], "id string, country_norm string"), str(tmp_path / "c"))
    assert {r.id for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {"b", "c"}
    assert [r.id for r in tables.read_cache(spark, str(tmp_path / "c"), "in").collect()] == ["c"]
    sinks.write_json({"a": 1}, str(tmp_path / "x/m.json"))
    assert sinks.read_json(str(tmp_path / "x/m.json")) == {"a": 1}
    sinks.package({"in/m.json": str(tmp_path / "x/m.json")}, str(tmp_path / "p.zip"))
    assert (tmp_path / "p.zip").stat().st_size > 0


def test_staged_tables(spark):
    stash = staging.Stash(spark)
    one, two = stash(spark.range(3)), stash(spark.range(5))
    stash.drop(one)
    assert two.count() == 5
    staging.clear(spark)
    with pytest.raises(Exception, match="(?i)path|exist|file"):
        spark.read.parquet(two.stash_path).count()
