import zipfile

import pytest
from pyspark.sql import functions as F

from kinweave.operators import decision, learning, quality
from kinweave.plans import cli, control, pipeline
from kinweave.schema import DecisionRule
from kinweave.sources import sinks, tables
from tests.test_pipeline import world


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("records")
    s1, targets, truth = world(spark, 30)
    for part in ("train", "test"):
        for i, rows in ((1, s1), (2, targets.where("entity_id like 'S2%'")), (3, targets.where("entity_id like 'S3%'"))):
            (out / f"{part}_source{i}.tsv").write_text("\n".join("\t".join(r) for r in [tuple(s1.columns), *map(tuple, rows.collect())]) + "\n")
    lists = truth.groupBy("source1_entity_id").agg(F.concat_ws(",", F.collect_list("candidate_entity_id"))).collect()
    (out / "train_ground_truth.tsv").write_text("\n".join("\t".join(r) for r in [("source1_entity_id", "matched_entity_ids"), *map(tuple, lists)]) + "\n")
    return out


def test_commands(spark, folder, tmp_path):
    out = str(tmp_path / "o")
    base = ["--data", str(folder), "--out", out]
    cli.main(["empty", *base])
    cli.main(["validate", *base, "--check-ids"])
    cli.main(["rules", *base])
    with pytest.raises(FileExistsError):
        open(tmp_path / "o/.lock", "x").close()
        open(tmp_path / "o/.lock", "x")
    cli.main(["fuzzy", *base])
    got = tables.read_tsv(spark, f"{out}/matching_results", ["source1_entity_id", "matched_entity_ids"])
    assert got.count() == 30 and got.where("matched_entity_ids <> ''").count() > 0
    cli.main(["measure", *base])
    cli.main(["audit", *base])
    assert (tmp_path / "o/recall.json").exists() and (tmp_path / "o/non_latin.json").exists()


def test_train_infer_resume_validate_package(spark, folder, tmp_path, monkeypatch):
    """A run that is ended in the second country goes on with it; its outputs pass the validator and are packed."""
    two = tmp_path / "data"
    two.mkdir()
    for part in ("train", "test"):
        for i in (1, 2, 3):
            lines = (folder / f"{part}_source{i}.tsv").read_text().splitlines()
            (two / f"{part}_source{i}.tsv").write_text("\n".join([lines[0], *lines[1:], *(x.replace("-", "-9", 1).replace("\tin", "\tfr") for x in lines[1:] if part == "test")]) + "\n")
    (two / "train_ground_truth.tsv").write_text((folder / "train_ground_truth.tsv").read_text())
    model, out = str(tmp_path / "m"), tmp_path / "o"
    cli.main(["train", "--data", str(two), "--out", model, "--modulo", "1", "--trees", "3", "--depth", "3", "--min-rows", "2"])
    args = ["infer", "--data", str(two), "--out", str(out), "--model", model]
    keep, seen = pipeline.infer_normalized, []

    def ends(left, *more):
        seen.append({r.country_norm for r in left.select("country_norm").distinct().collect()})
        if len(seen) == 2:
            raise KeyboardInterrupt
        return keep(left, *more)

    monkeypatch.setattr(pipeline, "infer_normalized", ends)
    with pytest.raises(KeyboardInterrupt):
        cli.main(args)
    assert seen == [{"fr"}, {"in"}] and not (out / "matching_results").exists() and not (out / ".lock").exists()
    written = {p: p.stat().st_mtime_ns for p in (out / "countries").rglob("*.parquet")}
    cli.main(args)
    assert seen[2:] == [{"in"}] and all(p.stat().st_mtime_ns == t for p, t in written.items())
    cli.main(["validate", "--data", str(two), "--out", str(out), "--check-ids"])
    order = [x.split("\t")[0] for x in (two / "test_source1.tsv").read_text().splitlines()[1:]]
    for name, column in cli.OUTPUTS.items():
        lines = sinks.whole(str(out / name)).decode().splitlines()
        assert lines[0] == f"source1_entity_id\t{column}" and [x.split("\t")[0] for x in lines[1:]] == order
        assert sum(x.split("\t")[1] != "" for x in lines[1:]) > 20
    cli.main(["package", "--data", str(two), "--out", str(out)])
    with zipfile.ZipFile(out / "submission.zip") as z:
        assert sorted(z.namelist()) == ["output/candidate_pairs.tsv", "output/matching_results.tsv"]
        assert z.read("output/matching_results.tsv") == sinks.whole(str(out / "matching_results"))


def test_rules_write_both_files_that_validate(folder, tmp_path):
    base = ["--data", str(folder), "--out", str(tmp_path / "o")]
    for command in ("rules", "fuzzy", "empty"):
        cli.main([command, *base])
        cli.main(["validate", *base, "--check-ids"])


def test_cache_and_experiment(folder, tmp_path, monkeypatch):
    rule = DecisionRule(threshold=0.5, cap=None, bipartite=False)
    monkeypatch.setattr(learning, "choose_rule", lambda ranked, truth, roster, config=None: (rule, decision.evaluate(ranked, truth, roster, rule)))
    base = ["--data", str(folder), "--out", str(tmp_path / "o"), "--modulo", "1", "--trees", "2", "--depth", "2", "--min-rows", "2", "--limit-s1", "25"]
    keep, made = learning.train, []
    monkeypatch.setattr(learning, "train", lambda *x, **y: made[0] if made else made.append(keep(*x, **y)) or made[0])
    cli.main(["cache", *base])
    cli.main(["experiment", *base])
    got = sinks.read_json(str(tmp_path / "o/experiment.json"))
    assert set(got) == {"calibration", "transfer", "best"} and 0 <= got["best"]["tune_macro_f05"] <= 1


def test_a_missing_target_file_is_skipped_with_a_warning(folder, tmp_path, capsys):
    for i in (1, 2):
        (tmp_path / f"test_source{i}.tsv").write_text((folder / f"test_source{i}.tsv").read_text())
    base = ["--data", str(tmp_path), "--out", str(tmp_path / "o")]
    cli.main(["rules", *base])
    cli.main(["validate", *base, "--check-ids"])
    assert capsys.readouterr().out.count("warning:") == 2


@pytest.mark.parametrize("text, said", [("", "empty"), ("source1_entity_id,matched_entity_ids\n", "separated by commas"), ("a\tb\n", "header is"), ("source1_entity_id\tmatched_entity_ids\nS1-0 without\n", "1 rows have no tab: 'S1-0 without'"), ("source1_entity_id\tmatched_entity_ids\nS1-77\tS2-1,S1-4,Q-1\n", "ids are of S1: S1-4")])
def test_what_the_validator_says(folder, tmp_path, capsys, text, said):
    cli.main(["empty", "--data", str(folder), "--out", str(tmp_path)])
    where = tmp_path / "matching_results"
    for p in [*where.glob("part-*"), *where.glob(".part-*")]:
        p.unlink()
    (where / "part-0.csv").write_text(text)
    with pytest.raises(SystemExit):
        cli.main(["validate", "--data", str(folder), "--out", str(tmp_path), "--check-ids"])
    assert said in capsys.readouterr().out


def test_validation_fails(spark, folder, tmp_path, capsys):
    out = tmp_path / "o"
    for name, column in (("matching_results", "matched_entity_ids"), ("candidate_pairs", "candidate_entity_ids")):
        (out / name).mkdir(parents=True)
        (out / name / "part-0.csv").write_text(f"source1_entity_id\t{column}\nS1-0\tS2-1,S2-1\n")
    with pytest.raises(SystemExit):
        cli.main(["validate", "--data", str(folder), "--out", str(out)])
    said = capsys.readouterr().out
    assert "rows repeat an id" in said and "have no row" in said


def test_lock(tmp_path):
    with control.exclusive(str(tmp_path)):
        with pytest.raises(RuntimeError):
            with control.exclusive(str(tmp_path)):
                pass
    (tmp_path / ".lock").write_text("999999999")
    with control.exclusive(str(tmp_path)):
        pass
    assert not (tmp_path / ".lock").exists()


def test_logger(tmp_path):
    control.logger(str(tmp_path / "l.txt"), "kinweave-test").info("said")
    assert "said" in (tmp_path / "l.txt").read_text()


def test_countries_left(spark, tmp_path):
    rows = spark.createDataFrame([("a", "in"), ("b", "fr")], "id string, country_norm string")
    assert control.countries_left(spark, rows, str(tmp_path / "x")).count() == 2
    rows.where("country_norm = 'in'").write.partitionBy("country_norm").parquet(str(tmp_path / "x"))
    assert [r.id for r in control.countries_left(spark, rows, str(tmp_path / "x")).collect()] == ["b"]


def test_gate_and_sample(spark):
    s1 = spark.createDataFrame([("S1-1", "IN"), ("S1-2", "FR")], "entity_id string, country string")
    good = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "")], "source1_entity_id string, ids string")
    quality.country_gate(good, good, s1, "IN")
    with pytest.raises(ValueError):
        quality.country_gate(good, good.where("ids = ''"), s1, "IN")
    assert quality.country_sample(s1, "IN", 5).count() == 1
