"""Command line: python -m kinweave.plans.cli COMMAND ... over tab-separated record files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.text import normalize
from kinweave.operators import learning, quality, rules
from kinweave.operators.blocking import PAIR
from kinweave.operators.features import feature_names
from kinweave.operators.learning import MatchModel
from kinweave.plans import control, pipeline
from kinweave.schema import BlockingConfig, DecisionRule
from kinweave.sources import sinks, tables
from kinweave.sources.staging import Stash

FOLDS = 3
OUTPUTS = {"matching_results": "matched_entity_ids", "candidate_pairs": "candidate_entity_ids"}


def _targets(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """S2 and S3; a file that isn't there is skipped with a warning."""
    found = []
    for i in (2, 3):
        path = f"{folder}/{part}_source{i}.tsv"
        if tables.exists(spark, path):
            found.append(tables.read_records(spark, path, f"S{i}"))
        else:
            print(f"warning: {path} isn't there; its targets are left out")
    return found[0].unionByName(found[1]) if len(found) == 2 else found[0] if found else _s1(spark, folder, part).limit(0).withColumn("target_source", F.lit("S2"))


def _s1(spark: SparkSession, folder: str, part: str) -> DataFrame:
    return tables.read_records(spark, f"{folder}/{part}_source1.tsv")


def _blocking(a: argparse.Namespace) -> BlockingConfig:
    return BlockingConfig(top_k=a.top_k, budget=a.budget)


def _booster(a: argparse.Namespace) -> dict:
    return {"trees": a.trees, "depth": a.depth, "rate": a.rate, "row_share": a.row_share, "column_share": a.column_share, "min_rows": a.min_rows, "min_gain": a.min_gain}


def _training_data(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S1, the target pool and the true links of a training folder."""
    folder = tables.assert_train_only_path(a.data)
    truth = tables.truth_pairs(tables.read_truth(spark, f"{folder}/train_ground_truth.tsv"))
    positives = truth.select(F.col(PAIR[1]).alias("entity_id"))
    pool = tables.target_pool(_targets(spark, folder, "train"), positives, a.modulo)
    tables.require_positives(pool, positives)
    s1 = _s1(spark, folder, "train")
    return (tables.first_rows(s1, a.limit_s1) if a.limit_s1 else s1), pool, truth


def _write_lists(spark: SparkSession, a: argparse.Namespace, links: DataFrame, candidates: DataFrame) -> None:
    """Both id-list files, in the order of the S1 file."""
    records = _s1(spark, a.data, "test")
    for (name, column), lists in zip(OUTPUTS.items(), (links, candidates), strict=True):
        sinks.write_id_list(sinks.in_file_order(lists.withColumnRenamed("ids", column), records), f"{a.out}/{name}")


def _country_lists(spark: SparkSession, path: str, country: str | None = None) -> list[DataFrame]:
    """Links and candidates as id lists, of one country or of all that are written."""
    rows = spark.read.parquet(path).withColumn("country_norm", F.coalesce(F.col("country_norm").cast("string"), F.lit("")))
    rows = rows if country is None else rows.where(F.col("country_norm") == country)
    return [rows.select(PAIR[0], F.concat_ws(",", c).alias("ids")) for c in ("ids", "candidate_ids")]


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    got = pipeline.train(*_training_data(spark, a), _blocking(a), **_booster(a))
    got.model.save(f"{a.out}/model")
    sinks.write_json({"rule": got.rule.to_json(), "metrics": got.metrics, "booster": _booster(a)}, f"{a.out}/trained.json")


def infer(spark: SparkSession, a: argparse.Namespace) -> None:
    """Country by country: each is written whole under countries/, and a run that was ended goes on with those that aren't there."""
    rule = DecisionRule.from_json(sinks.read_json(f"{a.model}/trained.json")["rule"], a.threshold, a.cap)
    trained = pipeline.Trained(MatchModel.load(f"{a.model}/model", feature_names(), FOLDS), rule, {})
    done = f"{a.out}/countries"
    with control.exclusive(a.out):
        log = control.logger(f"{a.out}/log.txt")
        left, right = pipeline.staged(_s1(spark, a.data, "test"), _targets(spark, a.data, "test"))
        todo = sorted(r.country_norm for r in control.countries_left(spark, left, done).select("country_norm").distinct().collect())
        for country in todo:
            own = left.where(F.col("country_norm") == country)
            own = tables.first_rows(own, a.limit_s1) if a.limit_s1 else own
            lists = pipeline.infer_normalized(own, right.where(F.col("country_norm") == country), trained, _blocking(a))
            sinks.write_cache(lists.withColumn("country_norm", F.lit(country)), done)
            quality.country_gate(*_country_lists(spark, done, country), own.withColumn("country", F.lit(country)), country)
            log.info("%s is written", country or "(no country)")
        _write_lists(spark, a, *_country_lists(spark, done))


def _matcher(links):
    """A matcher without a model: its links are its candidates."""

    def run(spark: SparkSession, a: argparse.Namespace) -> None:
        s1 = normalize(_s1(spark, a.data, "test"))
        roster = s1.select(F.col("entity_id").alias(PAIR[0]))
        with control.exclusive(a.out):
            lists = Stash(spark)(sinks.id_list(roster, links(s1, normalize(_targets(spark, a.data, "test"))), "ids"))
            _write_lists(spark, a, lists, lists)

    return run


def empty(spark: SparkSession, a: argparse.Namespace) -> None:
    roster = _s1(spark, a.data, "test").select(F.col("entity_id").alias(PAIR[0])).distinct()
    lists = sinks.empty_lists(roster, "ids")
    _write_lists(spark, a, lists, lists)


def measure(spark: SparkSession, a: argparse.Namespace) -> None:
    truth = tables.truth_pairs(tables.read_truth(spark, f"{a.data}/train_ground_truth.tsv"))
    sinks.write_json(pipeline.measure_recall(_s1(spark, a.data, "train"), _targets(spark, a.data, "train"), truth, _blocking(a)), f"{a.out}/recall.json")


def cache(spark: SparkSession, a: argparse.Namespace) -> None:
    """Features and labels of all candidate pairs, by country, for experiments."""
    sinks.write_cache(pipeline.cached_features(*_training_data(spark, a), _blocking(a)), f"{a.out}/features")


def experiment(spark: SparkSession, a: argparse.Namespace) -> None:
    """Over cached features: what calibration gives, how models carry over between countries, which booster settings are best."""
    pairs = spark.read.parquet(f"{a.cache or a.out}/features")
    truth = tables.truth_pairs(tables.read_truth(spark, f"{a.data}/train_ground_truth.tsv"))
    roster = pairs.select(PAIR[0], "country_norm").distinct()
    links = truth.join(roster, PAIR[0], "left_semi")
    counts = roster.join(links.groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_matches")), PAIR[0], "left").select(PAIR[0], F.coalesce("n_matches", F.lit(0)).alias("n_matches"))
    split = learning.three_way_split(counts).select(PAIR[0], "split")
    fit, tune = (pairs.join(split.where(F.col("split") == s), PAIR[0], "left_semi") for s in ("fit", "tune"))
    own = split.where("split = 'tune'").select(PAIR[0])
    names, booster = feature_names(), _booster(a)
    settings = [booster | change for change in ({}, {"depth": booster["depth"] + 1}, {"trees": 2 * booster["trees"], "rate": booster["rate"] / 2})]
    setting, rule, value = learning.parameter_search(fit, tune, names, links.join(own, PAIR[0], "left_semi"), own, settings)
    by_country = {}
    for r in sorted(roster.select("country_norm").distinct().collect()):
        mine = roster.where(F.col("country_norm") == r.country_norm).select(PAIR[0])
        by_country[r.country_norm] = (pairs.where(F.col("country_norm") == r.country_norm), links.join(mine, PAIR[0], "left_semi"), mine)
    found = {
        "calibration": learning.calibration_experiment(pairs, names, links, roster.select(PAIR[0])),
        "transfer": {f"{x} -> {y}": v for (x, y), v in learning.transfer_experiment(by_country, names).items()},
        "best": {"setting": setting, "rule": rule.to_json(), "tune_macro_f05": value},
    }
    sinks.write_json(found, f"{a.out}/experiment.json")


def package(spark: SparkSession, a: argparse.Namespace) -> None:
    """Both outputs in a ZIP, each as one file."""
    sinks.package({f"output/{name}.tsv": f"{a.out}/{name}" for name in OUTPUTS}, f"{a.out}/submission.zip")


def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    s1, targets = _s1(spark, a.data, a.part), _targets(spark, a.data, a.part).drop("target_source")
    rows = quality.non_latin_audit(s1.unionByName(targets)).collect()
    sinks.write_json({r.country: r.asDict() for r in rows}, f"{a.out}/non_latin.json")
    if a.part == "train":
        truth = tables.truth_pairs(tables.read_truth(spark, f"{a.data}/train_ground_truth.tsv"))
        crossing = quality.cross_country_links(truth, s1, targets)
        sinks.write_json({"cross_country": crossing.count(), "examples": quality.cross_country_examples(crossing), "several_owners": quality.multi_owner_targets(truth).count()}, f"{a.out}/truth.json")


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    roster = _s1(spark, a.data, "test").select(F.col("entity_id").alias(PAIR[0]))
    known = None
    if a.check_ids and all(tables.exists(spark, f"{a.data}/test_source{i}.tsv") for i in (2, 3)):
        known = _targets(spark, a.data, "test").select("entity_id")
    elif a.check_ids:
        print("warning: a target file isn't there; ids aren't checked against the targets")
    errors, warnings, lists = [], [], []
    for name, column in OUTPUTS.items():
        path = f"{a.out}/{name}"
        wrong, readable = quality.file_errors(spark.read.text(path), [PAIR[0], column]) if tables.exists(spark, path) else ([f"{path} isn't there"], False)
        errors += [f"{name}: {x}" for x in wrong]
        if readable:
            rows = spark.read.options(sep="\t", header=True, quote="", escape="", nullValue="\u0000", emptyValue="").schema(f"{PAIR[0]} string, ids string").csv(path)
            lists.append(rows.fillna(""))
    if len(lists) == 2:
        more, warnings = quality.validate_outputs(*lists, roster, known)
        errors += more
    for x in warnings:
        print(f"warning: {x}")
    for x in errors:
        print(f"error: {x}")
    if errors:
        sys.exit(1)


COMMANDS = {"train": train, "infer": infer, "rules": _matcher(rules.rule_links), "fuzzy": _matcher(rules.fuzzy_links), "empty": empty, "measure": measure, "cache": cache, "experiment": experiment, "package": package, "audit": audit, "validate": validate}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="kinweave", description=__doc__)
    out.add_argument("command", choices=COMMANDS)
    out.add_argument("--data", required=True, help="folder of the record files")
    out.add_argument("--out", required=True, help="folder for what is written")
    out.add_argument("--model", help="folder of a trained model")
    out.add_argument("--cache", help="folder of cached features (default: --out)")
    out.add_argument("--part", default="train", choices=["train", "test"])
    out.add_argument("--modulo", type=int, default=300, help="share of targets without a match in training")
    out.add_argument("--top-k", type=int, default=BlockingConfig.top_k)
    out.add_argument("--budget", type=int, default=BlockingConfig.budget, help="candidates of a record before scoring")
    out.add_argument("--limit-s1", type=int, default=0, help="for debugging: S1 records (of each country, in infer)")
    out.add_argument("--threshold", type=float)
    out.add_argument("--cap", type=int)
    out.add_argument("--check-ids", action="store_true")
    for name, kind, value in (("trees", int, 20), ("depth", int, 5), ("rate", float, 0.2), ("row-share", float, 0.85), ("column-share", float, 0.85), ("min-rows", int, 50), ("min-gain", float, 0.0)):
        out.add_argument(f"--{name}", type=kind, default=value, help="of the booster")
    return out


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    COMMANDS[a.command](SparkSession.builder.appName(f"kinweave-{a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
