"""From scored pairs to links: thresholds, caps, one owner per target, and the search for the best rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.blocking import PAIR
from kinweave.operators.metrics import fbeta, macro_fbeta
from kinweave.schema import DecisionRule, TrainingConfig

#: What stands for no cap where caps are numbers.
NO_CAP = 2**31 - 1


def probability_rank(scored: DataFrame, within: list[str] | None = None) -> DataFrame:
    """prob_rank: by probability, then candidate_rank, then id. within: columns that are the same for all rows of an S1 record."""
    order = Window.partitionBy(*(within or []), PAIR[0]).orderBy(F.desc("probability"), "candidate_rank", PAIR[1])
    return scored.withColumn("prob_rank", F.row_number().over(order))


def threshold_of(rule: DecisionRule) -> Column:
    if not rule.by_source:
        return F.lit(rule.threshold)
    return F.when(F.col(PAIR[1]).startswith("S2-"), rule.threshold_s2).otherwise(F.lit(rule.threshold_s3))


def predict(ranked: DataFrame, rule: DecisionRule) -> DataFrame:
    """The pairs that pass the threshold and the cap (no exclusivity)."""
    kept = ranked.where(F.col("probability") >= threshold_of(rule))
    return kept if rule.cap is None else kept.where(F.col("prob_rank") <= rule.cap)


def exclusive(pairs: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Each target stays with the S1 record of the highest probability; ties go to the smaller id. scope: within batches."""
    order = Window.partitionBy(PAIR[1], *(scope or [])).orderBy(F.desc(F.coalesce("probability", F.lit(0.0))), PAIR[0])
    return pairs.withColumn("_owner", F.row_number().over(order)).where("_owner = 1").drop("_owner")


def owners(pairs: DataFrame, within: list[str]) -> DataFrame:
    """exclusive() for pairs with probability that lie by within: at most one row of a target leaves a task, then they are compared."""
    first = Window.partitionBy(*within, PAIR[1]).orderBy(F.desc(F.coalesce("probability", F.lit(0.0))), PAIR[0])
    return exclusive(pairs.withColumn("_first", F.row_number().over(first)).where("_first = 1").select(*PAIR, "probability"))


def decide(ranked: DataFrame, rule: DecisionRule, scope: list[str] | None = None) -> DataFrame:
    kept = predict(ranked, rule)
    return exclusive(kept, scope) if rule.bipartite else kept


def link_lists(roster: DataFrame, links: DataFrame) -> DataFrame:
    """source1_entity_id and its ids by prob_rank for the whole roster; an empty list for none."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("prob_rank", PAIR[1]))), lambda x: x[PAIR[1]])
    lists = links.groupBy(PAIR[0]).agg(ordered.alias("ids"))
    return roster.select(PAIR[0]).distinct().join(lists, PAIR[0], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def _grid(values: list[tuple], schema: str, like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(values, schema)


def rule_grid(ranked: DataFrame, truth: DataFrame, roster: DataFrame, thresholds: tuple[float, ...] = TrainingConfig.thresholds, caps: tuple[int | None, ...] = TrainingConfig.caps, within: list[str] | None = None) -> DataFrame:
    """grid, threshold, cap and macro_f05 of every (threshold, cap) in one pass.

    Pairs that bring columns hit (1 for a true pair) and n_true (of their S1 record) aren't joined to the truth. within: as in probability_rank().

    Under one threshold and cap a record's links are the first ones by prob_rank. So pairs are reduced, per record,
    to the number and hits of each rank and threshold step; the caps then only decide how far the running sums go.
    """
    steps = sorted(thresholds)
    step = F.lit(0)
    for i, t in enumerate(steps):
        step = F.when(F.col("probability") >= F.lit(t), i + 1).otherwise(step)
    own = [*(within or []), PAIR[0], *(["n_true"] if "n_true" in ranked.columns else [])]
    marked = ranked.withColumn("step", step).where("step > 0")
    if "hit" not in ranked.columns:
        marked = marked.join(truth.select(*PAIR).distinct().withColumn("hit", F.lit(1)), PAIR, "left")
    marked = marked.select(*own, "prob_rank", "step", F.coalesce("hit", F.lit(0)).alias("hit"))
    finite = [c for c in caps if c is not None]
    # a pair counts for thresholds up to its step and for caps from its rank on
    allowed = F.filter(F.array(*[F.lit(c).cast("int") for c in [*finite, NO_CAP]]), lambda c: c >= F.col("prob_rank"))
    wide = marked.withColumn("cap", F.explode(allowed)).groupBy(*own, "cap", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("h"))
    # sums from the highest step down hold for all thresholds to the next lower step that the record has
    down = Window.partitionBy(*own, "cap").orderBy(F.desc("step"))
    sums = wide.select(*own, "cap", "step", F.sum("n").over(down).alias("n_pred"), F.sum("h").over(down).alias("n_hit"), F.lead("step", 1, 0).over(down).alias("lower"))
    rated = (sums if "n_true" in own else sums.join(_base(truth, roster), PAIR[0])).select("cap", fbeta(F.col("n_pred"), F.col("n_true"), F.col("n_hit")).alias("f"), (F.col("n_true") == 0).alias("single"), F.explode(F.sequence(F.col("lower") + 1, F.col("step"))).alias("at"))
    return grid_means(rated.groupBy("cap", "at").agg(F.sum("f").alias("f"), F.count_if("single").alias("spoilt")), truth, roster, thresholds, caps)


def _base(truth: DataFrame, roster: DataFrame) -> DataFrame:
    """n_true of every S1 record."""
    true = truth.select(*PAIR).distinct().groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_true"))
    return roster.select(PAIR[0]).distinct().join(true, PAIR[0], "left").select(PAIR[0], F.coalesce("n_true", F.lit(0)).alias("n_true"))


def grid_means(scored: DataFrame, truth: DataFrame, roster: DataFrame, thresholds: tuple[float, ...], caps: tuple[int | None, ...]) -> DataFrame:
    """rule_grid() from sums over the records with links: f and spoilt (records where nothing is true) by cap (NO_CAP for
    none) and at, the number of the threshold in order from 1 on."""
    steps = sorted(thresholds)
    entities, single = _base(truth, roster).agg(F.count(F.lit(1)), F.count_if(F.col("n_true") == 0)).first()
    order = [(i, t, c, steps.index(t) + 1, NO_CAP if c is None else c) for i, (t, c) in enumerate((t, c) for t in thresholds for c in caps)]
    grid = _grid(order, "grid int, threshold double, max_links int, at int, cap int", scored)
    # records without links score 1 where nothing is true and 0 otherwise
    value = (F.coalesce("f", F.lit(0.0)) + single - F.coalesce("spoilt", F.lit(0))) / F.lit(float(max(1, entities)))
    return grid.join(scored, ["at", "cap"], "left").select("grid", "threshold", F.col("max_links").alias("cap"), value.alias("macro_f05"))


def tune(ranked: DataFrame, truth: DataFrame, roster: DataFrame, config: TrainingConfig = TrainingConfig()) -> tuple[DecisionRule, float]:
    """The best global rule; the first grid point wins ties."""
    best = rule_grid(ranked, truth, roster, config.thresholds, config.caps).orderBy(F.desc("macro_f05"), "grid").first()
    return DecisionRule(threshold=best.threshold, cap=best.cap, bipartite=False), best.macro_f05


def evaluate(ranked: DataFrame, truth: DataFrame, roster: DataFrame, rule: DecisionRule) -> float:
    return macro_fbeta(roster, decide(ranked, rule), truth).first().macro_fbeta


def source_grid(ranked: DataFrame, truth: DataFrame, roster: DataFrame, fixed: DecisionRule, side: str, thresholds: tuple[float, ...]) -> list[float]:
    """macro F0.5 for each threshold of one source, the other one held, in one job."""
    points = []
    for i, t in enumerate(thresholds):
        two, three = (t, fixed.threshold_s3) if side == "s2" else (fixed.threshold_s2, t)
        least = F.when(F.col(PAIR[1]).startswith("S2-"), F.lit(float(two))).otherwise(F.lit(float(three)))
        points.append(F.when(F.col("probability") >= least, F.lit(i)))
    passed = ranked.withColumn("grid", F.explode(F.array_compact(F.array(*points))))
    if fixed.cap is not None:
        passed = passed.where(F.col("prob_rank") <= fixed.cap)
    links = exclusive(passed, ["grid"]) if fixed.bipartite else passed
    hits = truth.select(*PAIR).distinct().withColumn("hit", F.lit(1))
    counts = links.join(hits, PAIR, "left").groupBy("grid", PAIR[0]).agg(F.count(F.lit(1)).alias("n_pred"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hit"))
    true = truth.select(*PAIR).distinct().groupBy(PAIR[0]).agg(F.count(F.lit(1)).alias("n_true"))
    base = roster.select(PAIR[0]).distinct().join(true, PAIR[0], "left").select(PAIR[0], F.coalesce("n_true", F.lit(0)).alias("n_true"))
    got = counts.join(base, PAIR[0]).groupBy("grid").agg(F.sum(fbeta(F.col("n_pred"), F.col("n_true"), F.col("n_hit"))).alias("f"), F.count_if(F.col("n_true") == 0).alias("spoilt")).collect()
    entities, single = base.agg(F.count(F.lit(1)), F.count_if(F.col("n_true") == 0)).first()
    found = {r.grid: r for r in got}
    return [((found[i].f + single - found[i].spoilt) if i in found else single) / entities if entities else 0.0 for i in range(len(thresholds))]


def tune_by_source(ranked: DataFrame, truth: DataFrame, roster: DataFrame, cap: int | None, bipartite: bool = True, thresholds: tuple[float, ...] = TrainingConfig.thresholds) -> tuple[DecisionRule, float]:
    """Coordinate descent from (0.5, 0.5): S2's threshold, then S3's; the first best wins."""
    rule = DecisionRule(None, 0.5, 0.5, cap, bipartite)
    best = evaluate(ranked, truth, roster, rule)
    for side in ("s2", "s3"):
        values = source_grid(ranked, truth, roster, rule, side, thresholds)
        at = max(range(len(values)), key=lambda i: (values[i], -i))
        if values[at] > best:
            best = values[at]
            rule = DecisionRule(None, thresholds[at] if side == "s2" else rule.threshold_s2, thresholds[at] if side == "s3" else rule.threshold_s3, cap, bipartite)
    return rule, best


def choose_rule(ranked: DataFrame, truth: DataFrame, roster: DataFrame, config: TrainingConfig = TrainingConfig()) -> tuple[DecisionRule, float]:
    """The best of global, global with exclusivity, and by source with exclusivity; the first wins ties."""
    plain, value = tune(ranked, truth, roster, config)
    owned = DecisionRule(threshold=plain.threshold, cap=plain.cap, bipartite=True)
    options = [(plain, value), (owned, evaluate(ranked, truth, roster, owned)), tune_by_source(ranked, truth, roster, plain.cap, True, config.thresholds)]
    return max(enumerate(options), key=lambda x: (x[1][1], -x[0]))[1]


def accept_exclusivity(ranked: DataFrame, truth: DataFrame, roster: DataFrame, thresholds: tuple[float, ...], caps: tuple[int | None, ...]) -> tuple[DecisionRule, float]:
    """The best global rule, made exclusive only if that scores higher."""
    rule, value = tune(ranked, truth, roster, TrainingConfig(thresholds=thresholds, caps=caps))
    owned = DecisionRule(threshold=rule.threshold, cap=rule.cap, bipartite=True)
    other = evaluate(ranked, truth, roster, owned)
    return (owned, other) if other > value else (rule, value)
