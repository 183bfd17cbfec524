"""Close pairs are made bucket by bucket: against brute force, with buckets in parts, and without shuffles of pairs."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from kinweave.functions.text import char3gram_codes
from kinweave.operators import blocking as B
from kinweave.operators import decision, learning
from kinweave.plans import catalog

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, path, ids):
    rnd = random.Random(11)
    words = ["amber", "brick", "cedar", "delta"]
    rows = [(i, " ".join(rnd.choices(words, k=3) + ["common", "a", "bc"] + rnd.choices(words, k=8)), rnd.choice(["en", "fr"]), "web", 100 + i % 5) for i in ids]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def brute(rows, cap):
    def key(r):
        long = [t for t in r.name_norm.split() if len(t) >= 3]
        return (r.country_norm, *long[:2]) if len(long) >= 2 else None

    right = {}
    for r in rows:
        if r.target_source != "S1" and key(r):
            right.setdefault(key(r), []).append(r.entity_id)
    return {(r.entity_id, t) for r in rows if r.target_source == "S1" for t in right.get(key(r), []) if len(right[key(r)]) <= cap}


@pytest.mark.parametrize("part_pairs, cap", [(1 << 20, 5000), (7, 5000), (7, 9)])
@pytest.mark.parametrize("ids", [range(200), [*range(100), *range(100)]])
def test_close_pairs_equal_brute_force(spark, tmp_path, monkeypatch, part_pairs, cap, ids):
    """Ids that repeat too, whose pairs count once."""
    monkeypatch.setattr(B, "PART_PAIRS", part_pairs)
    monkeypatch.setattr(catalog, "CONFIG", catalog.BlockingConfig(bucket_cap=cap))
    d = catalog.Data(spark, documents(spark, tmp_path, ids), True)
    wanted = brute(d.all.collect(), cap)
    got = [tuple(r) for r in d.close().collect()]
    assert wanted and len(got) == len(wanted) and set(got) == wanted


def exchanges(frame):
    """What the plan moves after records of both sides have met."""
    with contextlib.redirect_stdout(out := io.StringIO()):
        frame.explain()
    depth = [(len(x) - len(x.lstrip(" :+-")), x) for x in out.getvalue().splitlines()]
    met = min(n for n, x in depth if re.search(r"(SortMerge|BroadcastHash|ShuffledHash)Join .*part", x))
    return [x for n, x in depth if n < met and "Exchange" in x]


def test_pairs_with_texts_and_ranks_are_not_shuffled(spark, tmp_path):
    d = catalog.Data(spark, documents(spark, tmp_path, range(60)), True)
    assert not exchanges(d.close()) and not exchanges(d.close_texts()) and not exchanges(d.scored(0.4)[0]) and not exchanges(d.scored(0.2, True)[0])


def test_what_a_query_stages_is_smaller_than_its_records(spark, tmp_path):
    d = catalog.Data(spark, documents(spark, tmp_path, range(60)), True)
    assert "business_name" not in d.all.columns and {"name_norm", "combined_norm"} <= set(d.all.columns)
    plain = catalog.Data(spark, str(tmp_path)).all
    assert not plain.select("entity_id", "combined_norm").exceptAll(d.all.select("entity_id", "combined_norm")).count()


def test_a_least_score_drops_only_pairs_below_it(spark, tmp_path):
    d = catalog.Data(spark, documents(spark, tmp_path, range(200)), True)
    columns = [*catalog.PAIR, "probability", "prob_rank"]
    whole = {tuple(r) for r in d.scored()[0].select(columns).collect()}
    for least in (0.4, 0.6, 0.75):
        assert {tuple(r) for r in d.scored(least)[0].select(columns).collect()} == {r for r in whole if r[2] >= least}


def test_owners_within_parts_equal_owners_of_all(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "PART_PAIRS", 7)
    d = catalog.Data(spark, documents(spark, tmp_path, range(150)), True)
    rows, within = d.scored(0.4)
    assert {tuple(r) for r in decision.owners(rows, within).collect()} == {tuple(r) for r in decision.exclusive(rows).select(*catalog.PAIR, "probability").collect()}


@pytest.mark.parametrize("positives, negatives, ratio", [(0, 50, 6), (3, 50, 2), (3, 50, 100), (5, 0, 2), (0, 0, 2)])
def test_negatives_are_the_first_by_hash(spark, positives, negatives, ratio):
    rows = [(f"S1-{i}", f"S2-{i}", int(i < positives)) for i in range(positives + negatives)]
    pairs = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, label int")
    order = F.md5(F.concat(F.lit("42:"), F.concat_ws(":", *catalog.PAIR)).cast("binary"))
    first = [tuple(r)[:3] for r in pairs.where("label = 0").orderBy(order).limit(max(1, positives) * ratio).collect()]
    got = learning.downsample_negatives(pairs, ratio)
    assert sorted(map(tuple, got.collect())) == sorted([*rows[:positives], *first]) and got.columns == pairs.columns


def test_code_points_of_a_text_are_made_once(spark):
    """Time per character stays about the same; made anew for every gram, it grew with the length (a minute for this)."""
    text = "".join(chr(97 + i % 23) + chr(97 + i % 19) for i in range(6000))
    frame = spark.createDataFrame([(text,), ("ab",), ("",), ("añ😀b",)], "t string").select("t", F.size(char3gram_codes(F.col("t"))).alias("n"))
    import time

    began = time.time()
    assert {r.t: r.n for r in frame.collect()} == {text: len({text[i : i + 3] for i in range(len(text) - 2)}), "ab": 1, "": 0, "añ😀b": 2}
    assert time.time() - began < 20


def test_keys_are_not_moved_where_frequent_tokens_are_few(spark, tmp_path):
    left, right = catalog.Data(spark, documents(spark, tmp_path, range(60)), True).capped()
    for side in (left, right):
        with contextlib.redirect_stdout(out := io.StringIO()):
            side.explain()
        assert not re.search(r"Exchange (hash|range|RoundRobin)", out.getvalue()) and "BroadcastHashJoin" in out.getvalue()
