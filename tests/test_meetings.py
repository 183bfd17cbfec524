import random
from collections import Counter

import numpy as np
import pytest

from kinweave.operators import meetings
from kinweave.plans import catalog

SET = "scope string, id string, keys array<long>"


def side(rnd, n, prefix, scopes):
    return [(rnd.choice(scopes), f"{prefix}{i:03}", rnd.sample(range(25), rnd.randrange(0, 9))) for i in range(n)]


@pytest.fixture(params=[(1 << 20, 1 << 17, 1 << 16), (7, 11, 1), (1 << 20, 5, 40)])
def limits(request, monkeypatch):
    for name, value in zip(("BLOCK", "PART", "STEPS"), request.param, strict=True):
        monkeypatch.setattr(meetings, name, value)
    return request.param


def test_sums_equal_brute_force(spark, limits):
    rnd = random.Random(limits[0])
    left = side(rnd, 50, "l", "abc")
    right = [(*row, [rnd.choice([1, 1, 4, 6]) for _ in row[2]]) for row in side(rnd, 70, "r", "abd")]
    wanted = Counter(w for s, _, a in left for t, _, b, of in right if s == t and (w := sum(x for key, x in zip(b, of, strict=True) if key in a)))
    got = meetings.sums(spark.createDataFrame(left, SET), spark.createDataFrame(right, f"{SET}, weights array<int>"))
    assert {r.weight: r.n_pairs for r in got.collect()} == wanted


@pytest.mark.parametrize("ignored", [[], [("a", 1), ("a", 7), ("b", 3)]])
def test_likest_equal_brute_force(spark, limits, ignored):
    rnd = random.Random(limits[0] + len(ignored))
    left, right = side(rnd, 50, "l", "abc"), side(rnd, 70, "r", "abd")
    wanted = set()
    for s, i, a in left:
        out = {key for scope, key in ignored if scope == s}
        shared = sorted((-len(set(a) & set(b) - out), j, b) for t, j, b in right if s == t and set(a) & set(b) - out)[:20]
        likest = sorted((n / len(set(a) | set(b)), j) for n, j, b in shared)[:4]
        wanted |= {(i, j, -score) for score, j in likest}
    frames = [spark.createDataFrame(x, SET) for x in (left, right)]
    assert {tuple(r) for r in meetings.likest(*frames, spark.createDataFrame(ignored, "scope string, key long"), 20, 4).collect()} == wanted


def test_empty_sides(spark):
    none, one, keys = spark.createDataFrame([], SET), spark.createDataFrame([("a", "x", [1])], SET), spark.createDataFrame([], "scope string, key long")
    for left, right in ((none, one), (one, none), (none, none)):
        assert meetings.likest(left, right, keys, 3, 3).count() == meetings.sums(left, right).count() == 0


def test_most_keeps_the_first_of_equal_ones():
    assert sorted(meetings.most(np.array([1, 3, 2, 2, 1, 2]), 3).tolist()) == [1, 2, 3]
    assert meetings.most(np.array([5, 5]), 3).tolist() == [0, 1]


@pytest.mark.parametrize("name", ["evidence_weights", "token_block_topk"])
def test_pairs_are_not_rows(spark, tmp_path, capsys, name):
    """600 S1 records and 1,200 targets share a name: 720,000 pairs, of which no plan's join or task makes rows."""
    rows = [(i, "amber brick cedar delta ember flint " + " ".join(f"w{i % 40}x{k}" for k in range(10)), "en", "web", 100) for i in range(1800)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    frame = catalog.QUERIES[name](spark, str(tmp_path))
    capsys.readouterr()
    frame.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "SortMergeJoin [source1" not in plan and "SortMergeJoin [country_norm" not in plan.split("MapInArrow")[0]
    got = frame.collect()
    assert sum(r.n_pairs for r in got) == 720_000 if name == "evidence_weights" else len(got) == 5 * 600


def test_repeated_ids_keep_the_general_plans(spark, tmp_path):
    """Two documents of one id are one record of both texts' evidence."""
    rows = [(0, "amber brick cedar"), (0, "amber delta ember"), (1, "amber brick delta")]
    spark.createDataFrame([(*r, "en", "web", 100) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.weight: r.n_pairs for r in catalog.QUERIES["evidence_weights"](spark, str(tmp_path)).collect()} == {4: 1}
