import random

import numpy as np
import pyarrow as pa
import pytest

from kinweave.functions.text import word_ngrams
from kinweave.operators import blocking as B
from kinweave.operators import cosines
from kinweave.plans import catalog
from kinweave.schema import BlockingConfig
from pyspark.sql import functions as F

SCHEMA = "entity_id string, country_norm string, name_norm string"
WORDS = ["moon", "moons", "moonlight", "sun", "a", "ab", "straße", "ключ", "é́t", "road", "rode", "aaaaaa"]


def side(rnd, n, prefix, countries):
    rows = [(f"{prefix}-{i}", rnd.choice(countries), rnd.choice([" ", "  ", "\t"]).join(rnd.choice(WORDS) for _ in range(rnd.randrange(6)))) for i in range(n)]
    return [*rows, (f"{prefix}-x", countries[0], None), (f"{prefix}-y", countries[0], ""), (f"{prefix}-z", countries[0], "zzz")]


def rows(frame):
    return sorted((r[0], r[1], round(r.name_tfidf_score, 8), r.name_tfidf_rank) for r in frame.collect())


@pytest.mark.parametrize("features", [600_000, 25])
@pytest.mark.parametrize("most", [1 << 21, 45])
def test_texts_give_the_cosines_of_vectors(spark, monkeypatch, features, most):
    rnd = random.Random(21)
    sides = [spark.createDataFrame(side(rnd, n, p, c), SCHEMA).cache() for n, p, c in ((60, "S1", ["en", "fr", "it"]), (110, "S2", ["en", "en", "fr", "de"]))]
    config = BlockingConfig(min_df=2, max_features=features)
    wanted = rows(B.tfidf_candidates(*sides, "name_norm", 3, config))
    monkeypatch.setattr(cosines, "MOST", most)
    assert len(wanted) > 80
    assert rows(B.tfidf_candidates(*sides, "name_norm", 3, config, unique=True)) == wanted


def test_blocks_don_t_matter(monkeypatch):
    rnd = random.Random(22)
    left, right = (pa.array([" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(6))) for _ in range(n)]) for n in (30, 70))
    whole = [np.concatenate(x) for x in zip(*cosines.cosines(left, right, 4, 2, 1000), strict=True)]
    monkeypatch.setattr(cosines, "BLOCK", 7)
    assert all(np.array_equal(a, np.concatenate(b)) for a, b in zip(whole, zip(*cosines.cosines(left, right, 4, 2, 1000), strict=True), strict=True))


def test_grams_equal_the_expression(spark):
    frame = spark.createDataFrame([(w,) for w in WORDS], "t string")
    assert [r.g for r in frame.select(word_ngrams(F.col("t")).alias("g")).collect()] == [cosines.grams(w) for w in WORDS]


def test_no_vector_is_moved(spark):
    plan = catalog.queries()["tfidf_cosine_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "gram" not in plan and "SortMergeJoin" not in plan
