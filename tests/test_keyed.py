import random

import pyarrow as pa
import pytest

from kinweave.functions import similarity as S
from kinweave.functions.text import alnum, soundex, token_set
from kinweave.operators import blocking as B
from kinweave.operators import keyed
from kinweave.plans import catalog
from kinweave.schema import BlockingConfig
from pyspark.sql import functions as F

SCHEMA = "entity_id string, country_norm string, name_norm string, address_norm string, address_numbers string"
WORDS = ["moon", "moons", "sun", "a_b", "a", "b_main", "main", "mayn", "straße", "ключ", "é́t", "ab", "road", "rode", "knight", "x" * 70]
CONFIG = BlockingConfig(token_cap=30, bucket_cap=25, budget=12, top_k=7)
SCORES = {"jaccard": (S.weighted_jaccard, token_set), "indel": (S.weighted_indel, S.sorted_tokens)}


def side(rnd, n, prefix, countries):
    def text(most):
        return rnd.choice([" ", " ", " ", "  ", "\t"]).join(rnd.choice(WORDS) for _ in range(rnd.randrange(most)))

    rows = [(f"{prefix}-{i}", rnd.choice(countries), text(12), text(24), "|".join(str(rnd.choice([7, 123, 208001, 4567])) for _ in range(rnd.randrange(4)))) for i in range(n)]
    return [*rows, (f"{prefix}-x", countries[0], None, "main road", "123"), (f"{prefix}-y", countries[0], "", "", "")]


@pytest.fixture(scope="module")
def sides(spark):
    rnd = random.Random(20)
    return spark.createDataFrame(side(rnd, 120, "S1", ["en", "fr", "it"]), SCHEMA).cache(), spark.createDataFrame(side(rnd, 160, "S2", ["en", "fr", "de"]), SCHEMA).cache()


def rows(frame):
    return sorted((r[0], r[1], r.keyed_score, r.keyed_rank) for r in frame.select(*B.PAIR, "keyed_score", "keyed_rank").collect())


@pytest.mark.parametrize("name", SCORES)
@pytest.mark.parametrize("most", [1 << 21, 55, 0])
def test_index_equals_rows(spark, sides, monkeypatch, name, most):
    score, prepare = SCORES[name]
    wanted = rows(B.keyed_candidates(*sides, CONFIG, score, prepare))
    monkeypatch.setattr(keyed, "MOST", most)
    assert len(wanted) > 300
    assert rows(B.keyed_candidates(*sides, CONFIG, score, prepare, unique=True)) == wanted


@pytest.mark.parametrize("chunk, steps, at_once", [(1, 1, 1), (7, 50, 3)])
def test_pieces_don_t_matter(spark, sides, monkeypatch, chunk, steps, at_once):
    for name, value in (("CHUNK", chunk), ("STEPS", steps), ("ROWS", at_once), ("WIDTHS", (2, 3))):
        monkeypatch.setattr(keyed, name, value)
    columns = [F.col("country_norm").alias("scope"), F.lit(0).alias("part"), F.col("entity_id").alias("id"), *[F.translate(c, "\t", " ").alias(n) for c, n in (("name_norm", "name"), ("address_norm", "address"))], F.col("address_numbers").alias("numbers"), alnum(F.col("name_norm")).alias("compact")]
    both = [r for i, x in enumerate(sides) for r in x.select(*columns, F.lit(i).alias("side")).dropna().collect()]
    both = sorted((r.asDict() for r in both), key=lambda r: (r["scope"], r["side"], r["id"]))
    batches = pa.Table.from_pylist(both).to_batches(max_chunksize=9)
    for name, kind in (("jaccard", keyed.Jaccard), ("indel", keyed.Indel)):
        wanted = rows(B.keyed_candidates(*sides, CONFIG, *SCORES[name]))
        got = [tuple(r.values()) for b in keyed._searched(CONFIG, kind, CONFIG.top_k)(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == wanted


def test_soundex_equals_the_expression(spark):
    words = [*WORDS, "", "123", "pfister", "tymczak", "hhh", "aeiou", "bb", "Ashcraft", "z9z", "İx", "jackson", "bfpvb", "mmnnrl"]
    frame = spark.createDataFrame([(w,) for w in words], "t string")
    assert [r.s for r in frame.select(soundex(F.col("t")).alias("s")).collect()] == [keyed.soundex(w) for w in words]


@pytest.mark.parametrize("name", ["topk_candidates", "scored_candidates"])
def test_no_pair_is_moved(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and "Window" not in plan
    assert "hashpartitioning(source1_entity_id" not in plan
