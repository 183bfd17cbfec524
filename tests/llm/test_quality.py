import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import quality as q
from kinweave.llm import queries
from kinweave.llm.textarrays import BASE, BYTE_VALUES


def test_ordinal_fit_recovers_an_order():
    rnd = np.random.default_rng(0)
    grades = rnd.integers(0, 3, 900)
    rows = [np.unique(np.concatenate([rnd.integers(1000, 1200, 20), [int(g)] if rnd.random() < 0.9 else []]).astype(np.int64)) for g in grades]
    model = q.fit(rows, grades)
    assert model.thresholds[0] <= model.thresholds[1]
    size = np.array([len(r) for r in rows])
    tails = model.tails(np.repeat(np.arange(900), size), np.concatenate(rows), 900)
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.corrcoef(tails.sum(axis=1), grades)[0, 1] > 0.8
    assert model.weights[0] < model.weights[1] < model.weights[2] or model.weights[0] < 0 < model.weights[2]


def test_features_are_those_of_the_row_alone():
    texts = ["Some words, some words again!", None, "", "été 日本 123", "x" * 100, "!!!"]
    together = [f for row, feature, words in q.features(pa.array(texts, pa.string())) for f in np.split(feature, np.searchsorted(row, np.arange(1, len(words))))]
    for t, f in zip(texts, together, strict=True):
        ((_, alone, words),) = q.features(pa.array([t], pa.string()))
        assert alone.tolist() == f.tolist() and len(set(f.tolist())) == len(f)
    assert len(together[1]) == len(together[2]) == len(together[5]) == 0


def test_long_text_in_parts(monkeypatch):
    text = "".join(f"word{i % 500} " for i in range(4000))
    whole = next(q.features(pa.array([text])))
    monkeypatch.setattr(q, "CHUNK", 5000)
    parts = next(q.features(pa.array([text])))
    assert whole[1].tolist() == parts[1].tolist() and whole[2].tolist() == parts[2].tolist()


def test_grades(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, 1), (None, 1, 0), (5, 1, None), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in q.grades_of(labels).collect()} == {1: 1, 2: 1, 3: 0, 5: 2}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (8, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.learn(odd_docs, q.grades_of(labels))
    got = q.grade(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert 0 <= r.tail_2 <= r.tail_1 <= 1 and abs(r.expected_grade - r.tail_1 - r.tail_2) < 1e-12
        if r.doc_id in (3, 4, 5):
            assert not r.kept and r.expected_grade == 0
    kept = sorted(str(r.doc_id) for r in got if r.kept)
    good = q.select_good(odd_docs, model)
    assert sorted(str(r.doc_id) for r in good.collect()) == kept and good.columns == odd_docs.columns
    assert q.learn(odd_docs, q.grades_of(labels.limit(0))) is None
    assert q.grade(odd_docs, None).where("kept").count() == odd_docs.where("trim(translate(text, '\t\n', '  ')) <> ''").count()
    assert q.grade(no_docs, model).count() == 0


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, grades = spark.read.parquet(f"{sf}/documents.parquet"), q.grades_of(spark.read.parquet(f"{sf}/labels.parquet"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = q.learn(docs, grades.where(~held))
    rows = q.grade(docs, model).join(grades.where(held), "doc_id").groupBy("grade").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.avg("expected_grade").alias("mean")).orderBy("grade").collect()
    assert rows[2].kept > 0.95 and rows[0].kept < 0.05 and rows[1].kept < 0.2
    assert rows[0].mean < rows[2].mean and rows[1].mean < rows[2].mean


def likelihood(row, feature, grades, weight, w, theta):
    """Weighted negative log-likelihood, a row at a time."""
    total = 0.0
    for i, g in enumerate(grades):
        score = sum(w[f] for r, f in zip(row, feature, strict=True) if r == i)
        tails = [1.0, *(1 / (1 + math.exp(t - score)) for t in theta), 0.0]
        total -= weight[i] * math.log(tails[g] - tails[g + 1])
    return total


def test_gradient_equals_finite_differences():
    rnd = np.random.default_rng(4)
    grades = rnd.integers(0, 3, 25)
    row = np.repeat(np.arange(25), 4)
    feature = rnd.integers(0, 12, 100)
    weight, w, theta = rnd.uniform(0.5, 2, 25), rnd.normal(size=12), np.array([-0.4, 0.9])
    by_w, by_theta = q.gradients(row, feature, grades, weight, w, theta)
    for given, found in ((w, by_w), (theta, by_theta)):
        for i in range(len(given)):
            ends = []
            for step in (1e-5, -1e-5):
                given[i] += step
                ends.append(likelihood(row, feature, grades, weight, w, theta))
                given[i] -= step
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(found[i], rel=1e-5, abs=1e-7)


def test_fit_lowers_the_loss_to_its_minimum():
    rnd = np.random.default_rng(6)
    grades = np.repeat([0, 1, 2], 60)
    rows = [np.unique(rnd.integers(0, 9, 5) + 3 * g).astype(np.int64) for g in grades]
    model = q.fit(rows, grades, rounds=800, sparse=0.0, least_rows=1)
    row, feature = np.repeat(np.arange(180), [len(r) for r in rows]), np.concatenate(rows)
    weight = np.full(180, 1 / 180)
    w, theta = model.weights[:20].astype(float), model.thresholds
    low = likelihood(row, feature, grades, weight, w, theta)
    assert low < 0.7 * likelihood(row, feature, grades, weight, 0 * w, np.array([-0.5, 0.5]))
    for _ in range(20):
        assert low <= likelihood(row, feature, grades, weight, w + rnd.normal(size=20) * 0.3, theta) + 1e-4


MASK = (1 << 64) - 1


def mixed(x):
    x = ((x ^ x >> 31) * 0x7FB5D329728EA185) & MASK
    x = ((x ^ x >> 27) * 0x81DADEF4BC2DD44D) & MASK
    return x ^ x >> 33


def hashed(word):
    value = sum(int(BYTE_VALUES[b]) * pow(BASE, i, 1 << 64) for i, b in enumerate(word)) & MASK
    return mixed(value ^ len(word) * 0x9E3779B97F4A7C15 & MASK)


def plain_features(text):
    """The same features with one loop over words."""
    data = text.encode()
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", data)
    if not words:
        return set()
    low = [w.lower() for w in words]
    place = lambda h: h >> 64 - q.BITS
    out = {place(hashed(w)) for w in low}
    distinct = len(out)
    out |= {place(mixed((hashed(w[: q.HEAD]) + 1) & MASK)) for w in low}

    def steps(share):
        return 0 if share <= 0 else min(12, max(1, math.ceil(math.log2(max(share, 2.0**-11))) + 12))

    signs = sum(not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b > 127 or b < 33 or b == 127 or b in b".,;:'\"-()!?") for b in data)
    marks = [sum(65 <= b < 91 for b in data), sum(48 <= b < 58 for b in data), signs, sum(b in b"!?" for b in data)]
    n = len(words)
    repeats = sum(a == b for a, b in zip(low, low[1:], strict=False))
    measures = [*(steps(m / len(data)) for m in marks), steps(repeats / n), min(20, int(10 * math.log10(max(1, n / max(1, distinct))))), min(20, int(sum(map(len, words)) / n)), int(math.log2(n))]
    return out | {place(mixed(v + 1000 * (k + 1))) for k, v in enumerate(measures)}


def test_query_equals_a_plain_loop(spark):
    """op7 over its whole table: features, scores and decisions again, a document at a time, with the fitted weights."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = q.learn(docs, q.grades_of(labels))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.op7_quality(spark, sf).collect()
    assert len(got) == docs.count()
    for r in got:
        found = plain_features(texts[r.doc_id])
        score = sum(float(model.weights[f]) for f in found)
        tails = [1 / (1 + math.exp(t - score)) for t in model.thresholds] if found else [0.0, 0.0]
        assert (r.tail_1, r.tail_2) == pytest.approx(tails, abs=1e-6) and r.expected_grade == pytest.approx(sum(tails), abs=1e-6)
        assert r.kept == (bool(found) and r.tail_2 >= 0.4)


def test_a_repeated_labelled_id_is_learned_once(spark):
    rows = [(1, f"good words number {i}") for i in range(50)] + [(2, "bad words"), (3, "worst of all")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    seen = []
    keep, q.fit = q.fit, lambda features, grades: seen.append((len(features), sorted(grades.tolist())))
    try:
        q.learn(frame, q.grades_of(labels))
    finally:
        q.fit = keep
    assert seen == [(3, [0, 1, 2])]


def test_very_long_texts(spark):
    text = "some words of a text, " * 200_000
    rows = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "x" * 3_000_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in q.grade(rows, q.learn(rows, q.grades_of(labels))).collect()}
    assert len(got) == 4 and got[1].tail_2 == got[2].tail_2 and not got[3].kept
