import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import fingerprint as f

PARTS = st.lists(st.text("ab c", max_size=12), min_size=1, max_size=6)


@given(PARTS, st.randoms())
@settings(max_examples=150, deadline=None)
def test_order_of_paragraphs_does_not_matter(parts, rnd):
    other = list(parts)
    rnd.shuffle(other)
    a, b = f.fingerprints(["\n".join(parts), "\n".join(other)])
    assert a == b


@given(PARTS, PARTS)
@settings(max_examples=150, deadline=None)
def test_insertion_and_deletion(left, right):
    a, b, both = (f.paragraph_sums(["\n".join(x)]) for x in (left, right, left + right))
    assert f.encoded(f.plus(a, b)) == f.encoded(both)
    assert f.encoded(f.minus(both, b)) == f.encoded(a)


@given(PARTS, PARTS)
@settings(max_examples=150, deadline=None)
def test_different_multisets_differ(left, right):
    a, b = f.fingerprints(["\n".join(left), "\n".join(right)])
    assert (a == b) == (sorted("\n".join(left).split("\n")) == sorted("\n".join(right).split("\n")))


def test_round_trip_and_likeness():
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(20)]
    sums = f.paragraph_sums(texts)
    again = f.decoded(f.encoded(sums))
    assert all((x == y).all() for x, y in zip(sums, again, strict=True))
    assert (f.likeness(sums, sums) == 1).all()
    part = f.paragraph_sums([f.edited_text(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)])
    near = f.likeness(sums, part)
    apart = f.likeness(sums, tuple(np.roll(x, 1, axis=0) for x in sums))
    assert 0.6 < near.mean() < 0.9 and apart.mean() < 0.2 and near.min() > apart.max()


def reference(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, other = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + other[:k]
        a, b, c = f.paragraph_sums([text]), f.paragraph_sums([edited]), f.paragraph_sums([other])
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), *f.encoded(a), *f.encoded(b), *f.likeness(a, b), *f.likeness(a, c)))
    return out


def test_query_rows_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i * 7 - 40, None if i % 11 == 0 else "\n".join("".join(rnd.choices("ab é日 ", k=rnd.randrange(30))) for _ in range(rnd.randrange(4)))) for i in range(60)]
    rows.append((None, "first of all\nwith two paragraphs"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for parts, buckets in ((1, 1), (5, 9), (3, 200)):
        got = [tuple(r) for r in f.edited_fingerprints(frame.repartition(parts), buckets=buckets).collect()]
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        want = reference(rows)
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5:] for r in got], [r[5:] for r in want])


def test_odd_rows(spark, odd_docs, no_docs):
    got = f.edited_fingerprints(odd_docs).collect()
    assert len(got) == odd_docs.count()
    ones = {r.fingerprint for r in got if r.doc_id in (1, 2)}
    assert len(ones) == 1
    assert {r.doc_id: r.n_chars for r in got}[3] == 0
    assert f.edited_fingerprints(no_docs).count() == 0
    alone = f.edited_fingerprints(odd_docs.where("doc_id = 1")).first()
    assert alone.near_next == 1.0
    assert len({r.edited_sha256 for r in f.edited_fingerprints(odd_docs.where("doc_id = 2")).collect()}) == 1


def test_a_hot_id_is_split(spark):
    rnd = random.Random(3)
    rows = [(50 if i % 3 == 0 else i, f"text {rnd.random()} of\nrow {i}") for i in range(120)] + [(50, "the same row")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = f.edited_fingerprints(frame, buckets=12).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    ranked = sorted(rows, key=lambda r: (r[0], order_hash(spark, r[1])))
    want = sorted((i, hashlib.sha256(f.edited_text(t, ranked[(n + 1) % len(ranked)][1]).encode()).hexdigest()) for n, (i, t) in enumerate(ranked))
    assert sorted((r.doc_id, r.edited_sha256) for r in got) == want
    keys = frame.select("doc_id", f.F.xxhash64("text").alias("h1"), f.F.xxhash64("text", f.F.lit(1)).alias("h2"), f.F.octet_length("text").alias("n_bytes")).distinct()
    dealt = f._in_range(keys, f._bounds(keys, 12))
    assert dealt.where("doc_id = 50").select("to").distinct().count() >= 3


def test_null_ids_and_equal_rows_are_split(spark):
    rnd = random.Random(4)
    rows = [(None if i % 2 else i, f"text {rnd.random()} of\nrow {i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    keys = frame.select("doc_id", f.F.xxhash64("text").alias("h1"), f.F.xxhash64("text", f.F.lit(1)).alias("h2"), f.F.octet_length("text").alias("n_bytes"))
    sizes = f._in_range(keys, f._bounds(keys, 10)).groupBy("to").count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) <= 24
    ranked = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order_hash(spark, r[1])))
    want = sorted(hashlib.sha256(f.edited_text(t, ranked[(n + 1) % len(ranked)][1]).encode()).hexdigest() for n, (_, t) in enumerate(ranked))
    assert sorted(r.edited_sha256 for r in f.edited_fingerprints(frame, buckets=10).collect()) == want


def test_a_million_equal_rows(spark):
    frame = spark.range(1_000_000).select(f.F.lit(5).cast("long").alias("doc_id"), f.F.lit("the same text\nagain").alias("text"))
    frame = frame.unionByName(spark.createDataFrame([(4, "before it"), (6, "after\nit")], "doc_id long, text string"))
    got = f.edited_fingerprints(frame).groupBy("doc_id", "edited_sha256", "near_next").count().collect()
    sha = {n: hashlib.sha256(f.edited_text(a, b).encode()).hexdigest() for n, a, b in ((4, "before it", "the same text\nagain"), (5, "the same text\nagain", "the same text\nagain"), (55, "the same text\nagain", "after\nit"), (6, "after\nit", "before it"))}
    assert sorted((r.doc_id, r.edited_sha256, r["count"]) for r in got) == sorted([(4, sha[4], 1), (5, sha[5], 999_999), (5, sha[55], 1), (6, sha[6], 1)])
    assert {r.near_next for r in got if r["count"] > 1} == {1.0}


def test_ranges_follow_the_bytes(spark):
    frame = spark.range(1000).select(f.F.col("id").alias("doc_id"), f.F.col("id").alias("h1"), f.F.xxhash64("id").alias("h2"), f.F.when(f.F.col("id") < 100, 1 << 22).otherwise(1 << 10).cast("long").alias("n_bytes"))
    bounds = f._bounds(frame, None)
    assert len(bounds) + 1 >= (100 << 22) // f.RANGE_BYTES
    sizes = f._in_range(frame, bounds).groupBy("to").agg(f.F.sum("n_bytes").alias("b")).collect()
    assert max(r.b for r in sizes) <= 2 * f.RANGE_BYTES


def test_very_long_texts(spark):
    rows = [(1, "a long line of words " * 100_000), (2, "short"), (3, "another\nline " * 80_000), (4, None)]
    got = sorted(tuple(r) for r in f.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3).collect())
    want = reference(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5:] for r in got], [r[5:] for r in want])


_hashes: dict = {}


def order_hash(spark, text):
    if text not in _hashes:
        _hashes[text] = spark.range(1).select(f.F.xxhash64(f.F.lit(text))).first()[0]
    return _hashes[text]
