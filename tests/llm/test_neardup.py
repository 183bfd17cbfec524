import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import components as components_module
from kinweave.llm import neardup as nd
from kinweave.llm import runtime
from kinweave.llm.components import components
from kinweave.llm.runtime import Stash


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, similarity):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if a is not None and b is not None and x and y and similarity.denominator * len(x & y) >= similarity.numerator * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def run(frame, width=3, similarity=Fraction(85, 100)):
    return sorted((tuple(r) for r in nd.near_duplicates(frame, width, similarity).collect()), key=repr)


def copies(rnd, base, n, most):
    """Copies of a text with up to most words changed."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(most + 1)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width, similarity", [(3, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_equals_brute_force(spark, width, similarity):
    rnd = random.Random(width)
    texts = []
    for _ in range(6):
        texts += copies(rnd, [f"w{rnd.randrange(500)}" for _ in range(120)], 25, 9)
    texts += ["one", "one", "ONE ", "two words", "", None, "a b c", "a b  c"]
    texts += texts[:10]
    rnd.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(None, texts[0]), (7, "row with a repeated id and other words"), (7, "row with a repeated id and other words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(frame, width, similarity) == brute(rows, width, similarity)


def test_stars_and_blocks_of_large_clusters(spark, monkeypatch):
    rnd = random.Random(9)
    texts = copies(rnd, [f"w{i}" for i in range(100)], 90, 12) + copies(rnd, [f"v{i}" for i in range(60)], 40, 3)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = run(frame)
    assert whole == brute(rows, 3, Fraction(85, 100)) and len({r[2] for r in whole}) > 20
    monkeypatch.setattr(components_module, "FEW", 30)
    for changed in ({"BLOCK": 7}, {"STAR": 5, "LARGE": 2, "ROUNDS": 2}, {"ROUNDS": 1}, {"BROADCAST_IDS": 0}):
        for name, value in changed.items():
            monkeypatch.setattr(nd, name, value)
        assert run(frame) == whole
    monkeypatch.setattr(runtime, "SMALL_TABLE", 0)
    assert run(frame) == whole


def test_near_copies_of_one_text_are_settled_by_stars(spark, monkeypatch):
    """Tasks grow with the cluster, not with its square: no blocks, and each text once or a few times."""
    rnd = random.Random(10)
    dealt = []
    keep = nd._sets
    monkeypatch.setattr(nd, "_sets", lambda rows, tasks, *more: dealt.append(tasks.count()) or keep(rows, tasks, *more))
    monkeypatch.setattr(nd, "_block_tasks", lambda *x: pytest.fail("blocks"))
    for n in (400, 1600):
        dealt.clear()
        frame = spark.createDataFrame(list(enumerate(copies(rnd, [f"w{i}" for i in range(300)], n, 2))), "doc_id long, text string")
        assert {r[2] for r in run(frame)} == {0} and sum(dealt) < 4 * n


def test_an_id_of_several_texts_connects_them(spark):
    rows = [(1, "a b c d e f g"), (7, "a b c d e f g"), (7, "p q r s t u v"), (9, "p q r s t u v"), (11, "k l m n"), (7, "x y z x y z w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(frame) == brute(rows, 3, Fraction(85, 100))


def test_a_hot_id_of_equal_rows(spark):
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    rows = [(5, " ".join(base))] * 300 + list(enumerate(copies(rnd, base, 30, 1), 10))
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, 3, Fraction(85, 100))


def test_very_long_texts(spark):
    rnd = random.Random(12)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["new"] + words[1000:])), (3, " ".join(words[: len(words) // 2])), (4, "w " * 500_000), (5, "x" * 2_000_000)]
    got = run(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r[2] for r in got] == [1, 1, 3, 4, 5]


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert run(odd_docs) == brute(rows, 3, Fraction(85, 100))
    assert run(no_docs) == []


def test_sketch_is_independent_of_step_and_order():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 500, 3000):
        elements = rnd.integers(0, 2**63, n, dtype=np.uint64)
        one = nd.sketch(elements, 60)
        assert (one != nd.FULL).all() and (one == nd.sketch(rnd.permutation(elements), 60)).all()
        want = np.full(60, nd.FULL)
        for r in range(120):
            h = nd.mix(elements ^ nd._seeds[60][r])
            for x in h.tolist():
                b = (x >> 32) * 60 >> 32 if r < 60 else r - 60
                want[b] = min(int(want[b]), r << 32 | x & 0xFFFFFFFF)
            if (want != nd.FULL).all():
                break
        assert (want == one).all()


def test_sketch_estimates_similarity():
    rnd = np.random.default_rng(2)
    pool = rnd.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = pool[:1000], pool[500:]
    agree = np.mean([(nd.sketch(a ^ np.uint64(s), 150) == nd.sketch(b ^ np.uint64(s), 150)).mean() for s in range(40)])
    assert abs(agree - 1 / 3) < 0.03


def test_bands_find_pairs_at_the_threshold():
    assert (1 - 0.85**nd.ROWS) ** nd.band_count(Fraction(85, 100)) <= 1e-7
    assert (1 - 0.8**nd.ROWS) ** nd.band_count(Fraction(4, 5)) <= 1e-7


def test_linked_is_exact_on_the_border():
    base = np.arange(100, dtype=np.uint64)
    near, far = np.concatenate([base[:85], np.zeros(0, np.uint64)]), base[:84]
    assert nd.linked([base, near], Fraction(85, 100))[0, 1] and not nd.linked([base, far], Fraction(85, 100))[0, 1]


def test_shingle_hashes_depend_on_words_alone():
    a, b = nd.shingle_sets(pa.array(["x  y\tz w", "X y z\nw"]), 3)
    assert (a == b).all() and len(a) == 2


@pytest.mark.parametrize("few", [50_000, 20, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components_module, "FEW", few)
    rnd = random.Random(4)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Stash(spark)).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), Stash(spark)).count() == 0


def test_hot_groups_of_copies(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the very same words of a document").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"))).alias("text"))
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(rows).collect()}
    assert all(got[i] == (0 if i % 3 == 0 else i) for i in range(3000))
