import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.llm import packing, queries


def plain(pieces, capacity):
    """Best fit by looking at every bin: the tightest without a conflict, the longest at that residual first."""
    bins, out, clock = [], [], 0
    for size, source, cluster, most in pieces:
        fit = [b for b in bins if b["left"] >= size and (source is None or b["s"].count(source) < most) and (cluster is None or cluster not in b["c"])]
        b = min(fit, key=lambda b: (b["left"], b["since"]), default=None)
        if b is None:
            b = {"n": len(bins), "left": capacity, "s": [], "c": set(), "since": 0}
            bins.append(b)
        out.append((b["n"], capacity - b["left"]))
        clock += 1
        b["left"] -= size
        b["since"] = clock
        b["s"].append(source)
        b["c"].add(cluster)
    return out


@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, 1, 2, 3, 4])), max_size=40), st.fixed_dictionaries({k: st.integers(1, 3) for k in (None, "a", "b", "c")}))
@settings(max_examples=300, deadline=None)
def test_best_fit_equals_looking_at_every_bin(pieces, most):
    pieces = sorted(((n, s, c, most[s]) for n, s, c in pieces), key=lambda p: -p[0])
    assert packing.pack_group(pieces, 20) == plain(pieces, 20)


def checked(frame, capacity, group_rows=2048, per_source=1):
    rows = packing.pack(frame, capacity, group_rows, per_source).collect()
    used = defaultdict(list)
    for r in rows:
        used[r.bin_id].append(r)
    for own in used.values():
        own.sort(key=lambda r: (r.bin_offset, r.n_words))
        at = 0
        for r in own:
            assert r.bin_offset == at and at + r.n_words <= capacity
            at += r.n_words
    return rows, used


def test_every_word_lies_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    rows, used = checked(docs, 512, 100)
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        n = len(texts[doc_id].text.split())
        assert [r.start for r in own] == list(range(0, max(1, n), 512)) and sum(r.n_words for r in own) == n
    for own in used.values():
        sources = [texts[r.doc_id].source for r in own]
        squeezed = ["".join(texts[r.doc_id].text.lower().split()) for r in own]
        assert len(set(sources)) == len(sources) and len(set(squeezed)) == len(squeezed)


def test_odd_rows(spark, odd_docs, no_docs):
    rows, _ = checked(odd_docs, 100)
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd_docs.collect()}
    assert sorted(r.copy for r in rows if r.doc_id == 2) == [0, 1]
    assert len({r.bin_id for r in rows if r.doc_id in (1, 2)}) == 3
    assert sum(r.n_words for r in rows if r.doc_id == 9) == 3000
    assert packing.pack(no_docs).count() == 0


def test_equal_rows_are_spread_over_bins(spark):
    rnd = random.Random(1)
    frame = spark.createDataFrame([(5, "same words here", "s", "")] * 40 + [(i, f"other {rnd.random()}", None, "") for i in range(10, 60)], "doc_id long, text string, source string, lang string")
    rows, used = checked(frame, 50, 10)
    assert all(sum(r.doc_id == 5 for r in own) <= 1 for own in used.values())
    assert sorted(r.copy for r in rows if r.doc_id == 5) == list(range(40))


def test_a_hot_source_gets_its_share_of_a_bin(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(f"w{rnd.random()}" for _ in range(rnd.randrange(5, 20))), "hot" if i % 3 == 0 else f"s{i % 20}" if i % 7 else None, "") for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    source = {i: s for i, _, s, _ in rows}
    got, used = checked(frame, 50, 300, None)
    most = max(sum(source[r.doc_id] == "hot" for r in own) for own in used.values())
    assert most == 2 and max(sum(source[r.doc_id] == "s1" for r in own) for own in used.values()) == 1
    assert sum(r.n_words for r in got) / len(used) / 50 > 0.9


def test_a_million_equal_rows(spark):
    rows = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("three words here").alias("text"), F.lit("s").alias("source"))
    got = packing.pack(rows, 30, 2048, 10)
    assert got.agg(F.countDistinct("copy"), F.min("copy"), F.max("copy"), F.sum("n_words")).first() == (1_000_000, 0, 999_999, 3_000_000)
    # equal rows are of one cluster, so each is alone in its bin
    assert got.select("bin_id").distinct().count() == 1_000_000


def test_a_very_long_text_is_cut(spark):
    rows = spark.createDataFrame([(1, "w " * 300_001, "s"), (2, "few words", "t")], "doc_id long, text string, source string")
    got, _ = checked(rows, 2048)
    own = [r for r in got if r.doc_id == 1]
    assert len(own) == 147 and sum(r.n_words for r in own) == 300_001


def test_bins_are_full(spark):
    got = queries.op10_packing(spark, "/root/testdata/sf0.1")
    words, bins = got.agg(F.sum("n_words"), F.countDistinct("bin_id")).first()
    assert words / bins / queries.PACK_WORDS > 0.93
