import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import similarity as S

WORD = st.text("abcde ", max_size=14)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@given(WORD, WORD)
@settings(max_examples=300, deadline=None)
def test_common_subsequence(a, b):
    assert S.common_subsequence(a, b) == brute_lcs(a, b)


@given(WORD, WORD)
@settings(max_examples=200, deadline=None)
def test_bounds_and_symmetry(a, b):
    for f, top in ((S.indel_ratio, 100), (S.token_sort, 100), (S.token_set, 100), (S.jaro_winkler, 1)):
        assert 0 <= f(a, b) <= top
    assert S.indel_ratio(a, b) == S.indel_ratio(b, a)
    assert S.sequence_ratio(a, b) == SequenceMatcher(None, a, b).ratio()


def test_golden():
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler("", "") == 1.0 and S.jaro_winkler("a", "") == 0.0
    assert S.indel_ratio("", "") == 100.0 and S.token_sort("b a", "a b") == 100.0
    assert S.token_set("", "a") == 0.0 and S.token_set("a b", "a b c") == 100.0
    assert S.token_set("a", "b") == 0.0


def test_native_measures(spark):
    rows = spark.createDataFrame([("abc", "abd", ["a", "b"], ["b", "c"]), ("", "", [], []), ("ab", "", ["a"], [])], "a string, b string, x array<string>, y array<string>")
    a, b, x, y = (F.col(c) for c in "abxy")
    got = rows.select(S.levenshtein_similarity(a, b), S.jaccard(x, y), S.overlap_coefficient(x, y), S.length_ratio(a, b)).collect()
    assert [[round(v, 6) for v in r] for r in got] == [[0.666667, 0.333333, 0.5, 1.0], [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0]]


def test_udfs_match_functions(spark):
    S.register(spark)
    rows = spark.createDataFrame([("ab cd", "cd ab x"), (None, "a"), ("", "")], "a string, b string")
    got = rows.selectExpr("indel_ratio(a, b) r", "token_sort_ratio(a, b) s", "token_set_ratio(a, b) t", "jaro_winkler(a, b) j", "sequence_ratio(a, b) q").collect()
    for r, (a, b) in zip(got, [("ab cd", "cd ab x"), ("", "a"), ("", "")], strict=True):
        assert tuple(r) == (S.indel_ratio(a, b), S.token_sort(a, b), S.token_set(a, b), S.jaro_winkler(a, b), S.sequence_ratio(a, b))


LONG = st.one_of(WORD, st.text("abé日 ", min_size=55, max_size=75), st.text("ab c", min_size=120, max_size=260))


@given(st.lists(st.tuples(LONG, LONG), max_size=12))
@settings(max_examples=150, deadline=None)
def test_many_pairs_at_once(pairs):
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert S.common_subsequences(left, right).tolist() == [S.common_subsequence(a, b) for a, b in pairs]
    assert S.token_sets(left, right).tolist() == [S.token_set(a, b) for a, b in pairs]


def test_carries_between_words():
    rnd = random.Random(1)
    pairs = [("".join(rnd.choices("ab", k=n)), "".join(rnd.choices("ab", k=m))) for n in (63, 64, 65, 127, 128, 129, 300) for m in (64, 65, 128, 130, 301) for _ in range(4)]
    assert S.common_subsequences(*map(list, zip(*pairs, strict=True))).tolist() == [brute_lcs(a, b) for a, b in pairs]
    assert S.common_subsequences([], []).tolist() == []
