import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from kinweave.llm import mixing, queries, runtime


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing what is left among the sources below their caps, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {s: 0.0 for s in sizes}, set(sizes), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s] + 1e-9}
        if not over:
            for s in open_:
                target[s] = weight[s] * level
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 500, "c": 20, "d": 3, "e": 7, None: 11}, {"x": 0, "y": 9}, {"only": 5}, {"é": 4, "z": 100, "Z": 1, "": 30}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = water(sizes)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def brute(rows, columns, text="text", source="source"):
    """(row, size, source size, target, copies) of each row, given as dicts."""
    totals, seen, out = Counter(), Counter(), []
    for r in rows:
        totals[r[source]] += len((r[text] or "").split())
    want = water(dict(totals))
    for r in rows:
        key = md5(":".join("" if r[c] is None else md5(str(r[c])) for c in sorted(columns)))
        rate = want[r[source]] / totals[r[source]] if totals[r[source]] else 0.0
        draw = int(md5(f"17:{key}:{seen[key]}")[:13], 16) / 16**13
        seen[key] += 1
        out.append((r, len((r[text] or "").split()), totals[r[source]], want[r[source]], int(rate) + (draw < rate - int(rate))))
    return out


@pytest.mark.parametrize("small", [100_000, 0])
def test_equals_brute_force(spark, odd_docs, no_docs, monkeypatch, small):
    monkeypatch.setattr(runtime, "SMALL_TABLE", small)
    docs = odd_docs.unionByName(odd_docs.where("doc_id in (1, 6, 9)")).unionByName(odd_docs.where("doc_id = 1"))
    rows = [r.asDict() for r in docs.collect()]
    want = brute(rows, docs.columns)
    mix = mixing.Mix(docs)
    got = [tuple(r) for r in mix.shares().collect()]
    assert Counter((i, n, s, round(t, 6), c) for i, n, s, t, c in got) == Counter((r["doc_id"], n, s, round(t, 6), c) for r, n, s, t, c in want)
    assert all(r[4] <= 3 for r in got)
    out = mix.rows()
    assert out.columns == docs.columns
    taken = Counter()
    for r, *_, c in want:
        taken[tuple(r.values())] += c
    assert Counter(tuple(r) for r in out.collect()) == +taken
    assert mixing.Mix(no_docs).shares().count() == 0 and mixing.Mix(no_docs).rows().count() == 0


def spread(rows):
    """By source: (taken, target, standard deviation of the draws)."""
    out = defaultdict(lambda: [0, 0.0, 0.0])
    for r in rows:
        rate = r.target / r.source_size if r.source_size else 0.0
        out[r.source][0] += r.taken
        out[r.source][1] = r.target
        out[r.source][2] += r.size**2 * (rate % 1) * (1 - rate % 1)
    return {s: (a, b, math.sqrt(v)) for s, (a, b, v) in out.items()}


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_taken_words_come_near_the_targets(spark, sf):
    """Within four standard deviations of the independent draws, which shrink against the target as a source grows."""
    folder = f"/root/testdata/sf{sf}"
    rows = queries.op9_mixing(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source"), "doc_id")
    for taken, target, sd in spread(rows.collect()).values():
        assert abs(taken - target) <= 4 * sd + 1e-6


@pytest.mark.parametrize("same_text", [True, False])
def test_rows_of_one_id_draw_apart(spark, tmp_path, same_text):
    rows = [(7, "one two three four five six seven eight" + ("" if same_text else f" {i}"), "en", "a", 40) for i in range(1000)]
    rows += [(100 + i, "other words " * 4, "en", "b", 48) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_mixing(spark, str(tmp_path)).collect()
    hot = [r for r in got if r.doc_id == 7]
    assert len(got) == 2000 and len(hot) == 1000
    assert sum(r.taken for r in hot) == pytest.approx(hot[0].target, rel=0.05)
    again = queries.op9_mixing(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    duckdb.sql(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert Counter(duckdb.sql(queries.MIXING_SQL).fetchall()) == Counter(map(tuple, got))


def test_a_million_equal_rows(spark):
    frame = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.when(F.col("id") < 0, "x").otherwise("a").alias("source"))
    frame = frame.unionByName(spark.range(10).select(F.col("id").alias("doc_id"), F.lit("w " * 100_000).alias("text"), F.lit("b").alias("source")))
    mix = mixing.Mix(frame)
    got = mix.shares().groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.count("*").alias("n")).collect()
    hot = next(r for r in got if r.n == 1_000_000)
    assert hot.taken == pytest.approx(hot.target, rel=0.01)
    assert mix.rows().where("source = 'a'").count() * 2 == hot.taken


def test_no_python_in_the_plan(spark, capsys):
    queries.op9_mixing(spark, "/root/testdata/sf0.001").explain()
    mixing.Mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).rows().explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
