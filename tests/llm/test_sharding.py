from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kinweave.llm import sharding as sh
from kinweave.llm.runtime import Stash


def extendible(rows, limit):
    """Splitting one bucket after another, from a single bucket on."""
    todo, done = [(0, 0, rows)], {}
    while todo:
        depth, prefix, held = todo.pop()
        if not held:
            continue
        if sum(b for _, b in held) <= limit or len(held) == 1 or depth == sh.BITS:
            done[(1 << depth) | prefix] = (depth, sum(b for _, b in held), len(held))
            continue
        for bit in (0, 1):
            todo.append((depth + 1, prefix << 1 | bit, [(h, b) for h, b in held if h >> (sh.BITS - depth - 1) & 1 == bit]))
    return done


def test_directory_equals_repeated_splitting(spark):
    rows = spark.range(3000).select(F.call_function("shiftrightunsigned", F.xxhash64("id"), F.lit(2)).alias("hash"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(900)) + 1).alias("n_bytes"))
    held = [(r.hash, r.n_bytes) for r in rows.collect()]
    for limit in (10**9, 40_000, 2_000, 500):
        got = {r.shard: (r.depth, r.shard_bytes, r.shard_rows) for r in sh.directory(rows, limit, Stash(spark)).collect()}
        assert got == extendible(held, limit)


def test_close_hashes_need_further_rounds(spark):
    held = [((5 << 40) + i, 10) for i in range(20)] + [(i << 55, 10) for i in range(60)]
    rows = spark.createDataFrame(held, "hash long, n_bytes long")
    got = {r.shard: (r.depth, r.shard_bytes, r.shard_rows) for r in sh.directory(rows, 30, Stash(spark)).collect()}
    assert got == extendible(held, 30)


def test_every_row_is_in_one_shard_that_fits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    limit = 60_000
    got = sh.assign(docs, limit).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    size, rows = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.n_bytes
        rows[r.shard].append(r)
    for shard, own in rows.items():
        assert size[shard] == own[0].shard_bytes and (size[shard] <= limit or len(own) == 1)
        assert all(r.oversize == (size[shard] > limit) for r in own)
    assert sum(r.n_bytes for r in got) == docs.agg(F.sum(F.octet_length("text"))).first()[0]


def test_equal_rows_can_be_split(spark):
    rows = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    got = sh.assign(rows, 100).collect()
    assert sorted(r.copy for r in got) == list(range(300)) and max(r.shard_bytes for r in got) <= 100


def test_odd_rows(odd_docs, no_docs):
    got = sh.assign(odd_docs, 200).collect()
    assert len(got) == odd_docs.count() and {r.n_bytes for r in got if r.doc_id in (3, 4)} == {0}
    assert {r.oversize for r in got if r.doc_id in (7, 9)} == {True}
    assert sh.assign(no_docs, 100).count() == 0


def test_written_shards_hold_every_row_and_fit(spark, odd_docs, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(20))
    shards = sh.write_shards(docs, 40_000, str(tmp_path / "out")).collect()
    back = spark.read.parquet(str(tmp_path / "out"))
    size = {r.shard: (r.b, r.n) for r in back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()}
    assert size == {r.shard: (r.shard_bytes, r.shard_rows) for r in shards}
    assert all(b <= 40_000 or n == 1 for b, n in size.values())
    assert back.drop("shard").exceptAll(docs).count() == docs.exceptAll(back.drop("shard")).count() == 0
    odd = sh.write_shards(odd_docs, 200, str(tmp_path / "odd")).collect()
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert set(back.columns) == {*odd_docs.columns, "shard_"} and back.drop("shard_").select(odd_docs.columns).exceptAll(odd_docs).count() == 0 == odd_docs.exceptAll(back.select(odd_docs.columns)).count()
    assert {r.shard_ for r in back.select("shard_").distinct().collect()} == {r.shard for r in odd}


def test_a_million_equal_rows(spark):
    rows = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    got = sh.assign(rows, 9_000)
    assert got.select("copy").distinct().count() == 1_000_000 and got.agg(F.min("copy"), F.max("copy")).first() == (0, 999_999)
    sums = got.groupBy("shard", "shard_bytes").agg(F.sum("n_bytes").alias("b")).collect()
    assert max(r.b for r in sums) <= 9_000 and all(r.b == r.shard_bytes for r in sums)


def test_very_long_texts(spark):
    rows = spark.createDataFrame([(i, "long word " * (200_000 if i < 3 else 2)) for i in range(30)], "doc_id long, text string")
    got = sh.assign(rows, 100_000).collect()
    assert len(got) == 30 and sorted(r.doc_id for r in got if r.oversize) == [0, 1, 2] and max(r.n_bytes for r in got) == 2_000_000
