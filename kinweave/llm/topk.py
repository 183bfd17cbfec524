"""Exact top-k search by inner product over norm-sorted blocks.

Vectors are scaled to integers and cut into blocks by descending length. An orthogonal rotation from the singular
vectors of all vectors (the eigenvectors of their d x d Gram matrix) puts most of a product into the leading
coordinates. Blocks are written once and stay where they are; queries come to them in waves of bounded size. A wave
meets the block of the longest vectors first, which gives each query its k-th best score so far; then every task reads
its blocks by descending length, skips those that no query can gain from (query's length times the block's greatest
length is below the score) and carries its best k from block to block. Inside a block, vectors are taken by descending
length in strips; a strip ends the search of a query once Cauchy-Schwarz on the whole lengths rules out the rest, and a
vector is scored only if its partial product over the leading coordinates plus the product of the residual lengths can
reach the k-th best score. Scores are integers, so nothing depends on rounding: bounds are widened by more than their
error, and products beyond 53 bits are made of exact products of parts.

What the driver holds doesn't grow with the rows: at most RANGES bounds of lengths and their counts, a d x d matrix,
one wave of queries.

Defined results: vectors that are null or hold a null or non-finite component take no part; a shorter vector is
continued by zeros; an empty vector scores 0; rows with the query's own id are no candidates, other repeated rows are
candidates each; a query that stands in several rows is answered for each of them; equal scores go to the smaller id;
ids that are null take no part. Scores beyond 64 bits are held at the limits of 64 bits, before they are ranked. Extra
columns are ignored, whatever their names; a table without queries or vectors gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.runtime import Stash, importable, range_index

LEADING, STRIP, QUERY_ROWS = 16, 512, 256
#: Vectors in a block: about 1/64 of all within these bounds.
SMALL, LARGE = 512, 8192
#: Ranges of length, at most; a range of more vectors than a block holds is dealt into several blocks.
RANGES = 1024
#: Bytes of the queries in a wave.
WAVE = 1 << 25
BITS = 53
FOUND = "query long, query_id long, vec_id long, score long"


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * component), or null if the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(vectors: DataFrame, width: int, longest: float) -> np.ndarray:
    """Right singular vectors of all rows, by descending singular value."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width) / max(longest, 1.0)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["cell", "value"])

    sums = vectors.select("vector").mapInArrow(gram, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width * width)
    for r in sums:
        out[r.cell] = r.value
    return np.linalg.eigh(out.reshape(width, width))[1][:, ::-1]


def _parts(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integer-valued doubles as sums of part[i] * 2**(bits * i), each part below 2**bits."""
    out = []
    while x.any():
        out.append(np.fmod(x, 2.0**bits))
        x = (x - out[-1]) / 2.0**bits
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows, within 64 bits: doubles, or Python integers where doubles can't hold them."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**BITS:
        return a @ b.T
    bits = (BITS - 1 - int(a.shape[1]).bit_length()) // 2
    total = np.zeros((len(a), len(b)), object)
    for i, x in enumerate(_parts(a, bits)):
        for j, y in enumerate(_parts(b, bits)):
            total += (x @ y.T).astype(np.int64).astype(object) * (1 << bits * (i + j))
    return np.minimum(2**63 - 1, np.maximum(-(2**63), total))


class Wave:
    """A set of queries with their k best so far; blocks come one after another."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, turn: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.floor, self.turn, self.k = ids, vectors, floor.copy(), turn, k
        self.lead = min(LEADING, vectors.shape[1])
        self.turned = vectors @ turn
        self.norm = np.sqrt((self.turned**2).sum(axis=1))
        self.rest = np.sqrt((self.turned[:, self.lead :] ** 2).sum(axis=1))
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

    def meet(self, c_ids: np.ndarray, c: np.ndarray, longest: float) -> None:
        """The block's vectors, by descending length."""
        live = np.flatnonzero(self.norm * longest * (1 + 1e-9) + 1e-6 >= self.floor)
        if not len(live):
            return
        cr = c @ self.turn
        norm, rest = np.sqrt((cr**2).sum(axis=1)), np.sqrt((cr[:, self.lead :] ** 2).sum(axis=1))
        for at in range(0, len(live), QUERY_ROWS):
            self._search(live[at : at + QUERY_ROWS], c_ids, c, cr, norm, rest)

    def _search(self, queries: np.ndarray, c_ids: np.ndarray, c: np.ndarray, cr: np.ndarray, norm: np.ndarray, rest: np.ndarray) -> None:
        slack = 1e-9 * self.norm[queries] * (norm.max(initial=0) + 1) + 1e-6
        for at in range(0, len(c_ids), STRIP):
            strip = slice(at, at + STRIP)
            on = self.norm[queries] * norm[strip].max(initial=0) + slack >= self.floor[queries]
            queries, slack = queries[on], slack[on]
            if not len(queries):
                return
            floor = self.floor[queries]
            bound = self.turned[queries, : self.lead] @ cr[strip, : self.lead].T + self.rest[queries, None] * rest[None, strip] + slack[:, None]
            can = (bound >= floor[:, None]) & (self.ids[queries, None] != c_ids[None, strip])
            columns = np.flatnonzero(can.any(axis=0))
            if not len(columns):
                continue
            ids, can = c_ids[strip][columns], can[:, columns]
            scores = products(self.vectors[queries], c[strip][columns])
            can &= (scores >= floor[:, None]).astype(bool)
            for row in np.flatnonzero(can.any(axis=1)).tolist():
                self._keep(int(queries[row]), ids[can[row]], scores[row, can[row]])

    def _keep(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.best[i][0], ids]), np.concatenate([self.best[i][1], scores])
        order = np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))) if scores.dtype == object else np.lexsort((ids, -scores))
        order = order[: self.k]
        self.best[i] = ids[order], scores[order]
        if len(order) == self.k:
            low = scores[order[-1]]
            exact = float(low)
            self.floor[i] = max(self.floor[i], exact if abs(exact) < 2.0**BITS else np.nextafter(exact, -np.inf))


def _vectors(data: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, width)


def _packed(rows: DataFrame, key: str, width: int) -> DataFrame:
    """One row per value of key, with the ids and vectors of the group by descending length, and the greatest length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> pa.RecordBatch:
            t = pa.concat_tables(held).combine_chunks()
            held.clear()
            data = _matrix(t["vector"].combine_chunks(), width)
            ids = t["vec_id"].to_numpy()
            norm = np.sqrt((data**2).sum(axis=1))
            order = np.lexsort((ids, -norm))
            return pa.RecordBatch.from_arrays([pa.array([t[key][0].as_py()], pa.int64()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([data[order].tobytes()], pa.binary()), pa.array([float(norm.max(initial=0))])], [key, "ids", "data", "longest"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            value = t[key].to_numpy()
            edges = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), len(value)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and held[0][key][0].as_py() != value[a]:
                    yield flush()
                held.append(t.slice(a, b - a))
        if held:
            yield flush()

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(pack, f"{key} long, ids binary, data binary, longest double")


def _met(blocks: DataFrame, held, width: int, k: int, floors_only: bool) -> DataFrame:
    """The best k of each task's blocks for each query of the wave; or the score of the k-th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave = Wave(*held.value, k)
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                wave.meet(ids, _vectors(row["data"], width, len(ids)), row["longest"])
        took = [b[-1:] if floors_only and len(b) == k else b[:0] if floors_only else b for b, _ in wave.best]
        scores = [int(s) for b, (_, x) in zip(took, wave.best, strict=True) for s in (x[-1:] if floors_only else x)[: len(b)]]
        owner = np.repeat(np.arange(len(took)), [len(b) for b in took])
        found = np.concatenate([np.zeros(0, np.int64), *took]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (owner, wave.ids[owner], found, scores)], ["query", "query_id", "vec_id", "score"])

    return blocks.select("ids", "data", "longest").mapInArrow(run, FOUND)


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """The rows with block: 0 for the longest vectors; what lies in one range of length is dealt by the row's number."""
    size = min(LARGE, max(SMALL, n // 64))
    wanted = min(RANGES, max(1, round(n / size)))
    cuts = sorted(set(rows.approxQuantile("length", [i / wanted for i in range(1, wanted)], 0.1 / wanted))) if wanted > 1 else []
    ranged = rows.withColumn("range", (F.lit(len(cuts)) - range_index(F.col("length"), cuts)).cast("int"))
    counts = sorted((r.range, r["count"]) for r in ranged.groupBy("range").count().collect())
    first, split, start = [], [], 0
    for r, c in counts:
        parts = max(1, round(c / size))
        first += [F.lit(r), F.lit(start).cast("long")]
        split += [F.lit(r), F.lit(parts).cast("long")]
        start += parts
    return ranged.withColumn("block", F.create_map(*first)[F.col("range")] + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.create_map(*split)[F.col("range")]))


def top_inner_products(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every row that meets `queries`."""
    spark = vectors.sparkSession
    importable(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), scaled(F.col(vector), scale).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")).where("vec_id is not null and vector is not null")
    rows = rows.withColumn("length", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))
    n, n_queries, width, longest = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("vector")), F.max("length")).first()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(rows, width, longest) if width else np.zeros((0, 0))
    stash = Stash(spark)
    blocks = stash(_packed(_blocks(rows, n).select("block", "vec_id", "vector"), "block", width))
    # a query is a row: rows are dealt by their numbers, so that those of one id needn't lie together
    groups = -(-n_queries // QUERY_ROWS)
    asked = rows.where("asks").select("vec_id", "vector", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("query_set"))
    sets = stash(_packed(asked, "query_set", width))
    waves = max(1, -(-n_queries * 8 * max(1, width) // WAVE))
    step = -(-groups // waves)
    paths, number = [], 0
    for first in range(0, groups, step):
        got = sets.where((F.col("query_set") >= first) & (F.col("query_set") < first + step)).select("ids", "data").collect()
        if not got:
            continue
        ids = np.concatenate([np.frombuffer(r.ids, np.int64) for r in got])
        matrix = np.concatenate([_vectors(r.data, width, len(r.ids) // 8) for r in got])
        del got
        floor = np.full(len(ids), -np.inf)
        held = spark.sparkContext.broadcast((ids, matrix, floor, turn))
        for r in _met(blocks.where("block = 0"), held, width, k, True).collect():
            floor[r.query] = r.score if abs(r.score) < 2**BITS else np.nextafter(float(r.score), -np.inf)
        held.destroy()
        held = spark.sparkContext.broadcast((ids, matrix, floor, turn))
        paths.append(stash(_met(blocks, held, width, k, False).withColumn("query", F.col("query") + number)).stash_path)
        held.destroy()
        number += len(ids)
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = spark.read.schema(FOUND).parquet(*paths).withColumn("rank", F.row_number().over(by_score))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
