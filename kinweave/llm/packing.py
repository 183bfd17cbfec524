"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

Pieces are placed by descending size. Open bins are kept by residual capacity; a bitmap of the residuals in use
gives the successor of a size, and the search goes on from there until it meets the tightest bin without a
conflict. Every bin carries a bitmap of the sources that it takes no more of and one of the duplicate clusters in
it: a bin takes at most one document of a cluster, and of a source as many as its share of the words amounts to in a
bin of average documents, rounded up (so one of most sources, and a hot source doesn't force bins to stay empty);
per_source sets one number for all. A document of more than the capacity is cut into full pieces and a rest; full
pieces fill bins of their own and the rest is packed.

Documents are dealt into groups by a hash of id, text and copy number, about group_rows in each, so a hot
source or cluster is spread; bins don't cross groups and a group's memory is bounded. Equal rows are counted and
the counts numbered, in many tasks, before they are dealt.

Defined results: null text and a text without words have size 0 and one empty piece, which is packed like any
other; a null source conflicts with nothing; the cluster is that of the text in lower case with white space
removed (exact copies but for case and spacing); null texts and empty texts have no cluster; null ids are packed like
others; a very long text is cut into pieces of the capacity; repeated rows are numbered in `copy`; extra columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.runtime import Stash, importable, lookup, numbered, partitions, word_count


class BestFit:
    """Bins by residual, with the successor search."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.used = 0  # bit r: some open bin has residual r
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.taken: dict[tuple[int, int], int] = {}

    def place(self, size: int, source: int, cluster: int, most: int = 1) -> tuple[int, int]:
        """(bin, offset); source and cluster are bitmaps of one bit, or 0 for none; most: pieces of the source in a bin."""
        left = self.used >> size
        residual = size - 1
        while left:
            step = (left & -left).bit_length()
            residual += step
            left >>= step
            for at, b in enumerate(self.open[residual]):
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    self._take(residual, at)
                    return b, self._put(b, residual, size, source, cluster, most)
        b = len(self.sources)
        self.sources.append(0)
        self.clusters.append(0)
        return b, self._put(b, self.capacity, size, source, cluster, most)

    def _take(self, residual: int, at: int) -> None:
        self.open[residual].pop(at)
        if not self.open[residual]:
            self.used &= ~(1 << residual)

    def _put(self, b: int, residual: int, size: int, source: int, cluster: int, most: int) -> int:
        if source and most > 1:
            self.taken[b, source] = self.taken.get((b, source), 0) + 1
        if most <= 1 or self.taken.get((b, source), 0) >= most:
            self.sources[b] |= source
        self.clusters[b] |= cluster
        rest = residual - size
        self.open[rest].append(b)
        self.used |= 1 << rest
        return self.capacity - residual


def pack_group(pieces: Iterable[tuple[int, object, object, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (size, source, cluster, most of the source in a bin), given by descending size."""
    fit = BestFit(capacity)
    seen: dict[tuple[str, object], int] = {}

    def bit(kind: str, value: object) -> int:
        return 0 if value is None else 1 << seen.setdefault((kind, value), len(seen))

    return [fit.place(size, bit("s", source), bit("c", cluster), most) for size, source, cluster, most in pieces]


def pack(docs: DataFrame, capacity: int = 2048, group_rows: int = 2048, per_source: int | None = None, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, copy, piece, start, n_words, bin_id, bin_offset: where every piece of every row lies.

    start is the piece's first word in the document; bins are (group << 32) + number.
    """
    spark = docs.sparkSession
    importable(spark)
    stash = Stash(spark)
    body = F.lower(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", ""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.when(F.length(body) > 0, F.xxhash64(body)).alias("cluster"))
    # staged before it is numbered, so that the texts are read once
    counted = stash(rows.groupBy("doc_id", "source", "size", "cluster").agg(F.count(F.lit(1)).alias("n")))
    single = stash(numbered(counted))
    n_pieces = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("size") / capacity))
    n, words, pieces_in_all = single.agg(F.count(F.lit(1)), F.sum("size"), F.sum(n_pieces)).first()
    groups = max(1, round(n / group_rows))
    # words of a source / words of all, times pieces in a full bin of average pieces
    in_bin = capacity * (pieces_in_all or 0) / max(1, words or 0) ** 2
    fair = F.lit(per_source) if per_source else F.greatest(F.lit(1), F.ceil(F.sum("size") * F.lit(float(in_bin))).cast("int"))
    shares = stash(single.groupBy("source").agg(fair.alias("most"), F.count(F.lit(1)).alias("n")))
    order = F.xxhash64("doc_id", "source", "size", "cluster", "copy")
    dealt = lookup(single, shares, ["source"], "n", "inner").select(F.pmod(order, F.lit(groups)).cast("int").alias("group"), order.alias("order"), "doc_id", "copy", "source", "cluster", "most", "size")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1))
    pieces = dealt.withColumn("piece", piece).withColumn("start", F.col("piece") * capacity).withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start")))
    spread = min(groups, partitions(spark))
    placed = pieces.repartition(spread, "group").sortWithinPartitions("group", F.desc("n_words"), "order", "piece")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, copy long, piece long, start long, n_words long, bin_id long, bin_offset long"
    names = ["doc_id", "copy", "piece", "start", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def flush() -> pa.RecordBatch:
            table = pa.concat_tables(held).combine_chunks()
            held.clear()
            got = pack_group(zip(*(table[c].to_pylist() for c in ("n_words", "source", "cluster", "most")), strict=True), capacity)
            base = table["group"][0].as_py() << 32
            table = table.select(names).append_column("bin_id", pa.array([base + b for b, _ in got], pa.int64())).append_column("bin_offset", pa.array([o for _, o in got], pa.int64()))
            return table.to_batches()[0]

        for batch in batches:
            table = pa.Table.from_batches([batch])
            group = table["group"].combine_chunks().to_numpy(zero_copy_only=False)
            edges = [0, *((group[1:] != group[:-1]).nonzero()[0] + 1).tolist(), len(group)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and held[0]["group"][0].as_py() != group[a]:
                    yield flush()
                held.append(table.slice(a, b - a))
        if held:
            yield flush()

    return placed.mapInArrow(run, schema)
