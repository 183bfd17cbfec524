"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs (the parts between newlines, empty ones included). Each paragraph is
hashed to a wide vector and the vectors are summed modulo powers of two, so the sum doesn't depend on the order
of paragraphs, and inserting or deleting one adds or subtracts its vector. The vector has two parts:

- EQUAL lanes of 64 bits, from BLAKE2b of the paragraph, added modulo 2**64: equal multisets have equal sums, and
  two different ones agree with negligible probability;
- LIKE lanes of 32 bits, added modulo 2**32: for each word of the paragraph, the pair of it and the word before it
  has a hash of LIKE bits, read as +1 or -1 and summed over the words. With a and b the (signed) lanes of two
  texts, mean (a - b)**2 estimates the squared distance of their word-pair counts and mean a**2 + b**2 that of
  texts with nothing in common, so 1 - ratio, held within 0 and 1, is their likeness.

Defined results: null is the empty text (one empty paragraph); two texts of equal fingerprint have likeness 1;
with rows of one id, the next document is the next row by (id, two hashes of the text), so equal rows follow each
other; null ids come first; the only row of a table is its own next document; texts of any length are read whole;
extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.runtime import Stash, importable, lookup, numbered
from kinweave.llm.textarrays import CHUNK, U64, byte_rows, chunks, mix, seeded, word_hashes

EQUAL, LIKE = 8, 128
#: Text in a range of ids: RANGE_BYTES up to FEW ranges, then up to WIDE_BYTES; above RANGES ranges (about what one shuffle can
#: have, 6 TB) a range grows, to 1 GB at 100 TB; ranges are streamed. Rows sampled for the bounds at most.
RANGE_BYTES, FEW, WIDE_BYTES, RANGES, SAMPLE = 1 << 23, 4096, 1 << 26, 100_000, 400_000
Sums = tuple[np.ndarray, np.ndarray]


def _equal_lanes(parts: list[str]) -> np.ndarray:
    out = np.zeros((len(parts), EQUAL), np.uint64)
    for i, text in enumerate(parts):
        raw = b"".join(blake2b(p, digest_size=8 * EQUAL).digest() for p in text.encode("utf-8", "surrogatepass").split(b"\n"))
        out[i] = np.frombuffer(raw, np.uint64).reshape(-1, EQUAL).sum(axis=0, dtype=np.uint64)
    return out


def _word_lanes(parts: list[str]) -> np.ndarray:
    """For each text the sums of +1 and -1 over its words."""
    out = np.zeros((len(parts), LIKE), np.uint32)
    column = pa.array([p.encode("utf-8", "surrogatepass") for p in parts], pa.large_binary())
    data, offsets = byte_rows(column)
    for first, last in chunks(offsets, CHUNK >> 1):
        run = data[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        # paragraphs are the rows here, so that no pair of words spans two of them
        breaks = np.flatnonzero(run == 10) + 1
        edges = np.unique(np.concatenate([at, breaks])) if len(run) else np.zeros(1, np.int64)
        if len(edges) < 2:
            continue
        words, count = word_hashes_of_paragraphs(run, edges)
        owner = np.repeat(np.searchsorted(at, edges[:-1], "right") - 1, count)
        begins = (np.cumsum(count) - count)[count > 0]
        pairs = np.empty_like(words)
        pairs[1:] = words[:-1]
        pairs[begins] = 0
        pairs = mix(pairs * U64(0x9E3779B97F4A7C15) + words)
        for a in range(0, len(pairs), 1 << 16):
            part = pairs[a : a + (1 << 16)]
            rows = owner[a : a + (1 << 16)]
            bits = np.unpackbits(np.stack([seeded(part, k) for k in range(LIKE // 64)], axis=1).view(np.uint8), axis=1)
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            size = np.diff(np.append(starts, len(rows)))[:, None]
            out[first + rows[starts]] += (2 * ones - size).astype(np.uint32)
    return out


def word_hashes_of_paragraphs(run: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(run) <= 2 * CHUNK:
        return word_hashes(run, edges)
    hashes, counts = [], []
    for a, b in chunks(edges):
        h, c = word_hashes(run[edges[a] : edges[b]], edges[a : b + 1] - edges[a])
        hashes.append(h)
        counts.append(c)
    return np.concatenate(hashes), np.concatenate(counts)


def paragraph_sums(parts: list[str]) -> Sums:
    """The vectors of texts; those of the paragraphs of one text add up to its own."""
    return _equal_lanes(parts), _word_lanes(parts)


def plus(a: Sums, b: Sums) -> Sums:
    return a[0] + b[0], a[1] + b[1]


def minus(a: Sums, b: Sums) -> Sums:
    return a[0] - b[0], a[1] - b[1]


def likeness(a: Sums, b: Sums) -> np.ndarray:
    x, y = a[1].astype(np.int32).astype(np.float64), b[1].astype(np.int32).astype(np.float64)
    apart, alone = ((x - y) ** 2).sum(axis=1), (x**2).sum(axis=1) + (y**2).sum(axis=1)
    out = np.clip(1 - np.divide(apart, alone, out=np.ones_like(apart), where=alone > 0), 0, 1)
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    return np.where(same, 1.0, np.where(apart == 0, np.where(alone > 0, 1.0, 0.0), out))


def encoded(sums: Sums) -> list[str]:
    return [base64.b64encode(a.tobytes() + b.tobytes()).decode() for a, b in zip(*sums, strict=True)]


def decoded(values: list[str]) -> Sums:
    raw = [base64.b64decode(v) for v in values]
    return (
        np.stack([np.frombuffer(r, np.uint64, EQUAL) for r in raw]) if raw else np.zeros((0, EQUAL), np.uint64),
        np.stack([np.frombuffer(r, np.uint32, LIKE, 8 * EQUAL) for r in raw]) if raw else np.zeros((0, LIKE), np.uint32),
    )


def fingerprints(texts: list[str | None]) -> list[str]:
    return encoded(paragraph_sums([t or "" for t in texts]))


def edited_text(text: str, other: str) -> str:
    """The last quarter of the code points replaced by the first as many of another text."""
    k = len(text) // 4
    return text[: len(text) - k] + other[:k]


def _edit_rows(texts: list[str], others: list[str]) -> tuple[Sums, Sums, list[str]]:
    """Sums of the texts and of their edited texts: the changed paragraphs are deleted and the new ones inserted."""
    tails, news, heads, shas = [], [], [], []
    for text, other in zip(texts, others, strict=True):
        k = len(text) // 4
        cut = len(text) - k
        at = text.rfind("\n", 0, cut) + 1
        heads.append(text[: at - 1] if at else None)
        tails.append(text[at:])
        news.append(text[at:cut] + other[:k])
        shas.append(sha256((text[:cut] + other[:k]).encode("utf-8", "surrogatepass")).hexdigest())
    sums = paragraph_sums([*tails, *news, *(h or "" for h in heads)])
    n = len(texts)
    old, new, head = ((a[i : i + n], b[i : i + n]) for a, b in [sums] for i in (0, n, 2 * n))
    none = np.array([h is None for h in heads], bool)
    head[0][none] = 0
    head[1][none] = 0
    whole = plus(head, old)
    return whole, plus(minus(whole, old), new), shas


KEY = ["doc_id", "h1", "h2"]
OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def sort_keys(known: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Byte strings in the order of (known, id, hash)."""
    out = np.zeros((len(ids), 17), np.uint8)
    out[:, 0] = known
    for at, x in ((1, ids), (9, hashes)):
        out[:, at : at + 8] = (x.astype(np.int64).view(np.uint64) ^ U64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def _bounds(keys: DataFrame, buckets: int | None) -> np.ndarray:
    """First keys of the ranges, which hold about the same number of bytes; an id of many rows is split by its texts' hashes."""
    size, n = keys.agg(F.sum("n_bytes"), F.count(F.lit(1))).first()
    wanted = buckets or max(1, min(FEW, math.ceil(size / RANGE_BYTES)), min(RANGES, math.ceil(size / WIDE_BYTES)))
    share = min(1.0, min(SAMPLE, 64 * wanted) / n)
    taken = keys.where(F.col("h2") <= F.lit(int(-(2**63) + share * (2**64 - 1) * (1 - 1e-12)))) if share < 1 else keys
    got = taken.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h1", "n_bytes").toArrow()
    found = sort_keys(*(got[c].to_numpy() for c in ("known", "id", "h1")))
    order = np.argsort(found, kind="stable")
    weight = np.cumsum(got["n_bytes"].to_numpy()[order] + 64)
    if not len(weight) or wanted < 2:
        return found[:0]
    return np.unique(found[order][np.searchsorted(weight, weight[-1] * np.arange(1, wanted) / wanted)])


def _in_range(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf(T.IntegerType())
    def at(known: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, sort_keys(known.to_numpy(), ids.to_numpy(), hashes.to_numpy()), "right").astype(np.int32))

    return rows.withColumn("to", at(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.col("h1")))


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    Rows are dealt by ranges of (id, hash of text) of about RANGE_BYTES of text each, whose bounds come from a sample of
    narrow keys. The last row of a range needs its next document from the range after it: of that only as many
    characters as it takes over and the fingerprint are sent. Equal rows are counted: one of them goes into the ranges,
    the others have an equal row as their next document and are made where the count is. The text is moved once.
    """
    spark = docs.sparkSession
    importable(spark)
    stash = Stash(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("h1"), F.xxhash64(body, F.lit(1)).alias("h2"))
    narrow = rows.select(*KEY, F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_chars"))
    keys = stash(narrow.groupBy(*KEY, "n_bytes", "n_chars").agg(F.count(F.lit(1)).alias("n")))
    if not keys.limit(1).count():
        return spark.createDataFrame([], OUT)
    again = keys.where("n > 1").select(*KEY, F.col("n").alias("n_equal"))
    copies = None
    if again.limit(1).count():
        known = lookup(rows, stash(again), KEY, "n_equal")
        firsts = stash(known.where("n_equal is not null").groupBy(*KEY).agg(F.first("text").alias("text"), F.first("n_equal").alias("n_equal")))
        rows = known.where("n_equal is null").drop("n_equal").unionByName(firsts.drop("n_equal"))
        alone = firsts.select(F.lit(0).alias("to"), F.lit(False).alias("guest"), "doc_id", "text", F.lit(None).cast("string").alias("sums"), (F.col("n_equal") - 1).alias("times"))
        times = T.StructType([*OUT.fields, T.StructField("times", T.LongType())])
        copies = numbered(stash(alone.mapInArrow(_with_themselves, times)), "times").drop("copy")

    bounds = _bounds(keys, buckets)
    order = [F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), "h1", "h2"]
    ends = _in_range(keys, bounds).groupBy("to").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order, "n_chars")).alias("last")).orderBy("to").collect()
    # the first row of each range is a guest of the range before it; the last range is followed by the first
    hosts = [(r.to, after.first.id, after.first.h1, after.first.h2, r.last.n_chars // 4) for r, after in zip(ends, ends[1:] + ends[:1], strict=True)]
    wanted = F.broadcast(spark.createDataFrame(hosts, "to int, id long, g1 long, g2 long, k long"))
    guests = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    guests = guests.select("to", *KEY, "k", "text").mapInArrow(_guests, "to int, doc_id long, h1 long, h2 long, text string, sums string")
    dealt = _in_range(rows, bounds).select("to", F.lit(False).alias("guest"), *KEY, "text", F.lit(None).cast("string").alias("sums"))
    dealt = dealt.unionByName(guests.select("to", F.lit(True).alias("guest"), *KEY, "text", "sums"))
    ordered = dealt.repartitionById(len(bounds) + 1, "to").sortWithinPartitions("to", "guest", F.col("doc_id").asc_nulls_first(), "h1", "h2")
    out = ordered.select("to", "guest", "doc_id", "text", "sums").mapInArrow(_pairs, OUT)
    return out if copies is None else out.unionByName(copies)


def _guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first k characters of each text, and the whole text's sums."""
    for batch in batches:
        texts, takes = batch.column(5).to_pylist(), batch.column(4).to_pylist()
        for i in range(len(texts)):
            part = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(4)), pa.array([texts[i][: takes[i]]], pa.string()), pa.array(fingerprints([texts[i]]), pa.string())], ["to", *KEY, "text", "sums"])


def _results(ids: list, texts: list[str], others: list[str], nexts: list[Sums | None]) -> pa.RecordBatch:
    """The result rows of texts and their next texts (of which others may hold the start alone, if nexts has their sums)."""
    whole, edited, shas = _edit_rows(texts, others)
    following = tuple(np.zeros_like(x) for x in whole)
    new = []
    for i, given in enumerate(nexts):
        if given is None and i + 1 < len(texts) and others[i] is texts[i + 1]:
            given = whole[0][i + 1], whole[1][i + 1]
        if given is None:
            new.append(i)
        else:
            following[0][i], following[1][i] = given
    if new:
        for lanes, got in zip(following, paragraph_sums([others[i] for i in new]), strict=True):
            lanes[new] = got
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array(shas, pa.string()),
            pa.array(encoded(whole), pa.string()),
            pa.array(encoded(edited), pa.string()),
            pa.array(likeness(whole, edited)),
            pa.array(likeness(whole, following)),
        ],
        OUT.names,
    )


def _with_themselves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose next document is an equal one."""
    for batch in batches:
        for i in range(len(batch)):
            text = batch.column(3)[i].as_py()
            got = _results(batch.column(2)[i : i + 1].to_pylist(), [text], [text], [None])
            yield pa.RecordBatch.from_arrays([*got.columns, batch.column(5)[i : i + 1]], [*OUT.names, "times"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next of its range, a few megabytes at a time."""
    ids: list = []
    texts: list[str] = []
    others: list[str] = []
    nexts: list[Sums | None] = []
    last: tuple | None = None
    size = 0
    for batch in batches:
        for to, guest, doc_id, text, sums in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if last is not None and last[0] == to and not last[1]:
                ids.append(last[2])
                texts.append(last[3])
                others.append(text)
                nexts.append(tuple(x[0] for x in decoded([sums])) if guest else None)
                size += len(last[3])
                if size >= CHUNK:
                    yield _results(ids, texts, others, nexts)
                    ids, texts, others, nexts, size = [], [], [], [], 0
            last = (to, guest, doc_id, text)
    if texts:
        yield _results(ids, texts, others, nexts)
