"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document is the set of 64-bit hashes of its word shingles. Its sketch (Dahlgaard, Knudsen and Thorup's fast
similarity sketching) has t coordinates, filled in rounds: in round i < t every element falls into a hashed bin
with a hashed value; in round t + j every element falls into bin j. A coordinate is the least (round, value) that
reached it, so all are filled after 2t rounds at most, and usually after about t ln t / n of them.

Documents of equal sets form one class, of which the smallest id stands for all. Bands of coordinates put
representatives into buckets; the number of bands follows from the similarity, so that a pair at the threshold is
missed with probability below `miss`. A pair is a candidate if it shares a bucket, and every candidate pair whose ends
aren't connected otherwise is compared on the full sets:

- stars: each bucket's members are compared with one of them, the hub. Links found are contracted to components. Large
  buckets that still hold several components get further stars with other hubs, each compared only with members of
  other components. A cluster of near copies is settled by these, in work that grows with its size;
- blocks: in what buckets are left with several components, members are cut into blocks, a large component into blocks
  of its own. Each pair of blocks but those of one component is a task of bounded size, which compares all its pairs of
  different components as products of membership matrices and returns a spanning forest of the links.

The components of all links are the result; links inside a component add nothing, so leaving them out loses none.

Defined results: null and word-less texts have empty sets and link with nothing; fewer words than a shingle make
one shingle of them all; rows of one id are one document with the links of each; rows without an id get a null
component and are kept; texts of any length are read whole; extra columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.components import components
from kinweave.llm.runtime import Stash, importable, lookup
from kinweave.llm.textarrays import FOLD, U64, byte_rows, chunks, mix, seeded, word_hashes

ROWS = 5
#: Members of a star's task, and of a block.
STAR, BLOCK = 256, 256
#: Buckets of more members than this get up to ROUNDS stars before blocks.
LARGE, ROUNDS = 64, 3
#: Documents to compare up to which their ids and tasks are broadcast to the second scan, and tasks of all of them.
BROADCAST_IDS, BROADCAST_TASKS = 150_000, 600_000
FULL = U64(0xFFFFFFFFFFFFFFFF)
_seeds: dict[int, np.ndarray] = {}


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = byte_rows(column)
    data = FOLD[data]
    factors = [U64(int(mix(np.array([k + 1], np.uint64))[0]) | 1) for k in range(width)]
    for first, last in chunks(offsets):
        words, count = word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        n = max(0, len(words) - width + 1)
        whole = np.zeros(n, np.uint64)
        for k, f in enumerate(factors):
            whole += words[k : k + n] * f
        whole = mix(whole)
        at = 0
        for c in count.tolist():
            if c >= width:
                yield np.unique(whole[at : at + c - width + 1])
            elif c:
                yield mix(np.array([sum(int(w) * int(f) for w, f in zip(words[at : at + c], factors, strict=False)) + c & int(FULL)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += c


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """t coordinates (round << 32 | value) of a non-empty set."""
    if t not in _seeds:
        _seeds[t] = seeded(np.arange(2 * t, dtype=np.uint64), 1)
    seeds, out, n = _seeds[t], np.full(t, FULL), len(elements)
    step = max(1, math.ceil(1.5 * t * math.log(t + 1) / n))
    for first in range(0, 2 * t, step):
        rounds = np.arange(first, min(first + step, 2 * t), dtype=np.uint64)
        hashes = mix(elements[None, :] ^ seeds[first : first + len(rounds), None])
        bins = (hashes >> U64(32)) * U64(t) >> U64(32)
        bins[rounds >= t] = (rounds[rounds >= t] - U64(t))[:, None]
        keys = (rounds << U64(32))[:, None] | (hashes & U64(0xFFFFFFFF))
        np.minimum.at(out, bins.ravel().astype(np.int64), keys.ravel())
        if (out != FULL).all():
            break
    return out


def band_count(similarity: Fraction, rows: int = ROWS, miss: float = 1e-7) -> int:
    """Bands of so many rows that miss a pair of this similarity with at most this probability."""
    return math.ceil(math.log(miss) / math.log(1 - float(similarity) ** rows))


def bands(elements: np.ndarray, count: int, rows: int = ROWS) -> np.ndarray:
    parts = sketch(elements, count * rows).reshape(count, rows)
    out = np.arange(1, count + 1, dtype=np.uint64)
    for k in range(rows):
        out = mix(out * U64(0x9E3779B97F4A7C15) + parts[:, k])
    return out.view(np.int64)


def linked(sets: list[np.ndarray], similarity: Fraction) -> np.ndarray:
    """Matrix of the pairs whose intersection is at least similarity times their union, on the full sets."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    width = int(shared.sum())
    common = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(256, (1 << 22) // m)
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((m, min(step, width - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    both = common.astype(np.int64)
    return similarity.denominator * both >= similarity.numerator * (size[:, None] + size[None, :] - both)


def forest(matrix: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the matrix connects, fewer than it has rows."""
    out, todo = [], set(range(len(matrix)))
    while todo:
        stack = [todo.pop()]
        while stack:
            a = stack.pop()
            for b in np.flatnonzero(matrix[a]).tolist():
                if b in todo:
                    todo.discard(b)
                    stack.append(b)
                    out.append((a, b))
    return out


def _sketches(rows: DataFrame, width: int, count: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, low, high, keys = [], [], [], []
            for s in shingle_sets(batch.column(1), width):
                sizes.append(len(s))
                low.append(int(seeded(s, 2).sum(dtype=np.uint64).view(np.int64)))
                high.append(int(seeded(s, 3).sum(dtype=np.uint64).view(np.int64)))
                keys.append(bands(s, count) if len(s) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, low, high)), lists], ["doc_id", "n_shingles", "low", "high", "bands"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, low long, high long, bands array<long>")


def _sets(rows: DataFrame, tasks: DataFrame, width: int, stash: Stash) -> DataFrame:
    """task, role, label, doc_id and elements of each of the tasks' (doc_id, task, role, label); a set is made once and dealt to its tasks."""
    wanted = stash(tasks.groupBy("doc_id").agg(F.collect_list(F.struct("task", "role", "label")).alias("tasks")))
    n, most = wanted.agg(F.count(F.lit(1)), F.sum(F.size("tasks"))).first()
    few = n <= BROADCAST_IDS and (most or 0) <= BROADCAST_TASKS

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(2), width)]
            # equal rows of one id are dealt once by each task
            keys = [(i, hash(s)) if s else None for i, s in zip(batch.column(0).to_pylist(), sets, strict=True)]
            new = [k for k, key in enumerate(keys) if key and key not in seen and not seen.add(key)]
            part = batch.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([sets[k] for k in new], pa.binary())], ["doc_id", "tasks", "elements"])

    kind = "array<struct<task:long,role:int,label:long>>"
    met = rows.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "tasks", "text")
    sets = met.mapInArrow(full_sets, f"doc_id long, tasks {kind}, elements binary").select("doc_id", "elements", F.explode("tasks").alias("t"))
    return sets.select("t.task", "t.role", "t.label", "doc_id", "elements")


def _compared(dealt: DataFrame, compare) -> DataFrame:
    """Links (a, b) that compare(ids, roles, labels, sets) finds in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, roles, labels, held = None, [], [], [], []
        found: list[tuple[int, int]] = []
        for batch in batches:
            own, role, label, doc_id = (batch.column(k).to_pylist() for k in range(4))
            for k, raw in enumerate(batch.column(4)):
                if own[k] != task:
                    found += compare(ids, roles, labels, held)
                    task, ids, roles, labels, held = own[k], [], [], [], []
                ids.append(doc_id[k])
                roles.append(role[k])
                labels.append(label[k])
                held.append(np.frombuffer(raw.as_buffer(), np.uint64).copy())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                found = []
        found = compare(ids, roles, labels, held)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    ordered = dealt.repartition("task").sortWithinPartitions("task", "role", "doc_id")
    return ordered.mapInArrow(run, "a long, b long")


def star_links(ids: list[int], roles: list[int], held: list[np.ndarray], similarity: Fraction) -> list[tuple[int, int]]:
    """Links of the sets of role 0, the hub's (one for each text of its id), with the others."""
    out = []
    hubs = roles.count(0)
    for i in range(hubs, len(ids)):
        for hub in held[:hubs]:
            common = int((hub[np.minimum(np.searchsorted(hub, held[i]), len(hub) - 1)] == held[i]).sum())
            if similarity.denominator * common >= similarity.numerator * (len(hub) + len(held[i]) - common) and ids[i] != ids[0]:
                out.append((ids[0], ids[i]))
                break
    return out


def block_links(ids: list[int], labels: list[int], held: list[np.ndarray], similarity: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different labels."""
    if len(ids) < 2:
        return []
    of = np.array(labels)
    matrix = linked(held, similarity) & (of[:, None] != of[None, :])
    return [(ids[a], ids[b]) for a, b in forest(matrix) if ids[a] != ids[b]]


def _star_tasks(pairs: DataFrame) -> DataFrame:
    """Tasks of distinct (hub, rep): at most about STAR members each, with the hub."""
    parts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("parts"))
    label = F.lit(0).cast("long").alias("label")
    members = pairs.join(parts, "hub").select(F.col("rep").alias("doc_id"), F.xxhash64("hub", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("task"), F.lit(1).alias("role"), label)
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return members.unionByName(hubs.select(F.col("hub").alias("doc_id"), F.xxhash64("hub", "part").alias("task"), F.lit(0).alias("role"), label))


def _block_tasks(members: DataFrame, stash: Stash) -> DataFrame:
    """Tasks of (band, rep, label): pairs of blocks of a bucket, without those of one component."""
    counts = members.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("band").agg(F.sum(F.when(F.col("n") < BLOCK, F.col("n")).otherwise(0)).alias("mixed"))
    own = counts.join(sizes, "band").select("band", "label", F.when(F.col("n") >= BLOCK, F.col("label")).alias("pure"), F.greatest(F.lit(1), F.ceil(F.when(F.col("n") >= BLOCK, F.col("n")).otherwise(F.col("mixed")) / BLOCK)).alias("parts"))
    placed = stash(members.join(own, ["band", "label"]).withColumn("block", F.xxhash64("band", F.coalesce("pure", F.lit(-1)), F.pmod(F.xxhash64("rep"), F.col("parts")))))
    blocks = placed.select("band", "block", "pure").distinct()
    other = blocks.select("band", F.col("block").alias("other"), F.col("pure").alias("other_pure"))
    pairs = blocks.join(other, "band").where("block <= other and not coalesce(pure = other_pure, false)").select("band", "block", "other", F.xxhash64("block", "other").alias("task"))
    tasks = pairs.select("band", "block", "task").unionByName(pairs.where("block <> other").select("band", F.col("other").alias("block"), "task"))
    return placed.join(tasks, ["band", "block"]).select(F.col("rep").alias("doc_id"), "task", F.lit(1).alias("role"), "label")


def _links(rows: DataFrame, classes: DataFrame, width: int, similarity: Fraction, stash: Stash) -> DataFrame | None:
    """Links (a, b) that connect what candidate pairs of representatives connect; None without any candidates."""
    keyed = classes.select("rep", F.explode("bands").alias("band")).distinct()
    buckets = stash(keyed.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    if not buckets.limit(1).count():
        return None
    members = stash(lookup(keyed, buckets, ["band"], "n", "inner").select("band", "rep", "hub", "n"))

    def stars(pairs: DataFrame) -> DataFrame:
        dealt = _sets(rows, _star_tasks(stash(pairs.where("rep <> hub").select("hub", "rep").distinct())), width, stash)
        return stash(_compared(dealt, lambda ids, roles, labels, held: star_links(ids, roles, held, similarity)))

    links = stars(members)
    turn = 1
    while True:
        labels = components(links, stash)
        known = members.select("band", "rep", "hub", "n").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("band", "rep", "hub", "n", F.coalesce("component", "rep").alias("label"))
        # the first hub has met all members of its bucket, so its own pairs are done
        open_ = known.where("rep <> hub").groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.min_by("rep", F.xxhash64("rep", F.lit(turn))).alias("next_hub"))
        # buckets of the same members are one
        open_ = open_.where("low <> high").groupBy("members", "x", "y", "next_hub").agg(F.min("band").alias("band"))
        open_ = stash(open_)
        if not open_.limit(1).count():
            return links
        large = open_.where(F.col("members") > LARGE)
        left = lookup(known.where("rep <> hub").select("band", "rep", "label"), open_.select("band", "members", "next_hub"), ["band"], "members", "inner")
        if turn >= ROUNDS or not large.limit(1).count():
            dealt = _sets(rows, _block_tasks(left.select("band", "rep", "label"), stash), width, stash)
            return links.unionByName(stash(_compared(dealt, lambda ids, roles, labels, held: block_links(ids, labels, held, similarity))))
        hub_label = labels.select(F.col("node").alias("next_hub"), F.col("component").alias("hub_label"))
        far = left.where(F.col("members") > LARGE).join(hub_label, "next_hub", "left").where("label <> coalesce(hub_label, next_hub)")
        links = stash(links.unionByName(stars(far.select(F.col("next_hub").alias("hub"), "rep"))))
        turn += 1


def near_duplicates(docs: DataFrame, width: int = 5, similarity: Fraction = Fraction(4, 5), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept of every row."""
    spark = docs.sparkSession
    importable(spark)
    stash = Stash(spark)
    count = band_count(similarity)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = stash(_sketches(rows, width, count))
    same = ["low", "high", "n_shingles"]
    real = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = stash(real.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("n")))
    parts = [_links(rows, classes, width, similarity, stash)]
    # an id of several texts connects their classes
    several = real.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("one"), F.max(F.struct(*same)).alias("other")).where("one <> other").select("doc_id")
    several = stash(several)
    if several.limit(1).count():
        parts.append(real.select("doc_id", *same).join(several, "doc_id", "left_semi").join(classes.select(*same, "rep"), same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    links = [p for p in parts if p is not None]
    found = components(links[0].unionByName(links[1]) if len(links) > 1 else links[0], stash) if links else spark.createDataFrame([], "node long, component long")

    # every row -> its class -> the component of the class's representative; a class of one row without links is its own
    named = classes.select(*same, "rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = stash(named.where("n > 1 or component is not null").select(*same, F.coalesce("component", "rep").alias("component"), "n"))
    filled = lookup(sketched.where("n_shingles > 0").select("doc_id", *same), named, same, "n").select("doc_id", "n_shingles", "component")
    out = filled.unionByName(sketched.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component")))
    per_row = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", per_row.alias("component_id"), F.coalesce(per_row == F.col("doc_id"), F.lit(True)).alias("kept"))
