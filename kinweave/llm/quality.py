"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= j) = sigmoid(w . x - theta_j): one weight vector of hashed-text features shared by all grades, and
ordered thresholds. The expected grade is the sum of the tail probabilities; a document is kept if the tail
probability of the highest grade is at least `keep`.

Features are presences, so that a few telling words count in a text of any length: each word (letters, digits and
bytes above 127; A-Z folded), its first five bytes, and the document's measures (share of capitals, of digits, of
other signs, distinct words, repeats, word length) in steps. They are hashed into 2**18 places.

Grades from labels: 0 toxic, 1 poor (quality 0), 2 good. The fit uses at most about sample_rows labelled rows, taken
by a hash of the id; scoring reads whole texts of all rows.

Defined results: null texts and texts without words get expected grade 0, tail probabilities 0 and aren't kept;
labels without an id or quality aren't used, and a null toxic label counts as 0; rows of one id that are labelled
differently take the lowest grade; of several documents of one labelled id, the one with the least feature set (in the
order of its bytes) is learned from; without labelled rows every text with words is kept at probability 1; repeated
rows are scored each; texts of any length are read whole; extra columns are ignored by grade() and kept by
select_good(), whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.runtime import importable
from kinweave.llm.textarrays import CHUNK, FOLD, U64, byte_rows, byte_sums, chunks, mix, range_hashes, spans

BITS = 18
GRADES = 3
HEAD = 5
_letters = np.zeros(256, bool)
_letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
NOT_WORD = ~_letters
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SIGN = NOT_WORD.copy()
SIGN[[*range(0, 33), 127, *b".,;:'\"-()!?"]] = False
LOUD = np.zeros(256, bool)
LOUD[[*b"!?"]] = True


def _steps(share: np.ndarray) -> np.ndarray:
    """Shares in steps of a factor of two: 0 for none, 12 for more than half."""
    return np.where(share > 0, np.clip(np.ceil(np.log2(np.maximum(share, 2.0**-11))) + 12, 1, 12), 0).astype(np.int64)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: (row of each feature from 0, feature, words of each row); features of a row are distinct."""
    data, offsets = byte_rows(column)
    for a, b in chunks(offsets, CHUNK):
        # a text of more than a few megabytes is read in parts, cut between words where it can be
        lo, end = int(offsets[a]), int(offsets[b])
        cuts = [lo]
        while end - cuts[-1] > 2 * CHUNK:
            tail = np.flatnonzero(NOT_WORD[data[cuts[-1] + CHUNK : cuts[-1] + 2 * CHUNK]])
            cuts.append(cuts[-1] + CHUNK + (int(tail[0]) if len(tail) else CHUNK))
        cuts.append(end)
        n = b - a
        words, repeats, letters = (np.zeros(n) for _ in range(3))
        marks = np.zeros((4, n))
        kinds, found = [], []
        for x, y in zip(cuts, cuts[1:], strict=False):
            run = data[x:y]
            at = np.clip(offsets[a : b + 1] - x, 0, y - x)
            first, last, count = spans(run, at, NOT_WORD)
            row = np.repeat(np.arange(n), count)
            sums = byte_sums(FOLD[run])
            whole = range_hashes(sums, first, last)
            heads = mix(range_hashes(sums, first, np.minimum(last, first + HEAD)) + U64(1))
            again = np.concatenate([[False], (whole[1:] == whole[:-1]) & (row[1:] == row[:-1])]) if len(whole) else np.zeros(0, bool)
            kinds.append(np.unique(_place(row, whole)))
            found.append(np.unique(_place(row, heads)))
            words += count
            repeats += np.bincount(row, again, n)
            letters += np.bincount(row, last - first, n)
            for k, table in enumerate((UPPER, DIGIT, SIGN, LOUD)):
                hits = np.concatenate([[0], np.cumsum(table[run])])
                marks[k] += hits[at[1:]] - hits[at[:-1]]
        found.append(np.unique(np.concatenate(kinds)))
        distinct = np.bincount(found[-1] >> BITS, minlength=n)
        size = np.maximum(1, np.diff(offsets[a : b + 1]))
        some = np.maximum(1, words)
        measures = [*(_steps(m / size) for m in marks), _steps(repeats / some), np.minimum(20, 10 * np.log10(np.maximum(1, some / np.maximum(1, distinct)))).astype(np.int64), np.minimum(20, letters / some).astype(np.int64), np.log2(some).astype(np.int64)]
        at = np.arange(n)[words > 0]
        for k, values in enumerate(measures):
            found.append(_place(at, mix((values[at] + 1000 * (k + 1)).astype(np.uint64))))
        got = np.unique(np.concatenate(found))
        yield (got >> BITS).astype(np.int64), (got & ((1 << BITS) - 1)).astype(np.int64), words.astype(np.int64)


def _place(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return row.astype(np.int64) << BITS | (hashes >> U64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of n rows."""
        score = np.bincount(row, self.weights[feature], n)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def gradients(row: np.ndarray, feature: np.ndarray, grades: np.ndarray, weight: np.ndarray, w: np.ndarray, theta: np.ndarray) -> list[np.ndarray]:
    """Of the weighted negative log-likelihood, by the weights and by the thresholds."""
    n, at = len(grades), np.arange(len(grades))
    tail = 1 / (1 + np.exp(np.clip(theta[None, :] - np.bincount(row, w[feature], n)[:, None], -40, 40)))
    full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
    slope = full * (1 - full)
    p = np.maximum(1e-9, full[at, grades] - full[at, grades + 1])
    pull = weight * (slope[at, grades] - slope[at, grades + 1]) / p
    down = weight[:, None] * slope[:, 1:-1] / p[:, None]
    edge = np.arange(1, GRADES)[None, :]
    return [-np.bincount(feature, pull[row], len(w)), (down * ((grades[:, None] == edge).astype(float) - (grades[:, None] == edge - 1))).sum(axis=0)]


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 200, rate: float = 0.05, sparse: float = 1e-3, least_rows: int = 8) -> OrdinalModel:
    """Maximum likelihood by full-batch Adam with a proximal step for the sum of |w|, each grade weighted alike.

    Only features of at least least_rows rows get a weight; the penalty leaves a few hundred.
    """
    size = np.array([len(r) for r in rows])
    row, feature = np.repeat(np.arange(len(rows)), size), np.concatenate(rows)
    seen = np.bincount(feature, minlength=1 << BITS) >= least_rows
    used = np.flatnonzero(seen)
    number = np.zeros(1 << BITS, np.int64)
    number[used] = np.arange(len(used))
    keep = seen[feature]
    row, feature = row[keep], number[feature[keep]]
    k = len(used)
    weight = (1 / np.maximum(1, np.bincount(grades, minlength=GRADES)))[grades]
    weight /= weight.sum()
    w, theta = np.zeros(k), np.arange(GRADES - 1, dtype=float) - (GRADES - 2) / 2
    mean = [np.zeros(k), np.zeros(GRADES - 1)]
    square = [np.zeros(k), np.zeros(GRADES - 1)]
    for turn in range(1, rounds + 1):
        steps = []
        for g, m, v in zip(gradients(row, feature, grades, weight, w, theta), mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            steps.append(np.minimum(2000, rate / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)))
        w -= steps[0] * mean[0] / (1 - 0.9**turn)
        w = np.sign(w) * np.maximum(0, np.abs(w) - steps[0] * sparse)
        theta = np.maximum.accumulate(theta - steps[1] * mean[1] / (1 - 0.9**turn))
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return OrdinalModel(weights, theta)


def grades_of(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id and grade of each labelled id."""
    grade = F.when(F.coalesce(F.col("toxic"), F.lit(0)) > 0, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.where(F.col(id_column).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_column).alias("doc_id")).agg(F.min(grade).alias("grade"))


def learn(docs: DataFrame, grades: DataFrame, sample_rows: int = 8000, id_column: str = "doc_id", text: str = "text") -> OrdinalModel | None:
    """Fit on about sample_rows labelled ids; None without any. Only the features of one row of each reach the driver."""
    importable(docs.sparkSession)
    n = grades.count()
    share = min(1.0, sample_rows / max(1, n))
    order = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    sample = grades.where(order <= F.lit(int(-(2**63) + share * (2**64 - 1) * (1 - 1e-12)))).select("doc_id", "grade")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).join(sample, "doc_id").select("doc_id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for row, feature, words in features(batch.column(2)):
                parts = np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, len(words))))
                part = batch.slice(at, len(words))
                at += len(words)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "grade", "features"])

    kind = docs.select(F.col(id_column)).schema[0].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, grade int, features binary").where(F.octet_length("features") > 0)
    got = made.groupBy("doc_id", "grade").agg(F.min("features").alias("features")).collect()
    got = sorted((r.doc_id, r.grade, bytes(r.features)) for r in got)
    if not got:
        return None
    return fit([np.frombuffer(f, np.int32) for _, _, f in got], np.array([g for _, g, _ in got]))


def _scores(column: pa.Array, model: OrdinalModel | None, keep: float) -> tuple[np.ndarray, np.ndarray]:
    """(tail probabilities, kept) of each text."""
    tails, kept = [np.zeros((0, GRADES - 1))], [np.zeros(0, bool)]
    for row, feature, words in features(column):
        t = model.tails(row, feature, len(words)) if model else np.ones((len(words), GRADES - 1))
        t[words == 0] = 0
        tails.append(t)
        kept.append((t[:, -1] >= keep) & (words > 0))
    return np.concatenate(tails), np.concatenate(kept)


def grade(docs: DataFrame, model: OrdinalModel | None, keep: float = 0.4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_1, tail_2 (P of at least that grade) and kept of every row."""
    spark = docs.sparkSession
    importable(spark)
    held = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails, kept = _scores(batch.column(1), held.value, keep)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), *(pa.array(np.ascontiguousarray(t)) for t in tails.T), pa.array(kept)], ["doc_id", "expected_grade", "tail_1", "tail_2", "kept"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, expected_grade double, tail_1 double, tail_2 double, kept boolean")


def select_good(docs: DataFrame, model: OrdinalModel | None, keep: float = 0.4, text: str = "text") -> DataFrame:
    """The rows that grade() keeps, with all their columns."""
    spark = docs.sparkSession
    importable(spark)
    held = spark.sparkContext.broadcast(model)
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(where), held.value, keep)[1]))

    return docs.mapInArrow(run, docs.schema)
