"""Pairs of records that share a key, made where the records of a bucket have met.

Both sides are dealt by bucket and part (blocking.parted) and sorted by it, the right side first. A task holds one bucket's
right side, which the cap on buckets bounds, and takes its left rows in turn. Pairs are numbers in arrays of about PAIRS,
equal texts are compared once in each, and only what is asked for becomes a row: no pair is sorted, shuffled or spilled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.operators import decision
from kinweave.operators.blocking import DEALT, PAIR
from kinweave.sources.staging import importable

#: Pairs that are compared at once, about.
PAIRS = 1 << 17
#: Shared elements that are listed at once, about.
STEPS = 1 << 20
IDS = f"{PAIR[0]} string, {PAIR[1]} string"
#: Of texts and the numbers of both texts of each pair.
Compare = Callable[[list[str], np.ndarray, np.ndarray], np.ndarray]


class Met:
    """Rows of several buckets with their pairs: left and right are the numbers of a pair's rows, a left row's pairs lie together."""

    def __init__(self, buckets: list[tuple[list[list], list[list]]]) -> None:
        self.buckets = buckets
        sides, numbers, first = ([], []), ([], []), [0, 0]
        for sides_of in buckets:
            n = [len(x[0]) for x in sides_of]
            numbers[0].append(np.repeat(np.arange(first[0], first[0] + n[0]), n[1]))
            numbers[1].append(np.tile(np.arange(first[1], first[1] + n[1]), n[0]))
            self.last = first[1]  # the first right row of the last bucket
            for i in (0, 1):
                sides[i].append(sides_of[i])
                first[i] += n[i]
        self.left, self.right = (np.concatenate(x) for x in numbers)
        self.ids, *self.texts = zip(*([[v for part in side for v in part[c]] for c in range(len(side[0]))] for side in sides), strict=True)

    def lengths(self, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Of both texts of each pair."""
        left, right = (np.array([len(t) for t in x], np.int64) for x in self.texts[column])
        return left[self.left], right[self.right]

    def compared(self, column: int, f: Compare, which: np.ndarray | None = None) -> np.ndarray:
        """f of the texts of all pairs, or of those which are asked for; f sees different pairs of texts only."""
        left, right = (self.left, self.right) if which is None else (self.left[which], self.right[which])
        known: dict[str, int] = {}
        a, b = (np.array([known.setdefault(t, len(known)) for t in x], np.int64) for x in self.texts[column])
        pairs, place = np.unique(a[left] * len(known) + b[right], return_inverse=True)
        return f(list(known), pairs // len(known), pairs % len(known))[place]

    def rows(self, which: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
        left, right = (pa.array(ids, pa.string()).take(pa.array(x[which])) for ids, x in zip(self.ids, (self.left, self.right), strict=True))
        return pa.RecordBatch.from_arrays([left, right, *map(pa.array, more.values())], [*PAIR, *more])


class Sets:
    """The sets of the right texts of some buckets, with the rows of each element of a bucket."""

    def __init__(self, rights: list[list[str]], make: Callable[[str], set[str]]) -> None:
        self.make, self.known, numbers, sizes, self.rows, n = make, [], [], [], [], 0
        for texts in rights:
            known: dict[str, int] = {}
            for t in texts:
                made = make(t)
                sizes.append(len(made))
                numbers += [known.setdefault(e, n + len(known)) for e in made]
            n += len(known)
            self.known.append(known)
            self.rows.append(len(texts))
        self.sizes = np.array(sizes, np.int64)
        number = np.array(numbers, np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), self.sizes)[np.argsort(number, kind="stable")]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(number, minlength=n))]).astype(np.int64)

    def met(self, lefts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Of all pairs of the buckets: how many elements the sets share, and how many both have in all, shared ones twice."""
        numbers, found, sizes = [], [], []
        for texts, known in zip(lefts, self.known, strict=True):
            for t in texts:
                made = self.make(t)
                mine = [known[e] for e in made if e in known]
                sizes.append(len(made))
                found.append(len(mine))
                numbers += mine
        n_left, rows = [len(x) for x in lefts], np.repeat(self.rows, [len(x) for x in lefts])
        first_right = np.repeat(np.cumsum([0, *self.rows[:-1]]), n_left)
        ends = np.cumsum(rows)
        pairs, row = int(ends[-1]), np.repeat(np.arange(len(sizes)), found)
        base, number = (ends - rows - first_right)[row], np.array(numbers, np.int64)
        start, size = self.first[number], self.first[number + 1] - self.first[number]
        shared, steps, a = np.zeros(pairs, np.int64), np.cumsum(size), 0
        while a < len(number):
            b = max(a + 1, int(np.searchsorted(steps, steps[a] - size[a] + STEPS, "right")))
            before = np.cumsum(size[a:b]) - size[a:b]
            at = np.arange(int(size[a:b].sum())) + np.repeat(start[a:b] - before, size[a:b])
            shared += np.bincount(self.owner[at] + np.repeat(base[a:b], size[a:b]), minlength=pairs)
            a = b
        mine = np.arange(pairs) - np.repeat(ends - rows - first_right, rows)
        return shared, np.repeat(sizes, rows) + self.sizes[mine]


class Kept:
    """Sets of texts that are made of columns; those of a right side are kept while its bucket goes on."""

    def __init__(self, columns: list[int], make: Callable[[str], set[str]]) -> None:
        self.columns, self.make, self.right, self.sets = columns, make, None, None

    def _texts(self, side: list[list[str]]) -> list[str]:
        return side[self.columns[0]] if len(self.columns) == 1 else [" ".join(x) for x in zip(*(side[c] for c in self.columns), strict=True)]

    def jaccard(self, met: Met) -> np.ndarray:
        """The share of their elements that the sets of each pair share; 0 where there are none."""
        got = []
        *done, (left, right) = met.buckets
        if done:
            got.append(Sets([self._texts(r) for _, r in done], self.make).met([self._texts(x) for x, _ in done]))
        if self.right is not right:
            self.right, self.sets = right, Sets([self._texts(right)], self.make)
        got.append(self.sets.met([self._texts(left)]))
        shared, total = (np.concatenate(x) for x in zip(*got, strict=True))
        return np.where(total > 0, shared / np.maximum(total - shared, 1), 0.0)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Met, bool]]:
    """Buckets by about PAIRS pairs, each left row's in one of them; and whether the last of them goes on in the next."""
    group, right, held, size = None, None, [], 0
    for batch in batches:
        changed = np.zeros(max(0, len(batch) - 1), bool)
        for i in range(4):
            changed |= pc.not_equal(batch.column(i)[1:], batch.column(i)[:-1]).to_numpy(zero_copy_only=False)
        names = [batch.column(i).to_pylist() for i in range(4)]
        columns = [["" if v is None else v for v in batch.column(i).to_pylist()] for i in range(4, batch.num_columns)]
        edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(batch)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if (now := [c[a] for c in names[:3]]) != group:
                if size >= PAIRS:
                    yield Met(held), False
                    held, size = [], 0
                group, right = now, [[] for _ in columns]
            if names[3][a] == 0:
                for had, c in zip(right, columns, strict=True):
                    had.extend(c[a:b])
            elif n := len(right[0]):
                while a < b:
                    if size >= PAIRS:
                        yield Met(held), held[-1][1] is right
                        held, size = [], 0
                    end = min(b, a + max(1, (PAIRS - size) // n))
                    if held and held[-1][1] is right:
                        for had, c in zip(held[-1][0], columns, strict=True):
                            had.extend(c[a:end])
                    else:
                        held.append(([c[a:end] for c in columns], right))
                    size += n * (end - a)
                    a = end
    if held:
        yield Met(held), False


def _meet(left: DataFrame, right: DataFrame, texts: list[str], run: Callable, more: str, known: DataFrame | None = None) -> DataFrame:
    """run over both sides (from blocking.parted), as ids and more columns; or, with the rows known of side -1, as these alone."""
    importable(left.sparkSession)
    sides = (x.select(*DEALT, F.lit(i).alias("side"), "entity_id", *texts) for i, x in ((1, left), (0, right)))
    both = next(sides).unionByName(next(sides))
    if known is not None:
        both = both.unionByName(known.withColumn("side", F.lit(-1)), allowMissingColumns=True)
    both = both.where("country_norm IS NOT NULL").repartition(*DEALT).sortWithinPartitions(*DEALT, "side", "entity_id")
    return both.mapInArrow(run, f"{IDS}, {more}" if known is None else more)


def _without_known(batches: Iterator[pa.RecordBatch], said: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The batches without rows of side -1, whose ids and n go to said before their bucket begins."""
    for batch in batches:
        known = pc.equal(batch.column(3), -1)
        if pc.any(known).as_py():
            some = batch.filter(known)
            said.update(zip(some.column(4).to_pylist(), some.column(5).to_pylist(), strict=True))
            batch = batch.filter(pc.invert(known))
        yield batch


def compared(left: DataFrame, right: DataFrame, measures: dict[str, tuple[str, Compare]]) -> DataFrame:
    """All pairs with measures, given as (text column, function)."""
    texts = sorted({c for c, _ in measures.values()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met, _ in _met(batches):
            yield met.rows(np.arange(len(met.left)), **{name: met.compared(texts.index(c), f) for name, (c, f) in measures.items()})

    return _meet(left, right, texts, run, ", ".join(f"{name} double" for name in measures))


def alike(left: DataFrame, right: DataFrame, measures: dict[str, tuple[list[str], Callable[[str], set[str]]]]) -> DataFrame:
    """All pairs with the Jaccard index of sets, given as (text columns that are joined by a space, what makes a text's set)."""
    texts = sorted({c for columns, _ in measures.values() for c in columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a bucket's side is its ids and then its texts
        kept = {name: Kept([1 + texts.index(c) for c in columns], make) for name, (columns, make) in measures.items()}
        for met, _ in _met(batches):
            yield met.rows(np.arange(len(met.left)), **{name: sets.jaccard(met) for name, sets in kept.items()})

    return _meet(left, right, texts, run, ", ".join(f"{name} double" for name in measures))


def _most(met: Met, column: int) -> np.ndarray:
    """The likeness that texts of these lengths can have."""
    a, b = met.lengths(column)
    return np.where(np.maximum(a, b) > 0, np.minimum(a, b) / np.maximum(np.maximum(a, b), 1), 1.0)


def probabilities(met: Met, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs whose weighted Levenshtein score is least or more to 6 places, and these scores; names are
    text 0 and addresses text 1. A text is compared only where the rest can still bring the pair to least."""
    most = 0.3 * _most(met, 1)
    which = np.flatnonzero(0.7 * _most(met, 0) + most >= least - 1e-5)
    name = 0.7 * met.compared(0, S.levenshtein_similarities, which)
    able = name + most[which] >= least - 1e-5
    which, name = which[able], name[able]
    score = np.floor((name + 0.3 * met.compared(1, S.levenshtein_similarities, which)) * 1e6 + 0.5) / 1e6
    return which[score >= least], score[score >= least]


def _places(sorted_keys: np.ndarray) -> np.ndarray:
    """From 1 on within each run of equal keys."""
    at = np.arange(len(sorted_keys))
    starts = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])[: len(at)]
    return at - np.maximum.accumulate(np.where(starts, at, 0)) + 1 if len(at) else at


def ranked(left: DataFrame, right: DataFrame, least: float, cap: int) -> DataFrame:
    """probability (least or more) and prob_rank of the cap best pairs of each left row by the texts n and a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met, _ in _met(batches):
            which, score = probabilities(met, least)
            order = np.lexsort((met.right[which], -score, met.left[which]))
            which, score = which[order], score[order]
            rank = _places(met.left[which])
            kept = rank <= cap
            yield met.rows(which[kept], probability=score[kept], prob_rank=rank[kept].astype(np.int32))

    return _meet(left, right, ["n", "a"], run, "probability double, prob_rank int")


def owned(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """probability of the best pair, of least or more, of each right row in each part by the texts n and a; ties go to the
    smaller left id. A right row whose left rows lie in several parts has as many pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[float, str]] = {}  # of a bucket that goes on
        for met, on in _met(batches):
            which, score = probabilities(met, least)
            order = np.lexsort((met.left[which], -score, met.right[which]))
            which, score = which[order], score[order]
            first = _places(met.right[which]) == 1
            for at, p in zip(which[first].tolist(), score[first].tolist(), strict=True):
                target, mine = met.ids[1][met.right[at]], met.ids[0][met.left[at]]
                if target not in best or (-p, mine) < (-best[target][0], best[target][1]):
                    best[target] = p, mine
            open_ids = set(met.ids[1][met.last :]) if on else set()
            done = [(mine, target, p) for target, (p, mine) in best.items() if target not in open_ids]
            best = {target: found for target, found in best.items() if target in open_ids}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64()))], [*PAIR, "probability"])

    return _meet(left, right, ["n", "a"], run, "probability double")


def rated(left: DataFrame, right: DataFrame, truth: DataFrame, thresholds: tuple[float, ...], caps: tuple[int | None, ...], beta: float = 0.5) -> DataFrame:
    """The sums of decision.grid_means() over the pairs by the texts n and a; truth has the true pairs, one of a target.

    A left row's pairs are ranked and counted at once, so only the sums leave a task. Ids are joined to the truth without
    their texts, and what is known of them (the number of a left row's true pairs, a right row's owner) meets these in the bucket.
    """
    of_left = truth.groupBy(F.col(PAIR[0]).alias("entity_id")).agg(F.count(F.lit(1)).cast("string").alias("n"))
    of_right = truth.select(F.col(PAIR[1]).alias("entity_id"), F.col(PAIR[0]).alias("n"))
    known = left.select(*DEALT, "entity_id").join(of_left, "entity_id").unionByName(right.select(*DEALT, "entity_id").join(of_right, "entity_id"))
    steps, limits, b2 = np.array(sorted(thresholds)), [decision.NO_CAP if c is None else c for c in caps], beta * beta

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, spoilt = np.zeros((len(limits), len(steps))), np.zeros((len(limits), len(steps)), np.int64)
        said: dict[str, str] = {}
        for met, _ in _met(_without_known(batches, said)):
            which, score = probabilities(met, float(steps[0]))
            order = np.lexsort((met.right[which], -score, met.left[which]))
            which, score = which[order], score[order]
            number = {who: i for i, who in enumerate(met.ids[0])}
            owner = np.array([number.get(who, -1) for who in map(said.get, met.ids[1])], np.int64)
            hits = np.concatenate([[0], np.cumsum(owner[met.right[which]] == met.left[which])])
            who, first, row = np.unique(met.left[which], return_index=True, return_inverse=True)
            at = np.searchsorted(steps, score, "right") - 1
            # by left row and threshold: the pairs that reach it, which are its first ones
            passed = np.bincount(row * len(steps) + at, minlength=len(who) * len(steps)).reshape(-1, len(steps))[:, ::-1].cumsum(axis=1)[:, ::-1]
            true = np.array([int(said.get(met.ids[0][i], 0)) for i in who.tolist()], np.int64)[:, None]
            for c, limit in enumerate(limits):
                n = np.minimum(passed, limit)
                hit = hits[first[:, None] + n] - hits[first][:, None]
                f[c] += np.where((true > 0) & (hit > 0), (1 + b2) * hit / np.maximum(b2 * true + n, 1), 0.0).sum(axis=0)
                spoilt[c] += ((true == 0) & (n > 0)).sum(axis=0)
        cap, at = (x.ravel() for x in np.meshgrid(limits, np.arange(1, len(steps) + 1), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in ((cap, pa.int32()), (at, pa.int32()), (f.ravel(), pa.float64()), (spoilt.ravel(), pa.int64()))], ["cap", "at", "f", "spoilt"])

    return _meet(left, right, ["n", "a"], run, "cap int, at int, f double, spoilt long", known).groupBy("cap", "at").agg(F.sum("f").alias("f"), F.sum("spoilt").alias("spoilt"))
