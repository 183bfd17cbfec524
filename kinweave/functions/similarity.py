"""Similarities: set measures and edit distance as column expressions, the others as Arrow-batched functions.

Conventions: two empty texts have ratio, Levenshtein and Jaro-Winkler similarity 1; set measures of empty sets are 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LANES = 4096
#: From this length of the second text on, SequenceMatcher leaves out letters that are frequent in it.
JUNK = 200
SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets, as arrays without repeats."""
    both, total = overlap_count(a, b), F.size(a) + F.size(b)
    return F.when(total > 0, both / (total - both)).otherwise(F.lit(0.0))


def overlap_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def overlap_coefficient(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, overlap_count(a, b) / least).otherwise(F.lit(0.0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def length_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.least(F.length(a), F.length(b)) / longest).otherwise(F.lit(0.0))


def words_of(text: str) -> set[str]:
    """text.token_set() of one text."""
    return {t for t in SPACE.split(text) if t}


def grams_of(text: str) -> set[str]:
    """text.char_ngrams() of one text."""
    return {text[i : i + 3] for i in range(max(1, len(text) - 2))} if text else set()


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda t: t != "")), " ")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by Hyyro's bit-parallel recurrence on one integer."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def numbered(left: list[str], right: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different texts, and the numbers of both texts of each pair."""
    known: dict[str, int] = {}
    one, two = (np.array([known.setdefault(t, len(known)) for t in x], np.int64) for x in (left, right))
    return list(known), one, two


def common_subsequences(left: list[str], right: list[str]) -> np.ndarray:
    """common_subsequence() of many pairs at once."""
    return subsequences(*numbered(left, right))


def subsequences(texts: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """common_subsequence() of many pairs at once, given as numbers of texts: the shorter text of a pair in bits, 64 to a
    word and as many words as it needs with carries between them, all pairs moving on one character of the longer text at a time."""
    length = np.array([len(t) for t in texts], np.int64)
    swap = length[one] > length[two]
    return _by_lanes(texts, length, np.where(swap, two, one), np.where(swap, one, two), np.zeros(len(one), np.int64), _common)


def _by_lanes(texts: list[str], length: np.ndarray, inner: np.ndarray, outer: np.ndarray, out: np.ndarray, f: Callable) -> np.ndarray:
    """f of blocks of pairs whose inner text fills equally many words, the longest outer texts first; where it is empty, out stays."""
    width = -(-length[inner] // 64)
    order = np.lexsort((inner, width))
    order = order[width[order] > 0]
    ends = [0, *(np.flatnonzero(np.diff(width[order])) + 1).tolist(), len(order)]
    for first, last in zip(ends, ends[1:], strict=False):
        lanes = max(1, LANES // int(width[order[first]])) if first < last else 1
        for at in range(first, last, lanes):
            part = order[at : min(last, at + lanes)]
            part = part[np.argsort(-length[outer[part]], kind="stable")]
            out[part] = f(Lanes(texts, inner[part], outer[part], int(width[part[0]])))
    return out


def levenshteins(texts: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Levenshtein distances of many pairs at once, given as numbers of texts, by Myers' bit-parallel recurrence in Hyyro's
    blocks of 64 bits: the shorter text of a pair is in the bits, and pairs whose longer text has ended stay as they are."""
    length = np.array([len(t) for t in texts], np.int64)
    swap = length[one] > length[two]
    short, long = np.where(swap, two, one), np.where(swap, one, two)
    return _by_lanes(texts, length, short, long, length[long], _distances)


def levenshtein_similarities(texts: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """levenshtein_similarity() of many pairs, given as numbers of texts."""
    length = np.array([len(t) for t in texts], np.int64)
    longest = np.maximum(length[one], length[two])
    return np.where(longest > 0, 1 - levenshteins(texts, one, two) / np.maximum(longest, 1), 1.0)


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """A row of letters for each text, the lengths, and the number of letters; letter 0 is beyond the end of a text."""
    length = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    number = np.zeros(int(points.max(initial=0)) + 1, np.int32)
    number[points] = 1
    number = np.cumsum(number, dtype=np.int32)
    grid = np.zeros((len(texts), int(length.max(initial=0))), np.int32)
    grid[np.arange(grid.shape[1])[None, :] < length[:, None]] = number[points]
    return grid, length, int(number[-1]) + 1


def _masks(grid: np.ndarray, letters: int, words: int) -> np.ndarray:
    """By word, row and letter, flat in these two: the places of the letter in the row, as bits."""
    where = np.zeros((words, len(grid) * letters), np.uint64)
    base = np.arange(len(grid)) * letters
    for j in range(min(grid.shape[1], 64 * words)):
        where[j // 64, base + grid[:, j]] |= np.uint64(1 << j % 64)
    where[:, base] = 0
    return where


def _low_bits(bits: np.ndarray) -> np.ndarray:
    """Words with so many of their lowest bits set (none below 0, all from 64 on)."""
    return np.where(bits >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.clip(bits, 0, 63).astype(np.uint64)) - np.uint64(1))


class Lanes:
    """A block of pairs: inner texts as bits by letter (where, from base), outer texts by place (cells, at rows longer);
    active: how many of the pairs have an outer text beyond each place."""

    def __init__(self, texts: list[str], inner: np.ndarray, outer: np.ndarray, words: int) -> None:
        self.n, self.words = len(inner), words
        used, rows = np.unique(np.concatenate([inner, outer]), return_inverse=True)
        self.grid, length, letters = _numbered([texts[i] for i in used.tolist()])
        self.inner, self.outer = rows[: self.n], rows[self.n :]
        own, place = np.unique(self.inner, return_inverse=True)
        self.bits, self.size = length[self.inner], length[self.outer]
        self.where = _masks(self.grid[own][:, : int(self.bits.max())], letters, words)
        self.base, self.cells = place * letters, np.ascontiguousarray(self.grid.T)
        self.active = np.searchsorted(-self.size, -np.arange(int(self.size[0])), "left").tolist()

    def letters(self, j: int, m: int) -> np.ndarray:
        """Where the masks of the outer texts' letter at place j are, for the first m pairs."""
        return self.cells[j].take(self.outer[:m]) + self.base[:m]

    def kept(self) -> np.ndarray:
        """The bits of the inner texts."""
        return _low_bits(self.bits[None, :] - 64 * np.arange(self.words)[:, None])


def _common(lanes: Lanes) -> np.ndarray:
    row = np.full((lanes.words, lanes.n), 2**64 - 1, np.uint64)
    for j, m in enumerate(lanes.active):
        at, carry = lanes.letters(j, m), None
        for w in range(lanes.words):
            now = row[w, :m]
            hit = now & lanes.where[w].take(at)
            total = now + hit
            if w + 1 < lanes.words or carry is not None:
                over = total < hit
            if carry is not None:
                total += carry
                over |= total < carry
            now -= hit
            now |= total
            carry = over if w + 1 < lanes.words else None
    return lanes.bits - np.bitwise_count(row & lanes.kept()).astype(np.int64).sum(axis=0)


def _distances(lanes: Lanes) -> np.ndarray:
    words, n = lanes.words, lanes.n
    one, top = np.uint64(1), np.uint64(63)
    plus, minus = np.full((words, n), 2**64 - 1, np.uint64), np.zeros((words, n), np.uint64)
    for j, m in enumerate(lanes.active):
        at = lanes.letters(j, m)
        up, down = one, None
        for w in range(words):
            equal, pv, mv = lanes.where[w].take(at), plus[w, :m], minus[w, :m]
            vertical = equal | mv
            if down is not None:
                equal |= down
            across = equal & pv
            across += pv
            across ^= pv
            across |= equal
            rise = across | pv
            np.invert(rise, out=rise)
            rise |= mv
            across &= pv  # now where it falls
            if w + 1 < words:
                next_up, next_down = rise >> top, across >> top
            rise <<= one
            rise |= up
            across <<= one
            if down is not None:
                across |= down
            np.bitwise_and(rise, vertical, out=mv)
            rise |= vertical
            np.invert(rise, out=rise)
            np.bitwise_or(across, rise, out=pv)
            if w + 1 < words:
                up, down = next_up, next_down
    kept = lanes.kept()
    return lanes.size + (np.bitwise_count(plus & kept).astype(np.int64) - np.bitwise_count(minus & kept)).sum(axis=0)


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / total length."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best ratio among the shared words alone and with either side's own words; 0 if a side has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    head = " ".join(both)
    one, two = " ".join([*both, *left]), " ".join([*both, *right])
    best = indel_ratio(one, two)
    return max(best, indel_ratio(head, one), indel_ratio(head, two)) if both else best


def token_sets(left: list[str], right: list[str]) -> np.ndarray:
    """token_set() of many pairs."""
    return set_ratios(*numbered(left, right))


def set_ratios(texts: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """token_set() of many pairs, given as numbers of texts: what has to be compared is listed first and compared at once.

    The shared words are the head of both sides, so they count whole, and only what follows is compared.
    """
    out = np.zeros(len(one))
    sets = [set(t.split()) for t in texts]
    words = [sorted(x) for x in sets]
    whole = [" ".join(x) for x in words]
    of, head, p, q = [], [], [], []
    for i, (a, b) in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
        x, y = sets[a], sets[b]
        both = x & y
        if not both:
            if x and y:
                of.append(i), head.append(0), p.append(whole[a]), q.append(whole[b])
        elif len(both) == len(x) or len(both) == len(y):
            out[i] = 100.0
        else:
            of.append(i), head.append(sum(map(len, both)) + len(both) - 1)
            p.append(" ".join([t for t in words[a] if t not in both])), q.append(" ".join([t for t in words[b] if t not in both]))
    if of:
        known, u, v = numbered(p, q)
        length = np.array([len(t) for t in known], np.int64)
        shared = np.array(head, np.int64)
        common = subsequences(known, u, v) + np.where(shared > 0, shared + 1, 0)
        sizes = [length[k] + np.where(shared > 0, shared + 1, 0) for k in (u, v)]
        best = 200.0 * common / (sizes[0] + sizes[1])
        out[of] = np.maximum(best, np.maximum(*(200.0 * shared / (shared + k) for k in sizes)))
    return out


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, t in zip(b, taken, strict=True) if t]
    swaps = sum(p != q for p, q in zip(left, right, strict=True)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for p, q in zip(a[:4], b[:4], strict=False):
        if p != q:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winklers(texts: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """jaro_winkler() of many pairs at once, given as numbers of texts: the second text of a pair in bits, of which each
    letter of the first takes the lowest free one within reach."""
    return _by_lanes(texts, np.array([len(t) for t in texts], np.int64), two, one, (one == two).astype(float), _jaro_winklers)


def _jaro_winklers(lanes: Lanes, weight: float = 0.1) -> np.ndarray:
    n, words, grid = lanes.n, lanes.words, lanes.grid
    if not lanes.active:
        return np.zeros(n)
    low = _low_bits(np.arange(65))
    reach = np.maximum(0, np.maximum(lanes.bits, lanes.size) // 2 - 1)
    free = np.full((words, n), 2**64 - 1, np.uint64)
    met = np.zeros((len(lanes.active), n), bool)
    for j, m in enumerate(lanes.active):
        at, found = lanes.letters(j, m), met[j, :m]
        start, end = j - reach[:m], j + 1 + reach[:m]
        for w in range(words):
            able = lanes.where[w].take(at)
            able &= free[w, :m]
            able &= low.take(np.clip(end - 64 * w, 0, 64))
            able &= ~low.take(np.clip(start - 64 * w, 0, 64))
            if w:
                able[found] = 0
            able &= ~able + np.uint64(1)
            free[w, :m] ^= able
            found |= able != 0
    taken = np.unpackbits(np.ascontiguousarray((~free).T).view(np.uint8), axis=1, bitorder="little").astype(bool)
    (pair, at), (_, to) = np.nonzero(met.T), np.nonzero(taken)
    swaps = np.bincount(pair, grid[lanes.outer[pair], at] != grid[lanes.inner[pair], to], n).astype(np.int64) // 2
    m = met.sum(axis=0)
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(lanes.size, 1) + m / lanes.bits + (m - swaps) / some) / 3, 0.0)
    prefix, same = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(min(4, grid.shape[1])):
        same &= (grid[lanes.outer, k] == grid[lanes.inner, k]) & (grid[lanes.inner, k] > 0)
        prefix += same
    return np.where(lanes.inner == lanes.outer, 1.0, np.where(jaro > 0.7, jaro + prefix * weight * (1 - jaro), jaro))


def sequence_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def sequence_ratios(texts: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """sequence_ratio() of many pairs at once, given as numbers of texts: the longest common runs of all pairs, then those on
    both sides of each run, until none is left. Second texts from JUNK on, whose frequent letters don't count, go one at a time."""
    length = np.array([len(t) for t in texts], np.int64)
    common, total = np.zeros(len(one), np.int64), length[one] + length[two]
    out = np.ones(len(one))
    whole = length[two] >= JUNK
    out[whole] = [sequence_ratio(texts[i], texts[j]) for i, j in zip(one[whole].tolist(), two[whole].tolist(), strict=True)]
    pair = np.flatnonzero(~whole & (length[one] > 0) & (length[two] > 0))
    if len(pair):
        grid, _, letters = _numbered(texts)
        grid = grid.astype(np.min_scalar_type(letters + 1))
        zero = np.zeros(len(pair), np.int64)
        parts = np.stack([pair, zero, length[one[pair]], zero, length[two[pair]]])
        while parts.shape[1]:
            parts = parts[:, np.lexsort((parts[4] - parts[3], parts[2] - parts[1]))]
            left = []
            for at in range(0, parts.shape[1], LANES):
                pair, a, a_end, b, b_end = now = parts[:, at : at + LANES]
                i, j, n = _longest_runs(grid, one[pair], two[pair], a, a_end, b, b_end, letters)
                common += np.bincount(pair, n, len(one)).astype(np.int64)
                for part in (np.stack([pair, a, i, b, j]), np.stack([pair, i + n, a_end, j + n, b_end])):
                    left.append(part[:, (n > 0) & (part[1] < part[2]) & (part[3] < part[4])])
            parts = np.concatenate(left, axis=1)
    return np.where(whole | (total == 0), out, 2.0 * common / np.maximum(total, 1))


def _longest_runs(grid: np.ndarray, one: np.ndarray, two: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the longest common run of texts one from a to a_end and two from b to b_end begins in both, and its length; the
    first in one, then in two."""
    size, other, last = a_end - a, b_end - b, grid.shape[1] - 1
    i, j, best = a.copy(), b.copy(), np.zeros(len(one), np.uint8)
    place = np.arange(int(other.max()))[:, None]
    within = np.where(place < other, grid[two, np.minimum(b + place, last)], grid.dtype.type(letters + 1))
    run, new = np.zeros((len(place) + 1, len(one)), np.uint8), np.zeros((len(place) + 1, len(one)), np.uint8)
    for k in range(int(size.max())):
        letter = np.where(k < size, grid[one, np.minimum(a + k, last)], grid.dtype.type(0))
        np.add(run[:-1], 1, out=new[1:])
        new[1:] *= within == letter
        longest = new.max(axis=0)
        better = np.flatnonzero(longest > best)
        if len(better):
            best[better] = longest[better]
            i[better] = a[better] + k + 1 - longest[better]
            j[better] = b[better] + new[:, better].argmax(axis=0) - longest[better]
        run, new = new, run
    return i, j, best.astype(np.int64)


def _batched(f: Callable[[str, str], float]):
    """An Arrow-batched function of two texts; null counts as ''; each distinct pair of a batch is computed once."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in known:
                known[pair] = f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype=float)

    return run


def indel_ratios(texts: list[str], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """indel_ratio() of many pairs, given as numbers of texts."""
    length = np.array([len(t) for t in texts], float)
    total = length[one] + length[two]
    return np.where(total > 0, 200.0 * subsequences(texts, one, two) / np.maximum(total, 1), 100.0)


def _each(f: Callable[[list[str], np.ndarray, np.ndarray], np.ndarray], a: pd.Series, b: pd.Series) -> pd.Series:
    """f of the different pairs of a batch; null counts as ''."""
    texts, one, two = numbered(a.fillna("").tolist(), b.fillna("").tolist())
    pairs, place = np.unique(one * max(1, len(texts)) + two, return_inverse=True)
    return pd.Series(f(texts, pairs // max(1, len(texts)), pairs % max(1, len(texts)))[place])


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(indel_ratios, a, b)


@F.pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _ratios(a, b)


@F.pandas_udf(T.DoubleType())
def token_sort_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _ratios(*(x.fillna("").map(lambda t: " ".join(sorted(t.split()))) for x in (a, b)))


@F.pandas_udf(T.DoubleType())
def token_set_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(set_ratios, a, b)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _each(jaro_winklers, a, b)


sequence_ratio_udf = _batched(sequence_ratio)


def register(spark: SparkSession) -> None:
    """The functions under their names for SQL."""
    for name, udf in (("indel_ratio", ratio_udf), ("token_sort_ratio", token_sort_udf), ("token_set_ratio", token_set_udf), ("jaro_winkler", jaro_winkler_udf), ("sequence_ratio", sequence_ratio_udf)):
        spark.udf.register(name, udf)


def weighted_levenshtein(name_a: Column, name_b: Column, address_a: Column, address_b: Column, least: float = 0.0) -> Column:
    """0.7 * name + 0.3 * address, native; texts come with their tokens sorted.

    Where that stays below least (to 5 places) even with the best address of these lengths, the score is 0, and the
    address, which takes most of the time, isn't compared.
    """
    name, address = levenshtein_similarity(name_a, name_b), levenshtein_similarity(address_a, address_b)
    if least <= 0:
        return 0.7 * name + 0.3 * address
    longest = F.greatest(F.length(address_a), F.length(address_b))
    most = F.when(longest > 0, F.least(F.length(address_a), F.length(address_b)) / longest).otherwise(F.lit(1.0))
    return F.when(0.7 * name + 0.3 * most >= least - 1e-5, 0.7 * name + 0.3 * address).otherwise(F.lit(0.0))


def weighted_indel(name_a: Column, name_b: Column, address_a: Column, address_b: Column) -> Column:
    """The same weights on Indel ratios; texts come with their tokens sorted, which makes them token-sort ratios."""
    return (0.7 * ratio_udf(name_a, name_b) + 0.3 * ratio_udf(address_a, address_b)) / 100


def weighted_jaccard(name_a: Column, name_b: Column, address_a: Column, address_b: Column) -> Column:
    """The same weights on token sets, given as arrays: the cheapest of the three, all native."""
    return 0.7 * jaccard(name_a, name_b) + 0.3 * jaccard(address_a, address_b)
