"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of that text. A document
is parsed greedily into the longest phrases that occur there (Ziv and Merhav's cross-parsing); the language
that needs the fewest phrases, normalised by log2 of its text's length, wins.

Every letter of the samples is a symbol of its own, whatever the script. The automata are sparse: the rows of their
states are laid over each other in one array (row displacement), so their size follows the samples and not the
alphabet. A state is the place where its row begins; a step looks at one cell, which either belongs to that state and
names the next one, or ends the phrase. Many texts run side by side in NumPy. Texts are parsed in blocks of BLOCK
symbols, each from the start; a block's border costs one phrase at most.

Defined results: null text or a text without letters gives `und`, score 0. Without any labelled text every
row gives `und`. Equal phrase counts go to the language first in code-point order. Repeated rows are
predicted each, and a text that is repeated is learned from once. Rows without a label or an id that the query asks
for are not learned from. Texts of any length are read whole, also for learning. Columns of the input other than id,
text and label are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.runtime import importable

BLOCK = 1024
GAP, OTHER = 0, 1
CHUNK_CHARS = 1 << 21
#: Characters of the pieces that samples are made of.
PIECE = 500
LEVELS = 60


@cache
def lower_letters() -> np.ndarray:
    """For each code point its lower-case letter (itself, where that is several), or -1 if it isn't a letter."""
    out = np.full(0x110000, -1, np.int32)
    for point in range(0x110000):
        ch = chr(point)
        if ch.isalpha():
            low = ch.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return nexts


class Layout:
    """Rows of a sparse table laid over each other: cell place[state] + symbol belongs to the state or to another one.

    Rows of several cells take the first place that fits; rows of one cell then fill the gaps. No two rows share a place.
    """

    def __init__(self, rows: list[dict[int, int]], width: int) -> None:
        size = np.array([len(r) for r in rows], np.int64)
        self.place = np.full(len(rows), -1, np.int64)
        self.free = np.ones(2 * int(size.sum()) + 2 * width + 64, bool)
        self.taken = np.zeros(len(self.free), bool)
        many = np.flatnonzero(size > 1)
        # rows come by descending size; those of one size are tried from the last one's place on
        at, last = 0, -1
        for state in many[np.argsort(-size[many], kind="stable")].tolist():
            symbols = np.array(sorted(rows[state]), np.int64)
            at, last = at if len(symbols) == last else 0, len(symbols)
            self.place[state] = at = self._first(symbols, at)
            self._grow(at + width + 1)
            self.taken[at] = True
            self.free[at + symbols] = False
        ones = np.flatnonzero(size == 1)
        symbols = np.array([next(iter(rows[s])) for s in ones.tolist()], np.int64)
        self._fill(ones, symbols, width)
        none = np.flatnonzero(size == 0)
        self._grow(int(np.count_nonzero(self.taken)) + len(none) + width)
        self.place[none] = np.flatnonzero(~self.taken)[: len(none)]
        end = int(self.place.max(initial=0)) + width + 1
        self.owner, self.next = np.full(end, -1, np.int64), np.zeros(end, np.int64)
        states = np.repeat(np.arange(len(rows)), size)
        cells = self.place[states] + np.array([c for r in rows for c in r], np.int64) if len(states) else states
        self.owner[cells] = self.place[states]
        self.next[cells] = self.place[np.array([to for r in rows for to in r.values()], np.int64)] if len(states) else 0

    def _grow(self, end: int) -> None:
        more = end - len(self.free)
        if more > 0:
            more += len(self.free)
            self.free = np.concatenate([self.free, np.ones(more, bool)])
            self.taken = np.concatenate([self.taken, np.zeros(more, bool)])

    def _first(self, symbols: np.ndarray, at: int) -> int:
        step = 32
        while True:
            self._grow(at + step + int(symbols[-1]) + 1)
            good = ~self.taken[at : at + step]
            for s in symbols.tolist():
                good &= self.free[at + s : at + s + step]
            hit = int(good.argmax())
            if good[hit]:
                return at + hit
            at += step
            step = min(4096, 2 * step)

    def _fill(self, states: np.ndarray, symbols: np.ndarray, width: int) -> None:
        left = np.arange(len(states))
        base = 0
        while len(left):
            self._grow(base + 2 * len(left) + 2 * width)
            cells = base + width + np.flatnonzero(self.free[base + width :])[: len(left)]
            now = left[: len(cells)]
            place = cells - symbols[now]
            good = np.zeros(len(place), bool)
            good[np.unique(place, return_index=True)[1]] = True
            good &= ~self.taken[place]
            self.place[states[now[good]]] = place[good]
            self.taken[place[good]] = True
            self.free[cells[good]] = False
            left = np.concatenate([now[~good], left[len(cells) :]])
            # cells that two rows wanted with one place stay open; the next round looks beyond the first of them
            base = max(base + 1, int(cells[0]) + 1 - width) if not good.any() else base


class CrossParser:
    """Parses texts against the sample text of each language."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        lower = lower_letters()
        texts = {k: lower[np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32)] for k, v in samples.items()}
        letters, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *texts.values()]), return_counts=True)
        letters, counts = letters[letters >= 0], counts[letters >= 0]
        letters = letters[np.argsort(-counts, kind="stable")]
        self.width = len(letters) + 2
        code = np.full(0x110000, OTHER, np.int32)
        code[letters] = np.arange(2, self.width)
        self.table = np.where(lower >= 0, code[lower], GAP).astype(np.int32)
        owners, nexts, firsts, self.fresh, self.logs, base = [], [], [], [], [], 0
        for lang in self.langs:
            symbols = self.symbols(samples[lang])
            rows = suffix_automaton(symbols.tolist())
            # the last row: a phrase has just ended with a symbol that the language's text lacks, or nothing is read yet
            layout = Layout([*rows, {}], self.width)
            fresh = base + int(layout.place[-1])
            first = np.full(self.width, fresh, np.int64)
            for c, to in rows[0].items():
                first[c] = base + int(layout.place[to])
            owners.append(np.where(layout.owner >= 0, layout.owner + base, -1))
            nexts.append(layout.next + base)
            firsts.append(first)
            self.fresh.append(fresh)
            self.logs.append(math.log2(len(symbols) + 2))
            base += len(layout.owner)
        kind = np.int32 if base < 1 << 31 else np.int64
        self.owner, self.next = (np.concatenate([np.zeros(0, kind), *x]).astype(kind) for x in (owners, nexts))
        self.first = np.array(firsts, kind).reshape(len(self.langs), self.width)

    def symbols(self, text: str) -> np.ndarray:
        """The letters' symbols, with one GAP for each run of other characters after a letter."""
        codes = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = codes != GAP
        if len(keep):
            keep[1:] |= codes[:-1] != GAP
        return codes[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases per text and language, symbols per text)."""
        rows = [self.symbols(t) for t in texts]
        lengths = np.array([len(r) for r in rows], np.int64)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(rows)), blocks)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        size = np.minimum(BLOCK, lengths[owner] - within * BLOCK)
        order = np.argsort(-size, kind="stable")
        owner, size = owner[order], size[order]
        starts = (np.cumsum(lengths) - lengths)[owner] + within[order] * BLOCK
        data = np.concatenate([*rows, np.zeros(BLOCK, np.int32)])
        lanes, langs = len(owner), len(self.langs)
        state = np.repeat(np.array(self.fresh, self.next.dtype)[:, None], lanes, axis=1)
        count = np.zeros((langs, lanes), np.int32)
        alive = np.searchsorted(-size, -np.arange(int(size[0]) if lanes else 0), "left")
        for i, m in enumerate(alive.tolist()):
            symbol, now = data[starts[:m] + i], state[:, :m]
            cell = now + symbol
            ended = self.owner.take(cell) != now
            count[:, :m] += ended
            state[:, :m] = np.where(ended, self.first.take(symbol, axis=1), self.next.take(cell))
        out = np.zeros((len(rows), langs), np.int64)
        for k in range(langs):
            out[:, k] = np.bincount(owner, count[k], len(rows))
        return out, lengths

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; the score is 1 - best / second best cost."""
        found, score = ["und"] * len(texts), np.zeros(len(texts))
        good = [i for i, t in enumerate(texts) if t and self.langs]
        at = 0
        while at < len(good):
            to, held = at, 0
            while to < len(good) and (to == at or held + len(texts[good[to]]) <= CHUNK_CHARS):
                held += len(texts[good[to]])
                to += 1
            part, at = good[at:to], to
            count, lengths = self.phrases([texts[i] for i in part])
            cost = count * np.array(self.logs) / np.maximum(lengths, 1)[:, None]
            best = np.argmin(cost, axis=1)
            low = np.sort(cost, axis=1)
            margin = 1 - low[:, 0] / np.maximum(low[:, 1], 1e-12) if len(self.langs) > 1 else np.ones(len(part))
            for j, i in enumerate(part):
                if lengths[j]:
                    found[i], score[i] = self.langs[best[j]], min(1.0, max(0.0, margin[j]))
        return found, score


def learn(labelled: DataFrame, text: str, lang: str, sample_chars: int = 40_000, total_chars: int = 4_000_000) -> dict[str, str]:
    """A sample of at most sample_chars characters of each language, and total_chars of all.

    Whole texts, with other characters than letters as single spaces, are cut into pieces of at most PIECE characters,
    and a language's distinct pieces are taken by the order of their hashes until the sample is full; so it doesn't
    matter in how many texts they lie. Levels of leading zero bits are summed first: the last level that is needed is
    the limit of what is collected, which is about twice the sample (a few thousand pieces at most).
    """
    letters = F.regexp_replace(F.col(text), r"\P{L}+", " ")
    pieces = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.regexp_extract_all(letters, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece")).where("piece <> ' '")
    rows = pieces.withColumn("order", F.xxhash64("piece")).withColumn("level", F.least(F.lit(64) - F.length(F.bin("order")), F.lit(LEVELS)))
    distinct = rows.groupBy("lang", "order", "level").agg(F.max(F.length("piece")).alias("chars"))
    sums: dict[str, dict[int, int]] = {}
    for r in distinct.groupBy("lang", "level").agg(F.sum("chars").alias("chars")).collect():
        sums.setdefault(r.lang, {})[r.level] = r.chars
    if not sums:
        return {}
    sample_chars = max(1, min(sample_chars, total_chars // len(sums)))
    edges = []
    for name, by_level in sorted(sums.items()):
        held, level = 0, LEVELS + 1
        while level > 0 and held < sample_chars:
            level -= 1
            held += by_level.get(level, 0)
        edges += [F.lit(name), F.lit(level)]
    # a literal map, so that the rows stay where they are; it has an entry for each language
    taken = rows.where(F.col("level") >= F.try_element_at(F.create_map(*edges), F.col("lang"))).groupBy("lang", "level", "order").agg(F.min("piece").alias("piece"))
    out: dict[str, str] = {}
    for r in sorted(taken.collect(), key=lambda r: (r.lang, -r.level, r.order)):
        if len(out.get(r.lang, "")) < sample_chars:
            out[r.lang] = f"{out.get(r.lang, '')}\n{r.piece}"[: sample_chars + 1]
    return {k: v for k, v in out.items() if any(c.isalpha() for c in v)}


def identify(docs: DataFrame, samples: dict[str, str], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row, from the text alone."""
    spark = docs.sparkSession
    importable(spark)
    held = spark.sparkContext.broadcast(CrossParser(samples))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held.value
        for batch in batches:
            found, score = parser.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
