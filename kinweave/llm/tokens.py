"""Token counts of whole texts from counts of distinct pre-tokens.

A pre-token is a run of spaces (or of U+2581, which the library uses for a space) and the run of other
characters after it. No piece of the vocabulary has another character before a U+2581 (checked when a model
is loaded), so no merge crosses the border of two pre-tokens and a text has as many pieces as its pre-tokens
together.

Documents are read in blocks of a few megabytes. A block holds, for each document, how often each of its distinct
pre-tokens occurs, by the pre-token's place in the block's vocabulary. The library counts the pieces of each distinct
pre-token once; the counts are joined to the frequencies by place, and a document sums count times frequency. Ids of
whole texts never exist. A worker keeps the counts of short pre-tokens in a table of bounded size, so frequent ones are
counted once for all its blocks. Nothing is shuffled: a join across the whole corpus would move the vocabularies and the
frequencies, which are larger than the texts (figures in the README).

Defined results: null counts as the empty text (0 bytes, 0 tokens); repeated rows are counted each; a text
without spaces is one pre-token, however long; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.runtime import importable

MARK = "▁"
PRETOKEN = re.compile(r"[^ ▁]+|[ ▁]+[^ ▁]*")
BLOCK_CHARS = 1 << 22
#: Pre-tokens whose counts a worker keeps, and their length at most.
KEPT, SHORT = 300_000, 40
_counters: dict[str, "PieceCounter"] = {}


def pretokens(text: str) -> list[str]:
    """The pre-tokens, each without its first space, as the library puts one before every text.

    A lone space at the end of a text is then the empty string, which counts as the one piece it is.
    """
    found = PRETOKEN.findall(text)
    if found and found[0][0] in f" {MARK}":
        return [found[0], *(x[1:] for x in found[1:])]
    return [x if i == 0 else x[1:] for i, x in enumerate(found)]


class PieceCounter:
    """Counts pieces with a SentencePiece model whose pieces hold a space at their start only."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this model crosses a space; pre-tokens can't be counted apart")
        if self.model.encode("a", out_type=str)[:1] == ["a"] or self.model.normalize("  a  b ") != f"{MARK * 3}a{MARK * 2}b{MARK}":
            raise ValueError("this model's normaliser drops or adds spaces in another way")

        self.known: dict[str, int] = {"": 1}

    def pieces(self, distinct: list[str]) -> np.ndarray:
        """The number of pieces of each pre-token."""
        new = [x for x in distinct if x not in self.known]
        got = dict(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True)) if new else {}
        out = np.array([self.known[x] if x in self.known else got[x] for x in distinct], np.int64)
        if len(self.known) < KEPT:
            self.known.update((x, n) for x, n in got.items() if len(x) <= SHORT)
        return out


def _counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


class Block:
    """Documents as frequencies of the places of their pre-tokens in one vocabulary."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.distinct: list[int] = []
        self.places: list[int] = []
        self.frequencies: list[int] = []
        self.chars = 0

    def add(self, text: str) -> None:
        counts = Counter(pretokens(text))
        self.distinct.append(len(counts))
        self.places += [self.number.setdefault(x, len(self.number)) for x in counts]
        self.frequencies += counts.values()
        self.chars += len(text)

    def tokens(self, pieces: np.ndarray) -> np.ndarray:
        """Tokens of each document, from the pieces of each place of the vocabulary."""
        weights = pieces[np.array(self.places, np.int64)] * np.array(self.frequencies, np.int64) if self.places else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(weights)])
        ends = np.cumsum(np.array(self.distinct, np.int64))
        return total[ends] - total[ends - np.array(self.distinct, np.int64)]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_column: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_path)
        for batch in batches:
            column = batch.column(1).fill_null("")
            counts, block = [np.zeros(0, np.int64)], Block()
            for value in column.to_pylist():
                block.add(value)
                if block.chars >= block_chars:
                    counts.append(block.tokens(counter.pieces(list(block.number))))
                    block = Block()
            counts.append(block.tokens(counter.pieces(list(block.number))))
            n = np.concatenate(counts)
            size = pa.compute.binary_length(column.cast(pa.large_binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], schema.names)

    return rows.mapInArrow(run, schema)
