"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query on trigrams that any match must contain
(concatenation: and; alternatives: or; short sets of exact strings are multiplied out). For a block of
documents an inverted index holds, for each trigram that some rule needs, the posting list of documents as
a bitmap; the queries intersect and unite the bitmaps, and only candidates are scanned with the rule itself.
Trigrams are of bytes with A-Z folded, so case doesn't matter for the index. A rule without a mandatory
trigram (long hexadecimal runs) scans every document.

Defined results: null is the empty text; spans are in code points, end exclusive; matches of one kind are
leftmost and don't overlap, and those that fail the rule's test are dropped; repeated rows are scanned each; texts of
any length are scanned whole, in time proportional to their length whatever they hold; other columns, whatever their
names, are ignored by reports and kept by redact(); an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.runtime import importable
from kinweave.llm.textarrays import CHUNK, FOLD, byte_rows, chunks

ALL = ("all",)
EXACT_LIMIT = 48

# ---- regular expression -> Boolean trigram query: ("all",), ("gram", t), ("and", ...), ("or", ...)


def _both(kind: str, parts: list[tuple]) -> tuple:
    flat: list[tuple] = []
    for p in parts:
        if p == ALL:
            if kind == "or":
                return ALL
            continue
        flat += p[1:] if p[0] == kind else [p]
    flat = list(dict.fromkeys(flat))
    return ALL if not flat else flat[0] if len(flat) == 1 else (kind, *flat)


def _grams(strings: set[bytes]) -> tuple:
    """What a text must hold to contain one of the strings."""
    return _both("or", [_both("and", [("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _charset(items: list) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).encode().lower())
        elif op is C.RANGE and value[1] - value[0] < 64 and value[1] < 128:
            out |= {chr(x).encode().lower() for x in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _query(nodes: list) -> tuple[set[bytes] | None, tuple]:
    """(all strings that the sequence can match, folded, or None if too many; query that every match meets)."""
    need: list[tuple] = []
    run: set[bytes] = {b""}
    whole = True

    def flush() -> None:
        nonlocal run, whole
        need.append(_grams(run))
        run, whole = {b""}, False

    for op, value in nodes:
        exact: set[bytes] | None = None
        query = ALL
        if op is C.LITERAL:
            exact = {chr(value).encode().lower()}
        elif op is C.IN:
            exact = _charset(value)
        elif op is C.SUBPATTERN:
            exact, query = _query(list(value[3]))
        elif op is C.BRANCH:
            parts = [_query(list(x)) for x in value[1]]
            exact = None if any(p[0] is None for p in parts) else set().union(*(p[0] for p in parts))
            query = _both("or", [p[1] if p[0] is None else _grams(p[0]) for p in parts])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            got, sub = _query(list(inner))
            if got is not None and low == high <= 8:
                exact = {b"".join(x) for x in product(sorted(got), repeat=low)} if len(got) ** low <= EXACT_LIMIT else None
            elif got is not None and (low, high) == (0, 1):
                exact = got | {b""}
            if low > 0:
                query = sub if got is None else _grams(got)
        elif op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
            exact = {b""}
        if exact is not None and len(exact) * len(run) <= EXACT_LIMIT:
            run = {a + b for a in run for b in exact}
            continue
        flush()
        need.append(query if exact is None else _grams(exact))
    if whole:
        return run, _grams(run)
    need.append(_grams(run))
    return None, _both("and", need)


def trigram_query(pattern: str) -> tuple:
    return _query(list(parser.parse(pattern)))[1]


def grams_of(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "gram" else set().union(*map(grams_of, query[1:])) if len(query) > 1 else set()


# ---- rules


@dataclass(frozen=True)
class Rule:
    """least: characters that the group must have, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    @cached_property
    def query(self) -> tuple:
        return trigram_query(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if len(m[self.group]) >= self.least]


_GAP = r"(?:\s|\\[nrt])"
#: The BEGIN line, the two header lines of encrypted keys, then the base64 body to the END line. Without an END line the body is
#: its runs of 16 characters or more and a last shorter one that is padded or fills a line. Line breaks may be escaped.
PEM = (
    r"-----BEGIN ((?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?)PRIVATE KEY-----"
    rf"(?:{_GAP}*(?:Proc-Type|DEK-Info):[^\r\n\\]*)*"
    r"(?:(?:[A-Za-z0-9+/=\s]++|\\[nrt])*+-----END \1PRIVATE KEY-----"
    rf"|(?:{_GAP}*[A-Za-z0-9+/]{{16,}}={{0,2}})+(?:{_GAP}+[A-Za-z0-9+/]+(?:={{1,2}}|(?=\s*[\r\n]|\\[nr]|\s*\Z)))?)?"
)

#: The base kinds, then what the method adds. A token of three parts starts where its run of characters starts, so that a
#: long run is tried once.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("pem", PEM),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")


class TrigramIndex:
    """Postings of the trigrams that some rule needs, over a run of documents."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.grams = sorted(set().union(*(grams_of(r.query) for r in rules)))
        self.number = {g: i for i, g in enumerate(self.grams)}
        self.slot = np.zeros(1 << 24, np.uint16)
        for g, i in self.number.items():
            self.slot[g[0] << 16 | g[1] << 8 | g[2]] = i + 1

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Row i: a bitmap of the documents that hold trigram i."""
        out = np.zeros((len(self.grams), len(offsets) - 1), bool)
        for first, last in chunks(offsets):
            for lo in range(int(offsets[first]), int(offsets[last]), CHUNK):
                hi = min(lo + CHUNK + 2, int(offsets[last]))
                b = FOLD[data[lo:hi]].astype(np.uint32)
                if len(b) < 3:
                    continue
                got = self.slot[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
                at = np.flatnonzero(got)
                doc = np.searchsorted(offsets, at + lo, "right") - 1
                inside = at + lo + 3 <= offsets[doc + 1]
                out[got[at[inside]].astype(np.int64) - 1, doc[inside]] = True
        return out

    def candidates(self, rule: Rule, postings: np.ndarray) -> np.ndarray:
        def meet(q: tuple) -> np.ndarray:
            if q == ALL:
                return np.ones(postings.shape[1], bool)
            if q[0] == "gram":
                return postings[self.number[q[1]]]
            return (np.logical_and if q[0] == "and" else np.logical_or).reduce([meet(x) for x in q[1:]])

        return np.flatnonzero(meet(rule.query))


Span = tuple[int, str, int]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules, self.index = rules, TrigramIndex(rules)
        self.order = {r.kind: i for i, r in enumerate(rules)}

    def scan(self, column: pa.Array) -> list[list[Span]]:
        """(start, kind, end) of every span of each row, by start, then in the rules' order."""
        texts: list = [None] * len(column)
        found: list[list[Span]] = [[] for _ in texts]
        postings = self.index.postings(*byte_rows(column))
        for rule in self.rules:
            for i in self.index.candidates(rule, postings).tolist():
                if texts[i] is None:
                    texts[i] = column[i].as_py() or ""
                if rule.kind == "hex" and not _LONG_HEX.search(texts[i]):
                    continue
                found[i] += [(a, rule.kind, b) for a, b in rule.spans(texts[i])]
        for spans in found:
            spans.sort(key=lambda s: (s[0], self.order[s[1]]))
        return found


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def _scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def joined(spans: list[Span], kinds: set[str] | None = None) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans if kinds is None or k in kinds)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (array of start, kind, end) of every row."""
    importable(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in batches:
            spans = [[{"start": a, "kind": k, "end": b} for a, k, b in row] for row in scanner.scan(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(run, schema)


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans, as kind:start:end joined by commas."""
    base = tuple(r.kind for r in rules if r.base)
    found = find_secrets(docs, rules, id_column, text)

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    own = F.filter("spans", lambda s: s["kind"].isin(*base))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, base), F.sha2(line(own), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: Callable[[str], str] | None = None) -> DataFrame:
    """The rows with every span of the text replaced by a mark; overlapping spans become one. Null texts stay null."""
    importable(docs.sparkSession)
    names = docs.columns
    where = names.index(text)

    def clean(value: str, spans: list[Span]) -> str:
        out, at = [], 0
        for a, kind, b in spans:
            if a >= at:
                out += [value[at:a], mark(kind) if mark else f"[{kind}]"]
            at = max(at, b)
        return "".join([*out, value[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(rules)
        for batch in batches:
            column = batch.column(where)
            hit = {i: s for i, s in enumerate(scanner.scan(column)) if s}
            if hit:
                column = pa.array([clean(v, hit[i]) if i in hit else v for i, v in enumerate(column.to_pylist())], column.type)
            yield pa.RecordBatch.from_arrays([column if i == where else batch.column(i) for i in range(len(names))], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

