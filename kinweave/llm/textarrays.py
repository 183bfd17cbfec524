"""Arrow string columns as NumPy arrays: byte views, words, 64-bit word hashes.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Their hash is a polynomial over per-byte random
values modulo 2**64, made from one prefix sum, then mixed with the word's length. Work goes in chunks of
a few megabytes, so memory doesn't follow the Arrow batch or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
LONG_WORD = 1 << 16
U64 = np.uint64

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x ^ U64(int.from_bytes(blake2b(seed.to_bytes(8, "little"), digest_size=8).digest(), "little")))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, 2 * CHUNK), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    column = column.fill_null("").cast(pa.large_binary()) if column.null_count else column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about limit bytes; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of each run of bytes outside gap, and the number of runs of each row."""
    white = gap[data]
    begins = ~white
    ends = begins.copy()
    starts = offsets[:-1][offsets[:-1] < len(data)]
    begins[1:] &= white[:-1]
    begins[starts] = ~white[starts]
    ends[:-1] &= white[1:]
    finals = offsets[1:][offsets[1:] > 0] - 1
    ends[finals] = ~white[finals]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return first, last, np.diff(np.searchsorted(first, offsets))


def byte_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; they depend on the bytes alone, not on where they lie."""
    raw = (sums[last] - sums[first]) * powers(pow(BASE, -1, 1 << 64), len(sums))[first]
    return mix(raw ^ (last - first).astype(np.uint64) * U64(0x9E3779B97F4A7C15))


def _hash_run(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last, count = spans(data, offsets)
    hashes = range_hashes(byte_sums(data), first, last)
    for i in np.flatnonzero(last - first > LONG_WORD):
        hashes[i] = int.from_bytes(blake2b(data[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes, count


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, number of words of each row) for one run of rows.

    A row of more than two chunks is read in pieces cut at white space; only a single word may exceed them.
    """
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    if len(data) <= 2 * CHUNK or len(offsets) > 2:
        return _hash_run(data, offsets)
    parts, at = [], 0
    while at < len(data):
        to = min(at + CHUNK, len(data))
        while to < len(data) and not WHITE[data[to]]:
            step = np.flatnonzero(WHITE[data[to : to + LONG_WORD]])
            to = min(len(data), to + (int(step[0]) if len(step) else LONG_WORD))
        parts.append(_hash_run(data[at:to], np.array([0, to - at]))[0])
        at = to
    out = np.concatenate(parts)
    return out, np.array([len(out)])
