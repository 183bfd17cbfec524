import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import textarrays as X

TEXTS = st.lists(st.one_of(st.none(), st.text("ab \t\né日 ", max_size=20)), max_size=6)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_words_and_hashes(texts):
    data, offsets = X.byte_rows(pa.array(texts, pa.string()))
    hashes, count = X.word_hashes(data, offsets) if len(offsets) > 1 else (np.zeros(0, np.uint64), np.zeros(0, int))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert count.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    by_word = {}
    for w, h in zip(flat, hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_long_rows_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    data, offsets = X.byte_rows(pa.array([text]))
    whole = X.word_hashes(data, offsets)
    monkeypatch.setattr(X, "CHUNK", 1000)
    parts = X.word_hashes(data, offsets)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_sliced_arrays():
    column = pa.array(["aa bb", None, "cc", "dd ee ff"]).slice(1, 3)
    assert X.word_hashes(*X.byte_rows(column))[1].tolist() == [0, 1, 3]


def test_chunks_cover_all_rows():
    offsets = np.array([0, 5, 5, 40, 41, 41])
    runs = list(X.chunks(offsets, 10))
    assert [i for a, b in runs for i in range(a, b)] == list(range(5))
