import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
COUNTER = tokens.PieceCounter(PATH)
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)


def counted(texts):
    block = tokens.Block()
    for t in texts:
        block.add(t)
    return block.tokens(COUNTER.pieces(list(block.number))).tolist()


@given(st.lists(st.text(st.sampled_from(" ▁ab\n\té.THE日 　<s>/0🙂"), max_size=25), max_size=5))
@settings(max_examples=500, deadline=None)
def test_counts_equal_the_library(texts):
    assert counted(texts) == [len(MODEL.encode(t)) for t in texts]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    assert counted([text]) == [len(MODEL.encode(text))]


def test_pretokens_are_counted_once():
    block = tokens.Block()
    for t in ["a b a b", "b a", "a  b"]:
        block.add(t)
    assert list(block.number) == ["a", "b", " b"] and block.frequencies == [2, 2, 1, 1, 1, 1] and block.distinct == [2, 2, 2]


def test_bounded_table(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 2)
    counter = tokens.PieceCounter(PATH)
    for texts in (["a b", "c d e", "one two"], ["two one b a " * 3, "f g"]):
        for t in texts:
            block = tokens.Block()
            block.add(t)
            assert block.tokens(counter.pieces(list(block.number))).tolist() == [len(MODEL.encode(t))]
    assert len(counter.known) <= 3


@pytest.mark.parametrize("block_chars", [1, 5000, tokens.BLOCK_CHARS])
def test_whole_table(spark, sample, odd_docs, no_docs, block_chars):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    for frame in (docs, odd_docs.repartition(3)):
        texts = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
        want = sorted(((i, len(t.encode()), len(MODEL.encode(t)), len(MODEL.encode(t)) > 4096) for i, t in texts), key=repr)
        assert sorted((tuple(r) for r in tokens.token_counts(frame, PATH, block_chars=block_chars).collect()), key=repr) == want
    assert tokens.token_counts(no_docs, PATH).count() == 0
