import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairscreen.llm import arrays
from pairscreen.llm.catalog import word_tokenizer
from pairscreen.llm.tokens import Encoder

from llm_cases import words_of

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abZ'éÉ×÷.!<|> \n\t\r\x0b9\u0301 sltre\x1c中ßÿ", max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_shingles(texts):
    data, offsets = arrays.buffer(pa.array(texts, pa.string()))
    hashes, rows = arrays.words(data, offsets)
    want = [(i, w) for i, t in enumerate(texts) for w in words_of(t)]
    assert rows.tolist() == [i for i, _ in want]
    same = {}
    for h, (_, w) in zip(hashes.tolist(), want):
        assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)
    values, of = arrays.distinct(*arrays.shingles(hashes, rows, len(texts), 2), len(texts))
    for i, t in enumerate(texts):
        w = words_of(t)
        expected = {tuple(w[j:j + 2]) for j in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
        assert (of == i).sum() == len(expected)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(word_tokenizer())


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_encoder_agrees_with_tokenizer(encoder, texts):
    column = pa.array(texts, pa.string())
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encoder.ids(column)] == want
    assert encoder.lengths(column).tolist() == [len(x) for x in want]


def test_encoder_special_strings_and_long_texts(encoder, monkeypatch):
    texts = ["a<|endoftext|>b", "<|ENDOFTEXT|>", "don't 'S x'Ll", "word " * 5000, "x" * 30_000, None, ""]
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encoder.ids(pa.array(texts))] == want
    monkeypatch.setattr("pairscreen.llm.tokens.CACHE_PIECES", 3)  # forgets all the time
    assert [x.tolist() for x in encoder.ids(pa.array(texts))] == want


def test_chunks_cover_rows_once():
    texts = pa.array(["abc", None, "", "d" * 100, "e"])
    assert list(arrays.chunks(texts, 10)) == [(0, 3), (3, 4), (4, 5)]
    assert list(arrays.chunks(pa.array([], pa.string()))) == []


def test_sliced_columns():
    texts = pa.array(["one two", "three", None, "four five six"]).slice(1, 3)
    data, offsets = arrays.buffer(texts)
    assert bytes(data) == b"threefour five six" and offsets.tolist() == [0, 5, 5, 18]
    assert np.array_equal(arrays.words(data, offsets)[1], [0, 2, 2, 2])


def test_tasks_leave_no_freed_memory():
    """What a task has freed goes back to the system, though a later block is in use."""
    import psutil

    def run(batches):
        blocks = [bytes(60_000) for _ in range(2000)]
        kept.append(bytes(60_000))
        blocks.clear()
        yield from batches

    def held():
        return psutil.Process().memory_info().rss

    kept = []
    out = arrays.giving_back(run)(iter([1, 2]))
    before = held()
    assert list(out) == [1, 2] and held() - before < 40_000_000
    assert list(arrays.giving_back(run)(iter([]))) == []
