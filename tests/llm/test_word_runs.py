"""op10: new words go to the tokenizer many in a call, with the ids that each has alone."""

import numpy as np
import pyarrow as pa
import pytest

from tagweave.llm import tokenbin
from tagweave.llm.queries import tokenizer_path

#: Words that are one or two pieces, and words that end, or are cut, in other ways.
WORDS = ["plain", "Éauxçré,", "ßtzü***", "a.</w>", "<|startoftext|>", "x<|", "It's", "o'", "İstanbul", "Kelvin", "क़", "áb", "≮", "ª", "À×", "a\u0085b", "2024-01-02",
         "日本,", "a1b2", "'", "...", "\x00", "b\t", "end!!"]


@pytest.fixture(scope="module")
def encoder():
    return tokenbin.WordEncoder(tokenizer_path(), 2)


def test_calls_are_few_and_ids_as_alone(encoder):
    """Failed before: a call of the tokenizer got each word as a text of its own."""
    words = [*WORDS, *(w + c for w in ("plain", "éà", "X") for c in "abcdefghijklmnopqrstuvwxyz,.-*!")]
    asked, real = [], encoder.tokenizer

    class Asked:
        def encode_batch_fast(self, texts, **k):
            asked.append(len(texts))
            return real.encode_batch_fast(texts, **k)

    encoder.tokenizer = Asked()
    try:
        found = encoder._fresh(words)
    finally:
        encoder.tokenizer = real
    assert found == encoder._alone(words)
    assert sum(asked) < len(WORDS)


@pytest.mark.parametrize("texts", [WORDS, [" ".join(WORDS * 40), "", " ".join(WORDS[::-1])], [""], []])
def test_texts_of_odd_words(encoder, texts):
    whole = tokenbin.WordEncoder(tokenizer_path(), 2, by_word=False)
    assert encoder.marks is not None and whole.marks is None
    assert all(np.array_equal(a, b) for a, b in zip(encoder.encode(pa.array(texts, pa.string())), whole.encode(pa.array(texts, pa.string()))))


def test_marks_that_do_not_add_up(encoder):
    """Words whose pieces are not as many as expected are encoded alone."""
    words, marks = ["one", "two,", "three"], encoder.marks
    try:
        encoder.marks = np.zeros_like(marks)
        assert encoder._fresh(words) == encoder._alone(words)
    finally:
        encoder.marks = marks
