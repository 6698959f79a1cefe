"""Words that come again are not learned again when the memo is full."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from waymesh.llm import token_output


@pytest.mark.parametrize("entries", [12, 4, 500_000])
def test_frequent_words_outlive_a_full_memo(monkeypatch, entries):
    monkeypatch.setattr(token_output, "MEMO_ENTRIES", entries)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder, learned = token_output.WordEncoder(tokenizer, np.uint16), []
    learn = encoder.learn
    encoder.learn = lambda words: (learned.extend(words), learn(words))[1]
    for k in range(20):
        text = f"alpha beta, gamma. delta {chr(97 + k)}xo {chr(97 + k)}yo {chr(97 + k)}zo"
        n, ids = encoder.encode(pa.array([text, None]), 1)
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert n.tolist() == [len(want) + 1, 1] and ids.tolist() == [*want, 1, 1]
        assert len(encoder.memo) <= entries + 9
    if entries > 4:
        assert [learned.count(w) for w in (b"alpha", b"beta,", b"gamma.", b"delta")] == [1] * 4
