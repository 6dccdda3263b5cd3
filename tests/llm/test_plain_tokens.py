"""Ids equal the plain call of the tokenizers library, added tokens included."""

import numpy as np
import pytest

from framemill.llm import tokens


@pytest.mark.parametrize("t", ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y z", "plain words only", "<|endoftext", "a  <|endoftext|>"])
def test_added_token(t):
    from tokenizers import Tokenizer

    path = tokens._tokenizer_path(tokens.TOKENIZER)
    plain = Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids
    enc = tokens.Encoder(path)
    assert np.frombuffer(enc.encode([t])[0], enc.kind).tolist() == plain
    assert np.frombuffer(enc.encode([t])[0], enc.kind).tolist() == plain  # from the memo
