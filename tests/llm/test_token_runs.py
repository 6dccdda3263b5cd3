"""Texts as Arrow arrays: distinct pieces are looked up once a batch, ids equal the plain call whatever the white space."""

import random

import pyarrow as pa
import pytest

from framemill.llm import tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(tokens._tokenizer_path(tokens.TOKENIZER))


def test_repeated_words_are_looked_up_once(enc):
    looked = []

    class Counting(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    enc.memo = Counting()
    texts = ["alpha beta gamma\nalpha, " * 500 + "end"] * 20
    assert enc.encode(texts) == enc.raw(texts)
    assert 0 < len(looked) < 50


SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]


@pytest.mark.parametrize("c", [*SPACES, "\x00", "\u180e", "\u200b", "\ufeff"])
def test_white_space(enc, c):
    texts = [f"{a}{c}{b}" for a in ("", "x", "x ", "x\n", "x.", " ") for b in ("", "y", " y", "\ny", ".y", " ")]
    texts += [f"one {t} two\nthree" for t in texts] + [c * 3]
    assert enc.encode(pa.array(texts)) == enc.raw(texts)
    assert enc.encode(pa.array(texts)) == enc.raw(texts)  # from the memo


def test_random_texts(enc):
    rnd = random.Random(5)
    parts = [" ", "\xa0", "\n", "\t", "\xa0", "\x1c", "a", "Bc", "'s", "'", ".", "!!", "12", "é", "ü", "中文", "𝄞", "²", "\u0301", "Ġ", "Ċ", "<|endoftext|>"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(25))) for _ in range(3000)]
    column = pa.array(["", *texts]).slice(1)
    assert enc.encode(column) == enc.raw(texts)


def test_runs_of_texts():
    texts = pa.array(["", "abc", "é" * 50, "", "abc", "abcd", ""])
    assert list(tokens.text_runs(texts, 7)) == [(0, 2), (2, 1), (3, 4)]
    assert list(tokens.text_runs(texts.slice(3), 3)) == [(0, 2), (2, 1), (3, 1)]
    assert list(tokens.text_runs(texts.slice(7), 7)) == []
