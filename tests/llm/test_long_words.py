"""Toxicity reads words to their ends."""

import numpy as np
import pytest

from slicewright.llm import toxicity


def test_pieces_cover_long_words():
    assert toxicity.words_of(None) == []
    assert toxicity.words_of("a " + "b" * 40) == ["a", "b" * 40]
    for n in (41, 59, 60, 61, 80, 500, 10_001):
        word = "".join(chr(0x4E00 + k % 20_000) for k in range(n))
        pieces = toxicity.words_of(f"x {word} y")[1:-1]
        assert max(map(len, pieces)) <= toxicity.PIECE
        assert "".join(p[: toxicity.STEP] for p in pieces[:-1]) + pieces[-1] == word
        assert all(any(word[k : k + 20] in p for p in pieces[k // 20 - 1 if k >= 20 else 0 : k // 20 + 1]) for k in range(n - 19))


@pytest.mark.parametrize("glue", ["", "-", "_"])
def test_an_insult_late_in_a_long_word_is_seen(glue):
    r = np.random.default_rng(0)
    vocabulary = [f"word{i}" for i in range(200)]
    make = lambda bad: " ".join(["nasty" if bad and k in (20, 70) else vocabulary[r.integers(200)] for k in range(90)])
    net = toxicity.fit([(make(k % 3 == 0), int(k % 3 == 0)) for k in range(300)])
    clean = glue.join(f"word{i}" for i in range(40))
    scores = toxicity.Reader(net).score([clean, clean + glue + glue.join(["nasty"] * 8)])
    assert scores[1] > scores[0]
