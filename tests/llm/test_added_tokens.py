"""The token store's encoder gives the ids of an untouched tokenizer, added tokens included."""

import numpy as np
import pytest

from slicewright.llm import token_store


def test_added_tokens_are_matched_as_the_tokenizer_does(tmp_path):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import AddedToken, Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    spaced = Tokenizer.from_file(path)
    spaced.add_tokens([AddedToken("b c", normalized=False)])
    spaced.save(str(tmp_path / "spaced.json"))
    texts = ["p <|endoftext|>. q", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x <|endoftext|", "plain words", "a b", "c d", "a b c d", ""]
    for name in (path, str(tmp_path / "spaced.json")):
        plain = Tokenizer.from_file(name)
        wanted = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert token_store.Encoder(name).encode(texts) == wanted
        assert [token_store.Encoder(name).encode([t])[0] for t in texts] == wanted
    assert np.frombuffer(token_store.Encoder(path).encode(texts[:1])[0], "<u4").tolist() == [79, 220, 50256, 13, 10662]
