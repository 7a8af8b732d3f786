"""The pair occurrence index against the library, with its lists merged as arrays, one by one, or both."""

import random

import pytest

from tracewright.llm import bpe


@pytest.mark.parametrize("many", [0, 3, 128])
def test_index_gives_the_library_s_ids(monkeypatch, many):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "MANY", many)
    rng = random.Random(many)
    bits = ["a", "b", "ab", "the", " ", "é", "𝒳", "\n", "aaaa", "<|endoftext|>", "!!", "1", "zzz", "ing"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["a" * 50000, "ab" * 30000, "".join(rng.choice("abcdefgh") for _ in range(60000)), "", "<|endoftext|>", "<|endoftext|>" * 3]
    path = bpe.vocabulary_file()
    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    encoder = bpe.Encoder(bpe.Vocabulary(open(path, encoding="utf-8").read()))
    for _ in range(2):  # the second time all words are known
        got = [ids.tolist() for group in bpe.groups(texts) for ids in encoder.encode_all(group)]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
