"""Operator 10's cached ids against the tokenizer on the whole text."""

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from sporeframe.llm.packing import WordCache

TEXTS = [
    "<|ENDOFTEXT|> A<|StartOfText|>b <|endoftext|>. <|endoftext|>ABC", "H̱ T̈ J̌", "xH̱y AT̈. W̊ Y̊ Ϊ́",
    "École École Ünter İ İ ẞ ΣΑΣ ﬁ Å", "Plain WORDS, DON'T <| A|> <|B <", "",
]


def ids_of(cache, texts):
    """Through one slice."""
    raw = [t.encode() for t in texts]
    ids, at = cache.encode(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_tokenizer(text):
    file = path("word_bpe_49k.json")
    assert ids_of(WordCache(file), [text]) == [Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids]


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_slices_of_many_texts_and_forgotten_pieces(most):
    """Texts next to each other without white space between, in slices that make the cache forget."""
    file = path("word_bpe_49k.json")
    whole, cache, rng = Tokenizer.from_file(file), WordCache(file, most), np.random.default_rng(0)
    words = ["x" * 32, "y" * 33 + ".", "é" * 16, "é" * 17, "ab" * 900, "aaaaaaa", "hello!?", "ß-ø", "ThE", "Word", "wörd", "it's", "don't!", "<|x", "A<|", "長い", "x.", "12ab", "...", "\x0b", "\u00a0", "\u2003z", "naïve,", "QQ"]
    for _ in range(30):
        texts = ["", *TEXTS, *("".join(rng.choice([*words, " ", "\n"]) for _ in range(rng.integers(0, 20))) for _ in range(5))]
        assert ids_of(cache, texts) == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_merges_of_every_length():
    """Random small-letter words through the merges alone."""
    file, rng = path("word_bpe_49k.json"), np.random.default_rng(1)
    model, merges = Tokenizer.from_file(file).model, WordCache(file).merges
    syllables = ["a", "b", "th", "the", "ing", "tion", "er", "zz", "qu", "ou", "s"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.integers(1, 12)))[:32] for _ in range(4000)]
    raw = [w.encode() for w in words]
    at = np.cumsum([0, *map(len, raw)])
    ids, sizes = merges.apply(np.frombuffer(b"".join(raw), dtype=np.uint8), at[:-1], np.diff(at))
    ends = np.cumsum(sizes)
    assert [ids[b - n : b].tolist() for n, b in zip(sizes, ends)] == [[t.id for t in model.tokenize(w)] for w in words]
