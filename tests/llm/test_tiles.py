"""Tile lookup against the library on random texts, with collisions and small tables."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_bpe import PARTS
from test_repair import PATH, library
from tokenizers import Tokenizer

from credence.llm import tiles


@pytest.mark.parametrize("bits", [21, 8])
def test_random_texts(bits, monkeypatch):
    rng, own = random.Random(bits), library()
    own_ids = lambda t: own.encode(t or "", add_special_tokens=False).ids
    find = tiles.Tiles(tiles.Library(PATH), bits)
    monkeypatch.setattr(tiles, "JOINED", 1 << bits - 4)
    for _ in range(30):
        few = [rng.choice([" word", " Word,", "x.", " été", " a\nb", "<|endoftext|>", "\n <|endoftext|>", *PARTS]) for _ in range(6)] if bits == 8 else [" word", " Word,", "x.", " été", " a\nb", "<|endoftext|>", "\n <|endoftext|>", *PARTS]
        texts = [rng.choice([None, "", "".join(rng.choices(few, k=rng.randint(0, 20)))]) for _ in range(40)]
        column = pa.array(["pad", *texts], pa.string())[1:]
        assert [np.frombuffer(x, "<u4").tolist() for x in find(column)] == [own_ids(t) for t in texts]


def test_equal_hashes_of_different_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "mix", lambda x: x * np.uint64(0) + np.uint64(5))
    own = library()
    texts = ["one two three", "four five", "", "one one"]
    got = tiles.Tiles(tiles.Library(PATH))(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokenizers_without_tiles():
    """One whose words end in a mark, and whose texts are lower-cased."""
    path = public_tokenizers.path("word_bpe_49k.json")
    texts, own = ["Some words, here", "", "again  and again"], Tokenizer.from_file(path)
    got = tiles.Tiles(tiles.Library(path))(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]
