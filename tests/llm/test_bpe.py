"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from credence.llm import bpe
from credence.llm.queries import op2_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", "x1", "12", "　", "\x85", "\xa0", "\x1c", "<|endoftext|>", "aaaa", "...", "日本", "​", "I'll", " \n", " the", "ing", "\0", " The.", " été,,", " no%%%", " 日本.", " ab'", ".'s", " -a"]


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("words", [0, 50])
def test_random_texts_encode_as_the_library_does(words):
    rng, encode = random.Random(7), library().encode_ordinary
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(8000)] + ["a" * 5000, "ab" * 3001, " " * 4000, ""]
    units = bpe.Units(bpe.replay_encoder(PATH, public_tokenizers.PATTERN), size=500, words=words)
    got = [x for i in range(0, len(texts), 500) for x in units(texts[i : i + 500])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [encode(t) for t in texts]


def test_small_vocabularies_with_overlapping_merges():
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate((b"aa", b"ab", b"ba", b"aab", b"abab", b"aaaa", b"baa"))}
    own, rng = bpe.MergeReplay(ranks), random.Random(2)
    there = tiktoken.Encoding("small", pat_str=r"[^ ]+| ", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(rng.choices("abc", k=rng.randint(0, 14))) for _ in range(3000)]
    assert [x.tolist() for x in own.encode([w.encode() for w in words])] == [there.encode_ordinary(w) for w in words]


def test_whole_table_and_edges(spark, sf_dir):
    encode = library().encode_ordinary
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2_bpe(spark, sf_dir).collect()} == want


def rows_of(rows):
    return [tuple(r) for r in rows]


def test_nulls_repeats_empty_long_and_clashing_columns(spark):
    long = "word's 12  x\n" * 200_000
    df = spark.createDataFrame([(None, None, 1), (3, "", 2), (3, "", 2), (5, long, 3)], "doc_id long, text string, ids int")
    rows = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded).decode() == (long if r.doc_id == 5 else "")) for r in rows) == [(-1, True), (3, True), (3, True), (5, True)]
    assert sorted(bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect(), key=str) == sorted(rows_of(rows), key=str)
    assert bpe.encode(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
