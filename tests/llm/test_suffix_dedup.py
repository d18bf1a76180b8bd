"""Removal of repeated strings against a scan of all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from credence.llm import suffix_dedup as sd


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    often = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if often[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append((len(d), [tuple(map(int, e)) for e in edges.reshape(-1, 2)], bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def check(spark, texts, length, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, k string").repartition(3)
    got = {r.doc_id: (r.n_bytes, [(x.start, x.end) for x in r.spans], bytes(r.kept)) for r in sd.removed(df, length).collect()}
    want = dict(enumerate(brute(texts, length)))
    assert {i for i in want if want[i] != got.get(i)} == set() and len(got) == len(want)


def words(rng, n):
    return " ".join(f"{rng.randrange(10**5)}é" for _ in range(n))


@pytest.mark.parametrize("length", [400, 64, 33])
def test_random_edits(spark, length):
    rng = random.Random(length)
    base = [words(rng, 200) for _ in range(4)]
    texts = [None, "", "short", "a" * 900, "ab" * 700, "ab" * 450, "x" + "a" * 500, words(rng, 300)]
    for _ in range(60):
        t = rng.choice(base)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", "ZZ", "é", t[:150]]) + t[i + rng.randrange(3) :]
        texts.append(rng.choice(["", words(rng, 40)]) + t[rng.randrange(300) : len(t) - rng.randrange(300)] + rng.choice(["", words(rng, 40)]))
    texts += [base[0]] * 3 + [words(rng, 30) + base[1][100 : 100 + n] + words(rng, 30) for n in range(length // 2 - 3, length // 2 + 300, 37)]
    p = words(rng, 80)[:length]
    texts += [words(rng, 10) + p + words(rng, 10), p, p[:-1] + "!"]
    check(spark, texts, length)


def test_whole_table(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts, 400)


def test_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(1)
    long = words(rng, 4000)
    pieces = sd.anchors(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long.encode())]), 400)
    monkeypatch.setattr(sd, "CHUNK_BYTES", 1000)
    for a, b in zip(pieces, sd.anchors(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long.encode())]), 400), strict=True):
        assert a.tolist() == b.tolist()
    check(spark, [long, long[1000:9000], words(rng, 100)], 400)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rng = random.Random(9)
    t = words(rng, 120)
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (None, "q" * 10), (3, words(rng, 90))], "doc_id long, text string")
    assert sorted(len(r.kept) for r in sd.removed(df).collect())[:4] == [0, 0, 0, 10]
    assert sd.removed(df.limit(0)).collect() == []


def test_clean_keeps_columns_and_whole_characters(spark):
    rng = random.Random(4)
    shared = "é" * 250
    rows = [(1, "a" + shared + "b" + words(rng, 20), "x"), (2, "c" + shared + "d", "y"), (3, None, None), (4, words(rng, 200), "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: (r.text, r.spans) for r in sd.clean(df).collect()}
    assert sd.clean(df).schema == df.schema
    assert out == {1: ("ab" + rows[0][1].split("b", 1)[1], "x"), 2: ("cd", "y"), 3: (None, None), 4: (rows[3][1], "z")}
