"""SimHash groups against all pairs, and the edges of the contract."""

import numpy as np
import pytest
import xxhash

from credence.llm import simhash
from credence.llm.components import components, forest


def brute(texts, distance=3, shingle=3):
    """Fingerprints and components by comparing everything."""
    fps = []
    for text in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        grams = [b" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(fps)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(f"{fp:016x}", find(i)) for i, fp in enumerate(fps)]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def result(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = sorted(table.collect())
    assert [r.doc_id for r in rows] == list(range(len(rows)))
    assert result(simhash.groups(table)) == dict(enumerate(brute([r.text for r in rows])))


@pytest.mark.parametrize("bucket", [512, 2])
def test_edges_and_dense_groups(spark, bucket):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all of the noise in the old town".split()
    texts = [None, "", " \t\n", "one", "One", "one two", "A b C", "a B c d", "é È x", "x" * 300_000]
    texts += [" ".join(base[:i] + [w] + base[i + 1 :]) * 6 for i in range(12) for w in ("x", "yy", "zzz")] + [" ".join(base)] * 5
    assert result(simhash.groups(docs(spark, texts), bucket=bucket)) == dict(enumerate(brute(texts)))


def test_any_distance_and_ring(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9, 40)) for _ in range(150)]
    for distance, segments, chain in ((2, 8, 5), (5, 8, 6), (6, 9, 9)):
        got = simhash.groups(docs(spark, texts), distance=distance, segments=segments, chain=chain)
        assert result(got) == dict(enumerate(brute(texts, distance)))


def test_null_ids_repeats_empty_and_clashing_columns(spark):
    rows = [(None, "a b c d", 1), (4, "a b c d", 2), (4, "a b c d", 3), (9, "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.groups(df).collect())
    assert got == [(-1, 4), (4, 4), (4, 4), (9, 9)]
    assert simhash.groups(df.limit(0)).collect() == []


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(400_000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "LONG", 1000)
    assert simhash.fingerprint(text) == whole


def test_patterns_cover_every_difference():
    for segments, chain, distance in ((10, 6, 3), (8, 6, 5), (12, 7, 4)):
        shapes = simhash.patterns(segments, chain, distance)
        rng = np.random.default_rng(1)
        for _ in range(3000):
            wrong = np.zeros(segments, int)
            for s in rng.integers(0, segments, rng.integers(0, distance + 1)):
                wrong[s] += 1
            assert any(all(not wrong[(start + i) % segments] for i in p) for start in range(segments) for p in shapes)


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(-500, 500, (400, 2))] + [(i, i + 1) for i in range(1000, 1300)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == forest(edges)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
