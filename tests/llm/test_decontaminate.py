"""Benchmark overlaps: word hashes, alignments against brute force, planted passages."""

import random
import re
import tracemalloc
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pytest

from credence.llm import decontaminate as dc
from credence.llm import queries, tokens


def split(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def test_words_of_texts_and_blocks(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "A b", " x ", "ab"] + ["".join(rng.choices("aB1é .\n", k=rng.randint(0, 60))) for _ in range(300)]
    data, starts = b"".join(t.encode() for t in texts), np.cumsum([0, *(len(t.encode()) for t in texts)])
    for size in (1 << 20, 7):
        monkeypatch.setattr(tokens, "CHUNK_BYTES", size)
        hashes, begins = tokens.words(np.frombuffer(data, np.uint8), starts)
        known = {}
        for i, t in enumerate(texts):
            own = hashes[begins[i] : begins[i + 1]].tolist()
            assert len(own) == len(split(t))
            assert all(known.setdefault(w, h) == h for w, h in zip(split(t), own, strict=True))
        assert len(set(known.values())) == len(known)


def brute(docs, items, least=dc.LEAST):
    """(document, item) -> equal words of the longest stretch of any alignment that is 80 % equal, if there are enough."""
    out = {}
    for d, text in docs:
        for i, item in items:
            a, b = split(text), split(item)
            if not set(a) & set(b):
                continue
            for shift in range(1 - len(b), len(a)):
                low, high = max(0, -shift), min(len(b), len(a) - shift)
                same = [a[shift + k] == b[k] for k in range(low, high)]
                if sum(same) < min(least, 0.8 * len(b)):
                    continue
                at = [0, *accumulate(same)]
                top = max(((e - s, -s, at[e] - at[s]) for s in range(len(same)) for e in range(s + 1, len(same) + 1) if 5 * (at[e] - at[s]) >= 4 * (e - s)), default=(0, 0, 0))
                if top[2] >= min(least, 0.8 * len(b)):
                    out[d, i] = max(out.get((d, i), 0), top[2])
    return out


def test_masks_meet_every_stretch():
    """The cases that the counting argument leaves open, and those around them."""
    for n in range(5, 17):
        for gone in combinations(range(n), n // 5):
            good = [i not in gone for i in range(n)]
            assert any(all(good[p + j] for j, x in enumerate(m) if x == "1") for m in dc.MASKS for p in range(n - len(m) + 1)), (n, gone)


def test_recall_of_substituted_passages():
    """Items of 5 to 60 words with up to a fifth of their words replaced at random: all are found."""
    rng = random.Random(2)
    items = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in range(5, 61) for _ in range(4)]
    block = dc.Block(pa.array(range(len(items))), pa.array(items))
    missed = 0
    for n, item in enumerate(items):
        w = item.split()
        for p in rng.sample(range(len(w)), len(w) // 5):
            w[p] = "zz"
        text = " ".join(["before"] * 7 + w + ["after"] * 7)
        hashes = tokens.text_words(text)
        found = {x[1] for x in dc.found_in(hashes, np.array([0, len(hashes)]), block, dc.LEAST, {})}
        missed += n not in found
    assert missed == 0


def test_repetitive_texts_and_items_cost_their_sum():
    item, text = tokens.text_words("spam " * 1000), tokens.text_words("spam " * 20_000)
    block = dc.Block(pa.array(["spam"]), pa.array(["spam " * 1000]))
    tracemalloc.start()
    found = list(dc.found_in(text, np.array([0, len(text)]), block, dc.LEAST, {}))
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert len(item) == 1000 and max(x[4] for x in found) == 1000
    assert sum(len(a) for i in block.indexes for a, _ in i.hits(*dc.seeds(text, np.array([0, len(text)]), i.mask, i.salt))) < 30_000 * len(dc.MASKS)


def test_random_pairs_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "Ab", "é"] + [f"w{rng.randrange(400)}" for _ in range(9)])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 5, 8, 9, 12, 13, 20, 30, 40])] + [(90, None), (91, ""), (None, " ".join(word() for _ in range(15)))]
    docs = [(0, None), (1, "")]
    for d in range(2, 250):
        w = [word() for _ in range(rng.randint(0, 40))]
        w[rng.randint(0, len(w)) : 0] = [x if rng.random() > 0.12 else "zz" for x in (rng.choice(items)[1] or "").split()][rng.randint(0, 8) :]
        docs.append((d, ", ".join(w)))
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_equal for r in dc.overlaps(df, bench).collect()}
    assert got == brute(docs, items) and len(got) > 30


@pytest.mark.parametrize("block", [1 << 18, 10])
def test_planted_passages_with_substitutions(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    rng = random.Random(8)
    items = [(i, " ".join(f"i{i}x{j}" for j in range(30))) for i in range(12)]
    docs = []
    for d in range(60):
        w = items[d % 12][1].split()
        for p in range(rng.randrange(10), 30, 10):
            w[p] = "other"
        docs.append((d, " ".join(f"d{d}y{j}" for j in range(50)) + " " + " ".join(w) + " tail"))
    docs += [(100 + d, " ".join(f"c{d}z{j}" for j in range(90))) for d in range(30)]
    rows = dc.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(d, d % 12) for d in range(60)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert len(dc.overlaps(docs, items).collect()) == 1
    assert dc.overlaps(docs.limit(0), items).collect() == [] == dc.overlaps(docs, items.limit(0)).collect()


def test_ids_of_any_type_repeated_rows_and_columns_of_other_names(spark):
    item = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame([("a", item, 1), ("a", item, 1), (None, f"y {item}", 2), ("c", None, 3), ("d", "y " * 300_000 + item, 4), ("e", "y " * 300_000, 5)], "doc_id string, text string, item_id int")
    items = spark.createDataFrame([("one", item, 9), (None, item, 9), ("none", None, 9)], "item_id string, text string, doc_id int")
    rows = sorted(((r.doc_id or "", r.item_id or "", r.start_word, r.n_words, r.n_equal) for r in dc.overlaps(docs, items).collect()))
    assert rows == sorted((d, i, s, 20, 20) for d, s in (("", 1), ("a", 0), ("a", 0), ("d", 300_000)) for i in ("", "one"))
    assert sorted((r.doc_id, r.item_id) for r in dc.clean(docs, items).collect()) == [("c", 3), ("e", 5)]


def test_whole_query_against_brute_force(spark, sf_dir):
    """All documents of the table; only those that share a word run with an item are worth a comparison."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    runs = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}  # noqa: E731  a stretch of 13 words or more that is 80 % equal has three in a row
    assert min(len(split(t)) for _, t in items) >= 13
    own = [(i, t, runs(split(t))) for i, t in items]
    want = {}
    for d, text in docs:
        here = runs(split(text))
        want |= brute([(d, text)], [(i, t) for i, t, r in own if r & here])
    got = {(r.doc_id, r.item_id): r.n_equal for r in queries.op8_decontaminate(spark, sf_dir).collect()}
    assert got == want and len(got) > 0
