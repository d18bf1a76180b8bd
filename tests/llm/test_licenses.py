"""License scans against containment over every stretch of words."""

import random

import numpy as np

from credence.llm import licenses as li
from credence.llm.license_texts import FULL_TEXTS
from credence.llm.tokens import shingles, text_words


def brute(docs, templates):
    """Best containment over all stretches as long as a window can be."""
    out = {}
    for n, own in li.classes(templates).items():
        for c in own:
            for name, wanted in c.members:
                for d, text in docs:
                    s = shingles(text_words(text), n)
                    hit = np.isin(s, wanted)
                    best = max((len(np.unique(s[i : i + c.step * c.blocks][hit[i : i + c.step * c.blocks]])) for i in np.flatnonzero(hit)), default=0) / len(wanted)
                    if best >= li.CONTAINMENT:
                        out[d, name] = best
    return out


def test_random_documents(spark):
    rng = random.Random(3)
    templates = li.TEMPLATES | {"one": "Word", "two": "two words", "none": " ,", "long": " ".join(f"t{rng.randrange(900)}" for _ in range(300))}
    docs = [(0, None), (1, ""), (2, "word"), (3, "x word two words y")]
    for d in range(4, 300):
        parts = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(60)))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(list(templates.values())).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if t:
                    t[rng.randrange(len(t))] = "changed"
            parts += [" ".join(t[rng.choice([0, 0, 2]) :]).upper(), " ".join(f"v{rng.randrange(500)}" for _ in range(rng.randrange(40)))]
        docs.append((d, ".\n".join(parts)))
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, license string").repartition(3)
    got = {(r.doc_id, r.license): r.containment for r in li.scan(df, templates).collect()}
    want = brute(docs, templates)
    assert got.keys() <= want.keys() and len(want) > 150
    whole = {k for k, v in want.items() if v == 1.0}
    assert whole <= got.keys() and len(got) >= 0.98 * len(want)  # borderline windows can be aligned less well


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {(r.doc_id, r.license) for r in li.scan(docs).collect()} == set(brute(rows, li.TEMPLATES))


def test_start_word_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c Released under the MIT License."), (7, "Released under the MIT License. " * 50_000)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.license, r.start_word) for r in li.scan(df).collect()) == [(0, "mit-line", 3), (7, "mit-line", 0)]
    assert li.scan(df.limit(0)).collect() == []


def test_full_texts_with_small_changes(spark, monkeypatch):
    """Each full text, re-wrapped, with a word in forty replaced, between other words: found by its name, twice for a repeated row."""
    docs = []
    for n, (_name, text) in enumerate(sorted(FULL_TEXTS.items())):
        w = [x if (i + n) % 40 else "changed" for i, x in enumerate(text.split())]
        docs.append((n, " ".join(f"a{n}x{j}" for j in range(300)) + "\n * " + "\n * ".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9)) + " tail" * 30))
    rows = li.scan(spark.createDataFrame(docs + docs[:1], "doc_id long, text string")).collect()
    names = sorted(FULL_TEXTS)
    assert {n for n in range(len(names)) if any(r.doc_id == n and r.license == names[n] for r in rows)} == set(range(len(names)))
    assert sum(r.doc_id == 0 and r.license == names[0] for r in rows) == 2
    monkeypatch.setattr(li, "MAX_TEMPLATE_BYTES", 2000)
    assert sorted(map(tuple, li.scan(spark.createDataFrame(docs + docs[:1], "doc_id long, text string")).collect())) == sorted(map(tuple, rows))
