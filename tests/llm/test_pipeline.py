"""The pipeline against brute-force versions of its stages, stage by stage on their own input."""

import hashlib
import random

import pytest
from test_bpe import library
from test_decontaminate import brute as leaks_brute
from test_decontaminate import split
from test_near_copies import brute as near_brute
from test_quality_rules import brute as counts
from test_suffix_dedup import brute as passages_brute

import corpus_pipeline as cp
from credence.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def leaking(docs, items):
    """Ids of documents with an overlap, by brute force on those that share three words in a row with an item."""
    runs = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    own = [(i, t, runs(split(t))) for i, t in items]
    out = set()
    for d, text in docs:
        here = runs(split(text))
        out |= {x for x, _ in leaks_brute([(d, text)], [(i, t) for i, t, r in own if r & here])}
    return out


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    """The table with near copies, shared passages and benchmark leaks planted into clean documents."""
    rng = random.Random(11)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    prose = lambda n: " ".join(f"p{rng.randrange(10**6)}" for _ in range(n))
    shared = prose(60)
    extra = [prose(300) for _ in range(12)]
    extra += [" ".join(w if i != 150 else "edited" for i, w in enumerate(x.split())) for x in extra[:3]] + [extra[0]]
    extra += [f"{prose(80)} {shared} {prose(80)}" for _ in range(4)] + [f"{prose(70)} {items[0]} {prose(70)}", f"{prose(70)}\n{items[1]}\n{prose(70)}", None, ""]
    return rows + [(10_000 + i, t, "en", "planted", len(t or "")) for i, t in enumerate(extra)]


def test_each_stage_on_its_own_input(spark, sf_dir, planted):
    docs = spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    seen = {r[0]: r for r in planted}
    stage = dict(cp.STAGES)
    names = list(stage)

    def rows(df):
        return {r.doc_id: r for r in df.collect()}

    one = cp.cut(stage[names[0]](spark, docs, sf_dir), "t")
    got = rows(one)
    assert one.columns == COLUMNS and all(tuple(r) == seen[i] for i, r in got.items())
    assert not any(counts(r.text)[5] for r in got.values())
    assert all(i in got for i in range(10_000, 10_022))

    two = cp.cut(stage[names[1]](spark, one, sf_dir), "t")
    left = rows(two)
    assert set(left) == near_brute([(i, r.text) for i, r in got.items()]) and all(left[i] == got[i] for i in left)
    assert not {10_012, 10_013, 10_014, 10_015} & set(left) and set(range(10_000, 10_012)) <= set(left)

    three = cp.cut(stage[names[2]](spark, two, sf_dir), "t")
    order = sorted(left)
    want = {i: kept for i, (_, _, kept) in zip(order, passages_brute([left[i].text for i in order], cp.PASSAGE_BYTES), strict=True)}
    cleaned = rows(three)
    assert three.columns == COLUMNS and {i: r.text for i, r in cleaned.items()} == {i: kept.decode(errors="ignore") for i, kept in want.items()}
    assert all(r.n_chars == len(r.text) for r in cleaned.values())
    assert all(len(cleaned[i].text.split()) <= 162 for i in range(10_016, 10_020))

    four = cp.cut(stage[names[3]](spark, three, sf_dir), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = leaking([(i, r.text) for i, r in cleaned.items()], items)
    assert {10_020, 10_021} <= gone and set(rows(four)) == set(cleaned) - gone

    five = rows(stage[names[4]](spark, four, sf_dir))
    encode = library().encode_ordinary
    for i, r in rows(four).items():
        assert five[i].n_tokens == len(encode(r.text)) and five[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert five.keys() == rows(four).keys()


def test_run_and_its_leftovers(spark, sf_dir):
    before = set(written())
    assert cp.run(spark, sf_dir).count() > 0
    # what is left: the stages' results, and what the last stages wrote for themselves
    left = set(written()) - before
    assert sum(any(f"/{name.replace(' ', '-')}-" in p for name, _ in cp.STAGES) for p in left) == len(cp.STAGES)
    assert len(left) <= len(cp.STAGES) + 2


def test_odd_tables(spark, tmp_path):
    """An empty table; nulls, repeated rows, a very long text and columns with the operators' own names."""
    from pyspark.sql import functions as F

    prose = lambda n, m: " ".join(f"t{n}w{j % m}" for j in range(n))
    long = prose(300_000, 299_999)
    rows = [(i, t, "en", "s", 1, "q", "kept", "x") for i, t in ((None, prose(80, 80)), (1, None), (2, ""), (3, long), (4, prose(90, 90)), (4, prose(90, 90)), (5, prose(100, 100)), (6, prose(100, 100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, q string, kept string, __by string")
    for name, table in (("full", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(3, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, "an item of some words that no text here has at all"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = cp.run(spark, f"{tmp_path}/full")
    assert sorted((r.doc_id or 0 for r in got.collect())) == [0, 3, 4, 5]
    assert got.where("doc_id = 3").select(F.col("decoded_sha256")).first()[0] == hashlib.sha256(long.encode()).hexdigest()
    assert cp.run(spark, f"{tmp_path}/none").collect() == []
