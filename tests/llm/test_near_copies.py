"""Near-copy removal against brute force over fingerprints and over exact similarities."""

import random
from collections import defaultdict

import pytest

from credence.llm import near_copies as near


def edited(rng, words, n):
    """words with n of them replaced, at places that no five-word shingle has two of."""
    out = list(words)
    for p in rng.sample(range(5, len(words) - 5, 6), n):
        out[p] = f"e{rng.randrange(10**6)}"
    return out


def left(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in near.dedup(df, **how).collect()}


def similar_pairs(rows):
    """(later, earlier) ids of different texts with a five-word similarity of 0.8 or more, by an index of all shingles."""
    sets = {i: near.shingle_set(t or "", 5) for i, t in rows}
    held, out = defaultdict(list), set()
    for i, s in sorted(sets.items()):
        common = defaultdict(int)
        for x in s:
            for j in held[x]:
                common[j] += 1
            held[x].append(i)
        out |= {(i, j) for j, n in common.items() if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9}
    return out


def brute(rows, distance=7, salts=near.SALTS):
    """Ids that stay."""
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t or "", i)
    kinds = [(i, t) for t, i in first.items()]
    fps = {i: near.prints(near.word_hashes(t, {}), salts) for i, t in kinds}
    close = lambda i, j: min((int(a) ^ int(b)).bit_count() for a, b in zip(fps[i], fps[j], strict=True)) <= distance
    return {i for i, _ in kinds} - {i for i, j in similar_pairs(kinds) if close(i, j)}


def family(rng, n, words=200):
    """Texts that differ from one in some words each: some are similar to each other, some not."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6, 8, 9][: max(1, words // 24)]))) for _ in range(n)]


@pytest.mark.parametrize("bucket", [4096, 6])
def test_families_against_brute_force(spark, bucket):
    """Small buckets split keys down to single fingerprints; dissimilar neighbours need several rounds."""
    rng = random.Random(bucket)
    texts = [t for n in (2, 5, 40, 60) for t in family(rng, n)] + ["", " ", "one word", None, "a b c d e f", "A b c d e f"]
    rng.shuffle(texts)
    assert left(spark, texts, bucket=bucket) == brute(list(enumerate(texts)))


def test_texts_that_share_a_fingerprint_but_not_their_order(spark):
    """The same words in other orders have equal fingerprints and no shingle in common: nearest candidates fail first."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(rng.sample(base, len(base))) for _ in range(30)]
    texts += [f"{t} {t.split()[0]}" for t in texts[5:30:4]]
    assert left(spark, texts) == brute(list(enumerate(texts))) == set(range(30))


def test_recall_of_similar_pairs(spark):
    """Pairs at a similarity of 0.8 to 0.9: at least nine in ten are found."""
    rng, texts = random.Random(9), []
    while len(texts) < 300:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        own, copy = " ".join(words), " ".join(edited(rng, words, max(1, len(words) // 48)))
        if near.jaccard(own, copy, 5) >= 0.8:
            texts += [own, copy]
    stay = left(spark, texts)
    assert set(range(0, 300, 2)) <= stay and len(stay) <= 150 + 15


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id for r in near.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(rows)


def test_nulls_ties_repeats_clashing_names_and_empty_tables(spark):
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "w", 2), (1, "other words here at all", "y", 3), (None, "a b c d e f", "z", 4), (None, "a b c d e f", "z", 4), (3, "A B C D E F", "w", 5), (4, None, "v", 6), (5, "", "v", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k_ string, i_ int")
    want = [(None, "a b c d e f", "z", 4)] * 2 + [(1, "a b c d e f", "w", 2), (1, "other words here at all", "y", 3), (4, None, "v", 6)]
    key = lambda r: (r[0] or 0, r[1] or "", r[2])
    assert sorted((tuple(r) for r in near.dedup(df).collect()), key=key) == sorted(want, key=key)
    assert near.dedup(df.limit(0)).collect() == []
    by_name = spark.createDataFrame([("b", "same text of six words here"), ("a", "same text of six words here")], "doc_id string, text string")
    assert [r.doc_id for r in near.dedup(by_name).collect()] == ["a"]


def test_very_long_texts(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    texts = [" ".join(words), " ".join(words[:150_000] + ["new"] + words[150_001:]), " ".join(reversed(words))]
    assert left(spark, texts) == {0, 2}


def test_sketches_lose_no_similar_pair():
    rng = random.Random(7)
    for words in (20, 100, 400, 3000):
        for text in family(rng, 40, words):
            other = " ".join(edited(rng, text.split(), rng.randint(1, max(1, words // 40))))
            (a, x), (b, y) = (near.sketch(near.word_hashes(t, {}), 5) for t in (text, other))
            apart = sum(int(v).bit_count() for v in x ^ y)
            one, two = near.shingle_set(text, 5), near.shingle_set(other, 5)
            assert (a, b) == (len(one), len(two)) and apart <= len(one ^ two)


@pytest.mark.parametrize(("bucket", "listed"), [(1, 16), (2, 1)])
def test_crowded_keys_against_brute_force(spark, monkeypatch, bucket, listed):
    """Keys longer by a segment, then in parts, in which seekers and targets are both too many for a list."""
    monkeypatch.setattr(near, "LISTED", listed)
    monkeypatch.setattr(near, "ROUND", 4)
    monkeypatch.setattr(near, "PAIRS", 8)
    rng = random.Random(bucket)
    base = [f"w{i}" for i in range(80)]
    texts = [t for n in (3, 30) for t in family(rng, n)] + [" ".join(rng.sample(base, len(base))) for _ in range(20)]
    texts += [f"{t} {t.split()[0]}" for t in texts[33::6]] + ["", " ", None]
    rng.shuffle(texts)
    assert left(spark, texts, bucket=bucket) == brute(list(enumerate(texts)))


def test_rows_and_candidates_do_not_grow_with_the_table(spark):
    """A kind has a row for each salt and segment, however many kinds there are; long texts of the same words in other
    orders, whose fingerprints are equal, are no candidates."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(1500)]
    texts = [" ".join(rng.sample(base, len(base))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = near.cut(near.text_prints(docs, near.SALTS, 5).withColumnRenamed("doc_id", "id"), "t")
    found = near.Candidates(kinds, 100_000_000, near.SALTS, 7, 8, 0.8, 4096, "bigint")
    assert found.keyed(kinds, 3).count() == 40 * 8 * near.SALTS
    assert found.first().count() == 0


def test_pairs_are_made_once(spark):
    rng = random.Random(12)
    texts = list(dict.fromkeys(family(rng, 30)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = near.cut(near.text_prints(docs, near.SALTS, 5).withColumnRenamed("doc_id", "id"), "t")
    found = near.Candidates(kinds, len(texts), near.SALTS, 7, 8, 0.8, 4096, "bigint")
    pairs = [(r.id, r.j_id) for r in found.more(kinds.select("id", "k"), 100).collect()]
    want = {(i, j) for i, j in similar_pairs(list(enumerate(texts))) if min((int(a) ^ int(b)).bit_count() for a, b in zip(*(near.prints(near.word_hashes(texts[x], {}), near.SALTS) for x in (i, j)), strict=True)) <= 7}
    assert len(pairs) == len(set(pairs)) and want <= set(pairs)


def test_few_candidates_are_looked_up_once(spark, monkeypatch):
    """Kinds that are not similar to their closest candidate meet the others of their lists, which hold fewer than a round."""

    def more(*_):
        raise AssertionError("looked up again")

    monkeypatch.setattr(near.Candidates, "more", more)
    rng = random.Random(5)
    texts = [t for _ in range(8) for t in family(rng, 14)]
    rng.shuffle(texts)
    assert left(spark, texts) == brute(list(enumerate(texts)))


def test_further_rounds_take_one_python_worker_a_task(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame(list(enumerate(family(rng, 12))), "doc_id long, text string")
    kinds = near.cut(near.text_prints(docs, near.SALTS, 5).withColumnRenamed("doc_id", "id"), "t")
    met = near.Candidates(kinds, 12, near.SALTS, 7, 8, 0.8, 4096, "bigint").more(kinds.select("id", "k"), 16)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the targets, and behind a shuffle the lists; two in a row were three
