"""Counts against brute force, and the guarantee of the cutoffs."""

import re
from collections import Counter
from math import comb

from pyspark.sql import functions as F

from credence.llm import quality_rules as qr
from credence.llm.queries import op9_quality_rules


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(wins)
    cover = {j for i, x in enumerate(wins) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_counts_on_whole_table(spark, sf_dir):
    want = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op9_quality_rules(spark, sf_dir).collect()
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == want
    assert all(r.base_failed or r.kept in (True, False) for r in rows) and not any(r.kept for r in rows if r.base_failed)


def test_counts_of_odd_texts(spark):
    texts = [None, "", " \n\t\x0b\r\n", "a", "a b", "a b c", "a b c a b c", "a a a a a", "a a a", "x\n\nx\n x\nx", "é#*$%&|<>　é", "a\x85b\xa0c", "a b c d a b c e b c d " * 40, "w " * 70_000]
    df = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(texts)], "doc_id long, text string, q string, n_words int")
    out, q = qr.annotate(df)
    assert {r.doc_id: tuple(r[q]) for r in out.collect()} == {i: brute(t) for i, t in enumerate(texts)}
    assert qr.annotate(df.limit(0))[0].collect() == []


def test_binomial_tail_is_exact(spark):
    cases = [(n, k, p) for n in (1, 5, 40, 300) for k in range(0, n, max(1, n // 6)) for p in (0.0125, 0.3) if k < n * p]
    for n, k, p in cases:
        got = spark.range(1).select(qr.binomial_tail(F.lit(n), F.lit(k).cast("long"), p)).first()[0]
        assert abs(got - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_cutoffs_hold_their_risk_and_catch_the_bad(spark):
    good = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en") for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"w{i}x{j}###" for j in range(60)), "en") for i in range(300)]
    few = [(20_000 + i, " ".join(f"v{i}y{j}###" for j in range(60)), None) for i in range(20)]
    docs = spark.createDataFrame([(*r, "z") for r in good + bad + few], "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([(i, int(i < 10_000), 0) for i, _, _ in good + bad + few] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    out, _, kept = qr.judge(docs, labels)
    verdict = {r.doc_id: r[kept] for r in out.collect()}
    assert len(verdict) == len(good + bad + few)
    assert sum(not verdict[i] for i, _, _ in good) <= 0.05 * len(good)
    assert not any(verdict[i] for i, _, _ in bad)
    assert all(verdict[i] for i, _, _ in few)  # too few labels to certify a cutoff
    assert all(r[kept] for r in qr.judge(docs, labels.limit(0))[0].collect())


def test_columns_of_any_name_and_repeated_rows(spark):
    text = " ".join(f"w{j}" for j in range(60))
    df = spark.createDataFrame([(1, text, "en", "a", "b", "c", "d", 0.5), (1, text, "en", "a", "b", "c", "d", 0.5)], "doc_id long, text string, lang string, __by string, __stratum string, by_ string, kept string, __cut_mean_word_chars double")
    out, _, kept = qr.judge(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert [(tuple(r)[:8], r[kept]) for r in out.select(*df.columns, kept).collect()] == [(tuple(df.first()), True)] * 2
