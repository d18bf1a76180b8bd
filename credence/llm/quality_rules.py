"""Quality rules with risk-controlled thresholds (DataFrame and SQL functions only).

Base rules count words, symbols, repeated lines and repeated three-word windows of each whole text. Documents that pass
them are judged by one cutoff for each stratum (language) and signal. A cutoff is used only if labelled holdout documents
of good quality certify it: with k of n of them above the cutoff, the exact binomial tail P(Bin(n, a) <= k), a being the
tolerated false rejection of that signal, must be at most delta / M, where M is the number of all (stratum, signal,
cutoff) tests. By the union bound every chosen cutoff then holds at once with probability 1 - delta, and a stratum's
false rejections stay below ``max_false_rejection``, which is split evenly over the signals. Among certified cutoffs the
one with the best trade of low-quality documents caught against good ones lost is used; a stratum with too few labels
gets no cutoff and loses nothing to this step.

Nulls: a null text is an empty one, a null language a stratum of its own, a null label no label. Documents with several
labels take the lowest. Repeated rows are judged alike. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh

WHITE = " \t\n\x0b\f\r"
WHITE_RE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"

#: signal -> (column expression over the counts, fixed grid of cutoffs); above a cutoff is rejected.
SIGNALS = {
    "symbols_per_word": ("q.n_symbols / q.n_words", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]),
    "repeats_per_word": ("q.n_repeat_words / q.n_words", [0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45]),
    "dup_lines_per_100_words": ("100 * q.n_dup_lines / q.n_words", [0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0]),
    "mean_word_chars": ("q.word_chars / q.n_words", [5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0]),
}


def counts(text: Column) -> list[tuple[str, Column]]:
    """Steps of (name, expression); each may refer to the earlier ones, in columns of their own so that none is computed twice."""
    w, win, order = F.col("__words"), F.col("__win"), F.col("__order")
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    # windows by (hash, place); those that equal a neighbour are repeated
    sort = F.when(F.size(F.array_distinct(win)) < F.size(win), F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    again = F.filter(order, lambda x, i: (x["h"] == F.get(order, i - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(order, i + 1)["h"]).eqNullSafe(True))
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + 3 - F.greatest(F.lit(0), a["end"] - p)).alias("n")),
        lambda a: a["n"],
    )
    return [
        ("__text", F.coalesce(text, F.lit(""))),
        ("__trim", F.btrim("__text", F.lit(WHITE))),
        ("__words", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", WHITE_RE))),
        ("__win", F.when(F.size(w) >= 3, hashed)),
        ("__order", sort),
        ("__repeats", F.coalesce(covered, F.lit(0).cast("long"))),
        ("__lines", F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")),
    ]


def annotate(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs with one more column, a struct of the base counts; its name is returned too. keep: the columns of docs to keep."""
    name, kept = fresh(docs.columns, "q"), keep if keep is not None else docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    for column, value in counts(F.col(f"__doc.`{text}`")):
        inner = inner.withColumn(column, value)
    n = F.size("__words").cast("long")
    struct = F.struct(
        n.alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.col("__repeats").alias("n_repeat_words"),
        ((n < 50) | (100 * F.col("__repeats") > 50 * n)).alias("base_failed"),
    )
    return inner.select(*[F.col(f"__doc.`{c}`").alias(c) for c in kept], struct.alias(name)), name


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms; 1 where k is not below n * p, for there it exceeds 0.3."""
    first = n * F.log1p(F.lit(-p))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))).alias("t"), a["s"].alias("s"))
    add = lambda a: F.struct(a["t"].alias("t"), (a["s"] + F.exp(a["t"])).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("t"), F.exp(first).alias("s")), lambda a, i: add(step(a, i)), lambda a: a["s"])
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def thresholds(labelled: DataFrame, *, max_false_rejection: float = 0.05, delta: float = 0.05, cost: float = 5.0) -> DataFrame:
    """labelled(stratum, quality, q struct) -> (stratum, signal, cutoff), certified ones only; what one holdout document above is worth is 1 if bad, -cost if good."""
    judged = labelled.where("NOT q.base_failed AND quality IS NOT NULL")
    cells = [(s, c, f"{s}__{i}") for s, (_, grid) in SIGNALS.items() for i, c in enumerate(grid)]
    above = lambda s, c, good: F.sum(F.when((F.col("quality") == int(good)) & (F.expr(SIGNALS[s][0]) > c), 1).otherwise(0))
    sums = [x for s, c, name in cells for x in (above(s, c, True).alias(f"{name}_k"), above(s, c, False).alias(f"{name}_b"))]
    per = cut(judged.groupBy("stratum").agg(F.sum(F.col("quality").cast("long")).alias("n"), *sums), "quality-cells")
    tests = max(1, per.count() * len(cells))
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(c).alias("cutoff"), F.col(f"{name}_k").alias("k"), F.col(f"{name}_b").alias("b")) for s, c, name in cells]))
    risk = max_false_rejection / len(SIGNALS)
    return (
        per.select("stratum", "n", rows.alias("c")).select("stratum", "n", "c.*")
        .where(binomial_tail(F.col("n"), F.col("k"), risk) <= delta / tests)
        .withColumn("worth", F.col("b") - cost * F.col("k")).where("worth > 0")
        .groupBy("stratum", "signal").agg(F.max_by("cutoff", F.struct("worth", "cutoff")).alias("cutoff"))
    )


def judge(docs: DataFrame, labels: DataFrame, *, keep: list[str] | None = None, stratum: str = "lang", **risk) -> tuple[DataFrame, str, str]:
    """Every row of docs with the struct of counts and a boolean: kept or not. Returns the names of both columns too.

    The counts are made once and written to the shared folder; texts are never shuffled.
    """
    counted, q = annotate(docs, keep=keep)
    counted = cut(counted, "quality")
    by = F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit("\0null"))
    label = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = counted.select(F.col("`doc_id`").alias("doc_id"), by.alias("stratum"), F.col(f"`{q}`").alias("q")).join(label, "doc_id").select("stratum", "quality", "q")
    limits = thresholds(labelled, **risk).groupBy("stratum").agg(*[F.max(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"__cut_{s}") for s in SIGNALS])
    names = [*counted.columns, *(f"__cut_{s}" for s in SIGNALS)]
    kept, own, stands = fresh(names, "kept"), fresh(names, "by_"), fresh(names, "stratum_")
    bound = {s: fresh(counted.columns, f"__cut_{s}") for s in SIGNALS}
    limits = cut(limits, "quality-cutoffs").withColumnsRenamed({"stratum": stands} | {f"__cut_{s}": bound[s] for s in SIGNALS})
    value = lambda s: F.expr(SIGNALS[s][0].replace("q.", f"`{q}`."))
    over = [F.coalesce(value(s) > F.col(bound[s]), F.lit(False)) for s in SIGNALS]
    verdict = ~F.col(f"`{q}`.base_failed")
    for x in over:
        verdict = verdict & ~x
    out = counted.withColumn(own, by).join(limits, F.col(own) == F.col(stands), "left")
    return out.withColumn(kept, F.coalesce(verdict, F.lit(False))).select(*[F.col(f"`{c}`") for c in counted.columns], F.col(f"`{kept}`")), q, kept
