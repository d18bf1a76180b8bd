"""Contradictions: exact pairs within a subject and predicate, and fuzzy pairs across them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..plans import State
from ..schema import FUNCTIONAL, LIVE, OBJECT_SIMILARITY, PREDICATE_SIMILARITY, SUBJECT_SIMILARITY
from ..tables import cut


def live(state: State) -> DataFrame:
    """Claims that count for conflicts, with their normalised terms."""
    rows = state.claims.where(F.col("epistemic_status").isin(*LIVE)).select("claim_id", "created_seq", "subj", "pred", "obj")
    return rows.withColumns({"s": fn.normalize(F.col("subj")), "p": fn.normalize(F.col("pred")), "o": fn.normalize(F.col("obj"))})


def linked_pairs(state: State) -> DataFrame:
    """(low, high): unordered pairs of claims that a conflict edge links."""
    e = state.edges.where("kind = 'conflicts_with'")
    return e.select(F.least("from_id", "to_id").alias("low"), F.greatest("from_id", "to_id").alias("high")).distinct()


def with_links(pairs: DataFrame, state: State) -> DataFrame:
    links = linked_pairs(state).withColumn("hit", F.lit(True))
    keyed = pairs.withColumns({"low": F.least("claim_a", "claim_b"), "high": F.greatest("claim_a", "claim_b")})
    return keyed.join(links, ["low", "high"], "left").withColumn("already_linked", F.coalesce("hit", F.lit(False))).drop("low", "high", "hit")


def detect(state: State) -> DataFrame:
    """All pairs of distinct objects of one subject and predicate; of claims with one object the first stands for all.

    The pairs are the answer, so their number is inherent; the rows joined are one for each distinct object.
    """
    one = live(state).groupBy("s", "p", "o").agg(F.min_by(F.struct("claim_id", "created_seq", "subj", "pred", "obj"), "created_seq").alias("c"))
    a, b = one.select("s", "p", F.col("c").alias("a")), one.select("s", "p", F.col("c").alias("b"))
    functional = F.col("p").isin(*FUNCTIONAL)
    pairs = a.join(b, ["s", "p"]).where("a.created_seq < b.created_seq").select(
        F.col("a.claim_id").alias("claim_a"), F.col("b.claim_id").alias("claim_b"), F.col("a.subj").alias("subject"), F.col("a.pred").alias("predicate"),
        F.col("a.obj").alias("object_a"), F.col("b.obj").alias("object_b"), functional.alias("functional"), F.when(functional, "conflict").otherwise("suggestion").alias("severity"),
    )
    return with_links(pairs, state)


def ranked(pairs: DataFrame) -> DataFrame:
    """Unlinked contradictions first."""
    return pairs.orderBy("already_linked", F.desc("functional"), "claim_a", "claim_b")


def linked_conflicts(state: State) -> DataFrame:
    """The pairs of detect() that a conflict edge links, found from the edges and not from all pairs."""
    one = live(state).groupBy("s", "p", "o").agg(F.min_by(F.struct("claim_id", "created_seq", "subj", "pred", "obj"), "created_seq").alias("c"))
    one = one.select("s", "p", "o", "c.*")
    links = linked_pairs(state)
    ends = links.select(F.col("low").alias("x"), F.col("high").alias("y")).union(links.select("high", "low"))
    a, b = (one.select(*[F.col(c).alias(f"{n}_{c}") for c in one.columns]) for n in ("a", "b"))
    pairs = ends.join(a, F.col("x") == F.col("a_claim_id")).join(b, F.col("y") == F.col("b_claim_id")).where("a_s = b_s AND a_p = b_p AND a_o <> b_o AND a_created_seq < b_created_seq")
    return pairs.select(
        F.col("a_claim_id").alias("claim_a"), F.col("b_claim_id").alias("claim_b"), F.col("a_subj").alias("subject"), F.col("a_pred").alias("predicate"),
        F.col("a_obj").alias("object_a"), F.col("b_obj").alias("object_b"), F.col("a_p").isin(*FUNCTIONAL).alias("functional"),
    )


def similar(strings: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of all pairs a < b of distinct normalised strings(n) whose token sets have at least that Jaccard similarity.

    Exact, by prefix filter: with tokens in ascending order of frequency, two sets that similar share a token among the
    first |t| - ceil(threshold * |t|) + 1 of each. Only ids and sizes are joined on these tokens, so rare ones decide;
    token sets join the pairs that are left, once each.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 would return all pairs")
    sets = cut(strings.select("n").distinct().withColumns({"id": F.monotonically_increasing_id(), "t": fn.token_set(F.col("n"))}), "similar-sets")
    tokens = sets.select("id", F.explode("t").alias("token"))
    often = tokens.groupBy("token").count()
    ranked_tokens = tokens.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("x"))
    size = F.size("x")
    head = F.slice("x.token", F.lit(1), size - F.ceil(threshold * size - F.lit(1e-9)).cast("int") + 1)
    keyed = cut(ranked_tokens.select("id", size.alias("size"), F.explode(head).alias("token")), "similar-prefixes")
    a, b = (keyed.select("token", F.col("id").alias(x), F.col("size").alias(f"n{x}")) for x in ("a", "b"))
    fits = (F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    pairs = a.join(b, "token").where(fits).select("a", "b").distinct()
    x, y = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("t").alias(f"t{c}")) for c in ("a", "b"))
    scored = pairs.join(x, "a").join(y, "b").withColumn("sim", fn.jaccard(F.col("ta"), F.col("tb"))).where(F.col("sim") >= threshold)
    return scored.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "sim")


#: Vectors of a tile, which is a file; and rows of a tile that are multiplied at once.
TILE, STRIP = 4096, 512


def close(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of all pairs a < b of distinct strings in vectors(n, v) whose cosine is at least the threshold.

    No filter bounds cosines of any vectors, so all are compared, but no vector is shuffled for it: they are written once,
    sorted by n, as files of bounded size, and the tasks that multiply two of these files read them from the shared folder.
    Time is quadratic, what is moved is linear but for the answer. A null or zero vector has cosine 0.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["v"].dataType.simpleString()
    v = F.col("v") if kind in ("array<float>", "array<double>") else F.col("v").cast("array<double>")
    rows = cut(vectors.where("n IS NOT NULL AND v IS NOT NULL").groupBy("n").agg(F.min(v).alias("v")).orderBy("n"), "vectors", rows_per_file=TILE)
    files = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("n").alias("n")).collect()  # a row for each tile
    tiles = [f"{rows._credence_path}/{f['file']}" for f in sorted(files, key=lambda f: f["n"])]
    pairs = len(tiles) * (len(tiles) + 1) // 2
    slots = spark.sparkContext.defaultParallelism
    todo = spark.range(0, pairs, 1, max(1, min(pairs, max(8 * slots, pairs // 8))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.cumsum([0, *range(len(tiles), 0, -1)])  # pairs are numbered by their first tile
        at, left = -1, None
        for batch in batches:
            for pair in batch.column(0).to_pylist():
                x = int(np.searchsorted(starts, pair, side="right")) - 1
                y = x + pair - int(starts[x])
                if x != at:
                    at, left = x, unit_vectors(tiles[x])
                right = left if y == x else unit_vectors(tiles[y])
                if left[1].shape[1] != right[1].shape[1]:
                    raise ValueError("vectors of different lengths")
                for start in range(0, len(left[0]), STRIP):
                    sims = left[1][start : start + STRIP] @ right[1].T
                    np.clip(sims, 0, 1, out=sims)
                    i, j = np.nonzero(sims >= threshold)
                    if x == y:
                        later = j > i + start
                        i, j = i[later], j[later]
                    names = [side.take(pa.array(k)) for side, k in ((left[0], i + start), (right[0], j))]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(sims[i, j])], names=["a", "b", "sim"])

    return todo.mapInArrow(run, "a string, b string, sim double")


def unit_vectors(uri: str) -> tuple[pa.Array, np.ndarray]:
    """The names of a tile and its vectors, of length 1 or 0."""
    store, path = fs.FileSystem.from_uri(uri)
    table = pq.read_table(path, columns=["n", "v"], filesystem=store, partitioning=None).combine_chunks()
    n, v = (table.column(c).chunk(0) for c in ("n", "v"))
    if len(pc.unique(pc.list_value_length(v))) > 1:
        raise ValueError("vectors of different lengths")
    matrix = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(n), -1)
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return n, np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def both_ways(pairs: DataFrame, strings: DataFrame) -> DataFrame:
    """(x, y, sim) in both orders, every string being similar to itself."""
    same = strings.select(F.col("n").alias("x"), F.col("n").alias("y"), F.lit(1.0).alias("sim")).distinct()
    return pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "sim").union(pairs.select("b", "a", "sim")).union(same)


def fuzzy(state: State, threshold: float | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Candidate pairs whose subjects and predicates are similar but not both equal. The object is scored, not a condition.

    Strings are compared by their token sets, or by the cosine of vectors(text, vector), which some model has made of
    them; texts are looked up as they are or normalised, and one without a vector is similar to itself alone.
    """
    subject, predicate = (SUBJECT_SIMILARITY, PREDICATE_SIMILARITY) if threshold is None else (threshold, threshold)
    c = cut(live(state), "live-claims")
    s, p = c.select(F.col("s").alias("n")), c.select(F.col("p").alias("n"))
    by_text = None if vectors is None else cut(vectors.select(fn.normalize(F.col("text")).alias("n"), F.col("vector").alias("v")), "text-vectors")
    pairs_of = lambda x, bar: similar(x, bar) if by_text is None else close(by_text.join(x.distinct(), "n", "left_semi"), bar)
    near_s = both_ways(pairs_of(s, subject), s).withColumnsRenamed({"x": "s", "y": "s2", "sim": "subj_sim"})
    near_p = both_ways(pairs_of(p, predicate), p).withColumnsRenamed({"x": "p", "y": "p2", "sim": "pred_sim"})
    other = c.withColumnsRenamed({x: f"{x}2" for x in c.columns})
    pairs = c.join(near_s, "s").join(near_p, "p").join(other, ["s2", "p2"]).where("created_seq < created_seq2 AND NOT (s = s2 AND p = p2)")
    osim = fn.similarity(F.col("o"), fn.token_set(F.col("o")), F.col("o2"), fn.token_set(F.col("o2")))
    if by_text is not None:
        one = by_text.groupBy("n").agg(F.min("v").alias("v"))
        pairs = pairs.join(one.withColumnsRenamed({"n": "o", "v": "ov"}), "o", "left").join(one.withColumnsRenamed({"n": "o2", "v": "ov2"}), "o2", "left")
        osim = F.when(F.col("o") == F.col("o2"), F.lit(1.0)).otherwise(F.coalesce(fn.cosine(F.col("ov"), F.col("ov2")), F.lit(0.0)))
    functional = F.col("p").isin(*FUNCTIONAL) | F.col("p2").isin(*FUNCTIONAL)
    cites = state.evidence.groupBy("claim_id").agg(F.sort_array(F.collect_set("source_id")).alias("sources"))
    scored = pairs.withColumn("obj_sim", osim).withColumn("relation", F.when(F.col("obj_sim") >= OBJECT_SIMILARITY, "same_object").otherwise("diff_object")).withColumn(
        "severity", F.when(F.col("relation") == "same_object", "same_object").when(functional, "diff_object_functional").otherwise("diff_object_multivalued")
    )
    out = scored.join(cites.withColumnRenamed("sources", "sources_a"), "claim_id", "left").join(cites.select(F.col("claim_id").alias("claim_id2"), F.col("sources").alias("sources_b")), "claim_id2", "left")
    relation = source_relation(F.col("sources_a"), F.col("sources_b"))
    out = out.select(
        F.col("claim_id").alias("claim_a"), F.col("claim_id2").alias("claim_b"), F.col("subj").alias("subject_a"), F.col("subj2").alias("subject_b"), F.col("pred").alias("predicate_a"), F.col("pred2").alias("predicate_b"),
        F.col("obj").alias("object_a"), F.col("obj2").alias("object_b"), *[F.bround(x, 3).alias(x) for x in ("subj_sim", "pred_sim", "obj_sim")], "relation", "severity",
        F.coalesce("sources_a", F.array()).alias("sources_a"), F.coalesce("sources_b", F.array()).alias("sources_b"), relation.alias("source_relation"),
    )
    return with_links(out, state)


def fuzzy_ranked(pairs: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "diff_object_functional", 0).when(F.col("severity") == "same_object", 1).otherwise(2)
    return pairs.orderBy("already_linked", rank, F.desc(F.col("subj_sim") + F.col("pred_sim")), "claim_a", "claim_b")


def source_relation(a: Column, b: Column) -> Column:
    """Of two sets of sources: unknown if one is missing, shared if they meet, else independent."""
    missing = F.coalesce(F.size(a), F.lit(0)).isin(0, -1) | F.coalesce(F.size(b), F.lit(0)).isin(0, -1)
    return F.when(missing, "unknown").when(F.arrays_overlap(a, b), "shared").otherwise("independent")
