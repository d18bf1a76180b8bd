"""Snapshot collapse against all pairs of conversations."""

import random

from credence.llm import chat


def brute(rows):
    convs = {}
    alone = {(True, None if r[1] is None else r[1], r[2], r[3]) for r in ((c, n, "unknown" if role is None else role, text or "") for c, n, role, text in rows if c is None)}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault((False, conv), []).append((turn is not None, turn or 0, "unknown" if role is None else role, text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in convs.items()} | {c: [c[2:]] for c in alone}
    out, held = [], set()
    for c, own in sorted(turns.items(), key=lambda x: (x[0][0], str(x[0][1]).zfill(9))):
        if tuple(own) not in held and not any(len(x) > len(own) and x[: len(own)] == own for x in turns.values()):
            out.append((None if c[0] else c[1], len(own), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in own)))
        held.add(tuple(own))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string").repartition(3)
    assert sorted((tuple(r) for r in chat.render(df).collect()), key=str) == brute(rows)


def test_whole_table(spark, sf_dir):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_random_snapshots_ties_and_nulls(spark):
    rng, rows = random.Random(2), []
    for c in range(120):
        n = rng.randint(1, 5)
        rows += [(c, i, rng.choice(["user", None]), rng.choice(["a", "b", None])) for i in range(n)]
    rows += [(500, 0, "user", "same turn"), (500, 0, "user", "same turn"), (500, 0, "bot", "x"), (501, None, None, None), (None, 1, "u", "t"), (None, 2, "u", "t"), (None, 1, "u", "own"), (None, 1, "u", "own"), (None, 5, None, None), (None, 1, "user", "same turn"), (502, 1, "u", "t"), (503, 7, "", ""), (504, 1, "u", "long " * 100_000)]
    check(spark, rows)


def test_empty_table(spark):
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
