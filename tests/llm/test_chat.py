import random

from pyspark.sql import functions as F

from flowloom.llm import chat


def _brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        if c is not None:
            convs.setdefault(c, set()).add((-2**63 if t is None else t, r or "", x or ""))
    import hashlib
    lists = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0], y[1], hashlib.sha256(y[2].encode()).hexdigest()))]
             for c, v in convs.items()}
    kept = {}
    for c, mine in lists.items():
        longer = any(len(o) > len(mine) and o[:len(mine)] == mine for o in lists.values())
        same = min(d for d, o in lists.items() if o == mine)
        if not longer and same == c:
            kept[c] = (mine, sum(mine[:len(o)] == o for o in lists.values()))
    return {(c, i + 1, len(mine), n, f"<|im_start|>{r}\n{x}<|im_end|>") for c, (mine, n) in kept.items()
            for i, (r, x) in enumerate(mine)}


def test_snapshots_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in range(120):
        talk = random.Random(c % 9)
        whole = [(i, ["user", "assistant"][i % 2], f"t{talk.randrange(3)}") for i in range(12)]
        rows += [(c, *turn) for turn in whole[:rng.randrange(1, 13)]]
    rows += [(500, None, None, None), (500, 1, "user", "x" * 50_000), (501, 1, "", ""), (501, 1, "", ""), (502, 1, "b", "b"),
             (502, 1, "b", "a"), (503, 1, "ab", ""), (504, 1, "a", "b"), (None, 1, "user", "lost")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, h1 string")
    got = {tuple(r) for r in chat.maximal_conversations(df.repartition(5)).collect()}
    assert got == _brute(rows)
    assert chat.maximal_conversations(df.limit(0)).count() == 0


def test_a_conversation_of_more_than_a_million_turns(spark):
    n = 1_200_000
    whole = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    part = whole.filter(F.col("turn") < n - 1).withColumn("conv_id", F.lit(2))
    got = chat.maximal_conversations(whole.unionByName(part)).groupBy("conv_id", "n_turns", "n_snapshots").count().collect()
    assert [tuple(r) for r in got] == [(1, n, 2, n)]
