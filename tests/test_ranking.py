import random

from pyspark.sql import functions as F

from offerlens.operators.ranking import keep_first, rank_in_blocks, top_k


def data(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.6 else rng.randint(1, 5), rng.randint(0, 9), i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g int, score int, id int")


def test_rank_in_blocks_is_row_number(spark):
    rows, df = data(spark)
    out = rank_in_blocks(df, ["g"], [-F.col("score"), F.floor(F.col("id") / 64)], [F.col("id")], "place")
    found = {(r.g, r.id): r.place for r in out.collect()}
    for g in range(6):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [found[(g, r[2])] for r in order] == list(range(1, len(order) + 1))


def test_top_k_with_a_column_as_k(spark):
    rows, df = data(spark)
    out = top_k(df, ["g"], [F.desc("score"), F.col("id")], F.col("g") + 3, ["id"]).collect()
    for g in range(6):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[: g + 3]
        assert sorted((r.rn, r.id) for r in out if r.g == g) == [(i + 1, r[2]) for i, r in enumerate(order)]


def test_keep_first(spark):
    rows, df = data(spark)
    out = keep_first(df, ["g", "score"], [F.col("id")]).collect()
    first = {}
    for g, s, i in rows:
        first.setdefault((g, s), i)
    assert {(r.g, r.score): r.id for r in out} == first


def test_partial_limit_before_the_shuffle(spark):
    _, df = data(spark)
    plan = keep_first(df, ["g"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("Partial")
