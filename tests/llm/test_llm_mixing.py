"""Mixing against targets by repeated sharing and a sorted running sum."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from offerlens.llm.mixing import mix, plan, take

DOCS = "doc_id bigint, text string, source string"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if goal[s] >= limit * sizes[s]]
        if not over:
            return stopped | goal
        stopped |= {s: limit * sizes[s] for s in over}


def corpus(seed=1, n=600):
    rnd = random.Random(seed)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 20, 300]), rnd.choice(["a", "a", "a", "b", "ä", "Z", None, "z9"])) for i in range(n)]
    return rows + [(None, "one two", "b"), (7, "again\tand\x0bagain", "a"), (n, None, "a"), (n + 1, "", None), (n + 2, "x " * 50_000, "big"), (n + 3, "", "hollow")]


def test_targets_and_taken_words(spark):
    rows = corpus()
    table = spark.createDataFrame(rows, DOCS).withColumns({"src": F.lit(1), "size": F.lit("x"), "h": F.lit(2), "cut": F.lit(3), "rest": F.lit(4)})
    found = mix(table.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, mix(table).collect()))
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    goal = plain_targets(sizes)
    assert len(found) == len(rows)
    name = lambda key: None if key == "b" else key[1:]
    for source in sizes:
        own = [r for r in found if name(r.src) == source]
        assert all(r.source_size == sizes[source] and abs(r.target - goal[source]) < 1e-6 * (1 + goal[source]) for r in own)
        assert all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in own)
        # A threshold on the hash: the nearest sum to the target.
        h = lambda r: int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
        whole = int(goal[source] // sizes[source]) if sizes[source] else 0
        rest, upto, best = goal[source] - whole * sizes[source], 0, [0]
        for k in sorted({h(r) for r in own}):
            upto += sum(r.size for r in own if h(r) == k)
            best.append(upto)
        near = min(abs(b - rest) for b in best)
        assert abs(sum(r.taken for r in own) - goal[source]) <= near + 1e-6
    assert abs(sum(goal.values()) - 1.5 * sum(sizes.values())) < 1e-3


def test_a_larger_budget_takes_a_superset(spark):
    table = spark.createDataFrame([(i, "w " * (i % 9), "ab"[i % 2]) for i in range(400)], DOCS)
    less = {r.doc_id for r in mix(table, share=0.5).where("copies > 0").collect()}
    more = {r.doc_id for r in mix(table, share=0.8).where("copies > 0").collect()}
    assert less < more


def test_empty_and_wordless_tables(spark):
    assert mix(spark.createDataFrame([], DOCS)).count() == 0
    rows = mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_plan_applies_to_whole_documents(spark):
    table = spark.createDataFrame(corpus(2, 100), DOCS).withColumn("size", F.size(F.split("text", "w")).cast("bigint"))
    out = take(table, plan(table.na.fill(0, ["size"])))
    assert out.count() == table.count() and {"text", "doc_id", "copies", "taken"} <= set(out.columns)
