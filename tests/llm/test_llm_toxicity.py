"""Toxicity: held-out ranking and odd inputs."""

import random

from pyspark.sql import functions as F

from offerlens.llm import toxicity as T

DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, toxic int"


def made(n=700, seed=1):
    """A third of the label-1 texts use a word that no list knows."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(10, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["you idiot", "you moron!", "zorkan" + word()]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_ranking(spark):
    docs, labels = made()
    table = spark.createDataFrame(docs, DOCS)
    scorer = T.train(table, spark.createDataFrame(labels, LABELS))
    assert any(t.startswith(b"zork") for t in scorer.lexicon.weights)
    found = T.score(table.withColumns({"score": F.lit("old"), "prediction": F.lit(1), "probability": F.lit(2)}), scorer)
    held = found.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    bad, good = ([r.score for r in held if (r.doc_id % 6 == 0) == want] for want in (True, False))
    assert sum(b > g for b in bad for g in good) > 0.95 * len(bad) * len(good)
    assert all(0 <= r.score <= 1 for r in held)
    assert sum(b >= 0.5 for b in bad) > 0.8 * len(bad) and sum(g >= 0.5 for g in good) < 0.05 * len(good)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "  "), (3, "You IDIOT! " * 20_000), (3, "You IDIOT! " * 20_000)], DOCS)
    rows = T.score(odd, scorer).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert min(r.score for r in rows if r.doc_id == 3) > max(r.score for r in rows if r.doc_id != 3)


def test_without_both_labels(spark):
    table = spark.createDataFrame([(i, f"text {i}") for i in range(20)], DOCS)
    for labels, want in (([], 0.0), ([(i, 1) for i in range(20)], 1.0), ([(i, None) for i in range(20)] + [(None, 1)], 0.0)):
        scorer = T.train(table, spark.createDataFrame(labels, LABELS))
        assert {r.score for r in T.score(table, scorer).collect()} == {want}
    assert T.score(table.limit(0), scorer).count() == 0


def test_features():
    empty = T.Lexicon({})
    f = lambda text, lexicon=empty: dict(zip(T.FEATURES, lexicon.features(text), strict=True))
    assert not any(f(None).values()) and f(None) == f("")
    assert f("you are an idiot")["near_second"] > 0 == f("the idiot stood far away from all of you")["near_second"]
    assert f("such an 1d10t here")["disguised"] > 0 and f("such an id1ot here")["disguised_hits"] > 0
    assert f("SHOUT")["capitals"] == 1 and f("hm!!")["marks"] == 0.5
    assert f("zorkanab", T.Lexicon({b"zork~": 5.0}))["strong"] == 1
