"""The corpus pipeline, stage by stage."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from conftest import TINY


def test_stages_over_the_test_table(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, TINY)
        assert name == P.STAGES[-1][0] or out.columns == P.COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.7 * len(ids)
        ids = kept
    assert docs.where("taken <> size * copies or copies not in (1, 2)").count() == 0


def test_decisions_take_effect(spark, tmp_path):
    rnd = random.Random(1)
    word = {"en": "the of and with house water".split(), "de": "der und nicht straße wasser ich".split()}
    text = lambda lang, n=80: " ".join(rnd.choice(word[lang]) + str(rnd.randint(0, 999)) for _ in range(n))
    passage = " ".join(f"item{k}" for k in range(15))
    common = "This line stands in very many documents"
    rows = [(i, text(lang := rnd.choice(["en", "de"])), lang, f"s{i % 3}", 0) for i in range(60)]
    copy = rows[10][1]
    rows += [(100, copy, "en", "s0", 0), (None, copy, "en", "s0", 0), (None, text("de"), "de", None, None)]
    rows += [(200 + i, f"{common}\n{text('en')}", "en", "s1", 0) for i in range(6)]
    rows += [(300, f"{text('de')} {passage} {text('de')}", "de", "s2", 0), (301, passage, "en", "s2", 0), (302, None, None, None, None), (303, "12 34", "en", "s0", 5)]
    spark.createDataFrame([(1, passage), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("size", F.lit("clash"))
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert {302, 303}.isdisjoint(seen["language"]) and len(seen["language"]) == len(rows) - 3  # two rows share the null id
    assert [i for i in range(200, 206) if common in seen["lines"][i].text] == [205]
    assert 10 in seen["near_duplicates"] and 100 not in seen["near_duplicates"] and None in seen["near_duplicates"]
    assert 301 not in seen["benchmark"] and "item7" not in seen["benchmark"][300].text
    assert seen["benchmark"][300].n_chars == len(seen["benchmark"][300].text)
    assert set(range(60)) <= set(seen["benchmark"])


def test_one_row_of_a_group_stays(spark):
    """Equal rows leave one; an id that names two texts loses only the one that is a copy."""
    rnd = random.Random(2)
    text = lambda: " ".join(f"w{rnd.randint(0, 9999)}" for _ in range(60))
    one, two, three, four = text(), text(), text(), text()
    rows = [(1, one), (1, one), (5, one), (7, two), (7, three), (3, three), (None, four), (None, four), (9, "é"), (9, "é"), (9, None), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", None, 0, "Row") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, `ROW` string")
    out = P.drop_near_duplicates(spark, docs, TINY)
    assert out.columns == P.COLUMNS
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert left == sorted([(1, one), (7, two), (3, three), (None, four), (None, four), (9, "é"), (2, None)], key=str)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
