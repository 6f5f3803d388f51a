"""Stupid backoff against plain counting."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm import ngram_lm as N
from offerlens.llm.common import map_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, order, alpha):
    split = [re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW)) for t in docs]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(order + 1) for i in range(len(w) - n + (n > 0)))
    own = [grams(w) for w in split]
    total = sum(own, Counter())
    out = []
    for words, mine in zip(split, own):
        score = 0.0
        for i in range(len(words)):
            longest = min(order, i + 1)
            for n in range(longest, 0, -1):
                g = tuple(words[i - n + 1 : i + 1])
                if total[g] > mine[g]:
                    score += math.log((total[g] - mine[g]) / (total[g[:-1]] - mine[g[:-1]])) + (longest - n) * math.log(alpha)
                    break
            else:
                score += math.log(0.5 / max(1, total[()] - mine[()])) + (longest - 1) * math.log(alpha)
        out.append((len(words), score))
    return out


@pytest.mark.parametrize("order,block", [(1, 1 << 20), (2, 50), (3, 1 << 20), (3, 1)])
def test_scores(spark, order, block):
    rnd = random.Random(order)
    docs = [rnd.choice([" ", "\n"]).join(rnd.choice(["a", "B", "b", "c", "dé", f"w{rnd.randint(0, 40)}"]) for _ in range(rnd.choice([0, 1, 2, 9, 40]))) for _ in range(60)]
    docs += [None, "", " ", "only here", "a b " * 4000, docs[5], docs[5]]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").withColumns({"block": F.lit(1), "part": F.lit(2), "n_words": F.lit("x")})
    found = {r.doc_id: r for r in N.lm_scores(table.repartition(3), order, block_words=block).collect()}
    assert len(found) == len(docs)
    for i, (n, score) in enumerate(brute(docs, order, 0.4)):
        assert found[i].n_words == n and found[i].log_score == pytest.approx(score, abs=1e-6)
        assert (found[i].mean_log is None) == (n == 0)


def test_odd_tables(spark):
    assert N.lm_scores(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = N.lm_scores(spark.createDataFrame([(None, "a"), ("x", None), ("x", "a")], "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.n_words) for r in rows) == [("", 1), ("x", 0), ("x", 1)]


def test_packing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1000):
        h = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (N.unpack_hashes(N.pack_hashes(h)) == h).all()
    for c in (np.array([1, 2]), np.array([1 << 40])):
        assert (N.unpack_counts(N.pack_counts(c)) == c).all()
    bounds = N.part_bounds(7)
    assert bounds[0] == 0 and (np.diff(bounds) > 0).all()


def test_a_task_that_runs_again_names_its_blocks_alike(spark, monkeypatch):
    frames = []
    monkeypatch.setattr(N, "map_rows", lambda *given: frames.append(map_rows(*given)) or frames[-1])
    docs = [(i, f"a b w{i % 7} c " * (i % 5)) for i in range(60)]
    N.lm_scores(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), block_words=20)
    blocks = lambda: sorted((r.block, r.part, bytes(r.body), r.ids) for r in frames[0].collect())
    first = blocks()
    assert first == blocks() and len({b for b, part, *_ in first if part == N.TEXT_ROW}) > 3


def test_only_plain_scans_repeat(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert N.repeats(docs.select("text", "id").where("id > 1"))
    assert not any(N.repeats(t) for t in (docs.repartition(2), docs.distinct(), docs.limit(1), docs.where("rand() < 0.5"), docs.select(F.rand())))


@pytest.mark.parametrize("lost", ["part = 0", f"part = {N.TEXT_ROW}"])
def test_missing_rows_are_errors(spark, monkeypatch, lost):
    drop = lambda df, run, ddl: map_rows(df.where(f"not ({lost})") if run.__name__ == "scored" else df, run, ddl)
    monkeypatch.setattr(N, "map_rows", drop)
    docs = [(i, f"a b w{i} c d e f g") for i in range(20)]
    with pytest.raises(Exception, match="block"):
        N.lm_scores(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
