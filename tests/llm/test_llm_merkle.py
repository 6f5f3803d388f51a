"""Merkle manifest against a plain tree: places, ties, nulls, proofs, tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from offerlens.llm import merkle
from offerlens.llm.common import ascii_lower

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
TAMPERED = "tampered"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root of a list of nodes, and for each what stands before and behind it on every level."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, grouped = [], []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for j in range(len(run)):
                for i in members[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(h("".join(run)))
            grouped.append([i for m in members[a : a + 16] for i in m])
        nodes, members = above, grouped
    return nodes[0], paths


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in own[s]]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, above):
        for r, path in zip(own[s], trees[s][1]):
            path, start = path + top, leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                start = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for before, behind in path:
                start = h(before + start + behind)
            out.append((r[0], leaf(r), trees[s][0], root, h("".join(a + b for a, b in path)), start, start == root))
    return out


def found(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = merkle.manifest(docs, tampered=F.when(tampered, merkle.leaf(text=ascii_lower(F.col("text")))))
    return [tuple(r) for r in merkle.verify(rows, F.coalesce("tampered", "leaf")).collect()]


def same(spark, rows, schema=SCHEMA):
    key = lambda r: tuple(map(str, r))
    assert sorted(found(spark.createDataFrame(rows, schema)), key=key) == sorted(plain([r[:5] for r in rows]), key=key)


def test_ties_nulls_and_clashes(spark):
    rnd = random.Random(3)
    ids = [None, 7, 7, 2**63 - 1, -(2**63), 0, 1, 63, 64, 65]
    rows = []
    for i in range(260):
        doc = rnd.choice([*ids, i, -i, i * 10**12])
        rows.append((doc, rnd.choice([None, "", "a", "A", "é", "z", "a"]), rnd.choice([None, "en"]), rnd.choice([None, -4]), rnd.choice([None, "", "Abc É", "x" * 50_000]), "at", 5, "leaf", 1))
    rows += rows[:30]  # whole rows repeat
    same(spark, rows, SCHEMA + ", at string, rank int, `LEAF` string, tree int")


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_sizes(spark, n):
    if n == 0:
        assert found(spark.createDataFrame([], SCHEMA)) == []
    else:
        same(spark, [(3 * i, "s", "en", i, "Text") for i in range(n)])


def test_many_sources(spark):
    same(spark, [(i, f"s{i}", None, None, "T") for i in range(40)])


def test_ids_are_integers(spark):
    with pytest.raises(ValueError, match="integer"):
        merkle.manifest(spark.createDataFrame([("a", "s", "en", 1, "t")], SCHEMA.replace("doc_id bigint", "doc_id string")))


def test_rank_without_sort(spark):
    """The rows reach their place by a join with the words of the bitmaps; nothing sorts or windows them."""
    rnd = random.Random(1)
    keys = [(rnd.choice("ab"), rnd.choice([rnd.randrange(-200, 200), rnd.randrange(-(2**62), 2**62), 5])) for _ in range(500)]
    got = merkle.ranked(spark.createDataFrame(keys, "g string, k bigint"), ["g"], F.col("k")).collect()
    assert len(got) == len(keys)
    for r in got:
        assert r.rank == sum(g == r.g and k < r.k for g, k in keys)
        assert r.same == sum(g == r.g and k == r.k for g, k in keys)
