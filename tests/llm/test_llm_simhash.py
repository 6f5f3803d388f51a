"""SimHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from offerlens.llm.simhash import blocks_for, candidate_links, cell_keys, components, fingerprint, forest, near_duplicates, places

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, ids):
    """Smallest id of each value's component, by all pairs."""
    parent = list(range(len(values)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(values)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(values))]


def family(seed, n, spread):
    """Fingerprints a few bits apart, and others."""
    rnd = random.Random(seed)
    base = rnd.getrandbits(64)
    near = [base ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, spread))) & (1 << 64) - 1 for _ in range(n)]
    return near + [rnd.getrandbits(64) for _ in range(n)]


def test_fingerprints():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 50, 20_000):
        text = rnd.choice([" ", "\n"]).join(rnd.choice(["The", "é", "x.", "b\xa0c"]) for _ in range(n))
        assert fingerprint(text.encode()) == plain_fingerprint(text)
    assert fingerprint(None) == fingerprint(b" \t\r\n") == 0


def test_the_embedding_is_a_lower_bound_and_near_ones_share_a_cell():
    v = np.array(family(5, 150, 5), np.uint64)
    grid = places(v).astype(int)
    for blocks in (6, 7, 8):
        keys = cell_keys(v, blocks)
        for i in range(len(v)):
            exact = np.bitwise_count(v ^ v[i])
            assert (np.abs(grid - grid[i]).sum(axis=1) <= exact).all()
            assert (keys == keys[i]).any(axis=1)[exact <= 4].all()
    assert blocks_for(10) == 6 < blocks_for(10**7) <= blocks_for(10**11)


def test_forests_join_what_all_pairs_join():
    v = np.array(sorted(set(family(7, 60, 6))), np.uint64)
    want = groups([int(x) for x in v], list(range(len(v))))
    for links in (forest(v), forest(v[::2]) + forest(v[1::2]) + forest(v[::2], v[1::2])):
        at = {int(x): k for k, x in enumerate(v)}
        got = list(range(len(v)))
        for _ in v:
            for a, b in links:
                got[at[a]] = got[at[b]] = min(got[at[a]], got[at[b]])
        assert got == want
    assert len(forest(v)) < len(v)


@pytest.mark.parametrize("cell_rows", [4096, 6])
def test_links_of_large_cells(spark, cell_rows):
    v = sorted(set(family(9, 120, 4)))
    signed = np.array(v, np.uint64).view(np.int64).tolist()
    links = candidate_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 6, cell_rows)
    root = {r.node: r.root for r in components(links).collect()}
    mine = [root.get(x, x) for x in signed]
    want = groups(v, list(range(len(v))))
    assert len({(a, b) for a, b in zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_components_of_chains_and_hubs(spark):
    rnd = random.Random(2)
    names = list(range(300))
    rnd.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(99)] + [(names[100], names[i]) for i in range(101, 200)] + [(5000 + i, 5001 + i) for i in range(60)] + [(9, 9)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    for part in (names[:100], names[100:200], list(range(5000, 5061))):
        assert {found[x] for x in part} == {min(part)}


def test_documents(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("qrstuvwxyz")
    docs = []
    for k in range(30):
        text = [word() for _ in range(rnd.choice([2, 3, 4, 60, 300]))]
        docs.append(" ".join(text))
        for _ in range(rnd.choice([0, 1, 5])):
            other = list(text)
            other[rnd.randrange(len(other))] = word()
            docs.append("\n".join(other).upper() if rnd.random() < 0.5 else " ".join(other))
    docs += ["same text here"] * 40 + [None, "", "  ", "x " * 30_000, docs[0]]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(docs)] + [(3, docs[3])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"fp": F.lit("x"), "id": F.lit(1), "root": F.lit(2)})
    found = near_duplicates(table)
    values = [plain_fingerprint(t) for _, t in rows]
    want = groups(values, [i for i, _ in rows])
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((i, "%016x" % v, c) for (i, _), v, c in zip(rows, values, want)), key=key)
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_other_radius(spark):
    """The radius is an argument: groups by all pairs at two and at seven bits."""
    values = sorted(set(family(4, 60, 9)))
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    for radius in (2, 7):
        links = candidate_links(rows, blocks_for(len(values), radius), radius=radius)
        found = {r.node & (1 << 64) - 1: r.root for r in components(links).collect()}
        close = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= radius]
        assert set(found) == {v for pair in close for v in pair}
        assert all(found[a] == found[b] for a, b in close)
        edges = {frozenset((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1)) for r in links.collect()}
        assert {e for e in edges if len(e) == 2} <= {frozenset(pair) for pair in close}
