"""Benchmark decontamination against a plain search for windows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from offerlens.llm.decontaminate import Automaton, find_contamination, item_words, remove_contamination

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(text, items, window):
    """Hit word places and item ids, by looking at every window of every item."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))
    own, hit, found = cut(text), set(), set()
    for name, item in items:
        words = cut(item)
        n = min(window, len(words))
        windows = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(name)
    return len(own), hit, found - {None}


def corpus(seed, words=6):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "B", "c", "dé", "É9", "xx"][:words])
    items = [(str(k), rnd.choice([" ", "-", "\n"]).join(word() for _ in range(rnd.choice([0, 1, 2, 3, 5, 8, 12])))) for k in range(8)]
    docs = [" ".join(word() for _ in range(rnd.randint(0, 40))) for _ in range(40)]
    docs += ["zz " + item + " zz " + item for _, item in items]
    return docs, items


@pytest.mark.parametrize("seed", range(6))
def test_automaton_finds_what_a_plain_search_finds(seed):
    docs, items = corpus(seed)
    items = [i for i in items if len(item_words(i[1].encode())) != 1]
    for window in (3, 5):
        machine = Automaton([(n, t.encode()) for n, t in items], window)
        for text in docs:
            n, hit, found = brute(text, items, window)
            spans, at = machine.scan(item_words(text.encode()))
            assert {p for a, b in spans for p in range(a, b)} == hit
            assert {machine.names[i] for i in at} == found
            assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("shard", [1 << 20, 30])
def test_documents_and_shards(spark, shard):
    docs, items = corpus(11)
    items += [(None, "one two three four"), ("x", None), ("y", ""), ("0", items[0][1]), ("long", "word " * 25)]
    docs += [None, "", "One TWO three, four!", "...", "word " * 5000, "one two three four"]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], DOCS).withColumns(
        {"n_words": F.lit("old"), "spans": F.lit(1), "items": F.lit(2)}
    )
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = find_contamination(table, bench, window=4, max_shard_bytes=shard).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, found = brute(docs[r.doc_id], items, 4)
        assert (r.n_words, r.n_hit, r.items) == (n, len(hit), sorted(found))


def test_cut_leaves_clean_texts(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    # The inner passage's cut brings the outer one together.
    nested = "x1 x2 alpha beta gamma delta epsilon " + passage + " zeta eta theta iota kappa x3 x4 x5 x6 x7 x8 x9"
    docs = [
        (1, "clean words stay\nas they are", "en", "s", 0), (2, "y " * 20 + passage + " z" * 20, "en", "s", 0), (3, nested, "en", "s", 0),
        (4, passage, "en", "s", 0), (5, None, None, None, None), (6, "", "en", "s", 0), (None, "z " * 30 + passage, "en", "s", 0),
    ]
    bench = spark.createDataFrame([(1, passage)], "item_id int, text string")
    for shard in (1 << 20, 10):
        rows = {r.doc_id: r for r in remove_contamination(spark.createDataFrame(docs, DOCS), bench, max_coverage=0.8, max_shard_bytes=shard).collect()}
        assert set(rows) == {1, 2, 3, 5, 6, None}
        assert (rows[1].text, rows[1].n_cut, rows[5].text, rows[6].text) == (docs[0][1], 0, None, "")
        assert rows[2].text == "y " * 20 + "\n" + " z" * 20 and rows[2].n_cut == 10
        assert all(not brute(r.text, [("1", passage)], 10)[1] for r in rows.values())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id int, text string")
    some = spark.createDataFrame([(1, "a b", None, None, 3)], DOCS)
    assert find_contamination(docs, spark.createDataFrame([(1, "a b")], "item_id int, text string")).count() == 0
    assert [(r.n_words, r.n_hit, r.items) for r in find_contamination(some, bench).collect()] == [(2, 0, [])]
    assert remove_contamination(some, bench).columns == [*some.columns, "n_cut"]


def test_shards_change_nothing_in_cut_texts(spark):
    p = lambda a, b: " ".join(f"p{i}" for i in range(a, b + 1))
    items = [(str(k), p(a, b)) for k, (a, b) in enumerate([(1, 15), (11, 22), (30, 41), (34, 45), (38, 50)])]
    _, more = corpus(11)
    items += [(f"m{k}", t) for k, (_, t) in enumerate(more)]
    docs = ["u " * 40 + p(1, 22) + " v" * 40, "u " * 9 + p(30, 50) + " v" * 9, p(1, 22) + " w" * 15]
    # The cut of the inner passage brings together a window of another item.
    docs += ["u " * 40 + p(1, 6) + " " + p(34, 45) + " " + p(7, 15) + " v" * 40, "u " * 40 + p(34, 40) + " " + p(11, 22) + " " + p(41, 45) + " v" * 40]
    docs += corpus(11)[0] + [None, "", "no hit", p(1, 22)]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], DOCS)
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole, parts = (
        {r.doc_id: (r.text, r.n_cut) for r in remove_contamination(table, bench, max_coverage=0.6, max_shard_bytes=shard).collect()} for shard in (1 << 20, 30)
    )
    assert parts == whole and parts[0] == ("u " * 40 + "\n" + " v" * 40, 22) and 2 in parts
    assert all(not brute(t, items, 10)[1] for t, _ in parts.values())
