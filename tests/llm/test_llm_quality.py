"""Quality rules: statistics against plain Python, outliers by group."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from offerlens.llm import quality as Q

DOCS = "doc_id bigint, text string, lang string, source string"


def plain(text):
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    hit = {p for i, w in enumerate(windows) if many[w] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark):
    rnd = random.Random(1)
    texts = [rnd.choice(["", " ", "\n"]) + "".join(rnd.choice("ab é😀") + rnd.choice(["a", " ", "\n", "# ", "\x0b", "\x85"]) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    texts += [None, "", " \t", "a b c d e", "a b c d e a b c d e", "a " * 30, "x y z w v " * 3000, "same line\nsame line\n same line\nsame line \n\n", "one\n" * 5 + "two three four five six seven\n" * 2]
    table = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], DOCS).withColumns({"n_words": F.lit("x"), "n_chars": F.lit(1), "n_lines": F.lit(2)})
    for r in Q.statistics(table).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id]), texts[r.doc_id]


def made(n=300):
    rnd = random.Random(2)
    word = lambda k: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(2, k)))
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(word(7 if lang == "en" else 30) for _ in range(rnd.randint(60, 400))), lang, "big"))
    rows += [(1000 + i, " ".join(word(7) for _ in range(200)), "en", f"small{i}") for i in range(4)]
    return rows, word


def test_outliers_by_language_and_source(spark):
    rows, word = made()
    odd = [
        (2000, " ".join(word(30) for _ in range(200)), "en", "big"),  # usual in the other language
        (2001, " ".join("#$%&" + word(7) for _ in range(200)), "en", "big"),
        (2002, "w x y z " * 40, "en", "big"),
        (2003, None, "en", "big"), (2004, "too short", None, None), (None, " ".join(word(7) for _ in range(100)), "en", "big"),
    ]
    table = spark.createDataFrame(rows + odd + rows[:1], DOCS).withColumns({"x0": F.lit(1), "grp": F.lit("g"), "bin": F.lit(2), "kept": F.lit(3)})
    found = {r.doc_id: r for r in Q.judge(table, min_rows=50).collect()}
    assert len(found) == len(rows) + len(odd)
    assert not any(found[i].kept for i in range(2000, 2005))
    assert found[2000].d2 > Q.chi_square(1 - 1e-6) and not found[2000].base_failed and found[2002].base_failed and found[2003].base_failed
    good = [found[i] for i, *_ in rows] + [found[None]]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert Q.judge(table.limit(0)).count() == 0


def test_estimates_withstand_a_third_of_junk(spark):
    rows, word = made(200)
    junk = [(3000 + i, " ".join("#" * 6 + word(7) for _ in range(150)), "en", "big") for i in range(40)]
    found = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(rows + junk, DOCS), min_rows=50).collect()}
    assert not any(found[i] for i, *_ in junk)
    assert sum(found[i] for i, *_ in rows) >= 0.99 * len(rows)


def test_small_tables_reject_by_base_rules_only(spark):
    rows, _ = made(12)
    found = Q.judge(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r.kept and r.d2 is None for r in found)


def test_quantiles():
    for p, want in ((0.5, 4.351), (0.95, 11.07), (0.999, 20.52)):
        assert abs(Q.chi_square(p) - want) < 0.02 * want


def test_small_groups_are_judged_by_their_language_then_by_all_rows(spark):
    rows, word = made()
    symbols = lambda: " ".join("#$%&" + word(7) for _ in range(200))
    junk = [(4000 + i, symbols(), "en", "new") for i in range(40)] + [(4100, symbols(), "rare", "big"), (4101, symbols(), None, None)]
    alone = [(4200, " ".join(word(7) for _ in range(200)), "rare", "big")]
    found = {r.doc_id: r for r in Q.judge(spark.createDataFrame(rows + junk + alone, DOCS), min_rows=60).collect()}
    assert len(found) == len(rows + junk + alone) and all(r.d2 is not None for r in found.values())
    assert not any(found[i].kept or found[i].base_failed for i, *_ in junk)
    assert found[4200].kept and sum(found[i].kept for i, *_ in rows) >= 0.99 * len(rows)


def test_levels_hold_the_large_groups_too(spark):
    rows = [("en", "a", i >= 5) for i in range(9)] + [("en", "b", i == 0) for i in range(2)] + [("de", "a", False)] + [("fr", "a", False)] * 4
    table = spark.createDataFrame(rows, "gl string, gs string, base_failed boolean")
    found = {(r.gl, r.gs): [v.grp for v in r.levels] for r in Q.grouped(table, 4).collect()}
    assert found == {("en", "a"): ["2\nena", "2\nen", "*"], ("en", "b"): ["2\nen", "*"], ("de", "a"): ["*"], ("fr", "a"): ["2\nfra", "*"]}
