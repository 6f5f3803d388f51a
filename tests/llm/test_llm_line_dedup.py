"""Line dedup against a plain count of keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlens.llm.line_dedup import Bloom, Growing, dedup_lines

DOCS = "doc_id bigint, text string"
BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars, min_docs):
    key = lambda line: line.strip(BLANK).translate(LOW)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines
            if i is None or not (len(h := holders.get(key(x), set())) >= min_docs and i != max(h))
        ]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def corpus():
    rnd = random.Random(3)
    pool = [rnd.choice(["", " ", "\t", "é" * 9]) + f"Line number {k} " + "x" * rnd.randint(0, 12) + rnd.choice(["", "\r", " "]) for k in range(60)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(120)]
    rows += [(200 + i, "The common LINE of very many\nown %d" % i) for i in range(300)]
    rows += [(600, None), (601, ""), (602, "\n\n"), (None, pool[0]), (None, None), (5, rows[5][1]), (5, rows[5][1]), (7, "other"), (603, pool[1] + "\n" * 20_000)]
    return rows


@pytest.mark.parametrize("bits", [1 << 27, 1 << 11])
def test_same_lines_go_whatever_the_filter(spark, bits):
    rows = corpus()
    table = spark.createDataFrame(rows, DOCS).withColumns({"n_lines": F.lit("old"), "line": F.lit(1), "doc": F.lit(2), "salt": F.lit(3)})
    out = dedup_lines(table, min_chars=14, min_docs=3, twice_bits=bits)
    assert out.columns == ["doc_id", "text", "line", "doc", "salt", "n_lines", "n_dropped"]
    found = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(found, key=key) == sorted(brute(rows, 14, 3), key=key)


def test_text_ids_and_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
    line = "a line that is long enough to count"
    rows = [(c, line) for c in "abcd"]
    found = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert found == {"a": "", "b": "", "c": "", "d": line}


def test_filters():
    h = np.random.default_rng(0).integers(0, 1 << 63, 40_000).astype(np.uint64)
    growing, fixed = Growing(1 << 10), Bloom(1 << 20)
    for part in np.array_split(h[:20_000], 7):
        growing.add(part)
    fixed.add(h[:20_000])
    assert growing.has(h[:20_000]).all() and fixed.has(h[:20_000]).all()
    assert growing.has(h[20_000:]).mean() < 0.2 and fixed.has(h[20_000:]).mean() < 0.01
    assert len(growing.parts) > 2
