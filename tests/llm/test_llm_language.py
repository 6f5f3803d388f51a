"""Language identification: held-out accuracy, calibration and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import TINY
from offerlens.llm import language as L

DOCS = "doc_id bigint, text string, lang string, source string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    model = L.train(docs)
    rows = L.identify(docs, model).withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).where("fold = 0").collect()
    assert len(rows) > 20
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    assert (model.weights == 0).mean() > 0.3  # sparse


def test_held_out_rows_and_ids_teach_nothing(spark):
    text = {"x": "lorem ipsum dolor", "y": "quick brown fox"}
    rows = [(i, f"{text[k]} {i}", k, "s") for i, k in enumerate("xy" * 40)]
    table = spark.createDataFrame(rows, DOCS).withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5)
    wrong = table.withColumn("lang", F.when(F.col("fold") == 0, "z").otherwise(F.col("lang")))
    model = L.train(wrong)
    assert model.langs == ["x", "y"]
    found = L.identify(wrong.drop("lang", "source", "doc_id").withColumns({"score": F.lit("old"), "lang_pred": F.lit(1)}), model).collect()
    assert {r.text.split()[0]: r.lang_pred for r in found} == {"lorem": "x", "quick": "y"}
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_texts(spark):
    rows = [(1, None, "a", "s"), (2, "", "a", "s"), (3, "123 !? ²", "b", "s"), (4, "é", None, "s"), (None, "words here", "a", None), (6, "ab " * 100_000, "a", "s"), (7, "Zb", "b", "s"), (8, "zb zb", "b", "s")]
    table = spark.createDataFrame(rows + rows[:2], DOCS)
    found = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(table, L.train(table)).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0)
    assert {found[4][0], found[6][0]} <= {"a", "b"}
    empty = spark.createDataFrame([], DOCS)
    assert L.train(empty).langs == [] and L.identify(empty, L.train(empty)).count() == 0
    assert L.identify(table, L.train(empty)).where("lang_pred <> 'und' or score <> 0").count() == 0


def test_counts_cover_the_whole_text():
    text = "abç D" * 40_000
    total = L.counts(text)
    low = text.lower()
    assert total.sum() == sum(len(low) - n + 1 for n in L.ORDERS)
    assert (L.counts("xy" * 10) > 0).sum() <= 2 + 2 + 2


def test_penalty_and_temperature():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(300):
        k = i % 3
        at = np.unique(np.concatenate([rng.integers(0, 50, 5) + 100 * k, rng.integers(1000, 1 << L.BITS, 5)]))
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)))))
        labels.append(k)
    labels = np.array(labels)
    few, _ = L.ftrl(rows, labels, 3, l1=0.5)
    many, bias = L.ftrl(rows, labels, 3, l1=0.001)
    assert (few != 0).sum() < (many != 0).sum()
    logits = np.array([v @ many[at] + bias for at, v in rows])
    assert (logits.argmax(axis=1) == labels).mean() > 0.95
    noisy = np.where(rng.random(300) < 0.3, (labels + 1) % 3, labels)
    assert L.fit_temperature(logits, noisy) == pytest.approx(4 * L.fit_temperature(logits / 4, noisy), rel=0.2)


def plain_counts(text):
    """Hashed n-grams one by one: digits are one character, blanks another."""
    low = "".join("0" if c in "0123456789" else " " if c in " \t\n\x0b\x0c\r" else c for c in text.lower())
    out = {}
    for n in L.ORDERS:
        for i in range(len(low) - n + 1):
            h = 0
            for k, c in enumerate(low[i : i + n]):
                h = (h * 0x01000193 + ord(c) + k + 1) % 2**32
            at = (h * 0x9E3779B1) % 2**32 >> 32 - L.BITS
            out[at] = out.get(at, 0) + 1
    return out


def test_counts_against_single_grams():
    rng = np.random.default_rng(2)
    alphabet = list("abcXYZ éß😀0 9\n\t.") + ["\u2028"]
    for n in (0, 1, 2, 3, 50, L.CHUNK - 1, L.CHUNK, L.CHUNK + 2, 2 * L.CHUNK + 1):
        text = "".join(rng.choice(alphabet, n))
        total = L.counts(text)
        assert {int(i): int(total[i]) for i in np.flatnonzero(total)} == plain_counts(text)


def test_training_against_plain_arithmetic():
    """Follow-the-regularised-leader and the score, one weight at a time."""
    rng = np.random.default_rng(3)
    rows, labels, classes = [], [], 3
    for i in range(40):
        at = np.unique(rng.integers(0, 30, 6))
        rows.append((at, rng.random(len(at))))
        labels.append(int(rng.integers(0, classes)))
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02
    z, n = {}, {}

    def weight(key, l1, l2):
        if abs(z.get(key, 0.0)) <= l1:
            return 0.0
        return -(z[key] - np.sign(z[key]) * l1) / ((beta + np.sqrt(n[key])) / alpha + l2)

    def score(at, v):
        raw = [sum(x * weight((f, k), l1, l2) for f, x in zip(at.tolist(), v)) + weight(("bias", k), 0.0, 0.0) for k in range(classes)]
        e = np.exp(np.array(raw) - max(raw))
        return e / e.sum()

    order = np.random.default_rng(0)
    for _ in range(4):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            p = score(at, v)
            step = {("bias", k): (p[k] - (k == labels[i]), 0.0, 0.0) for k in range(classes)}
            step |= {(f, k): (x * (p[k] - (k == labels[i])), l1, l2) for f, x in zip(at.tolist(), v) for k in range(classes)}
            moves = {key: (g, (np.sqrt(n.get(key, 0.0) + g * g) - np.sqrt(n.get(key, 0.0))) / alpha * weight(key, a, b)) for key, (g, a, b) in step.items()}
            for key, (g, shift) in moves.items():
                z[key] = z.get(key, 0.0) + g - shift
                n[key] = n.get(key, 0.0) + g * g
    weights, bias = L.ftrl(rows, np.array(labels), classes)
    for f in range(30):
        assert weights[f] == pytest.approx([weight((f, k), l1, l2) for k in range(classes)], abs=1e-9)
    assert bias == pytest.approx([weight(("bias", k), 0.0, 0.0) for k in range(classes)], abs=1e-9)


def test_every_language_stays_in_a_bounded_sample(spark):
    """More languages than the sample has rows for: each still has one."""
    rows = [(1000 * k + i, f"w{chr(97 + k % 26)}{k}x " * 3 if i % 3 else "12", f"l{k:03d}", "s") for k in range(120) for i in range(9)]
    model = L.train(spark.createDataFrame(rows + rows[:20], DOCS), rows=60)
    assert model.langs == [f"l{k:03d}" for k in range(120)]
