"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties), then calibrated by a
temperature. The model is fitted on a bounded sample of the labelled rows; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from offerlens.llm.common import Sent, add_columns, fold, map_rows, texts

BITS = 14
ORDERS = (1, 2, 3)
CHUNK = 1 << 16  # characters handled at once
LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """Hashed counts of the character n-grams of a whole text; letters are lower-cased, digits and blanks folded."""
    total, small = np.zeros(1 << BITS, np.int64), text.lower()
    for at in range(0, len(small), CHUNK):
        # An n-gram that crosses a chunk's end belongs to the chunk it starts in.
        total += _counts(small[at : at + CHUNK + max(ORDERS) - 1], CHUNK)
    return total


def _counts(part: str, starts: int) -> np.ndarray:
    c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    c = np.where((c >= 48) & (c <= 57), np.uint32(48), np.where((c == 32) | (c >= 9) & (c <= 13), np.uint32(32), c))
    total = np.zeros(1 << BITS, np.int64)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            mixed = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            total += np.bincount(mixed[:starts], minlength=1 << BITS)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (features, languages)
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF with sublinear counts and unit length, as indices and values."""
        n = counts(text)
        at = np.flatnonzero(n)
        v = (1 + np.log(n[at])) * self.idf[at]
        return at, v / (np.linalg.norm(v) or 1.0)

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(*self.vector(text)) / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(p[k])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int,
    epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over single examples; returns weights and biases (bias without penalty)."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def weights(z, n, l1, l2):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            w, b = weights(z[at], n[at], l1, l2), weights(zb, nb, 0.0, 0.0)
            g = softmax(v @ w + b)
            g[labels[i]] -= 1
            grad = np.outer(v, g)
            grown = n[at] + grad * grad
            z[at] += grad - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    return weights(z, n, l1, l2), weights(zb, nb, 0.0, 0.0)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, from a grid refined twice."""
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean()
    low, high = np.log(0.02), np.log(20.0)
    for _ in range(3):
        grid = np.linspace(low, high, 25)
        k = int(np.argmin([loss(np.exp(t)) for t in grid]))
        low, high = grid[max(0, k - 1)], grid[min(24, k + 1)]
    return float(np.exp((low + high) / 2))


def sample(labelled: DataFrame, rows_per_lang: int, rows: int) -> DataFrame:
    """About ``rows_per_lang`` rows of each language, fewer of each where that makes more than ``rows`` in all, one at least.

    Rows are chosen by a hash of the id; the row of the least hash that has a letter always belongs to them.
    """
    unit = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    least = F.min(F.when(F.col("text").rlike(r"\p{L}"), unit))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), least.alias("least")).orderBy("lang").collect()  # a row for each language
    if not sizes:
        return labelled.limit(0)
    each = min(rows_per_lang, max(1, rows // len(sizes)))
    # The bounds are a literal: a join would bring all texts of a language to one task.
    bound = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, max(min(1.0, each / r.n), (r.least or 0.0) + 2.0**-31))])
    return labelled.where(unit < bound[F.col("lang")])


def train(
    docs: DataFrame, rows_per_lang: int = 400, rows: int = 20_000, text_col: str = "text", lang_col: str = "lang",
    id_col: str = "doc_id",
) -> Model:
    """Fit on rows that aren't held out, with a language and a letter; every fifth of them sets the temperature.

    ``rows_per_lang`` and ``rows`` bound the sample; every language that has a labelled row with a letter is in it. Rows come to the
    driver as packed sparse counts of 2**14 features at most, 12 bytes each. The model holds 2**14 weights for each language.
    Repeated rows count as often as they occur.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(fold(F.col("id")) != 0, F.lit(False))
    )

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in it:
            columns: list[list] = [[], [], [], []]
            for text, doc, lang in zip(batch.column("text").to_pylist(), batch.column("id").to_pylist(), batch.column("lang").to_pylist()):
                if has_letter(text):
                    n = counts(text)
                    at = np.flatnonzero(n)
                    for column, value in zip(columns, (str(doc), lang, at.astype(np.int32).tobytes(), n[at].astype(np.int64).tobytes())):
                        column.append(value)
            yield columns

    found = map_rows(sample(labelled, rows_per_lang, rows), counted, "id string, lang string, at binary, n binary")
    found = sorted(found.collect(), key=lambda r: (r.id, r.lang, bytes(r.at), bytes(r.n)))
    langs = sorted({r.lang for r in found})
    if not langs:
        return Model([], np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0))
    seen = np.zeros(1 << BITS)
    for r in found:
        seen[np.frombuffer(r.at, np.int32)] += 1
    model = Model(langs, np.log((1 + len(found)) / (1 + seen)) + 1, np.zeros((1 << BITS, len(langs))), np.zeros(len(langs)))

    def scaled(r) -> tuple[np.ndarray, np.ndarray]:
        at = np.frombuffer(r.at, np.int32)
        v = (1 + np.log(np.frombuffer(r.n, np.int64))) * model.idf[at]
        return at, v / np.linalg.norm(v)

    number = {lang: i for i, lang in enumerate(langs)}
    vectors = [scaled(r) for r in found]
    labels = np.array([number[r.lang] for r in found])
    apart = np.arange(len(found)) % 5 == 4
    chosen = np.flatnonzero(~apart)
    model.weights, model.bias = ftrl([vectors[i] for i in chosen], labels[chosen], len(langs))
    if apart.any():
        logits = np.array([model.logits(*vectors[i]) for i in np.flatnonzero(apart)])
        model.temperature = fit_temperature(logits, labels[apart])
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, ``lang_pred`` and ``score`` (input columns of these names are replaced).

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learned.
    """
    sent = Sent(docs.sparkSession, model)  # 2**14 weights for each language

    def predict(batch: pa.RecordBatch) -> list:
        found = [sent.value.predict(None if t is None else t.decode()) for t in texts(batch, text_col)]
        return [[lang for lang, _ in found], [score for _, score in found]]

    return add_columns(docs, predict, "lang_pred string, score double")
