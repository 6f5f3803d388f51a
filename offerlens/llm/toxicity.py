"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are lexicon densities, second-person proximity, and rates of capitals, punctuation and obfuscation. The
lexicon is a short list of common insults and what is learned: words and word beginnings that go with the label. The
features on which trees and calibration are fitted use a lexicon learned on the other half of the training rows, so
they are no better than those of new texts; scores use a lexicon learned on all of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from offerlens.llm.common import Sent, add_columns, fold, map_rows, texts
from offerlens.storage import stored

PREFIXES = (4, 5, 6)  # bytes of a word's beginning
# Second-person words of some languages.
SECOND_PERSON = frozenset(
    w.encode() for w in (
        "you your yours yourself u ur ya "
        "tu te toi ton ta tes vous votre vos "
        "du dich dir dein deine euch ihr euer "
        "tú usted ustedes ti tus vosotros"
    ).split()
)
# Common insults, known without any labels.
INSULTS = frozenset(
    w.encode() for w in (
        "idiot idiots idiotic moron morons moronic stupid dumb fool fools loser losers scum scumbag trash garbage pathetic "
        "worthless disgusting clown clowns imbecile jerk creep freak coward bastard bitch asshole shit fuck fucking damn "
        "idiota estúpido estúpida imbécil basura asqueroso imbécile crétin connard débile ordure dégoûtant "
        "dumm dummkopf trottel arschloch abschaum widerlich scheiße"
    ).split()
)
INSULT_WEIGHT = 4.0
LEET = bytes.maketrans(b"01345@7$!", b"oieasatsi")
DISGUISED = re.compile(rb"[a-z][0134578@$*!_]{1,2}[a-z]")
_BREAK = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b in b"'" else 32 for b in range(256))
_UPPER = bytes(range(65, 91))
_MARKS = b"!?"
_PUNCTUATION = b".,;:'\"()[]-"
_SYMBOLS = b"#*$%&|<>@^~_=+/\\{}`"
_DIGITS = b"0123456789"
FEATURES = (
    "strong", "strong_count", "weak", "weight", "top", "second", "near_second", "disguised", "disguised_hits",
    "single", "capitals", "marks", "punctuation", "symbols", "digits", "length",
)


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_BREAK).split()


def terms(word: bytes) -> list[bytes]:
    """The word and its beginnings, told apart by a mark."""
    return [word, *(word[:n] + b"~" for n in PREFIXES if len(word) > n)]


@dataclass
class Lexicon:
    weights: dict[bytes, float]  # log odds by term

    def weight(self, word: bytes) -> float:
        get = self.weights.get
        best = max(get(word, 0.0), INSULT_WEIGHT if word in INSULTS else 0.0)
        if len(word) > 4:
            best = max(best, get(word[:4] + b"~", 0.0), get(word[:5] + b"~", 0.0), get(word[:6] + b"~", 0.0))
        return best

    def features(self, text: str | None) -> list[float]:
        own = tokens(text or "")
        raw = (text or "").encode("utf-8", "replace")
        n, chars = max(1, len(own)), max(1, len(raw))
        memo: dict[bytes, float] = {}
        hits: list[tuple[int, float]] = []
        second: list[int] = []
        for i, w in enumerate(own):
            v = memo.get(w)
            if v is None:
                v = memo[w] = self.weight(w)
            if v:
                hits.append((i, v))
            if w in SECOND_PERSON:
                second.append(i)
        strong = sum(v >= 3 for _, v in hits)
        near = sum(any(t in SECOND_PERSON for t in own[max(0, i - 3) : i + 4]) for i, _ in hits)
        low = raw.lower()
        hidden = sum(1 for _ in DISGUISED.finditer(low))
        found = 0
        if hidden:
            for w in low.split():
                if DISGUISED.search(w):
                    found += self.weight(re.sub(rb"[^a-z\x80-\xff]", b"", w.strip(b".,!?;:").translate(LEET))) >= 3
        rate = lambda marks: (len(raw) - len(raw.translate(None, marks))) / chars
        return [
            strong / n, math.log1p(strong), (len(hits) - strong) / n, sum(v for _, v in hits) / n,
            max((v for _, v in hits), default=0.0), len(second) / n, near / n, hidden / n, found / n,
            sum(len(w) == 1 for w in own) / n, rate(_UPPER), rate(_MARKS), rate(_PUNCTUATION), rate(_SYMBOLS),
            rate(_DIGITS), math.log1p(len(own)),
        ]


def featured(docs: DataFrame, lexicon: Lexicon, text_col: str) -> DataFrame:
    sent = Sent(docs.sparkSession, lexicon)

    def compute(batch: pa.RecordBatch) -> list:
        return [[sent.value.features(None if t is None else t.decode("utf-8", "replace")) for t in texts(batch, text_col)]]

    return add_columns(docs, compute, "__dense array<double>")


def term_counts(rows: DataFrame) -> DataFrame:
    """``(text, label, half)`` -> ``(term, na, ka, nb, kb)``: rows with the term and those with label 1, by half."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        total: dict[bytes, list[int]] = {}

        def emptied() -> list:
            out = [list(total), *([n[k] for n in total.values()] for k in range(4))]
            total.clear()
            return out

        for batch in it:
            for text, label, half in zip(*(batch.column(name).to_pylist() for name in ("text", "label", "half"))):
                own: set[bytes] = set()
                for w in set(tokens(text or "")):
                    own.update(terms(w))
                at = 0 if half else 2
                for t in own:
                    n = total.setdefault(t, [0, 0, 0, 0])
                    n[at] += 1
                    n[at + 1] += label
                if len(total) > 500_000:
                    yield emptied()
        yield emptied()

    names = ("na", "ka", "nb", "kb")
    counts = map_rows(rows, counted, "term binary, " + ", ".join(f"{n} bigint" for n in names))
    return counts.groupBy("term").agg(*[F.sum(n).alias(n) for n in names])


def learn_lexicon(sums: DataFrame, bad: int, good: int, min_docs: int = 3) -> Lexicon:
    """``(term, n, k)`` -> all terms that go with label 1, by the likelihood ratio; the training sample bounds their number."""
    if not bad or not good:
        return Lexicon({})
    odds = F.log((F.col("k") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("k") + 0.5) / (good + 1.0))
    part = lambda x, of: F.when(x > 0, x * F.log(x / of)).otherwise(F.lit(0.0))
    base = bad / (bad + good)
    ratio = 2 * (part(F.col("k"), F.col("n") * base) + part(F.col("n") - F.col("k"), F.col("n") * (1 - base)))
    best = sums.where((F.col("k") >= min_docs) & (F.col("k") > 0.5 * F.col("n"))).select("term", odds.alias("odds"), ratio.alias("ratio"))
    chosen = best.where("odds > 1 and ratio > 11").collect()
    return Lexicon({bytes(r.term): float(r.odds) for r in chosen})


@dataclass
class Scorer:
    lexicon: Lexicon
    trees: object
    calibration: object
    constant: float


def train(
    docs: DataFrame, labels: DataFrame, rows: int = 16_000, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic"
) -> Scorer:
    """Fit on about ``rows`` labelled rows that aren't held out, chosen by a hash of the id.

    Rows with a null label or id are left out. Where not both labels occur, the score is the share of label 1.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.coalesce(fold(F.col("id")) != 0, F.lit(False))
    )
    n = known.count()
    unit = lambda salt: F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = known.where(unit("sample") < min(1.0, rows / max(n, 1)))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = stored(text.join(chosen, "id").withColumn("half", unit("half") < 0.5), "toxicity-rows")
    of = {(bool(r.half), int(r.label)): r.n for r in base.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    bad, good = ([of.get((half, label), 0) for half in (True, False)] for label in (1, 0))
    sums = stored(term_counts(base.select("text", "label", "half")).where("ka + kb > 0"), "toxicity-terms")
    first = learn_lexicon(sums.select("term", F.col("na").alias("n"), F.col("ka").alias("k")), bad[0], good[0])
    second = learn_lexicon(sums.select("term", F.col("nb").alias("n"), F.col("kb").alias("k")), bad[1], good[1])
    lexicon = learn_lexicon(sums.select("term", (F.col("na") + F.col("nb")).alias("n"), (F.col("ka") + F.col("kb")).alias("k")), sum(bad), sum(good))
    rest = featured(base.where("half"), second, "text").union(featured(base.where("not half"), first, "text"))
    dense = stored(
        rest.select(F.col("label").cast("double").alias("label"), "__dense", (unit("fit") < 0.7).alias("fit")).coalesce(4), "toxicity-features"
    )
    fit = dense.where("fit").select("label", array_to_vector("__dense").alias("__features"))
    counted = {(r.label, r.fit): r.n for r in dense.groupBy("label", "fit").agg(F.count("*").alias("n")).collect()}
    rate = sum(bad) / max(1, sum(bad) + sum(good))
    if len(counted) < 4:
        return Scorer(lexicon, None, None, rate)
    boosting = GBTClassifier(
        featuresCol="__features", labelCol="label", predictionCol="__label", maxIter=16, maxDepth=3, stepSize=0.3, seed=1
    ).setRawPredictionCol("__raw").setProbabilityCol("__p")
    trees = boosting.fit(fit)
    apart = trees.transform(dense.where("not fit").select("label", array_to_vector("__dense").alias("__features")))
    margin = F.get(vector_to_array("__raw"), F.lit(1)).alias("__margin")
    calibration = IsotonicRegression(featuresCol="__margin", labelCol="label", predictionCol="__fitted").fit(apart.select(margin, "label"))
    return Scorer(lexicon, trees, calibration, rate)


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``score`` in 0 to 1 (an input column of this name is replaced).

    The calibrated value, with a thousandth of the trees' own probability so that equal steps keep their order.
    Null and empty texts have features too: all are zero.
    """
    kept = [c for c in docs.columns if c.lower() != "score"]
    if scorer.trees is None:
        return docs.select(*kept, F.lit(scorer.constant).alias("score"))
    dense = featured(docs.select(*kept), scorer.lexicon, text_col).withColumn("__features", array_to_vector("__dense")).drop("__dense")
    raw = scorer.trees.transform(dense).withColumn("__margin", F.get(vector_to_array("__raw"), F.lit(1)))
    fitted = scorer.calibration.transform(raw)
    own = F.get(vector_to_array("__p"), F.lit(1))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.999 * F.col("__fitted") + 0.001 * own))
    return fitted.select(*kept, value.alias("score"))
