"""URL filter: allow and block rules first, then logistic regression on hashed character n-grams of host and path.

All steps are DataFrame operations and Spark's own learning stages; the model is fitted on a small labelled table.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerlens.llm.common import ascii_lower

FEATURES = 1 << 18  # so many that n-grams of unknown hosts seldom share a weight with known ones
ORDERS = (3, 4, 5)
MAX_RULES = 1000


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


# A small labelled table, one topic on each line.
BLOCK_WORDS = (
    "casino-win free-bets jackpot-slots poker-bonus lottery-prize "
    "cheap-pills viagra-online diet-pills pharma-discount "
    "adult-x xxx-video sex-cams porn-tube hot-escorts "
    "spam-farm link-farm click-bait mass-mailer seo-links "
    "ads-track ad-server banner-ads pixel-track track-click popup-ads "
    "malware-kit phish-login crack-serial warez-download keygen-free "
    "payday-loans quick-cash get-rich crypto-double fake-watches"
).split()
ALLOW_WORDS = (
    "news-daily city-times weather-report sports-results "
    "public-library national-archive museum-art open-books "
    "university science-journal math-lectures history-notes "
    "python-docs linux-kernel code-review data-tools "
    "garden-care cooking-recipes travel-guide mountain-hikes "
    "health-service family-doctor school-board town-council "
    "music-school film-festival theatre photo-album "
    "train-times bike-shop furniture kitchen-store language-course "
    "north earth thread method author brother theory rhythm strength another nothing thinking tradition nation heather "
    "station thirteen hand handle sand ring string river water letter stone even river-boat island england ireland"
).split()
SITES = ("example.com", "example.net", "example.org")
PATHS = ("/en/12", "/de/345.html", "/fr/67/", "/es/890", "/en/4/", "/")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``(url, label)``: the words above as host names with usual prefixes and paths; 1 is block."""
    rows = []
    for label, names in ((1.0, BLOCK_WORDS), (0.0, ALLOW_WORDS)):
        for i, name in enumerate(names):
            for j, prefix in enumerate(("", "www.", "blog.", "m.")):
                rows.append((f"https://{prefix}{name}.{SITES[(i + j) % 3]}{PATHS[(i + j) % 6]}", label))
    return spark.createDataFrame(rows, "url string, label double")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of the host between marks and of the path, told apart by their first character; digits are alike."""

    def of(text: Column, mark: str, n: int) -> Column:
        at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    plain = lambda c: F.translate(c, "123456789", "000000000")
    marked = F.concat(F.lit("."), plain(host), F.lit("."))
    return F.concat(*[of(marked, "h", n) for n in ORDERS], *[of(plain(path), "p", n) for n in ORDERS])


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (host and path together) that fits, as ``struct<rule, verdict>``; null if none does.

    Of rules that are equally long, the one with the longer host wins, then the first in string order.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; apply them in parts")
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.host + r.path))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in reversed(ordered):
        name = rule.host.lower()
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def featured(df: DataFrame, host: Column, path: Column) -> DataFrame:
    hashing = HashingTF(inputCol="__ngrams", outputCol="__features", numFeatures=FEATURES, binary=True)
    return hashing.transform(df.withColumn("__ngrams", ngrams(host, path)))


def train(labelled: DataFrame):
    """Fit on ``(url, label)``; None where not both labels occur. Rows with a null label are left out."""
    rows = labelled.where("label is not null").select("url", "label").coalesce(1)
    if rows.select("label").distinct().count() < 2:
        return None
    host, path = split_url(F.col("url"))
    return LogisticRegression(
        featuresCol="__features", labelCol="label", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__label",
        regParam=0.002, maxIter=60,
    ).fit(featured(rows.select("label", host.alias("host"), path.alias("path")), F.col("host"), F.col("path")))


def judge(
    pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame, threshold: float = 0.5, url_col: str = "url", id_col: str = "page_id"
) -> DataFrame:
    """One row for each row of ``pages``: id, ``host``, ``path``, ``rule``, ``verdict``, ``score`` (of block).

    The longest fitting rule decides, else the score. Without a model the score is 0. Null and malformed urls have
    empty parts, fit rules for none and are scored like any other. Other columns are ignored.
    """
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    model = train(labelled)
    if model is None:
        scored = parts.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(featured(parts, F.col("host"), F.col("path"))).withColumn("score", F.get(vector_to_array("__p"), F.lit(1)))
    found = scored.withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("__rule.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return found.select(id_col, "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "score")
