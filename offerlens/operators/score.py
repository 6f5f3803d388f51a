"""Comparison scoring of products inside comparison sets.

Products carry ``comparison_id`` (the set), ``idx`` (their order in it), ``user_context`` and the
product columns. Facts about a set are partial aggregates joined back per block of the set, never windows over
its rows, so one set may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerlens.functions.price import parse_price, parse_price_loose
from offerlens.functions.text import let, round_tenths, search
from offerlens.operators.ranking import rank_in_blocks, spread, with_group_facts
from offerlens.storage import stored

# Input positions per block: how much of one set may meet in one task.
BLOCK = 1 << 16

# Constants of the scoring rules.
DEFAULT_LOW, DEFAULT_HIGH = 100.0, 1000.0
DEFAULT_RATING = 4.5
DEFAULT_VALUE = 8.5
DEFAULT_TITLE, DEFAULT_PRICE, DEFAULT_ID = "Product", "$0.00", "PROD_"
NO_PRODUCTS = "No products provided for comparison."
STOCK_PRO = "Solid feature baseline with positive market feedback"
STOCK_CON = "Slightly higher weight/footprint depending on your portability needs"


def price_extremes(products: DataFrame, price: str = "price_val") -> DataFrame:
    """Lowest and highest positive price per set; 100 and 1000 where there is none."""
    positive = F.when(F.col(price) > 0, F.col(price))
    return products.groupBy("comparison_id").agg(
        F.coalesce(F.min(positive), F.lit(DEFAULT_LOW)).alias("min_price"),
        F.coalesce(F.max(positive), F.lit(DEFAULT_HIGH)).alias("max_price"),
    )


def rating_value(rating: Column) -> Column:
    """First run of digits and dots; 4.5 where the text has none or it is no number."""
    return F.coalesce(search(rating, r"([\d.]+)").try_cast("double"), F.lit(DEFAULT_RATING))


def specs_score(count: Column) -> Column:
    return F.least(F.lit(9.5), F.greatest(F.lit(6.0), F.lit(7.0) + count * F.lit(0.3)))


def value_score(price: Column, low: Column, high: Column) -> Column:
    ratio = (price - low) / (high - low)
    return F.when(high > low, round_tenths(F.lit(9.5) - ratio * F.lit(3.5))).otherwise(F.lit(DEFAULT_VALUE))


def context_bonus(context: Column, specs: Column, bullets: Column) -> Column:
    """0.4 for every context word of four letters or more found in specs or bullets, at most 1.2.

    Words are counted as often as they are given. Only ASCII words can match, as the searched text is
    the escaped JSON form of the product.
    """
    terms = F.filter(
        F.split(F.lower(context), r"(?U)[\s\x1c-\x1f]+"),
        lambda t: (F.length(t) > 3) & t.rlike(r"\A[\x00-\x7f]+\z"),
    )
    hits = let(
        F.lower(searchable_text(specs, bullets)),
        lambda text: F.size(F.filter(terms, lambda t: text.contains(t))),
    )
    bonus = F.least(F.lit(1.2), F.greatest(hits, F.lit(0)) * F.lit(0.4))
    return F.when(F.coalesce(context != "", F.lit(False)), F.coalesce(bonus, F.lit(0.0))).otherwise(F.lit(0.0))


def searchable_text(specs: Column, bullets: Column) -> Column:
    """Specs as a JSON object followed by bullets as a JSON array, escaped in one go.

    A control character stands for the quotes around each text until the quotes inside are escaped.
    """
    mark = "\x01"
    pairs = F.transform(
        specs, lambda s: F.concat(F.lit(mark), s["key"], F.lit(f"{mark}: {mark}"), s["value"], F.lit(mark))
    )
    items = F.transform(bullets, lambda b: F.concat(F.lit(mark), b, F.lit(mark)))
    raw = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}["), F.array_join(items, ", "), F.lit("]"))
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        raw = F.replace(raw, F.lit(plain), F.lit(escaped))
    return F.replace(raw, F.lit(mark), F.lit('"'))


def pros() -> Column:
    """Up to three advantages, in fixed order."""
    bullets = F.transform(
        F.slice("bullet_points", 1, 2),
        lambda b: F.when(F.length(b) > 90, F.concat(F.substring(b, 1, 90), F.lit("..."))).otherwise(b),
    )
    price, low = F.col("price_val"), F.col("min_price")
    facts = F.filter(
        F.array(
            F.when(
                (price == low) & (low > 0),
                F.concat(F.lit("Lowest price in comparison matrix ("), F.col("price"), F.lit(")")),
            ),
            F.when(
                F.col("rating_val") >= 4.7,
                F.concat(
                    F.lit("Outstanding user satisfaction rating ("), F.col("rating_val").cast("string"), F.lit("/5.0)")
                ),
            ),
            F.when(
                F.size("specs") >= 5,
                F.concat(
                    F.lit("Comprehensive technical specs dataset ("),
                    F.size("specs").cast("string"),
                    F.lit(" attributes verified)"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    found = F.concat(facts, bullets)
    padded = F.when(F.size(found) < 2, F.concat(found, F.array(F.lit(STOCK_PRO)))).otherwise(found)
    return F.slice(padded, 1, 3)


def cons() -> Column:
    """The highest price, or a stock line."""
    price, high = F.col("price_val"), F.col("max_price")
    return F.array(
        F.when(
            (price == high) & (high > F.col("min_price")),
            F.concat(F.lit("Highest cost item in selected dataset ("), F.col("price"), F.lit(")")),
        ).otherwise(F.lit(STOCK_CON))
    )


def with_defaults(products: DataFrame) -> DataFrame:
    """What a product lacks (null) gets the scorer's defaults."""
    specs, bullets = products.schema["specs"].dataType, products.schema["bullet_points"].dataType
    return products.withColumns(
        {
            "specs": F.coalesce("specs", F.array().cast(specs)),
            "bullet_points": F.coalesce("bullet_points", F.array().cast(bullets)),
            "title": F.coalesce("title", F.lit(DEFAULT_TITLE)),
            "price": F.coalesce("price", F.lit(DEFAULT_PRICE)),
            "product_id": F.coalesce("product_id", F.concat(F.lit(DEFAULT_ID), F.coalesce(F.col("idx"), F.lit(0)).cast("string"))),
        }
    )


def score(products: DataFrame, price_source: str = "loose", exclude_unpriced: bool = False) -> DataFrame:
    """Add every score of a product, its pros and its cons.

    Null specs and bullets are empty; null titles, prices and identifiers get defaults.

    ``price_source='strict'`` reads prices as the filters do instead of the scorer's own way.
    ``exclude_unpriced`` leaves out products without a positive price.
    """
    strict = F.coalesce(parse_price(F.col("price")), F.lit(0.0))
    df = with_defaults(products).withColumns(
        {
            "price_val": strict if price_source == "strict" else parse_price_loose(F.col("price")),
            "rating_val": rating_value(F.col("rating")),
        }
    )
    if exclude_unpriced:
        df = df.where("price_val > 0")
    # What a product has by itself comes before the join with its set's prices, so that texts nobody asks for aren't shuffled.
    df = df.withColumns(
        {
            "specs_score": specs_score(F.size("specs")),
            "performance_score": round_tenths(F.least(F.lit(10.0), F.col("rating_val") * 2.0)),
            "context_bonus": context_bonus(F.col("user_context"), F.col("specs"), F.col("bullet_points")),
        }
    )
    df = df.withColumn(
        "build_score", round_tenths(F.least(F.lit(10.0), F.col("performance_score") * 0.95 + 0.5))
    )
    positive = F.when(F.col("price_val") > 0, F.col("price_val"))
    df = with_group_facts(
        df,
        ["comparison_id"],
        F.pmod(F.xxhash64("idx", "product_id"), F.lit(spread(df))),
        {
            "min_price": (F.min(positive), F.min("min_price")),
            "max_price": (F.max(positive), F.max("max_price")),
        },
    )
    df = df.withColumns(
        {
            "min_price": F.coalesce("min_price", F.lit(DEFAULT_LOW)),
            "max_price": F.coalesce("max_price", F.lit(DEFAULT_HIGH)),
        }
    )
    df = df.withColumn("value_score", value_score(F.col("price_val"), F.col("min_price"), F.col("max_price")))
    weighted = (
        F.col("performance_score") * 0.35
        + F.col("value_score") * 0.25
        + F.col("specs_score") * 0.25
        + F.col("build_score") * 0.15
    )
    overall = round_tenths(F.least(F.lit(9.9), weighted + F.col("context_bonus")))
    return df.withColumns({"overall_score": overall, "pros": pros(), "cons": cons()})


def rank_scored(scored: DataFrame, block: int = BLOCK) -> DataFrame:
    """Position of every product in its set: best score first, ties in input order.

    Scores are whole tenths, so a set falls into blocks of one score and a stretch of input positions. The scored
    rows are stored first, as blocks are sized and numbered from them; columns that nobody asks for should be dropped before.
    """
    scored = stored(scored, "scored")
    tenths = F.coalesce(F.rint(F.col("overall_score") * -10).cast("int"), F.lit(0))
    blocks = [tenths, F.coalesce(F.floor(F.col("idx") / block), F.lit(0))]
    return rank_in_blocks(scored, ["comparison_id"], blocks, [F.col("idx")], "position")


def verdicts(scored: DataFrame) -> DataFrame:
    """Winner, best value and both texts per set, as one partial aggregate."""
    chosen = ["product_id", "title", "price", "overall_score", "value_score"]
    best = F.min(F.struct((-F.col("overall_score")).alias("o"), "idx", *chosen))
    value = F.min(
        F.struct((-F.col("value_score")).alias("v"), (-F.col("overall_score")).alias("o"), "idx", *chosen)
    )
    df = scored.groupBy("comparison_id").agg(
        best.alias("w"), value.alias("b"), F.first("user_context").alias("user_context")
    )
    return df.select(
        "comparison_id",
        F.col("w.product_id").alias("winner_id"),
        F.col("w.title").alias("winner_title"),
        F.col("w.overall_score").alias("winner_score"),
        F.col("b.product_id").alias("best_value_id"),
        F.col("b.title").alias("best_value_title"),
        F.col("b.value_score").alias("best_value_score"),
        recommendation(F.col("w.title"), F.col("w.overall_score"), F.col("user_context")).alias(
            "recommendation_reason"
        ),
        summary(F.col("b.title"), F.col("b.price"), F.col("w.title")).alias("verdict_summary"),
    )


def recommendation(title: Column, overall: Column, context: Column) -> Column:
    """Long verdict text (fixed wording)."""
    notice = F.when(
        F.coalesce(context != "", F.lit(False)),
        F.concat(F.lit(" tailored to your preference '"), context, F.lit("'")),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("Based on comprehensive spec analysis, pricing efficiency, and feature density, **"),
        title,
        F.lit("** emerges as the top recommendation"),
        notice,
        F.lit(".\n\nKey Deciding Factors:\n1. **Overall Performance Score:** "),
        overall.cast("string"),
        F.lit(
            "/10 across verified technical benchmarks.\n"
            "2. **Spec Density:** Delivers high value with strong component features relative to price.\n"
            "3. **User Satisfaction:** Holds top customer feedback scores."
        ),
    )


def summary(value_title: Column, value_price: Column, winner_title: Column) -> Column:
    """Short verdict text (fixed wording)."""
    return F.concat(
        F.lit("If budget is your top priority, go with **"),
        value_title,
        F.lit("** ("),
        value_price,
        F.lit("). If maximum performance and spec completeness are required, **"),
        winner_title,
        F.lit("** is the clear winner."),
    )


def with_empty_sets(verdict: DataFrame, requested: DataFrame) -> DataFrame:
    """Every requested set, those without products with the fixed message and no winner."""
    found = verdict.withColumn("_found", F.lit(True))
    out = requested.select("comparison_id").distinct().join(found, "comparison_id", "left")
    text = F.when(F.col("_found"), F.col("verdict_summary")).otherwise(F.lit(NO_PRODUCTS))
    return out.withColumn("verdict_summary", text).drop("_found")
