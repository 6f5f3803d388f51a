"""Price, currency, discount, rating and review-count normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from offerlens.functions.text import collapse_ws, drop_format_chars, find_all, present, search_text

# Currency symbol by a fragment of the page URL, tested in this order.
CURRENCY_BY_URL = [
    (".co.uk", "£"),
    (".de", "€"),
    (".fr", "€"),
    (".es", "€"),
    (".it", "€"),
    (".ca", "CA$"),
    (".com.au", "A$"),
]


def price_display(c: Column) -> Column:
    """Readable price text: no invisible characters, single blanks; null becomes ''."""
    return F.coalesce(collapse_ws(drop_format_chars(c)), F.lit(""))


def parse_price(c: Column, multi_group: bool = False) -> Column:
    """Highest number in a price text, as double; null if there is none.

    Separators are handled in one left-to-right sweep each: blanks between digits and commas
    before three digits join, a comma before two final digits is a decimal point. One sweep joins
    one thousands group only, so ``R1 299 999`` gives 1299; ``multi_group=True`` joins all groups.
    """
    text = collapse_ws(drop_format_chars(c))
    if multi_group:
        text = F.regexp_replace(text, r"(?<=\d)\s+(?=\d)", "")
        text = F.regexp_replace(text, r"(?<=\d),(?=\d{3})", "")
    else:
        text = F.regexp_replace(text, r"(\d+)\s+(\d+)", "$1$2")
        text = F.regexp_replace(text, r"(\d+),(\d{3})", "$1$2")
    text = F.regexp_replace(text, r"(?U)([0-9]+),([0-9]{2})\b", "$1.$2")
    numbers = F.transform(find_all(text, r"(\d+(?:\.\d+)?)"), lambda n: n.try_cast("double"))
    return F.when(~c.rlike("(?i)unavailable"), F.array_max(numbers))


def parse_price_loose(c: Column) -> Column:
    """Digits and dots only, read as one number; 0.0 for anything unreadable."""
    return F.coalesce(F.regexp_replace(c, r"[^\d.]", "").try_cast("double"), F.lit(0.0))


def detect_currency(url: Column, html: Column | None = None) -> Column:
    """Currency symbol from the URL, or from rand marks in the page."""
    rand = url.contains(".co.za")
    if html is not None:
        text = F.coalesce(html, F.lit(""))
        rand = rand | text.contains("R ") | text.contains("ZAR")
    out = F.when(rand, F.lit("R"))
    for fragment, symbol in CURRENCY_BY_URL:
        out = out.when(url.contains(fragment), F.lit(symbol))
    return out.otherwise(F.lit("$"))


def currency_code(url: Column, symbol: Column) -> Column:
    return (
        F.when(url.contains(".co.za") | symbol.contains("R"), F.lit("ZAR"))
        .when(symbol.contains("$"), F.lit("USD"))
        .otherwise(symbol)
    )


def discount_percentage(price: Column, original: Column) -> Column:
    """Whole percent off, ties to even; null unless both are non-zero and the price went down."""
    ok = (price != 0) & (original != 0) & (original > price)
    return F.when(ok, F.rint((original - price) / original * 100).cast("int"))


def rating_numeric(c: Column) -> Column:
    return F.regexp_replace(search_text(c, r"(\d+(?:[.,]\d+)?)"), ",", ".").try_cast("double")


def review_count_numeric(c: Column) -> Column:
    """All digits of the text read as one integer, 0 if there are none."""
    return F.coalesce(F.regexp_replace(c, r"[^\d]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def rand_prefix(c: Column) -> Column:
    """Put ``R`` before a price that lacks it; texts without any digit stay as they are."""
    needs = present(c) & ~c.startswith("R") & c.rlike(r"\d")
    return F.when(needs, F.concat(F.lit("R "), c)).otherwise(c)


def split_price(symbol: Column, whole: Column, fraction: Column) -> Column:
    """Assemble a price shown as separate whole and fraction parts; null without a whole part."""
    base = F.concat(symbol, F.regexp_replace(price_display(whole), r"\.+\z", ""))
    return F.when(
        whole.isNotNull(),
        F.when(fraction.isNotNull(), F.concat(base, F.lit("."), price_display(fraction))).otherwise(base),
    )
