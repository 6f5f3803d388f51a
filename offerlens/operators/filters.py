"""Row predicates on pages and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerlens.functions.text import present, strip_u
from offerlens.schema import PRICE_UNAVAILABLE

# Texts that mark a bot-check page.
BLOCK_MARKS = [
    "Robot Check",
    "api-services-support@amazon.com",
    "Type the characters you see in this image",
]


def valid_amazon(title: Column, price: Column, specs: Column, bullets: Column, image: Column) -> Column:
    """A real listing: named, and with at least a price, a spec, a bullet or a picture."""
    name = strip_u(F.coalesce(title, F.lit("")))
    named = (name != "") & ~(name.startswith("Amazon Product (") & name.endswith(")"))
    priced = present(price) & (price != PRICE_UNAVAILABLE)
    described = (F.coalesce(F.size(specs), F.lit(0)) > 0) | (F.coalesce(F.size(bullets), F.lit(0)) > 0)
    return named & (priced | described | present(image))


def valid_takealot(title: Column, price: Column) -> Column:
    shown = strip_u(F.coalesce(price, F.lit("")))
    return (strip_u(F.coalesce(title, F.lit(""))) != "") & (shown != "") & (shown != PRICE_UNAVAILABLE)


def in_price_range(price: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Inclusive bounds; an unknown price fails only where a bound is set. Bounds may be columns."""
    ok = F.lit(True)
    for bound, inside in ((low, lambda b: price >= b), (high, lambda b: price <= b)):
        if bound is None:
            continue
        b = bound if isinstance(bound, Column) else F.lit(float(bound))
        ok = ok & (b.isNull() | F.coalesce(inside(b), F.lit(False)))
    return ok


# Words of 64 bits that are sent to every task at most; with more keys, fewer of the other rows are left out.
MOST_WORDS = 1 << 21


def likely_among(df: DataFrame, wanted: DataFrame, keys: list[str], most_words: int = MOST_WORDS) -> DataFrame:
    """The rows whose ``keys`` stand in ``wanted``, and some others, for a join that decides.

    Each wanted key sets one bit of sixteen per key, and rows at unset bits are left out where they are read, so that few of them
    are shuffled. The bits take at most ``most_words`` words, however many keys there are. ``wanted`` is read twice: store it first.
    """
    n_words = min(max(wanted.count() // 4, 1024), most_words)
    place = F.pmod(F.xxhash64(*keys), F.lit(64 * n_words))
    word = F.call_function("div", place, F.lit(64))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))
    none = df.sparkSession.range(n_words).select("id", F.lit(0).cast("bigint"))
    bits = wanted.select(word.alias("_word"), bit.alias("_bit")).union(none).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_word", "_bits"))), lambda w: w["_bits"])
    # A filter, as the planner moves it to where the rows are read, before other columns are made and rows are shuffled.
    return df.where(F.get(bits.agg(listed.alias("words")).scalar(), word.cast("int")).bitwiseAND(bit) != 0)


def block_reason(html: Column) -> Column:
    """Why a snapshot cannot be read: 'empty', 'blocked' or null."""
    marked = F.lit(False)
    for mark in BLOCK_MARKS:
        marked = marked | html.contains(mark)
    return F.when(~present(html), F.lit("empty")).when(marked, F.lit("blocked"))
