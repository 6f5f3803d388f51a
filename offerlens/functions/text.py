"""String and array helpers as Column expressions (no Python on the rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Every character that counts as whitespace at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Whitespace as a Unicode-aware class; Java's plain \s is ASCII only.
_WS = r"(?U)[\s\x1c-\x1f]+"


def drop_format_chars(c: Column) -> Column:
    """Remove invisible format characters (Unicode category Cf)."""
    return F.regexp_replace(c, r"\p{Cf}", "")


def collapse_ws(c: Column) -> Column:
    """Every whitespace run becomes one blank; no blanks at either end."""
    return F.trim(F.regexp_replace(c, _WS, " "))


def strip_u(c: Column) -> Column:
    """Strip Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def nonempty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_nonempty(*cols: Column) -> Column:
    """First value that is neither null nor empty (null if there is none)."""
    return F.coalesce(*[nonempty(c) for c in cols])


def present(c: Column) -> Column:
    """True iff the string is neither null nor empty; never null."""
    return F.coalesce(c != "", F.lit(False))


def first_of(arr: Column) -> Column:
    """First array element, null for an empty or null array."""
    return F.get(arr, F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, where it would else be repeated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def search(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null where the pattern does not occur."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def search_text(c: Column, pattern: str, group: int = 1) -> Column:
    """:func:`search` for a group that takes part in every match and is never empty: the text is gone through once."""
    found = F.array(F.regexp_extract(c, pattern, group))
    return F.get(F.array_remove(found, F.lit("")), F.lit(0))


def find_all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def ordered_unique(arr: Column) -> Column:
    """Distinct elements in order of first appearance, nulls and empties dropped."""
    return F.array_distinct(F.filter(arr, lambda x: x.isNotNull() & (x != "")))


def title_case(c: Column) -> Column:
    """Capital at the start of every run of letters, all other letters small.

    ``initcap`` looks at blanks only, so ``usb3cable`` would lose its second capital.
    """
    runs = find_all(c, r"(\p{L}+|\P{L}+)")
    return F.array_join(
        F.transform(
            runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))
        ),
        "",
    )


def round_tenths(c: Column) -> Column:
    """Round the exact binary value to one decimal, ties to even.

    ``round`` and ``bround`` go through the shortest decimal text of the double and differ on
    values such as 8.35; ``format_number`` rounds the exact value.
    """
    return F.regexp_replace(F.format_number(c, 1), ",", "").cast("double")


def spec_value(specs: Column, key: str) -> Column:
    """Value of one key in ``array<struct<key,value>>``, null if absent."""
    return F.get(F.filter(specs, lambda s: s["key"] == key), F.lit(0))["value"]


def first_spec(specs: Column, keys: list[str]) -> Column:
    """First non-empty value over several spellings of a key, in order."""
    return first_nonempty(*[spec_value(specs, k) for k in keys])


def specs_first_wins(specs: Column) -> Column:
    """Keep the first entry of every key."""
    return F.aggregate(
        specs,
        F.filter(specs, lambda s: F.lit(False)),
        lambda acc, s: F.when(F.exists(acc, lambda a: a["key"] == s["key"]), acc).otherwise(
            F.concat(acc, F.array(s))
        ),
    )


def specs_last_wins(specs: Column) -> Column:
    """A later value replaces an earlier one; the key keeps its first place."""

    def chosen(back: Column, keys: Column) -> Column:
        # The last entry of a key is its first one from behind; no lambda runs over all entries for each key.
        value = lambda k: F.get(back, F.array_position(keys, k).cast("int") - 1)["value"]
        return F.transform(F.array_distinct(F.reverse(keys)), lambda k: F.struct(k.alias("key"), value(k).alias("value")))

    return let(F.reverse(specs), lambda back: let(F.transform(back, lambda s: s["key"]), lambda keys: chosen(back, keys)))


def split_terms(c: Column) -> Column:
    """Comma list -> stripped, non-empty, ordered-unique terms."""
    return ordered_unique(F.transform(F.split(c, ","), strip_u))
