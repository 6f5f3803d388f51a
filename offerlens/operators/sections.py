"""Sections hidden in free text: ingredients, directions, safety warnings, bullets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from offerlens.functions.text import find_all, let, ordered_unique, present, search, strip_u
from offerlens.schema import NO_INGREDIENTS
from offerlens.sources.shop_fields import INGREDIENT_KEYS, LINE_KEYS

# A headed section ends before the next line that starts with a capitalised word.
_BODY = r"\s*\n+([^\n]+(?:\n+[^\n]+)*?)(?=\n+[A-Z][a-z]+|$)"
DIRECTIONS_SECTION = "Directions" + _BODY
SAFETY_SECTION = "Safety (?:Warning|Information)" + _BODY
DIRECTIONS_SENTENCES = r"(?i)Directions:?\s*([^.]+(?:\.[^.]+){0,2})"
SAFETY_SENTENCES = r"(?i)Safety (?:Warning|Information):?\s*([^.]+(?:\.[^.]+){0,2})"
USE_SENTENCES = r"(?i)(?:Suggested Use|Directions|How to use):?\s*([^.\n]+(?:\.[^.\n]+){0,2})"
CAUTION_SENTENCES = r"(?i)(?:Disclaimer|Safety Warning|Warnings?|Caution):?\s*([^.\n]+(?:\.[^.\n]+){0,3})"
INGREDIENT_SECTIONS = [
    "(?i)(?:Active\\s+)?Ingredients" + _BODY,
    r"(?i)Ingredients:?\s*([^\n]+)",
    r"(?i)Composition:?\s*([^\n]+)",
]
INGREDIENT_SENTENCES = r"(?i)(?:Active\s+)?Ingredients:?\s*([^.\n]+(?:\.[^.\n]+){0,2})"
LISTED_BENEFITS = r"(?:[-•*]|\b(?:Benefits?|Features?):\s*)([^\n•*-]+)"


def _found(c: Column, pattern: str) -> Column:
    return strip_u(search(c, pattern))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def directions(info: Column, description: Column) -> Column:
    """Directions from the information section, else up to three sentences of the description."""
    fallback = F.when(description.contains("Directions"), _found(description, DIRECTIONS_SENTENCES))
    return _text(F.coalesce(F.nullif(_found(info, DIRECTIONS_SECTION), F.lit("")), fallback))


def safety_warning(info: Column, description: Column) -> Column:
    fallback = F.when(description.contains("Safety"), _found(description, SAFETY_SENTENCES))
    return _text(F.coalesce(F.nullif(_found(info, SAFETY_SECTION), F.lit("")), fallback))


def suggested_use(description: Column) -> Column:
    """Up to three sentences after a usage heading in a description."""
    named = description.contains("Suggested Use") | description.contains("Directions")
    return _text(F.when(named, _found(description, USE_SENTENCES)))


def disclaimer(description: Column) -> Column:
    """Up to four sentences after a warning heading in a description."""
    named = (
        description.contains("Disclaimer") | description.contains("Warning") | description.contains("Caution")
    )
    return _text(F.when(named, _found(description, CAUTION_SENTENCES)))


def listed_benefits(description: Column) -> Column:
    """Bullets written inside running text: of the first eight, those of a sensible length."""
    items = F.transform(F.slice(find_all(description, LISTED_BENEFITS), 1, 8), strip_u)
    return F.filter(items, lambda b: (F.length(b) > 5) & (F.length(b) < 200))


def ingredients(info: Column, description: Column, bullets: Column, specs: Column) -> Column:
    """All ingredient statements of a listing joined by `` | ``, or the fixed 'not specified' text."""
    keys = "|".join(INGREDIENT_KEYS)
    named = F.filter(specs, lambda s: s["key"].rlike(rf"\A(?:{keys})\z") & (F.length(s["value"]) > 2))
    by_key = lambda found: F.flatten(
        F.array(
            *[
                F.transform(
                    F.slice(F.filter(found, lambda s: s["key"] == k), 1, 1),
                    lambda s: F.concat_ws(": ", s["key"], s["value"]),
                )
                for k in INGREDIENT_KEYS
            ]
        )
    )
    from_specs = let(named, lambda found: F.when(F.size(found) > 0, by_key(found)))
    from_info = [_found(info, p) for p in INGREDIENT_SECTIONS]
    from_info = [F.when(F.length(x) > 3, x) for x in from_info]
    stated = F.filter(F.array(*from_info), lambda x: x.isNotNull())
    sure = F.concat(F.coalesce(from_specs, F.array().cast("array<string>")), stated)
    text = F.concat_ws(" ", description, F.array_join(bullets, " "))
    mentioned = F.filter(
        F.transform(find_all(text, INGREDIENT_SENTENCES), strip_u), lambda m: F.length(m) > 5
    )
    every = F.aggregate(
        mentioned,
        sure,
        lambda found, m: F.when(F.exists(found, lambda f: f.contains(m)), found).otherwise(
            F.concat(found, F.array(m))
        ),
    )
    unique = ordered_unique(F.transform(every, strip_u))
    return F.when(F.size(unique) > 0, F.array_join(unique, " | ")).otherwise(F.lit(NO_INGREDIENTS))


_ENTRY = "array<struct<key:string,value:string,paired:boolean>>"


def line_attributes(block: Column) -> Column:
    """Attributes of a text block, line by line, as ``array<struct<key,value,paired>>``.

    A known attribute name takes the next line as its value (``paired``), unless that is another known
    name or too long; other lines count if they read ``name: value``.
    """
    lines = F.filter(F.transform(F.split(block, "\n"), strip_u), lambda l: l != "")
    known = lambda l: l.rlike(r"\A(?:" + "|".join(LINE_KEYS) + r")\z")
    none = F.lit(None).cast("string")

    def entry(key: Column, value: Column, paired: bool) -> Column:
        return F.array(F.struct(key.alias("key"), value.alias("value"), F.lit(paired).alias("paired")))

    def step(state: Column, line: Column) -> Column:
        pending, found = state["pending"], state["found"]
        closes = pending.isNotNull() & ~known(line) & (F.length(line) < 400)
        name = strip_u(F.substring_index(line, ":", 1))
        value = strip_u(F.substring(line, F.instr(line, ":") + 1, F.length(line)))
        inline = (
            line.contains(":") & (F.length(line) < 150) & (name != "") & (value != "") & (F.length(name) < 40)
        )
        added = (
            F.when(closes, F.concat(found, entry(pending, line, True)))
            .when(~known(line) & inline, F.concat(found, entry(name, value, False)))
            .otherwise(found)
        )
        waiting = F.when(~closes & known(line), line).otherwise(none)
        return F.struct(waiting.alias("pending"), added.alias("found"))

    start = F.struct(none.alias("pending"), F.array().cast(_ENTRY).alias("found"))
    return F.when(present(block), F.aggregate(lines, start, step, lambda s: s["found"])).otherwise(
        F.array().cast(_ENTRY)
    )
