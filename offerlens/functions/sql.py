"""Prices and identifiers as functions of SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from offerlens.functions.identity import ASIN_PLACES
from offerlens.functions.text import BLANKS

_STRIPPED = "btrim(c, '" + "".join(f"\\u{ord(b):04x}" for b in BLANKS) + "')"
_SHOWN = r"trim(regexp_replace(regexp_replace(c, r'\p{Cf}', ''), r'(?U)[\s\x1c-\x1f]+', ' '))"


def _replaced(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, r'{pattern}', '{by}')"


def _price() -> str:
    text = _replaced(_SHOWN, r"(\d+)\s+(\d+)", "$1$2")
    text = _replaced(text, r"(\d+),(\d{3})", "$1$2")
    text = _replaced(text, r"(?U)([0-9]+),([0-9]{2})\b", "$1.$2")
    numbers = rf"transform(regexp_extract_all({text}, r'(\d+(?:\.\d+)?)', 1), n -> try_cast(n as double))"
    return f"case when not contains(lower(c), 'unavailable') then array_max({numbers}) end"


def _asin() -> str:
    patterns = [r"(?i)\A([A-Z0-9]{10})\z", *[f"(?i){place}([A-Z0-9]{{10}})" for place in ASIN_PLACES]]
    found = [f"nullif(regexp_extract({_STRIPPED}, r'{p}', 1), '')" for p in patterns]
    return f"upper(coalesce({', '.join(found)}))"


#: Name -> (type, expression over the text ``c``); what they mean is said at the column functions of the same name.
FUNCTIONS = {
    "parse_price": ("double", _price()),
    "price_display": ("string", f"coalesce({_SHOWN}, '')"),
    "extract_asin": ("string", _asin()),
    "extract_plid": ("string", r"upper(nullif(regexp_extract(c, r'(?i)(PLID\d+)', 1), ''))"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Register ``parse_price``, ``price_display``, ``extract_asin`` and ``extract_plid`` for the session; their names.

    They are SQL expressions that the optimizer inlines, so no Python runs on the rows.
    """
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}(c string) returns {kind} return {body}")
    return list(FUNCTIONS)
