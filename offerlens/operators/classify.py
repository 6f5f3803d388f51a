"""Listing classification: package type, quantity and integrity alerts as a column cascade."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from offerlens.functions.text import first_spec, spec_value, strip_u

# Title wordings by kind, matched on the lower-cased title as whole words.
STARTER_KIT = [
    "starter kit", "starter pack", "starter set",
    "complete kit", "full kit", "combo kit",
    "primary unit with", r"unit \+ refill", "device with refill",
    r"machine \+ ", "with charger and battery", "with 2 batteries",
    "lens kit", r"with [0-9\-]+mm lens", "bundle with",
]
BARE_UNIT = [
    "bare tool", "tool only", "tool-only",
    "body only", "body-only",
    "without battery", "no battery", "battery not included",
    "no charger", "charger not included",
    "without lens", "no lens", "lens not included",
]
ACCESSORY = [
    r"(?:case|cover|sleeve|housing|pouch|skin)\s+(?:for|compatible with)",
    r"(?:stand|mount|bracket|dock|holder|tripod|strap|band)\s+(?:for|compatible with)",
    "screen protector", "protective (?:case|cover|glass)",
]
REFILL = [
    "refills?", "replacement", "cartridges?",
    "toner", "ink cartridge", "brush heads?",
    "razor blades?", "mats?", "pads?",
    "filter pack", "water filters?", "coffee pods?",
    "capsules?", "tablets?", "pods?", "tape roll",
]
MULTI_PACK = [r"(?:twin|2|3|4|5|6|12)\s*pack"]
CONSUMABLE = [r"\d+\s*ml", r"\d+\s*g", "liquid", "oil", "bottles?", "capsules?", "tablets?"]

# Short texts of which each match of a kind's wordings holds one; patterns are tried on texts with one of them only.
STARTER_STEMS = ["starter", "kit", "with", "+ "]
BARE_STEMS = ["bare tool", "only", "without", "no ", "not included"]
ACCESSORY_STEMS = ["for", "compatible with", "screen protector", "protective "]
REFILL_STEMS = [
    "refill", "replacement", "cartridge", "toner", "brush head", "razor blade", "mat", "pad", "filter", "pod", "capsule",
    "tablet", "tape roll",
]
MULTI_PACK_STEMS = ["pack"]
EXISTING_STEMS = ["existing"]

# Parts of a title that name a powered device (no word boundaries).
APPLIANCE_PARTS = [
    "laptop", "tv", "monitor", "speaker", "phone", "tablet", "console", "printer",
    "blender", "kettle", "toaster", "vacuum", "drill", "saw", "grinder",
    "lamp", "zapper", "trap", "swatter", "inverter", "power station", "generator",
    "camera", "diffuser unit", "primary unit",
]

# Wordings of the description.
EXISTING_UNIT = (
    r"(?U)existing\s+(?:unit|device|machine|appliance|heater|plug|diffuser|printer|shaver|toothbrush|dispenser)"
)
HOST_DEVICE = ["oled", "display", "processor", "ram", "storage", "battery life", "mah", "camera"]
CLAIMS = [
    ("plugs into outlet", ["plugs into (?:standard )?outlet"]),
    ("automatic shut-off", ["automatic shut-off"]),
    ("electronic display/LED", ["led indicator", "digital display", "lcd screen"]),
    ("battery/charging", ["rechargeable battery", "built-in battery", "usb-c charging"]),
    ("motor/wattage", ["variable speed", "motor speed", "watts? power"]),
]

# Spellings of the specification keys that are looked at, and the quantity in a title.
COUNT_KEYS = ["Unit count", "Unit Count", "Number of items", "Number of Items"]
VOLUME_KEYS = ["Item volume", "Item Volume", "Units"]
FORM_KEY = "Item form"
TITLE_QUANTITY = r"(?iU)(\d+)\s*(?:x\s*(\d+(?:\.\d+)?\s*(?:ml|g|count|liters?)))"

# Package types with (device included, refill only, needs a base device).
STARTER = "Starter Kit / Complete Bundle"
BARE = "Bare Tool / Body Only (No Battery/Lens)"
ACCESSORY_TYPE = "Accessory / Case / Mount"
REFILL_TYPE = "Refill / Replacement Consumable"
APPLIANCE = "Standalone Device / Appliance"
STANDARD = "Standard Product"
TYPE_FLAGS = {
    STARTER: (True, False, False),
    BARE: (True, False, False),
    ACCESSORY_TYPE: (False, False, True),
    REFILL_TYPE: (False, True, True),
    APPLIANCE: (True, False, False),
    STANDARD: (None, False, False),
}

# Alert texts.
BARE_ALERT = (
    "BARE_UNIT_WARNING: This product is sold as 'Bare Tool / Body Only'. Batteries, charger, or lenses "
    "are NOT included and must be purchased separately."
)
ACCESSORY_ALERT = (
    "ACCESSORY_ONLY_WARNING: This product is a protective case, mount, or accessory. The actual electronic "
    "device is NOT included."
)
MISMATCH_ALERT = [
    "VENDOR_DESCRIPTION_MISMATCH: The seller description contains machine/electrical features (",
    "), but this listing is a REFILL / REPLACEMENT ONLY (",
    "). The base device/machine is NOT included.",
]
REFILL_ALERT = (
    "REFILL_ONLY_NOTICE: Requires an existing host machine or unit. No base appliance is included."
)


def holds_any(text: Column, parts: list[str]) -> Column:
    """True iff one of the parts stands anywhere in the text."""
    return reduce(or_, [text.contains(part) for part in parts])


def words(text: Column, wordings: list[str], stems: list[str] | None = None) -> Column:
    """True iff one of the wordings stands in the text as whole words; every match holds one of ``stems``, if given."""
    found = text.rlike(r"(?U)\b(?:" + "|".join(wordings) + r")\b")
    return holds_any(text, stems) & found if stems else found


def title_text(title: Column) -> Column:
    return F.lower(strip_u(F.coalesce(title, F.lit(""))))


def description_text(description: Column, bullets: Column, rich: Column) -> Column:
    """Everything the seller wrote outside the title, in lower case."""
    return F.lower(
        F.concat_ws(
            " ",
            strip_u(F.coalesce(description, F.lit(""))),
            F.array_join(F.coalesce(bullets, F.array().cast("array<string>")), " "),
            F.coalesce(rich, F.lit("")),
        )
    )


def pack_quantity(title: Column, specs: Column) -> Column:
    stripped = strip_u(title)
    in_title = F.when(
        stripped.rlike(TITLE_QUANTITY),
        F.concat(
            F.regexp_extract(stripped, TITLE_QUANTITY, 1),
            F.lit(" x "),
            F.regexp_extract(stripped, TITLE_QUANTITY, 2),
        ),
    )
    return F.coalesce(in_title, first_spec(specs, COUNT_KEYS), F.lit("1"))


def net_volume(specs: Column) -> Column:
    return F.coalesce(first_spec(specs, VOLUME_KEYS), F.lit(""))


def with_text(df: DataFrame) -> DataFrame:
    """Add ``title_lc`` and ``desc_lc``."""
    return df.withColumns(
        {
            "title_lc": title_text(F.col("title")),
            "desc_lc": description_text(F.col("description"), F.col("bullet_points"), F.col("aplus_content")),
        }
    )


def with_flags(df: DataFrame) -> DataFrame:
    """Add the boolean evidence columns; needs ``title_lc``, ``desc_lc`` and ``specs``."""
    title, desc = F.col("title_lc"), F.col("desc_lc")
    form = F.lower(F.coalesce(spec_value(F.col("specs"), FORM_KEY), F.lit("")))
    consumable = words(title, CONSUMABLE) | form.contains("oil") | form.contains("liquid")
    df = df.withColumns(
        {
            "is_starter": words(title, STARTER_KIT, STARTER_STEMS),
            "is_bare": words(title, BARE_UNIT, BARE_STEMS),
            "is_accessory": words(title, ACCESSORY, ACCESSORY_STEMS),
            "is_consumable_pack": words(title, MULTI_PACK, MULTI_PACK_STEMS) & consumable,
            "requires_existing": holds_any(desc, EXISTING_STEMS) & desc.rlike(EXISTING_UNIT),
            "is_appliance": holds_any(title, APPLIANCE_PARTS),
        }
    )
    implied = (F.col("is_consumable_pack") | F.col("requires_existing")) & ~F.col("is_starter")
    return df.withColumn("is_refill", words(title, REFILL, REFILL_STEMS) | implied)


def package_type() -> Column:
    """Type by precedence; needs the flags."""
    return (
        F.when(F.col("is_starter"), F.lit(STARTER))
        .when(F.col("is_bare"), F.lit(BARE))
        .when(F.col("is_accessory"), F.lit(ACCESSORY_TYPE))
        .when(F.col("is_refill"), F.lit(REFILL_TYPE))
        .when(F.col("is_appliance"), F.lit(APPLIANCE))
        .otherwise(F.lit(STANDARD))
    )


def type_flag(kind: Column, position: int) -> Column:
    out = F.lit(None).cast("boolean")
    for value in (True, False):
        kinds = [name for name, flags in TYPE_FLAGS.items() if flags[position] is value]
        out = F.when(kind.isin(kinds), F.lit(value)).otherwise(out)
    return out


def claims() -> Column:
    """Labels of whole-machine features claimed by the seller, in fixed order."""
    found = [F.when(words(F.col("desc_lc"), ws), F.lit(label)) for label, ws in CLAIMS]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def alerts() -> Column:
    """Alerts as ``array<struct<code,message>>``; needs type, flags, claims and quantity."""
    kind = F.col("package_type")
    head, middle, tail = MISMATCH_ALERT
    listed = F.array_join(
        F.transform(F.col("misleading_claims"), lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "
    )
    mismatch = F.concat(F.lit(head), listed, F.lit(middle), F.col("pack_quantity"), F.lit(tail))
    has_claims = F.size("misleading_claims") > 0
    message = (
        F.when(kind == BARE, F.lit(BARE_ALERT))
        .when((kind == ACCESSORY_TYPE) & words(F.col("desc_lc"), HOST_DEVICE), F.lit(ACCESSORY_ALERT))
        .when((kind == REFILL_TYPE) & has_claims, mismatch)
        .when((kind == REFILL_TYPE) & F.col("requires_existing"), F.lit(REFILL_ALERT))
    )
    one = F.struct(F.substring_index(message, ":", 1).alias("code"), message.alias("message"))
    return F.filter(F.array(one), lambda a: a["message"].isNotNull())


def analyse(df: DataFrame) -> DataFrame:
    """Add type, flags, quantity, volume, claims and ``alerts`` to products.

    Needs ``title, description, bullet_points, aplus_content, specs``; keeps the evidence columns.
    """
    df = with_flags(with_text(df)).withColumn("package_type", package_type())
    kind = F.col("package_type")
    df = df.withColumns(
        {
            "device_included": type_flag(kind, 0),
            "is_refill_only": type_flag(kind, 1),
            "requires_base_device": type_flag(kind, 2),
            "pack_quantity": pack_quantity(F.col("title"), F.col("specs")),
            "net_volume_or_weight": net_volume(F.col("specs")),
            "misleading_claims": F.when(kind == REFILL_TYPE, claims()).otherwise(
                F.array().cast("array<string>")
            ),
        }
    )
    return df.withColumn("alerts", alerts())


EVIDENCE = [
    "title_lc", "desc_lc", "is_starter", "is_bare", "is_accessory", "is_consumable_pack",
    "requires_existing", "is_appliance", "is_refill", "misleading_claims", "alerts",
]
DETAILS = [
    "package_type", "is_refill_only", "device_included", "requires_base_device",
    "pack_quantity", "net_volume_or_weight",
]


def classify(df: DataFrame) -> DataFrame:
    """Products with ``package_details`` and ``listing_integrity_alerts`` as in the product schema."""
    out = analyse(df).withColumns(
        {
            "package_details": F.struct(*DETAILS),
            "listing_integrity_alerts": F.transform("alerts", lambda a: a["message"]),
        }
    )
    return out.drop(*EVIDENCE, *DETAILS)


def alert_rollup(classified: DataFrame) -> DataFrame:
    """Listings per package type and alert code ('' = no alert)."""
    code = F.explode_outer(F.transform("listing_integrity_alerts", lambda m: F.substring_index(m, ":", 1)))
    return (
        classified.select(F.col("package_details.package_type").alias("package_type"), code.alias("alert_code"))
        .groupBy("package_type", F.coalesce("alert_code", F.lit("")).alias("alert_code"))
        .agg(F.count("*").alias("listings"))
    )
