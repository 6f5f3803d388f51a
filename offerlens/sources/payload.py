"""Product payloads of a shop API (JSON) -> products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerlens.functions.identity import extract_asin
from offerlens.functions.price import detect_currency, price_display
from offerlens.functions.text import first_nonempty, let, present, specs_last_wins
from offerlens.schema import NO_RATING, UNKNOWN_AVAILABILITY

PAYLOAD = (
    "asin string, title string, brand string, rating string, ratings_total string, "
    "main_image struct<link:string>, description string, directions string, safety_warning string, "
    "important_information string, feature_bullets array<string>, "
    "specifications array<struct<name:string,value:string>>, attributes array<struct<name:string,value:string>>, "
    "buybox_winner struct<price:struct<raw:string,value:string>,rrp:struct<raw:string>,availability:struct<raw:string>>"
)


def payload_products(payloads: DataFrame, skip_rejects: bool = False) -> DataFrame:
    """Rows ``(url, payload)`` -> text columns of products, ready for ``pages.finish``.

    ``payload`` is the JSON text of one product. Texts that can't be read as one give what can be read of them, at worst an
    empty record; with ``skip_rejects`` they are left to :func:`payload_rejects`.
    """
    if skip_rejects:
        payloads = payloads.where(reject_reason(F.col("payload")).isNull())
    df = payloads.withColumn("p", F.from_json("payload", PAYLOAD))
    text = lambda path, default="": F.coalesce(F.col(path), F.lit(default))
    winner = "p.buybox_winner"
    bare = F.concat(detect_currency(F.col("url")), text(f"{winner}.price.value", "0.00"))
    return df.select(
        "url",
        F.lit("amazon").alias("store_id"),
        F.lit("Amazon").alias("source"),
        F.coalesce("p.asin", extract_asin(F.col("url"))).alias("product_id"),
        text("p.title").alias("title"),
        text("p.brand").alias("brand"),
        price_display(F.coalesce(first_nonempty(F.col(f"{winner}.price.raw")), bare)).alias("price"),
        price_display(F.col(f"{winner}.rrp.raw")).alias("original_price"),
        text("p.rating", NO_RATING).alias("rating"),
        F.concat(text("p.ratings_total", "0"), F.lit(" ratings")).alias("review_count"),
        text("p.main_image.link").alias("image_url"),
        F.when(present(F.col(f"{winner}.availability.raw")), F.lit("In Stock"))
        .otherwise(F.lit(UNKNOWN_AVAILABILITY))
        .alias("availability"),
        text("p.description").alias("description"),
        text("p.directions").alias("directions"),
        text("p.safety_warning").alias("safety_warning"),
        text("p.important_information").alias("important_information"),
        F.coalesce("p.feature_bullets", F.array().cast("array<string>")).alias("bullet_points"),
        payload_specs().alias("specs"),
    )


# Parts of a payload that are looked into, and the kind of each.
_PARTS = {
    "main_image": "object", "buybox_winner": "object", "feature_bullets": "list", "specifications": "list", "attributes": "list",
}
_KINDS = {"object": "OBJECT", "list": "ARRAY"}


def reject_reason(payload: Column) -> Column:
    """Why a payload holds no product; null for those that do.

    ``empty`` for a null or blank text, ``no JSON`` for one that doesn't parse, ``no object``, or the first part that is of
    another kind than a product's. Parts may be missing or null. Where a key is named twice the last one counts.
    """
    def kind(v: Column) -> Column:
        return F.regexp_extract(F.schema_of_variant(v), r"\A(\w+)", 1)

    def judge(v: Column) -> Column:
        # A text with a key named twice is no VARIANT but can be read.
        unread = F.from_json(payload, "map<string,string>").isNull()
        out = F.when(v.isNull(), F.when(unread, F.lit("no JSON"))).when(kind(v) != "OBJECT", F.lit("no object"))
        for part, wanted in _PARTS.items():
            found = kind(F.try_variant_get(v, f"$.{part}", "variant"))
            out = out.when(~found.isin(_KINDS[wanted], "VOID"), F.lit(f"{part}: no {wanted}"))
        return out

    return F.when(present(F.trim(payload)), let(F.try_parse_json(payload), judge)).otherwise(F.lit("empty"))


def payload_rejects(payloads: DataFrame) -> DataFrame:
    """The payloads that hold no product, with the ``reason``."""
    return payloads.withColumn("reason", reject_reason(F.col("payload"))).where("reason is not null")


def payload_specs() -> Column:
    """Specifications overlaid by attributes; both need a name, attributes a value too."""
    kind = "array<struct<name:string,value:string>>"
    listed = F.filter(F.coalesce("p.specifications", F.array().cast(kind)), lambda s: present(s["name"]))
    over = F.filter(
        F.coalesce("p.attributes", F.array().cast(kind)), lambda s: present(s["name"]) & present(s["value"])
    )
    entries = F.transform(
        F.concat(listed, over), lambda s: F.struct(s["name"].alias("key"), s["value"].alias("value"))
    )
    return specs_last_wins(entries)
