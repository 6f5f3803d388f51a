"""Stored pages -> products: one Python pass for the raw strings, columns for everything else."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from offerlens.functions.identity import (
    choose_image,
    clean_gallery,
    clean_page_title,
    extract_asin,
    title_from_url,
)
from offerlens.functions.price import (
    currency_code,
    detect_currency,
    discount_percentage,
    parse_price,
    price_display,
    rand_prefix,
    rating_numeric,
    review_count_numeric,
    split_price,
)
from offerlens.functions.text import (
    collapse_ws,
    first_nonempty,
    first_of,
    first_spec,
    ordered_unique,
    present,
    search,
    spec_value,
    specs_first_wins,
    specs_last_wins,
    strip_u,
)
from offerlens.operators import sections
from offerlens.operators.classify import classify
from offerlens.operators.filters import block_reason
from offerlens.operators.routing import StoreRegistry
from offerlens.schema import (
    NO_INGREDIENTS,
    NO_RATING,
    NO_REVIEWS,
    PRICE_UNAVAILABLE,
    PRODUCT,
    UNKNOWN_AVAILABILITY,
)
from offerlens.sources import page_tree
from offerlens.sources.page_tree import LIST_FIELDS, read_fields
from offerlens.sources.shop_fields import FIELD_TABLES

# The page reader travels with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(page_tree)

TEXT_FIELDS = [
    "title_text", "h1_text", "page_title", "price_text", "price_whole", "price_fraction", "original_text",
    "rating_text", "reviews_text", "desc_text", "info_text", "brand_text", "availability_text", "rich_text",
    "popularity_text", "image_hires", "image_sizes", "image_src",
]
ROW = "struct<variant:string,section:int,cells:array<string>,others:array<string>,key:string,value:string>"
RAW_DDL = ", ".join(
    [f"{f} string" for f in TEXT_FIELDS]
    + [f"{f} array<string>" for f in LIST_FIELDS]
    + [f"spec_rows array<{ROW}>", "blocks array<struct<section:int,text:string>>", "prime_mark boolean", "error string"]
)


def raw_fields(pages: DataFrame, tables: dict[str, dict]) -> DataFrame:
    """Add the raw fields of every page and drop ``html``; ``selectors`` names the table per row."""
    kept = [f for f in pages.schema.fields if f.name != "html"]
    raw_schema = T.StructType.fromDDL(RAW_DDL)
    kept_names, raw_types = [f.name for f in kept], to_arrow_schema(raw_schema)

    def fields(html: str, name: str) -> dict:
        try:
            return read_fields(html, tables[name])
        except Exception as e:  # an unreadable page is a row with an error, whatever goes wrong
            return {"error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty: dict[str, dict] = {}  # what an empty page gives is the same for all that one table reads
        for batch in batches:
            rows = []
            for html, name in zip(batch["html"].to_pylist(), batch["selectors"].to_pylist()):
                if html:
                    rows.append(fields(html, name))
                else:
                    if name not in empty:
                        empty[name] = fields(html, name)
                    rows.append(empty[name])
            raw = [pa.array([row.get(f.name) for row in rows], f.type) for f in raw_types]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept_names), *raw], names=[*kept_names, *raw_types.names])

    return pages.mapInArrow(run, T.StructType(kept + raw_schema.fields))


def page_records(pages: DataFrame, registry: StoreRegistry, tables: dict[str, dict] | None = None) -> DataFrame:
    """Pages ``(url, html[, store_id])`` -> text columns of products, ready for :func:`finish`.

    Pages of no known store are left out. ``reason`` says why a page holds nothing: ``empty``,
    ``blocked`` or ``unreadable``. The loose price search and the currency marks look at the page in the
    JVM, so Python returns only the selected strings.
    """
    tables = registry.field_tables(tables or FIELD_TABLES)
    if "store_id" not in pages.columns:
        pages = pages.withColumn("store_id", registry.route(F.col("url")))
    base = pages.select(
        "url", "store_id", F.coalesce(F.col("html"), F.lit("")).alias("html"),
        registry.selectors(F.col("store_id")).alias("selectors"),
    ).where("selectors is not null")
    html, shop = F.col("html"), F.col("selectors")
    second = shop == "takealot"
    reason = F.when(second, F.when(html == "", F.lit("empty"))).otherwise(block_reason(html))
    base = base.withColumns(
        {
            "symbol": detect_currency(F.col("url"), html),
            "loose_price": F.when(second, strip_u(F.regexp_extract(html, r"(?U)(R\s*[0-9\s,.]+)", 1))),
            "reason": reason,
        }
    ).withColumn("html", F.when(F.col("reason").isNull(), html).otherwise(F.lit("")))
    raw = raw_fields(base, tables)
    df = raw.withColumns(
        {
            "reason": F.coalesce("reason", F.when(F.col("error").isNotNull(), F.lit("unreadable"))),
            "attributes": F.transform(
                "blocks",
                lambda b: F.struct(b["section"].alias("section"), sections.line_attributes(b["text"]).alias("entries")),
            ),
        }
    )
    by_shop = lambda a, b: F.when(second, b).otherwise(a)
    df = df.withColumns(
        {
            "specs": by_shop(_amazon_specs(), _takealot_specs()),
            "description": by_shop(_description("Product description"), _description("Description")),
            "image_url": by_shop(
                choose_image(F.col("image_hires"), F.col("image_sizes"), F.col("image_src")),
                F.coalesce("image_src", F.lit("")),
            ),
            "source": registry.store_name(F.col("store_id")),
            "product_id": registry.identifier(F.col("store_id"), F.col("url")),
        }
    )
    df = df.withColumns(
        {
            "bullet_points": by_shop(_amazon_bullets(), _takealot_bullets()),
            "brand": by_shop(_amazon_brand(), _takealot_brand()),
        }
    )
    found = sections.ingredients(F.col("info_text"), F.col("description"), F.col("bullet_points"), F.col("specs"))
    return df.withColumn("listed", found).withColumns({name: by_shop(x, y) for name, x, y in _fields()})


def extract_products(
    pages: DataFrame, registry: StoreRegistry, tables: dict[str, dict] | None = None, with_reason: bool = False
) -> DataFrame:
    """Pages -> products. Empty pages become placeholder records.

    Bot-check pages are dropped, or kept without fields and with a ``reason`` if ``with_reason``.
    """
    df = page_records(pages, registry, tables)
    if with_reason:
        return finish(df, extra=["reason"])
    return finish(df.where("reason is null or reason <> 'blocked'"))


def finish(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Numbers, currency and classification, the same for every way a record came about.

    Needs the text columns of a product (missing ones become null) and optionally ``symbol``; the
    result has the columns of ``schema.PRODUCT``.
    """
    have = set(df.columns)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in PRODUCT.fields if f.name not in have}
    numbers = {
        "price_numeric": parse_price(F.col("price")),
        "original_price_numeric": parse_price(F.col("original_price")),
        "rating_numeric": rating_numeric(F.col("rating")),
        "review_count_numeric": review_count_numeric(F.col("review_count")),
    }
    if "symbol" in have:
        numbers["currency"] = F.when(F.col("store_id") == "takealot", F.lit("ZAR")).otherwise(
            currency_code(F.col("url"), F.col("symbol"))
        )
    texts = {k: v for k, v in missing.items() if k in ("original_price", "rating", "review_count", "aplus_content")}
    if texts:
        df = df.withColumns(texts)
    df = df.withColumns({**{k: v for k, v in missing.items() if k not in texts}, **numbers})
    df = df.withColumn(
        "discount_percentage", discount_percentage(F.col("price_numeric"), F.col("original_price_numeric"))
    )
    return classify(df).select(*[f.name for f in PRODUCT.fields], *(extra or []))


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def _fields() -> list[tuple[str, Column, Column]]:
    """``(column, first shop's rule, second shop's rule)`` over raw fields and earlier columns."""
    description, info = F.col("description"), F.col("info_text")
    asin = extract_asin(F.col("url"))
    empty = F.col("reason").isNotNull()
    name = F.coalesce(F.concat(F.lit("Amazon Product ("), asin, F.lit(")")), F.lit("Amazon Product"))
    h1 = F.when(~F.lower("h1_text").contains("about this item"), F.col("h1_text"))
    amazon_title = F.when(empty, name).otherwise(
        F.coalesce(
            first_nonempty(F.col("title_text"), h1, clean_page_title(F.col("page_title")), title_from_url(F.col("url"))),
            name,
        )
    )
    plid = F.coalesce(search(F.col("url"), r"(PLID\d+)"), F.lit(""))
    takealot_title = F.when(empty, F.lit("Takealot Product")).otherwise(
        F.coalesce(first_nonempty(F.col("title_text")), F.concat(F.lit("Takealot Product ("), plid, F.lit(")")))
    )

    amazon_price = F.when(present(F.col("price_text")), price_display(F.col("price_text"))).otherwise(
        split_price(F.col("symbol"), F.col("price_whole"), F.col("price_fraction"))
    )
    shown = _text("price_text", PRICE_UNAVAILABLE)
    no_price = (shown == "") | F.lower(shown).contains("unavailable")
    takealot_price = rand_prefix(F.when(no_price, F.coalesce(F.nullif("loose_price", F.lit("")), shown)).otherwise(shown))

    texts = F.filter("merchant_texts", lambda t: t != "")
    seller = F.when(F.size(texts) >= 2, F.get(texts, F.lit(1)))
    shipper = F.coalesce(F.get(texts, F.lit(2)), seller)
    promise = first_of(F.filter("return_texts", lambda t: F.lower(t).contains("return") | F.lower(t).contains("day")))
    amazon_seller = F.struct(
        F.coalesce(first_nonempty(seller, F.col("brand")), F.lit("Amazon.co.za")).alias("seller"),
        F.coalesce(first_nonempty(shipper), F.lit("Amazon.co.za")).alias("shipper"),
        F.coalesce("prime_mark", F.lit(False)).alias("is_prime"),
        F.coalesce(first_nonempty(promise), F.lit("Standard 30-day return policy")).alias("return_policy"),
    )
    takealot_seller = F.struct(
        F.coalesce(first_nonempty(spec_value(F.col("specs"), "Seller")), F.lit("Takealot")).alias("seller"),
        F.lit("Takealot").alias("shipper"),
        F.lit(False).alias("is_prime"),
        F.lit("Takealot 30-day return policy").alias("return_policy"),
    )

    included = first_spec(F.col("specs"), ["Included Components", "Package Contents"])
    items = ordered_unique(F.col("box_texts"))
    amazon_box = F.when(F.size(items) > 0, items).otherwise(_parts(included, ","))
    takealot_box = _parts(first_spec(F.col("specs"), ["What's in the box", "What’s in the box"]), "\n")

    rich = collapse_ws(F.col("rich_text"))
    image = F.col("image_url")
    return [
        ("title", amazon_title, takealot_title),
        ("price", F.coalesce(first_nonempty(amazon_price), F.lit(PRICE_UNAVAILABLE)), takealot_price),
        ("original_price", price_display(F.col("original_text")), _text("original_text")),
        ("rating", _text("rating_text", NO_RATING), _text("rating_text", NO_RATING)),
        ("review_count", _text("reviews_text", NO_REVIEWS), _text("reviews_text", NO_REVIEWS)),
        (
            "availability",
            F.when(empty, F.lit(UNKNOWN_AVAILABILITY)).otherwise(_text("availability_text", "In Stock")),
            F.lit("In stock"),
        ),
        ("social_proof", _text("popularity_text"), F.lit(None).cast("string")),
        ("seller_info", amazon_seller, takealot_seller),
        (
            "breadcrumbs",
            ordered_unique(F.col("crumb_texts")),
            F.filter(ordered_unique(F.col("crumb_texts")), lambda c: F.lower(c) != "home"),
        ),
        (
            "gallery_images",
            clean_gallery(image, F.col("gallery_links")),
            F.filter(F.array(image), lambda i: i != ""),
        ),
        (
            "ingredients",
            F.when(empty, F.lit(NO_INGREDIENTS)).otherwise(F.col("listed")),
            F.coalesce(first_nonempty(_paired("Ingredients")), F.col("listed")),
        ),
        ("aplus_content", F.when(F.length(rich) > 15, rich).otherwise(F.lit("")), F.lit(None).cast("string")),
        ("whats_in_the_box", amazon_box, takealot_box),
        ("directions", sections.directions(info, description), sections.suggested_use(description)),
        ("safety_warning", sections.safety_warning(info, description), sections.disclaimer(description)),
        ("important_information", _text("info_text"), F.lit("")),
    ]


def _parts(c: Column, sep: str) -> Column:
    parts = F.filter(F.transform(F.split(c, sep), strip_u), lambda p: p != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def _description(heading: str) -> Column:
    return strip_u(F.regexp_replace(_text("desc_text"), rf"(?i)\A({heading}\s*)+", ""))


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _amazon_specs() -> Column:
    """Specification entries in variant order, first value of a key wins."""

    def pair(r: Column) -> Column:
        cells, others = r["cells"], r["others"]
        two = lambda a: _entry(F.get(a, F.lit(0)), F.get(a, F.lit(1)))
        return (
            F.when((r["variant"] == "details") & r["value"].isNotNull(), _entry(r["key"], r["value"]))
            .when((r["variant"] == "rich") & (F.size(cells) != 2), _entry(F.lit(None), F.lit(None)))
            .when(F.size(cells) >= 2, two(cells))
            .when(F.size(others) >= 2, two(others))
            .otherwise(_entry(F.lit(None), F.lit(None)))
        )

    def tidy(r: Column) -> Column:
        p = pair(r)
        key = F.when(r["variant"] == "bullets", strip_u(F.replace(p["key"], F.lit(":"), F.lit("")))).otherwise(
            F.regexp_replace(p["key"], r":+\z", "")
        )
        return F.struct(
            r["variant"].alias("variant"),
            key.alias("key"),
            F.translate(p["value"], "\u200e\u200f", "").alias("value"),
        )

    def short(s: Column) -> Column:
        rich = s["variant"] == "rich"
        return (
            present(s["key"])
            & present(s["value"])
            & (F.length(s["key"]) < F.when(rich, 50).otherwise(60))
            & (~rich | (F.length(s["value"]) < 200))
        )

    rows = F.coalesce(F.col("spec_rows"), F.array().cast(f"array<{ROW}>"))
    kept = F.filter(F.transform(rows, tidy), short)
    return specs_first_wins(F.transform(kept, lambda s: _entry(s["key"], s["value"])))


def _paired(key: str) -> Column:
    """First value of a known attribute in the page's text blocks."""
    entries = F.flatten(F.transform("attributes", lambda b: b["entries"]))
    return first_of(F.filter(entries, lambda e: e["paired"] & (e["key"] == key)))["value"]


def _takealot_specs() -> Column:
    """Specification entries of tables and text blocks, last value of a key wins.

    Containers are read from the outside in, a container's rows before its text, so a value found
    further inside replaces one found further out.
    """
    rows = F.coalesce(F.col("spec_rows"), F.array().cast(f"array<{ROW}>"))

    def placed(section: Column, phase: int, at: Column, key: Column, value: Column) -> Column:
        return F.struct(
            section.alias("section"),
            F.lit(phase).alias("phase"),
            at.alias("at"),
            key.alias("key"),
            value.alias("value"),
        )

    tables = F.transform(
        F.filter(rows, lambda r: F.size(r["cells"]) == 2),
        lambda r, i: placed(
            r["section"],
            0,
            i,
            F.regexp_replace(F.get(r["cells"], F.lit(0)), r":+\z", ""),
            F.get(r["cells"], F.lit(1)),
        ),
    )
    tables = F.filter(tables, lambda s: present(s["key"]) & present(s["value"]) & (F.length(s["key"]) < 50))
    lines = F.flatten(
        F.transform(
            "attributes",
            lambda b: F.transform(b["entries"], lambda e, i: placed(b["section"], 1, i, e["key"], e["value"])),
        )
    )
    ordered = F.array_sort(F.concat(tables, F.coalesce(lines, F.slice(tables, 1, 0))))
    return specs_last_wins(F.transform(ordered, lambda s: _entry(s["key"], s["value"])))


def _amazon_bullets() -> Column:
    keep = lambda b: ~b.startswith("Make sure this fits") & (F.length(b) > 3)
    return ordered_unique(F.filter(F.coalesce("bullet_texts", F.array().cast("array<string>")), keep))


def _takealot_bullets() -> Column:
    given = F.coalesce("bullet_texts", F.array().cast("array<string>"))
    items = ordered_unique(F.filter(given, lambda b: F.length(b) > 3))
    return F.when(F.size(items) > 0, items).otherwise(sections.listed_benefits(F.col("description")))


def _amazon_brand() -> Column:
    # Texts around the brand name in the line below the title.
    name = F.col("brand_text")
    for around in ("Brand: ", "Visit the ", " Store"):
        name = F.replace(name, F.lit(around), F.lit(""))
    return F.coalesce(first_spec(F.col("specs"), ["Brand", "Brand Name", "Manufacturer"]), name, F.lit(""))


def _takealot_brand() -> Column:
    return F.coalesce(first_nonempty(_paired("Brand"), F.col("brand_text")), F.lit("Takealot"))
