"""Inputs -> products through the table of stored pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerlens.functions.identity import extract_asin, title_from_url
from offerlens.functions.text import collapse_ws, first_nonempty
from offerlens.operators.ranking import keep_first
from offerlens.operators.routing import StoreRegistry
from offerlens.schema import NO_RATING, NO_REVIEWS, PRICE_UNAVAILABLE, PRODUCT, UNKNOWN_AVAILABILITY
from offerlens.sources.pages import finish, page_records
from offerlens.storage import new_path, stored


def placeholder() -> dict[str, Column]:
    """Text columns of a record whose page is absent or unreadable; all others are null."""
    url, takealot = F.col("url"), F.col("store_id") != "amazon"
    asin = extract_asin(url)
    name = F.coalesce(
        first_nonempty(title_from_url(url)),
        F.concat(F.lit("Amazon Product ("), asin, F.lit(")")),
        F.lit("Amazon Product"),
    )
    first_shop = {
        "original_price": "",
        "rating": NO_RATING,
        "review_count": NO_REVIEWS,
        "availability": UNKNOWN_AVAILABILITY,
        "image_url": "",
        "description": "",
        "directions": "",
        "safety_warning": "",
        "important_information": "",
    }
    return {
        "url": url,
        "store_id": F.col("store_id"),
        "source": F.col("source"),
        "product_id": F.when(takealot, F.col("product_id")).otherwise(F.coalesce(asin, F.lit("N/A"))),
        "title": F.when(takealot, F.concat("source", F.lit(" Product"))).otherwise(name),
        "brand": F.when(~takealot, F.split_part(collapse_ws(name), F.lit(" "), F.lit(1))),
        "price": F.lit(PRICE_UNAVAILABLE),
        "bullet_points": F.array().cast("array<string>"),
        "specs": F.array().cast("array<struct<key:string,value:string>>"),
        **{c: F.when(~takealot, F.lit(v)) for c, v in first_shop.items()},
    }


def page_store(
    pages: DataFrame, registry: StoreRegistry, path: str | None = None, buckets: int = 1024, name: str | None = None
) -> DataFrame:
    """Stored pages as a table clustered by their canonical URL, of which a lookup reads the buckets it needs.

    Keeps the columns of ``pages`` and adds ``canon`` and ``bucket``, the number of the bucket. A bucket is a folder of its
    own with the pages sorted by ``canon``: a filter on its number leaves the other folders unread, and a join or window by
    ``canon`` doesn't shuffle the pages. ``name`` is the table's name in the session's catalog; a later
    application finds the pages again by :func:`open_page_store`.
    """
    spark = pages.sparkSession
    canon = registry.canonical(registry.route(F.col("url")), F.col("url"))
    keyed = pages.withColumn("canon", canon).withColumn("bucket", bucket_of(F.col("canon"), buckets))
    name, path = name or f"pages_{uuid.uuid4().hex}", path or new_path(spark, "pages")
    clustered = keyed.repartition(buckets, "canon").write.partitionBy("bucket").bucketBy(buckets, "canon").sortBy("canon")
    clustered.option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name).withMetadata("bucket", {"buckets": buckets})


def open_page_store(spark: SparkSession, path: str, schema: str, buckets: int = 1024, name: str | None = None) -> DataFrame:
    """The table that :func:`page_store` wrote to ``path``; ``schema`` is the DDL of its pages' own columns."""
    name = name or f"pages_{uuid.uuid4().hex}"
    spark.sql(
        f"create table {name} ({schema}, canon string, bucket int) using parquet partitioned by (bucket) "
        f"clustered by (canon) sorted by (canon) into {int(buckets)} buckets location '{path}'"
    )
    spark.catalog.recoverPartitions(name)
    return spark.table(name).withMetadata("bucket", {"buckets": buckets})


def bucket_of(canon: Column, buckets: int) -> Column:
    """The bucket that Spark's own clustering gives a value."""
    return F.pmod(F.hash(canon), F.lit(buckets))


def newest_pages(wanted: DataFrame, pages: DataFrame, registry: StoreRegistry) -> DataFrame:
    """``(canon, html)`` of the wanted canonical URLs, the snapshot with the greatest ``fetched_at`` of each.

    Of a :func:`page_store` only the buckets asked for are read; their numbers, at most as many as there are buckets,
    go into the filter as constants. The joins are merge joins: Spark's estimate of a page's size knows nothing of its text, and
    pages taken for small would be sent through the driver.
    """
    if "canon" not in pages.columns:
        pages = pages.withColumn("canon", registry.canonical(registry.route(F.col("url")), F.col("url")))
    elif "bucket" in pages.columns:
        buckets = pages.schema["bucket"].metadata["buckets"]
        asked = sorted(r.bucket for r in wanted.select(bucket_of(F.col("canon"), buckets).alias("bucket")).distinct().collect())
        if len(asked) < buckets:
            pages = pages.where(F.col("bucket").isin(asked))
    found = pages.join(wanted.select("canon").distinct().hint("merge"), "canon", "left_semi")
    order = [F.col("fetched_at").desc_nulls_last()] if "fetched_at" in pages.columns else []
    return keep_first(found, ["canon"], [*order, F.col("url"), F.xxhash64("html")]).select("canon", "html")


def lookup_products(urls: DataFrame, pages: DataFrame, registry: StoreRegistry) -> DataFrame:
    """One product per distinct ``(url, store_id)``.

    ``pages`` holds ``url, html``, optionally ``fetched_at``, or is a :func:`page_store`. Both sides meet under the
    store's canonical URL, and the newest snapshot is taken. Only the pages asked for reach the extraction job. Pages that are missing, blocked or hold
    no valid product of the first shop give a placeholder record; the second shop's pages are taken as
    they are.
    """
    wanted = urls.select("url", "store_id").where("store_id is not null").distinct()
    wanted = wanted.withColumn("canon", registry.canonical(F.col("store_id"), F.col("url")))
    if "bucket" in pages.columns:
        wanted = stored(wanted, "asked")  # read for the buckets, then for the pages
    records = page_records(wanted.join(newest_pages(wanted, pages, registry).hint("merge"), "canon", "left").drop("canon"), registry)
    valid = registry.is_valid(F.col("store_id"), skip=("takealot",))
    lost = F.col("reason").isNotNull() | ~valid
    records = records.withColumn("lost", lost)
    have, instead = set(records.columns), placeholder()
    names = [f.name for f in PRODUCT.fields if f.name in have]
    chosen = [
        F.when(F.col("lost"), instead.get(n, F.lit(None))).otherwise(F.col(n)).alias(n) for n in names
    ]
    symbol = F.when(~F.col("lost"), F.col("symbol")).alias("symbol")
    return finish(records.select(*chosen, symbol))
