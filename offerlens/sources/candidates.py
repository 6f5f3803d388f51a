"""Search-result links -> candidate products in rank order.

Links are rows ``(run_id, store_id, query_idx, page_num, pos, href)``: one stored search run is a set
of result pages per store and search term, pages counted from 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerlens.operators.filters import likely_among
from offerlens.operators.ranking import keep_first, salted, top_k
from offerlens.operators.routing import StoreRegistry
from offerlens.storage import stored


@dataclass(frozen=True)
class Caps:
    """How much of a search run's stored results is looked at; without a cap, everything.

    ``max_pages`` maps a shop to the number of result pages read per search term. ``min_candidates`` is the least
    length at which a term's candidate list is cut, and four times its quota if that is more.
    """

    max_pages: tuple[tuple[str, int], ...] = ()
    min_candidates: int | None = None


NO_CAPS = Caps()
# The caps of a run against live shops, where every page costs a request.
LIVE_CAPS = Caps((("amazon", 20), ("takealot", 10)), 30)

GROUP = ["run_id", "store_id", "query_idx"]
RANK = ["page_num", "pos"]


def canonical_links(links: DataFrame, caps: Caps = NO_CAPS, registry: StoreRegistry | None = None) -> DataFrame:
    """Links to products with canonical ``url`` and the ``product_id`` by which a store tells its products apart.

    Links of stores that the registry doesn't know are those of :func:`link_rejects`.
    """
    registry = registry or StoreRegistry()
    store, href = F.col("store_id"), F.col("href")
    read = F.lit(True)
    for shop, pages in caps.max_pages:
        read = read & ((store != shop) | (F.col("page_num") <= pages))
    # One condition: split, its second part would be tested where the links are made, and make them twice.
    out = links.where(F.when(read, registry.is_product_link(store, href))).withColumn("url", registry.link_url(store, href))
    return out.withColumn("product_id", F.coalesce(registry.identifier(store, F.col("url")), F.col("url")))


def link_rejects(links: DataFrame, registry: StoreRegistry | None = None) -> DataFrame:
    """The links that no search run can use, with the ``reason``: an unknown shop, or no product behind the link."""
    registry = registry or StoreRegistry()
    store = F.col("store_id")
    known = F.coalesce(store.isin(registry.store_ids()), F.lit(False))
    product = F.coalesce(registry.is_product_link(store, F.col("href")), F.lit(False))
    reason = F.when(~known, "unknown shop").when(~product, "no product")
    return links.withColumn("reason", reason).where("reason is not null")


def first_links(
    links: DataFrame, caps: Caps = NO_CAPS, registry: StoreRegistry | None = None, salt: bool = False
) -> DataFrame:
    """Each product once per (run, store, query), at its first position.

    The shops' own rules differ in name only: one compares URLs, the other identifiers; the canonical
    URL of the former is made from the identifier and the host, so both are kept in the key. With ``salt`` the rows come in the parts
    of :func:`salted` by ``product_id``, which the key decides: a ranking of the lists then needs no shuffle before its own.
    """
    registry = registry or StoreRegistry()
    by_url = [p.store_id for p in registry.plugins() if p.keyed_by_url]
    key = F.when(F.col("store_id").isin(by_url), F.col("url")).otherwise(F.col("product_id"))
    order = [F.col(c) for c in RANK]
    found, keys = canonical_links(links, caps, registry).withColumn("_key", key), [*GROUP, "_key"]
    if salt:
        found, keys = salted(found, GROUP, ["product_id"]), [*GROUP, "_salt", "_key"]
    first = keep_first(found, keys, order)
    return first.where("url <> ''").drop("_key")


def before_dry_page(first: DataFrame, enough: Column | None = None) -> DataFrame:
    """Drop what stands after the first page without a new link.

    Page numbers of pages with new links must be 1, 2, 3, …; the first gap ends the list. The page facts
    are few, so the links themselves are not ranked. Given ``enough``, a column over the links that is constant within a list,
    pages before which a list has as many links are left out too, whatever they hold. ``first`` is read twice or three
    times: store it first.
    """
    page = [*GROUP, "page_num"]
    most = F.max(F.lit(None).cast("int") if enough is None else enough)
    pages = first.groupBy(*page).agg(F.count("*").alias("new_links"), most.alias("_enough"))
    w = Window.partitionBy(*GROUP).orderBy("page_num")
    before = F.coalesce(F.sum("new_links").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pages.withColumn("_nth", F.row_number().over(w)).withColumn("_before", before)
    live = placed.where("_nth = page_num").where("_enough is null or _before < _enough").select(*page)
    if enough is not None:
        live = stored(live, "live-pages")
        first = likely_among(first, live, page)
    return first.join(live, page, "left_semi")


def result_links(links: DataFrame, target_count: Column, caps: Caps = NO_CAPS, registry: StoreRegistry | None = None) -> DataFrame:
    """Candidate list per (run, store, query): new links in page order up to a count.

    Adds ``rank`` (1-based). ``target_count`` is a column over the links.
    """
    listed = before_dry_page(stored(first_links(links, caps, registry), "links"), target_count)
    order = [F.col(c) for c in RANK]
    return top_k(listed, GROUP, order, target_count, ["product_id"]).withColumnRenamed("rn", "rank")
