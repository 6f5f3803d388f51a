"""The three batch jobs: search runs, direct inputs, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerlens.functions.identity import lookup_url, unwrap_amazon_url
from offerlens.functions.text import let
from offerlens.operators.allocate import allocate, candidate_prefix, store_targets, with_eligibility
from offerlens.operators.filters import in_price_range, likely_among
from offerlens.operators.lookup import lookup_products
from offerlens.operators.routing import StoreRegistry
from offerlens.operators.score import score, verdicts
from offerlens.sources.candidates import NO_CAPS, Caps
from offerlens.sources.urls import dedupe_inputs
from offerlens.storage import stored


# Runs up to which their shares are sent to every task; those of more runs are joined like any table.
FEW_RUNS = 1_000_000


def search_run(
    links: DataFrame,
    runs: DataFrame,
    pages: DataFrame | None = None,
    products: DataFrame | None = None,
    registry: StoreRegistry | None = None,
    validate: tuple[str, ...] = ("amazon",),
    caps: Caps = NO_CAPS,
) -> DataFrame:
    """Stored search results -> accepted products per run, in result order.

    ``runs`` holds ``run_id, limit, source, min_price, max_price, n_queries``. Product facts come from
    ``products`` (store_id, url, …) or are extracted from ``pages``, and then only for links that some
    run can reach; of several facts about one product any one is taken. Only validity and price of ``products`` take part in the
    allocation; their other columns are looked up for what was accepted. ``validate`` names the stores whose own
    validity rule is applied. All terms of all runs are worked off; ``caps`` may limit what is looked at. Every shop of the
    registry may have a share; see ``store_targets`` for how runs name shops, and ``run_rejects`` and ``link_rejects`` for what
    can't be used.
    """
    registry = registry or StoreRegistry()
    n_queries, n_runs = runs.agg(F.max("n_queries"), F.count("*")).first()
    n_queries = n_queries or 0
    reachable = candidate_prefix(links, store_targets(runs, registry), caps, registry, few_runs=n_runs <= FEW_RUNS).drop("href")
    given = products is not None
    if not given:
        reachable = stored(reachable, "reachable")
        products = stored(lookup_products(reachable, pages, registry), "products")
    skip = tuple(s for s in registry.store_ids() if s not in validate)
    facts = products.withColumn("is_valid", registry.is_valid(F.col("store_id"), skip)).drop("product_id")
    page, judged = ["store_id", "url"], ["is_valid", "price_numeric"]
    judgement = facts.select(*page, *judged)
    if given:
        judgement = judgement.dropDuplicates(page)
    accepted = allocate(with_eligibility(reachable, judgement), n_queries, caps, registry)
    rest = [c for c in facts.columns if c not in accepted.columns]
    if given:
        # Of several facts, one with the validity and price that the allocation has seen.
        accepted = stored(accepted, "accepted")
        seen = accepted.select(*page, *[F.col(c).alias(f"_{c}") for c in judged]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in judged]
        facts = likely_among(facts.select(*page, *judged, *rest), seen, page).join(seen, page).where(same[0] & same[1]).dropDuplicates(page)
    return accepted.join(facts.select(*page, *rest), page, "left")


def direct_run(
    inputs: DataFrame,
    pages: DataFrame,
    order: list[Column],
    registry: StoreRegistry | None = None,
    unknown: str | None = None,
    compat_key: bool = False,
    low: float | None = None,
    high: float | None = None,
    scope: tuple[str, ...] = (),
) -> DataFrame:
    """Given URLs and identifiers ``(input, …)`` -> one product per distinct input.

    Inputs that no page can be named for are those of :func:`direct_rejects`; inputs of unknown shops aren't, if ``unknown`` names the store whose rules they get.
    ``compat_key`` takes the identifier rules of all stores in turn for de-duplication. Price bounds are
    off unless given. ``scope`` names columns of the inputs within which repeats are dropped, such as the list they are from.
    """
    registry = registry or StoreRegistry()
    df = addressed(inputs, registry, unknown).where("reason is null").drop("reason")
    # Read for the pages and for the inputs.
    df = stored(dedupe_inputs(df, order, store_id=None if compat_key else "store_id", scope=scope, registry=registry), "direct-inputs")
    found = lookup_products(df, pages, registry)
    return df.join(found.hint("merge"), ["url", "store_id"]).where(in_price_range(F.col("price_numeric"), low, high))


def addressed(inputs: DataFrame, registry: StoreRegistry, unknown: str | None = None) -> DataFrame:
    """Add ``store_id``, the page's ``url`` and, where there is none, the ``reason``."""
    text = F.col("input")
    known = lambda t: F.when(~t.startswith("http") & lookup_url(t).isNotNull(), F.lit("amazon")).otherwise(registry.route(t, unknown))
    store = let(text, known)
    target = F.when(F.col("store_id") == "amazon", unwrap_amazon_url(lookup_url(text))).otherwise(
        registry.canonical(F.col("store_id"), text)
    )
    reason = F.when(F.col("store_id").isNull(), "unknown shop").when(F.coalesce("url", F.lit("")) == "", "no address")
    return inputs.withColumn("store_id", store).withColumn("url", target).withColumn("reason", reason)


def direct_rejects(inputs: DataFrame, registry: StoreRegistry | None = None, unknown: str | None = None) -> DataFrame:
    """The inputs that :func:`direct_run` has no page for, with a ``reason``."""
    return addressed(inputs, registry or StoreRegistry(), unknown).where("reason is not null")


def compare(products: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Scored products and one verdict per comparison set."""
    scored = score(products, **options)
    return scored, verdicts(scored)
