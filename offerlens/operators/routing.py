"""Store plugins and routing of URLs to stores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerlens.functions.identity import (
    AMAZON_ZA,
    TAKEALOT as TAKEALOT_HOME,
    absolute,
    clean_takealot_url,
    extract_asin,
    extract_plid,
    netloc,
    unwrap_amazon_url,
)
from offerlens.functions.text import let
from offerlens.operators.filters import valid_amazon, valid_takealot


def _always(df_col: Callable[[str], Column]) -> Column:
    return F.lit(True)


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*\z", "")


@dataclass(frozen=True)
class StorePlugin:
    """One shop: its domains, its identifier rule and its validity rule.

    ``identifier`` maps a URL column to an identifier column. ``is_valid`` maps a column getter to a
    boolean column over product columns. ``selectors`` names the table of page selectors that the
    extraction job uses (see ``offerlens.sources.shop_fields``). ``canonical`` maps a URL column to the form under
    which all links to one page meet; without it, queries and fragments are cut. A shop whose pages no known table
    fits brings its own as ``fields`` (same shape as those of ``shop_fields``), which then stands for ``selectors``.

    For search runs: ``product_link`` tells which links of a result page lead to products (without it, those with an
    identifier), ``home`` stands before links without a host. ``keyed_by_url`` tells a term's products apart by URL
    instead of identifier; ``hides_used`` leaves out products that earlier terms took before a list's end is looked for.
    """

    store_id: str
    store_name: str
    domains: tuple[str, ...]
    identifier: Callable[[Column], Column]
    is_valid: Callable[[Callable[[str], Column]], Column] = _always
    selectors: str = "amazon"
    canonical: Callable[[Column], Column] = _bare
    fields: dict | None = None
    product_link: Callable[[Column], Column] | None = None
    home: str = ""
    keyed_by_url: bool = False
    hides_used: bool = False

    def is_product_link(self, href: Column) -> Column:
        return self.product_link(href) if self.product_link else self.identifier(self.link_url(href)).isNotNull()

    def link_url(self, href: Column) -> Column:
        """Canonical URL of a link on one of the shop's result pages."""
        return self.canonical(absolute(href, self.home))

    def table_name(self) -> str:
        return self.selectors if self.fields is None else f"own:{self.store_id}"


# Shops known from the start, in order of priority, with their domains.
AMAZON = StorePlugin(
    "amazon",
    "Amazon",
    ("amazon.co.za", "amazon.com", "amazon.co.uk", "amzn.to"),
    extract_asin,
    lambda c: valid_amazon(c("title"), c("price"), c("specs"), c("bullet_points"), c("image_url")),
    "amazon",
    unwrap_amazon_url,
    product_link=lambda href: href.contains("/dp/") | href.contains("/gp/product/"),
    home=AMAZON_ZA,
    keyed_by_url=True,
    hides_used=True,
)
TAKEALOT = StorePlugin(
    "takealot",
    "Takealot",
    ("takealot.com",),
    extract_plid,
    lambda c: valid_takealot(c("title"), c("price")),
    "takealot",
    clean_takealot_url,
    product_link=lambda href: href.contains("/PLID"),
    home=TAKEALOT_HOME,
)


class StoreRegistry:
    """Ordered collection of plugins; earlier stores win when several match a URL."""

    def __init__(self, plugins: tuple[StorePlugin, ...] = (AMAZON, TAKEALOT)):
        self._plugins: dict[str, StorePlugin] = {}
        for plugin in plugins:
            self.register(plugin)

    def register(self, plugin: StorePlugin) -> None:
        """Add a store; an existing id keeps its priority and gets the new plugin."""
        self._plugins[plugin.store_id] = plugin

    def get(self, store_id: str) -> StorePlugin:
        key = store_id.lower().strip()
        if key not in self._plugins:
            raise ValueError(f"Unknown store '{store_id}'. Supported stores: {self.store_ids()}")
        return self._plugins[key]

    def store_ids(self) -> list[str]:
        return list(self._plugins)

    def plugins(self) -> list[StorePlugin]:
        return list(self._plugins.values())

    def as_table(self, spark: SparkSession) -> DataFrame:
        """Stores as rows ``(store_id, store_name, domain, priority)``."""
        rows = [
            (p.store_id, p.store_name, domain, priority)
            for priority, p in enumerate(self._plugins.values())
            for domain in p.domains
        ]
        return spark.createDataFrame(rows, "store_id string, store_name string, domain string, priority int")

    def route(self, url: Column, unknown: str | None = None) -> Column:
        """Store of a URL by its host: no join and no shuffle, every row kept.

        A text that only mentions the second shop's domain goes there too. Anything else is null, or
        ``unknown`` (pass ``'amazon'`` to read unknown shops with that store's rules).
        """

        def by_host(u: Column, host: Column) -> Column:
            out = F.when(F.lit(False), F.lit(None).cast("string"))
            for plugin in self._plugins.values():
                out = out.when(_any_domain(host, plugin.domains), F.lit(plugin.store_id))
            if "takealot" in self._plugins:
                out = out.when(u.contains("takealot.com"), F.lit("takealot"))
            return out.otherwise(F.lit(unknown).cast("string"))

        return let(url, lambda u: let(F.lower(netloc(u)), lambda host: by_host(u, host)))

    def matches(self, store_id: str, url: Column) -> Column:
        """Whether the host of a URL belongs to one store."""
        return _any_domain(F.lower(netloc(url)), self.get(store_id).domains)

    def identifier(self, store_id: Column, url: Column) -> Column:
        """Identifier of a URL by the rule of its own store."""
        return self._by_store(store_id, lambda p: p.identifier(url), "string")

    def canonical(self, store_id: Column, url: Column) -> Column:
        """URL in the form of its own store; URLs of unknown stores stay as they are."""
        own = self._by_store(store_id, lambda p: p.canonical(url), "string")
        return F.coalesce(let(own, lambda u: F.when(u != "", u)), url)

    def is_product_link(self, store_id: Column, href: Column) -> Column:
        """Whether a link on a result page leads to a product; null for unknown stores."""
        return self._by_store(store_id, lambda p: p.is_product_link(href), "boolean")

    def link_url(self, store_id: Column, href: Column) -> Column:
        return self._by_store(store_id, lambda p: p.link_url(href), "string")

    def is_valid(self, store_id: Column, skip: tuple[str, ...] = ()) -> Column:
        """Validity by the rule of each row's store; stores in ``skip`` are not tested."""
        rule = self._by_store(
            store_id, lambda p: F.lit(True) if p.store_id in skip else p.is_valid(F.col), "boolean"
        )
        return F.coalesce(rule, F.lit(False))

    def store_name(self, store_id: Column) -> Column:
        return self._by_store(store_id, lambda p: F.lit(p.store_name), "string")

    def selectors(self, store_id: Column) -> Column:
        """Name of the selector table for the pages of a store."""
        return self._by_store(store_id, lambda p: F.lit(p.table_name()), "string")

    def field_tables(self, known: dict[str, dict]) -> dict[str, dict]:
        """The selector tables that the stores use; an unknown name is an error here, not in a task."""
        tables = {**known, **{p.table_name(): p.fields for p in self._plugins.values() if p.fields is not None}}
        lost = [p.store_id for p in self._plugins.values() if p.table_name() not in tables]
        if lost:
            raise ValueError(f"stores without a selector table: {lost}; known tables: {sorted(known)}")
        return {name: tables[name] for name in {p.table_name() for p in self._plugins.values()}}

    def _by_store(self, store_id: Column, rule: Callable[[StorePlugin], Column], kind: str) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast(kind))
        for plugin in self._plugins.values():
            out = out.when(store_id == plugin.store_id, rule(plugin))
        return out


#: Parts into which the rows of one host are split when they are joined with its store.
HOST_PARTS = 16


def route_table(df: DataFrame, url: str, registry: StoreRegistry, out: str = "store_id", unknown: str | None = None) -> DataFrame:
    """``df`` with the store of its column ``url`` as ``out``: what :meth:`StoreRegistry.route` gives, for many stores.

    A chain of conditions grows with the registry and is tested on every row. Here the registry is a table: each distinct host
    is cut into its pieces of the lengths that domains have, pieces and domains meet in an equality join, and the store
    with the first priority is chosen. Rows then find their host's store; those of one host are split into ``HOST_PARTS`` parts,
    as a host may hold most of them. Every row is kept; a null URL has no store but ``unknown``.
    """
    domains = registry.as_table(df.sparkSession).select(F.lower("domain").alias("_piece"), F.col("store_id").alias("_store"), "priority")
    lengths = F.array(*[F.lit(n) for n in sorted({len(d) for p in registry.plugins() for d in p.domains})])
    keyed = df.withColumn("_host", F.lower(netloc(F.col(url)))).withColumn("_part", F.pmod(F.xxhash64(url), F.lit(HOST_PARTS)))
    hosts = keyed.select("_host").where("_host <> ''").distinct()
    cuts = F.flatten(F.transform(lengths, lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("_host") - n + 1, F.lit(1))), lambda at: F.substr("_host", at, n)
    )))
    pieces = hosts.select("_host", F.explode(F.array_distinct(cuts)).alias("_piece"))
    found = pieces.join(domains, "_piece").groupBy("_host").agg(F.min_by("_store", "priority").alias("_store"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1)).cast("array<bigint>")).alias("_part")
    stored_in = keyed.join(found.select("_host", "_store", parts), ["_host", "_part"], "left")
    store = F.col("_store")
    if "takealot" in registry.store_ids():
        store = F.coalesce(store, F.when(F.col(url).contains("takealot.com"), F.lit("takealot")))
    routed = stored_in.withColumn(out, F.coalesce(store, F.lit(unknown).cast("string")))
    return routed.select(*[c for c in df.columns if c != out], out)


def _any_domain(host: Column, domains: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for domain in domains:
        hit = hit | host.contains(domain.lower())
    return hit

