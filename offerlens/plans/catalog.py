"""Named queries over the test tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from offerlens import adapters as A
from offerlens.functions import identity as I, price as P
from offerlens.functions.sql import register_functions
from offerlens.functions.text import split_terms, strip_u
from offerlens.operators import allocate as AL, classify as C, filters as FL, score as S, sections
from offerlens.operators.ranking import keep_first, top_k
from offerlens.operators.lookup import lookup_products, page_store
from offerlens.operators.routing import AMAZON, TAKEALOT, StorePlugin, StoreRegistry, route_table
from offerlens.plans.search import compare, direct_rejects as direct_rejects_of, direct_run, search_run
from offerlens.sinks import dataset as D
from offerlens.sinks.markdown import markdown_lines
from offerlens.sources import candidates as CA, urls as U
from offerlens.sources.pages import extract_products, finish
from offerlens.sources.payload import payload_products, payload_rejects as payload_rejects_of
from offerlens.sources.result_pages import page_links
from offerlens.storage import new_path, stored
from offerlens.streaming import clicks, watch as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

EXAMPLE_STORES = [
    StorePlugin(f"example_{end}", f"Example {end}", (f"example.{end}",), lambda url: F.nullif(F.regexp_extract(url, r"/(\d+)", 1), F.lit("")))
    for end in ("com", "net", "org")
]
#: A shop that takes part in search runs: its own link rule, address and identifiers; its pages fit a known table.
VILLAGE = StorePlugin(
    "village", "Village", ("village.example",), lambda url: F.nullif(F.regexp_extract(url, r"/item/(\d+)", 1), F.lit("")),
    selectors="takealot", home="https://village.example",
)
SCANNED_AT = "2024-01-01 00:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def registry() -> StoreRegistry:
    return StoreRegistry((AMAZON, TAKEALOT, *EXAMPLE_STORES))


def on_offers(*columns) -> Query:
    return lambda spark, sf: A.offers(spark, sf).select("oid", *columns)


# --- prices, ratings ---------------------------------------------------------------------------


@query
def price_parse(spark, sf):
    return A.offers(spark, sf).select(
        "oid", P.parse_price(F.col("price")).alias("price_numeric"), P.parse_price(F.col("original_price")).alias("original_price_numeric")
    )


@query
def price_display(spark, sf):
    return A.offers(spark, sf).select("oid", P.price_display(F.concat(F.lit("‎ "), "price", F.lit(" "))).alias("price_display"))


@query
def price_loose(spark, sf):
    return A.offers(spark, sf).select("oid", P.parse_price_loose(F.col("price")).alias("price_loose"))


def _shop_address(df: DataFrame) -> DataFrame:
    ends = F.array(*[F.lit(e) for e in ("co.za", "co.uk", "de", "fr", "es", "it", "ca", "com.au", "com")])
    end = F.element_at(ends, (F.col("oid") % 9 + 1).cast("int"))
    text = F.when(F.col("oid") % 7 == 0, F.lit("R 10")).when(F.col("oid") % 7 == 1, F.lit("12 ZAR")).otherwise(F.lit("$ 10"))
    return df.select("oid", F.concat(F.lit("https://www.amazon."), end, F.lit("/dp/"), "product_id").alias("url"), text.alias("html"))


@query
def currency_detect(spark, sf):
    return _shop_address(A.offers(spark, sf)).select("oid", P.detect_currency(F.col("url"), F.col("html")).alias("symbol"))


@query
def currency_code(spark, sf):
    return _shop_address(A.offers(spark, sf)).select(
        "oid", P.currency_code(F.col("url"), P.detect_currency(F.col("url"), F.col("html"))).alias("currency")
    )


@query
def discount_pct(spark, sf):
    low, high = P.parse_price(F.col("price")), P.parse_price(F.col("original_price"))
    return A.offers(spark, sf).select("oid", P.discount_percentage(low, high).alias("discount_percentage"))


@query
def rating_numeric(spark, sf):
    return A.offers(spark, sf).select("oid", P.rating_numeric(F.col("rating")).alias("rating_numeric"))


@query
def review_count_numeric(spark, sf):
    return A.offers(spark, sf).select("oid", P.review_count_numeric(F.col("review_count")).alias("review_count_numeric"))


@query
def rand_prefix(spark, sf):
    bare = F.when(F.col("oid") % 2 == 0, F.ltrim(F.regexp_replace("price", "^R", ""))).otherwise(F.col("price"))
    return A.offers(spark, sf).select("oid", P.rand_prefix(bare).alias("price"))


@query
def split_price(spark, sf):
    whole = F.when(F.col("oid") % 5 != 0, F.concat(F.expr("cast(cents div 100 as string)"), F.lit(".")))
    fraction = F.when(F.col("oid") % 3 != 0, F.lpad(F.expr("cast(cents % 100 as string)"), 2, "0"))
    return A.offers(spark, sf).select("oid", P.split_price(F.lit("R"), whole, fraction).alias("price"))


# --- identity, URLs, text ----------------------------------------------------------------------


@query
def asin_extract(spark, sf):
    text = F.when(F.col("oid") % 5 == 0, F.concat(F.lit(" "), F.lower("product_id"))).otherwise(F.col("href"))
    return A.offers(spark, sf).select("oid", I.extract_asin(text).alias("asin"))


@query
def plid_extract(spark, sf):
    return A.offers(spark, sf).select("oid", I.extract_plid(F.lower("href")).alias("plid"))


@query
def unwrap_url(spark, sf):
    return A.offers(spark, sf).where("store_id = 'amazon'").select("oid", I.unwrap_amazon_url(I.absolute(F.col("href"), I.AMAZON_ZA)).alias("url"))


@query
def takealot_url(spark, sf):
    return A.offers(spark, sf).where("store_id = 'takealot'").select("oid", I.clean_takealot_url(F.col("href")).alias("url"))


@query
def click_url(spark, sf):
    return A.offers(spark, sf).select("oid", I.clicked_url(I.absolute(F.col("href"), I.AMAZON_ZA)).alias("url"))


@query
def unique_key(spark, sf):
    text = F.when(F.col("oid") % 9 == 0, F.col("title")).otherwise(F.col("href"))
    return A.offers(spark, sf).select("oid", I.unique_key(text, F.col("store_id")).alias("unique_key"))


@query
def target_url(spark, sf):
    text = F.when(F.col("oid") % 2 == 0, F.col("product_id")).otherwise(F.col("href"))
    return A.offers(spark, sf).select("oid", I.lookup_url(text).alias("url"))


@query
def title_from_url(spark, sf):
    return A.offers(spark, sf).select("oid", I.title_from_url(I.absolute(F.col("href"), I.AMAZON_ZA)).alias("title"))


@query
def title_escapes(spark, sf):
    """Titles from slugs with whole, bad and cut escapes, and with bytes that are no UTF-8."""
    slug = F.element_at(F.array(*[F.lit(raw) for raw, _ in A.ESCAPED]), (F.col("pk") % len(A.ESCAPED) + 1).cast("int"))
    url = F.concat(F.lit("https://www.amazon.com/"), slug, F.col("oid").cast("string"), F.lit("/dp/B0DLT1WSHY"))
    return A.offers(spark, sf).select("oid", I.title_from_url(url).alias("title"))


@query
def sql_functions(spark, sf):
    """Prices and identifiers by the functions that SQL text can call."""
    register_functions(spark)
    sql = """select oid, parse_price(price) as price_numeric, price_display(price) as price_display, extract_asin(href) as asin,
      extract_plid(href) as plid from {offers}"""
    return spark.sql(sql, offers=A.offers(spark, sf))


@query
def page_title_clean(spark, sf):
    ends = F.element_at(F.array(F.lit(" : Amazon.co.za: Garden"), F.lit(" | amazon.com"), F.lit(""), F.lit(" Robot Check")), (F.col("oid") % 4 + 1).cast("int"))
    return A.offers(spark, sf).select("oid", I.clean_page_title(F.concat("title", ends)).alias("title"))


@query
def image_choice(spark, sf):
    sizes = F.concat(F.lit('{"'), "image_url", F.lit('":[300,300],"https://x/y.jpg":[1,1]}'))
    hires = F.when(F.col("oid") % 3 == 0, F.col("image_url"))
    dynamic = F.when(F.col("oid") % 3 == 1, sizes)
    return A.offers(spark, sf).select("oid", I.choose_image(hires, dynamic, F.lit("https://x/src.jpg")).alias("image_url"))


@query
def gallery(spark, sf):
    links = F.array(F.col("image_url"), F.lit("https://x/other.jpg"), F.concat("image_url", F.lit("?sprite")), F.regexp_replace("image_url", "300", "1500"))
    return A.offers(spark, sf).select("oid", F.array_join(I.clean_gallery(F.lit("https://x/main.jpg"), links), " ").alias("gallery"))


@query
def cell_text(spark, sf):
    from offerlens.sinks.markdown import cell

    return A.offers(spark, sf).select("oid", cell(F.col("title")).alias("title"))


def _turns(spark, sf):
    return A.table(spark, sf, "conversations")


@query
def search_terms(spark, sf):
    terms = I.search_terms(F.array(F.col("text"), F.lit("whey, casein")))
    return _turns(spark, sf).select("conv_id", "turn", F.posexplode(terms).alias("pos", "term"))


@query
def output_name(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", I.output_name(split_terms(F.col("text"))).alias("file_name"))


@query
def text_urls(spark, sf):
    doc = F.col("doc_id").cast("string")
    asin = F.lpad(doc, 10, "0")
    linked = F.concat(
        F.col("text"), F.lit(" see HTTPS://www.amazon.co.za/x/dp/"), asin, F.lit("?a=1\nhttps://www.amazon.com/gp/product/"), asin, F.lit("\thttps://www.amazon.co.za/dp/"), asin
    )
    listed = F.concat(F.col("text"), F.lit("\n"), asin, F.lit(", "), asin, F.lit("\n\nhttps://a.example/x?y=1,"))
    text = F.when(F.col("doc_id") % 3 != 0, linked).otherwise(listed)
    docs = A.table(spark, sf, "documents").select("doc_id", text.alias("text"))
    return U.explode_text_urls(docs)


@query
def url_list(spark, sf):
    """Write inputs as a text file, read them back as a list with one more from the caller."""
    path = new_path(spark, "url-list")
    A.offers(spark, sf).select(F.concat(F.lit("  "), "href", F.lit(" "))).write.text(path)
    return U.read_url_list(spark, path, ["https://www.takealot.com/x/PLID1"]).select("part", "input")


# --- routing, filters --------------------------------------------------------------------------


@query
def route_store(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", registry().route(F.col("url")).alias("store_id"))


@query
def route_offers(spark, sf):
    shop = F.when(F.col("oid") % 10 == 0, F.lit("https://shop.unknown.example/?u=takealot.com")).when(
        F.col("oid") % 10 == 1, F.lit("https://shop.unknown.example/x")
    ).otherwise(F.col("url"))
    r = StoreRegistry()
    return A.offers(spark, sf).select("oid", r.route(shop).alias("store_id"), r.route(shop, "amazon").alias("parser"))


@query
def route_many(spark, sf):
    """Listings under the hosts of some thousand shops, of which some hold another one's domain."""
    none = lambda url: F.lit(None).cast("string")
    shops = [StorePlugin(f"s{k}", f"Shop {k}", (f"s{k}.example",), none) for k in range(3000)]
    shops += [StorePlugin(f"d{k}", f"Digit {k}", (f"{k}.example",), none) for k in range(10)]
    host = F.concat(F.lit("https://WWW.s"), (F.col("pk") * 7 % 4000).cast("string"), F.lit(".example/item/"))
    url = F.when(F.col("oid") % 11 == 0, F.lit("https://other.test/s1.example")).otherwise(F.concat(host, F.col("oid").cast("string")))
    return route_table(A.offers(spark, sf).select("oid", url.alias("url")), "url", StoreRegistry(tuple(shops))).select("oid", "store_id")


@query
def url_matches_store(spark, sf):
    r = registry()
    return A.table(spark, sf, "pages").select("page_id", r.matches("example_com", F.col("url")).alias("is_com"), r.matches("amazon", F.col("url")).alias("is_amazon"))


@query
def store_identifier(spark, sf):
    r = registry()
    return A.table(spark, sf, "pages").select(
        "page_id", r.identifier(r.route(F.col("url")), F.col("url")).alias("product_id"), r.store_name(r.route(F.col("url"))).alias("store_name")
    )


@query
def blocked_pages(spark, sf):
    """All pages, some with a bot check at their end, and an empty page for each."""
    html = F.when(F.col("page_id") % 10 == 3, F.concat("html", F.lit("Robot Check"))).otherwise(F.col("html"))
    pages = A.table(spark, sf, "pages")
    both = pages.select("page_id", html.alias("html")).union(pages.select(-F.col("page_id") - 1, F.lit("")))
    return both.select("page_id", FL.block_reason(F.col("html")).alias("reason"))


@query
def valid_amazon(spark, sf):
    c = F.col
    return A.offers(spark, sf).where("store_id = 'amazon'").select(
        "oid", FL.valid_amazon(c("title"), c("price"), c("specs"), c("bullet_points"), c("image_url")).alias("is_valid")
    )


@query
def valid_takealot(spark, sf):
    return A.offers(spark, sf).where("store_id = 'takealot'").select("oid", FL.valid_takealot(F.col("title"), F.col("price")).alias("is_valid"))


@query
def price_range(spark, sf):
    return A.offers(spark, sf).where(FL.in_price_range(P.parse_price(F.col("price")), 20000, 30000)).select("oid")


@query
def validity_by_store(spark, sf):
    return A.offers(spark, sf).select("oid", StoreRegistry().is_valid(F.col("store_id")).alias("is_valid"))


# --- classification ----------------------------------------------------------------------------


@query
def package_flags(spark, sf):
    return C.with_flags(C.with_text(A.offers(spark, sf))).select(
        "oid", "is_starter", "is_bare", "is_accessory", "is_refill", "requires_existing", "is_appliance"
    )


@query
def package_type(spark, sf):
    return C.analyse(A.offers(spark, sf)).select("oid", "package_type", "device_included", "is_refill_only", "requires_base_device")


@query
def pack_quantity(spark, sf):
    return A.offers(spark, sf).select(
        "oid", C.pack_quantity(F.col("title"), F.col("specs")).alias("pack_quantity"), C.net_volume(F.col("specs")).alias("net_volume")
    )


@query
def claims(spark, sf):
    return C.analyse(A.offers(spark, sf)).select("oid", F.array_join("misleading_claims", "|").alias("claims"))


@query
def alerts(spark, sf):
    return C.classify(A.offers(spark, sf)).select("oid", F.explode_outer("listing_integrity_alerts").alias("alert")).where("alert is not null")


@query
def alert_rollup(spark, sf):
    return C.alert_rollup(C.classify(A.offers(spark, sf)))


# --- inputs, search runs, allocation -----------------------------------------------------------


def _inputs(spark, sf) -> DataFrame:
    """Every listing as an input twice: as a link and, later, as its canonical URL."""
    o = A.offers(spark, sf)
    href = F.col("href")
    full = F.when(F.col("store_id") == "amazon", I.absolute(href, I.AMAZON_ZA)).otherwise(I.absolute(href, I.TAKEALOT))
    later = F.array(F.struct(F.lit(0).alias("part"), full.alias("input")), F.struct(F.lit(1).alias("part"), F.col("url").alias("input")))
    return o.select("oid", "store_id", F.explode(later).alias("i")).select("oid", "store_id", "i.part", "i.input")


@query
def dedupe_first(spark, sf):
    df = U.dedupe_inputs(_inputs(spark, sf), [F.col("part"), F.col("oid")], store_id="store_id")
    return df.select("oid", "part", "unique_key")


@query
def anti_seen(spark, sf):
    o = A.offers(spark, sf)
    known = A.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select((F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("oid"))
    return AL.drop_seen(o.select("oid", "product_id"), known, ["oid"])


@query
def store_split(spark, sf):
    return AL.store_targets(A.runs(spark, sf)).select("run_id", "store_id", "target")


@query
def candidate_links(spark, sf):
    return CA.first_links(A.links(A.offers(spark, sf))).select("run_id", "store_id", "query_idx", "page_num", "pos", "product_id", "url")


@query
def result_links(spark, sf):
    return CA.result_links(A.links(A.offers(spark, sf)), F.lit(30)).select("run_id", "store_id", "query_idx", "rank", "product_id", "url")


def _search(spark, sf, caps=CA.LIVE_CAPS, terms: int = 0) -> DataFrame:
    o = A.offers(spark, sf)
    facts = o.withColumn("price_numeric", P.parse_price(F.col("price"))).select(
        "store_id", "url", "product_id", "title", "price", "price_numeric", "specs", "bullet_points", "image_url"
    )
    return search_run(A.links(o, terms or 3), A.runs(spark, sf, terms), products=facts, caps=caps)


@query
def allocation_uncapped(spark, sf):
    """All stored links count, however many pages and candidates there are."""
    return _search(spark, sf, CA.NO_CAPS).select("run_id", "accept_idx", "store_id", "query_idx", "pass_no", "product_id")


@query
def allocation_many_terms(spark, sf):
    """Runs of one to eight search terms."""
    return _search(spark, sf, CA.NO_CAPS, 8).select("run_id", "accept_idx", "store_id", "query_idx", "pass_no", "product_id")


@query
def result_page_links(spark, sf):
    """Links read back from result pages written as HTML."""
    return page_links(A.result_pages(A.links(A.offers(spark, sf)))).select("run_id", "store_id", "query_idx", "page_num", "pos", "href")


@query
def result_page_forms(spark, sf):
    """Links read back from result pages whose anchors are written in many ways."""
    return page_links(A.odd_result_pages(A.links(A.offers(spark, sf)))).select("run_id", "store_id", "query_idx", "page_num", "pos", "href")


@query
def search_pages(spark, sf):
    """The whole path: result pages, their links, product pages, extraction, filters, allocation."""
    found = page_links(A.result_pages(A.links(A.part_listings(spark, sf))))
    accepted = search_run(found, A.runs(spark, sf), pages=A.shop_pages(spark, sf))
    return accepted.select("run_id", "accept_idx", "store_id", "query_idx", "pass_no", "product_id", "title", "price")


def _three_shops() -> StoreRegistry:
    return StoreRegistry((AMAZON, TAKEALOT, VILLAGE))


@query
def three_shops(spark, sf):
    """The whole path for three shops, the third one a plugin: result pages, links, product pages, filters, allocation."""
    shops = _three_shops()
    found = page_links(A.result_pages(A.links(A.three_shop_listings(spark, sf))), shops)
    accepted = search_run(found, A.three_shop_runs(spark, sf), pages=A.three_shop_pages(spark, sf), registry=shops)
    return accepted.select("run_id", "accept_idx", "store_id", "query_idx", "pass_no", "product_id", "title", "price")


@query
def three_shop_counts(spark, sf):
    """How the runs' limits are split over three shops, and the shops asked for that nobody knows."""
    asked = A.three_shop_runs(spark, sf)
    given = AL.store_targets(asked, _three_shops()).select("run_id", "store_id", "target", F.lit(None).cast("string").alias("reason"))
    lost = AL.run_rejects(asked, _three_shops()).select("run_id", F.col("shop").alias("store_id"), F.lit(None).cast("int").alias("target"), "reason")
    return given.unionByName(lost)


@query
def link_rejects(spark, sf):
    """Links of three shops that a search run of the first two can't use, with the reason; some lead to no product."""
    found = A.links(A.three_shop_listings(spark, sf))
    found = found.withColumn("href", F.when(F.col("pos") % 7 == 0, F.lit("/help")).otherwise(F.col("href")))
    return CA.link_rejects(found).select("run_id", "store_id", "query_idx", "page_num", "pos", "reason")


@query
def quota_pass(spark, sf):
    return _search(spark, sf).where("pass_no = 1").select("run_id", "store_id", "query_idx", "product_id")


@query
def rollover(spark, sf):
    return _search(spark, sf).where("pass_no = 2").select("run_id", "store_id", "query_idx", "product_id")


@query
def allocation_full(spark, sf):
    return _search(spark, sf).select("run_id", "accept_idx", "store_id", "query_idx", "pass_no", "product_id")


@query
def run_counts(spark, sf):
    return AL.run_counts(_search(spark, sf))


@query
def flagship(spark, sf):
    """A whole search run: links, candidates, filters, allocation, and the accepted products; all stored links count."""
    return _search(spark, sf, CA.NO_CAPS).select(
        "run_id", "accept_idx", "store_id", "product_id", "title", "price", "price_numeric", F.size("specs").alias("spec_count")
    )


@query
def top_offers(spark, sf):
    """The ten cheapest priced listings of every store."""
    o = A.offers(spark, sf).withColumn("price_numeric", P.parse_price(F.col("price"))).where("price_numeric is not null")
    return top_k(o, ["store_id"], [F.col("price_numeric"), F.col("oid")], 10, ["oid"]).select("store_id", "rn", "product_id", "price_numeric")


@query
def multi_store_union(spark, sf):
    o = C.with_text(A.offers(spark, sf))
    amazon = o.where("store_id = 'amazon'").select("oid", "store_id", F.col("product_id").alias("asin"))
    takealot = o.where("store_id = 'takealot'").select("oid", "store_id", F.col("product_id").alias("plid"))
    return AL.union_stores(amazon, takealot)


# --- comparison --------------------------------------------------------------------------------


def _scored(spark, sf) -> DataFrame:
    return S.score(A.comparisons(A.offers(spark, sf)))


@query
def price_extremes(spark, sf):
    df = A.comparisons(A.offers(spark, sf)).withColumn("price_val", P.parse_price_loose(F.col("price")))
    return S.price_extremes(df)


@query
def context_bonus(spark, sf):
    df = A.comparisons(A.offers(spark, sf))
    return df.select("product_id", S.context_bonus(F.col("user_context"), F.col("specs"), F.col("bullet_points")).alias("context_bonus"))


@query
def scores(spark, sf):
    return _scored(spark, sf).select(
        "comparison_id", "product_id", "specs_score", "value_score", "rating_val", "performance_score", "build_score", "overall_score"
    )


@query
def strict_scores(spark, sf):
    df = S.score(A.comparisons(A.offers(spark, sf)), price_source="strict", exclude_unpriced=True)
    return df.select("comparison_id", "product_id", "value_score", "overall_score")


@query
def pros_cons(spark, sf):
    return _scored(spark, sf).select("product_id", F.array_join("pros", "\n").alias("pros"), F.array_join("cons", "\n").alias("cons"))


@query
def ranking(spark, sf):
    scored = _scored(spark, sf).select("comparison_id", "idx", "product_id", "overall_score")
    return S.rank_scored(scored).select("comparison_id", "position", "product_id", "overall_score")


@query
def winner(spark, sf):
    return S.verdicts(_scored(spark, sf)).select("comparison_id", "winner_id", "winner_score")


@query
def best_value(spark, sf):
    return S.verdicts(_scored(spark, sf)).select("comparison_id", "best_value_id", "best_value_score")


@query
def verdict(spark, sf):
    """Every part asks for a comparison; parts nobody sells get the fixed message."""
    asked = A.table(spark, sf, "part").select(F.col("p_partkey").alias("comparison_id")).union(spark.range(1).select(F.lit(-1).cast("bigint")))
    done = compare(A.comparisons(A.offers(spark, sf)))[1]
    return S.with_empty_sets(done, asked).select("comparison_id", "winner_title", "best_value_title", "recommendation_reason", "verdict_summary")


def _sparse(spark, sf) -> DataFrame:
    return S.score(A.sparse(A.comparisons(A.offers(spark, sf))))


@query
def scores_sparse(spark, sf):
    """Scores of listings that lack titles, prices, specs, bullets, ratings or identifiers."""
    return _sparse(spark, sf).select("comparison_id", "idx", "product_id", "specs_score", "value_score", "rating_val", "overall_score")


@query
def pros_cons_sparse(spark, sf):
    return _sparse(spark, sf).select("comparison_id", "idx", F.array_join("pros", "\n").alias("pros"), F.array_join("cons", "\n").alias("cons"))


@query
def verdict_sparse(spark, sf):
    asked = A.table(spark, sf, "part").select((F.col("p_partkey") * 2).alias("comparison_id"))
    done = S.verdicts(_sparse(spark, sf))
    return S.with_empty_sets(done, asked).select("comparison_id", "winner_id", "winner_title", "best_value_title", "recommendation_reason", "verdict_summary")


# --- pages, payloads, sections -----------------------------------------------------------------


@query
def ingredients_text(spark, sf):
    c = F.col
    return A.offers(spark, sf).select(
        "oid", sections.ingredients(F.lit(None).cast("string"), c("description"), c("bullet_points"), c("specs")).alias("ingredients")
    )


@query
def directions_text(spark, sf):
    none = F.lit(None).cast("string")
    return A.offers(spark, sf).select(
        "oid",
        sections.directions(none, F.col("description")).alias("directions"),
        sections.safety_warning(none, F.col("description")).alias("safety_warning"),
        sections.suggested_use(F.col("description")).alias("suggested_use"),
        sections.disclaimer(F.col("description")).alias("disclaimer"),
    )


@query
def document_sections(spark, sf):
    """Ingredient and direction statements in the whole documents."""
    c = F.col("text")
    empty = F.array().cast("array<string>")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(c, F.lit(" Ingredients: salt, "), F.col("lang"), F.lit(". Directions: stir. Wait."))).otherwise(c)
    return A.table(spark, sf, "documents").select(
        "doc_id",
        sections.ingredients(F.lit(None).cast("string"), text, empty, F.array().cast("array<struct<key:string,value:string>>")).alias("ingredients"),
        F.length(sections.directions(F.lit(None).cast("string"), text)).alias("directions_length"),
    )


@query
def api_payload(spark, sf):
    o = A.offers(spark, sf)
    named = F.transform("specs", lambda s: F.struct(s["key"].alias("name"), s["value"].alias("value")))
    payload = F.struct(
        F.col("product_id").alias("asin"),
        "title",
        F.when(F.col("oid") % 4 == 0, F.lit(None)).otherwise(F.lit(4.5)).alias("rating"),
        F.col("sk").alias("ratings_total"),
        F.col("bullet_points").alias("feature_bullets"),
        named.alias("specifications"),
        F.array(
            F.struct(F.lit("Brand").alias("name"), F.lit("Overlay").alias("value")), F.struct(F.lit("Empty").alias("name"), F.lit("").alias("value"))
        ).alias("attributes"),
        F.struct(
            F.struct(F.when(F.col("oid") % 3 != 0, F.col("price")).alias("raw"), F.expr("cents div 100").alias("value")).alias("price"),
            F.struct(F.nullif("original_price", F.lit("")).alias("raw")).alias("rrp"),
            F.struct(F.when(F.col("oid") % 5 != 0, F.lit("In stock.")).alias("raw")).alias("availability"),
        ).alias("buybox_winner"),
    )
    df = finish(payload_products(o.select("url", F.to_json(payload).alias("payload"))))
    return df.select(
        "product_id", "title", "price", "price_numeric", "original_price", "rating", "review_count_numeric", "availability",
        F.array_join(F.transform("specs", lambda s: F.concat_ws("=", s["key"], s["value"])), ";").alias("specs"),
        F.col("package_details.package_type").alias("package_type"),
    )


@query
def payload_rejects(spark, sf):
    """Payloads of which most can't be read, in one way or another: the products that are left, and the reason of the others."""
    payload = F.element_at(F.array(*[F.lit(text) for text, _ in A.PAYLOADS]), (F.col("pk") % len(A.PAYLOADS) + 1).cast("int"))
    df = A.offers(spark, sf).select("url", F.replace(payload, F.lit("@"), F.col("product_id")).alias("payload"))
    kept = finish(payload_products(df, skip_rejects=True)).select("url", "product_id", "title", F.lit(None).cast("string").alias("reason"))
    lost = payload_rejects_of(df).select("url", F.lit(None).cast("string").alias("product_id"), F.lit(None).cast("string").alias("title"), "reason")
    return kept.unionByName(lost)


@query
def page_extract(spark, sf):
    """Products of the shop pages of all parts."""
    df = extract_products(A.shop_pages(spark, sf), StoreRegistry())
    return df.select(
        "source", "product_id", "title", "brand", "price", "price_numeric", "currency", "rating_numeric", "review_count_numeric",
        "availability", "description", "directions", F.array_join("breadcrumbs", ">").alias("breadcrumbs"),
        F.array_join("bullet_points", "|").alias("bullets"),
        F.array_join(F.transform("specs", lambda s: F.concat_ws("=", s["key"], s["value"])), ";").alias("specs"),
        F.col("package_details.package_type").alias("package_type"), F.size("listing_integrity_alerts").alias("n_alerts"),
        F.col("seller_info.seller").alias("seller"), "url",
    )


@query
def page_fields(spark, sf):
    """Original prices, images, rich text, box contents, sellers, returns and popularity of pages, empty ones too."""
    df = extract_products(A.full_pages(spark, sf), StoreRegistry())
    return df.select(
        "product_id", "title", "original_price", "image_url", F.array_join("gallery_images", " ").alias("gallery"), "availability",
        "important_information", "aplus_content", F.array_join("whats_in_the_box", "|").alias("box"), F.col("seller_info.seller").alias("seller"),
        F.col("seller_info.shipper").alias("shipper"), F.col("seller_info.is_prime").alias("is_prime"),
        F.col("seller_info.return_policy").alias("return_policy"), "social_proof",
    )


@query
def page_products(spark, sf):
    """Titles of the stored web pages read as three plugin stores."""
    df = extract_products(A.table(spark, sf, "pages").select("url", "html"), registry())
    return df.select("url", "store_id", "title", "price", "price_numeric", "availability")


@query
def page_lookup(spark, sf):
    """Links of all listings looked up among the pages; most are missing and get placeholders."""
    pages = A.shop_pages(spark, sf)
    part = F.col("pk").cast("string")
    url = F.when(F.col("pk") % 2 == 0, F.concat(F.lit("https://www.amazon.co.za/dp/"), F.lpad(part, 10, "0"))).otherwise(
        F.concat(F.lit("https://www.takealot.com/x/PLID"), part)
    )
    asked = A.offers(spark, sf).select(F.when(F.col("sk") % 2 == 0, url).otherwise(F.col("url")).alias("url"))
    r = StoreRegistry()
    found = lookup_products(asked.withColumn("store_id", r.route(F.col("url"))), pages, r)
    return found.select("url", "store_id", "product_id", "title", "price", "brand")


@query
def page_lookup_snapshots(spark, sf):
    """The same lookup among pages stored under raw links, each with an older snapshot under its plain one."""
    pages = A.shop_pages(spark, sf)
    raw = F.when(F.col("url").contains("takealot"), F.concat("url", F.lit("?src=mail"))).otherwise(
        F.concat(F.regexp_replace("url", "/dp/", "/Nice-Lamp/dp/"), F.lit("/ref=x?psc=1"))
    )
    newer = pages.select(raw.alias("url"), "html", F.lit(2).alias("fetched_at"))
    older = pages.select("url", F.lit("<p>an older page</p>").alias("html"), F.lit(1).alias("fetched_at"))
    store = page_store(newer.unionByName(older), StoreRegistry(), buckets=64)
    part = F.col("pk").cast("string")
    url = F.when(F.col("pk") % 2 == 0, F.concat(F.lit("https://www.amazon.co.za/dp/"), F.lpad(part, 10, "0"))).otherwise(
        F.concat(F.lit("https://www.takealot.com/x/PLID"), part)
    )
    asked = A.offers(spark, sf).select(F.when(F.col("sk") % 2 == 0, url).otherwise(F.col("url")).alias("url"))
    r = StoreRegistry()
    found = lookup_products(asked.withColumn("store_id", r.route(F.col("url"))), store, r)
    return found.select("url", "store_id", "product_id", "title", "price", "brand")


@query
def direct_rejects(spark, sf):
    """Direct inputs that no shop can be found for, with the reason."""
    text = F.when(F.col("oid") % 3 == 0, F.concat(F.lit("https://nowhere.example/"), "product_id")).when(
        F.col("oid") % 3 == 1, F.concat(F.lit("free text "), "title")
    ).otherwise(F.col("url"))
    return direct_rejects_of(A.offers(spark, sf).select("oid", text.alias("input"))).select("oid", "input", "reason")


@query
def direct_products(spark, sf):
    """All listings' links and all page URLs given as direct inputs."""
    pages = A.shop_pages(spark, sf)
    inputs = pages.select(F.lit(0).alias("part"), F.col("url").alias("input")).unionByName(
        A.offers(spark, sf).select(F.lit(1).alias("part"), F.when(F.col("oid") % 3 == 0, F.lit("https://nowhere.example/x")).otherwise(F.col("url")).alias("input"))
    )
    df = direct_run(inputs, pages, [F.col("part"), F.col("input")])
    return df.select("input", "store_id", "unique_key", "product_id", "title", "price_numeric")


# --- sinks -------------------------------------------------------------------------------------


def _reports(spark, sf) -> DataFrame:
    """Every search run as one report of its accepted products."""
    o = A.offers(spark, sf)
    facts = o.withColumn("price_numeric", P.parse_price(F.col("price"))).drop("href", "aplus_content", "pk", "sk", "oid", "cents")
    found = search_run(A.links(o), A.runs(spark, sf), products=facts, caps=CA.LIVE_CAPS)
    # What the report alone shows is made of accepted products.
    found = found.withColumns(
        {
            "source": F.initcap("store_id"),
            "brand": F.coalesce(C.first_spec(F.col("specs"), ["Brand"]), F.lit("")),
            "availability": F.lit("In Stock"),
            "ingredients": F.lit("Not specified on main detail page"),
            "directions": sections.suggested_use(F.col("description")),
            "safety_warning": F.lit(""),
        }
    )
    return found.withColumnsRenamed({"run_id": "report_id", "accept_idx": "idx"})


@query
def markdown_report(spark, sf):
    return markdown_lines(_reports(spark, sf), F.lit(SCANNED_AT)).select("report_id", "section", "idx", "line", "text")


@query
def markdown_files(spark, sf):
    """Reports written by a name that ends in ``.md``, read back line by line."""
    path = new_path(spark, "reports") + ".md"
    D.export(_reports(spark, sf), path, F.lit(SCANNED_AT))
    return spark.read.text(path).select(F.col("report_id").cast("bigint").alias("report_id"), F.col("value").alias("text"))


@query
def rewritten_runs(spark, sf):
    """Results of all runs stored, then those of every other run stored again with other content and once more."""
    path = new_path(spark, "runs")
    found = stored(_search(spark, sf).select("run_id", "accept_idx", "store_id", "query_idx", "pass_no", "product_id"), "found")
    D.rewrite_runs(found, path)
    D.rewrite_runs(found.where("run_id % 2 = 0 and accept_idx = 1"), path)
    D.rewrite_runs(found.where("run_id % 2 = 0"), path)
    return spark.read.schema(found.schema).parquet(path).select(*found.columns)


@query
def json_document(spark, sf):
    """The single-document form, written as text parts and read back as one line count per report."""
    path = new_path(spark, "reports")
    D.export(_reports(spark, sf), path, F.lit(SCANNED_AT))
    lines = spark.read.text(path)
    return lines.groupBy("report_id").agg(
        F.count(F.when(F.col("value").contains('"product_id"'), 1)).alias("products"),
        F.count(F.when(F.col("value").contains('"metadata"'), 1)).alias("heads"),
    ).select(F.col("report_id").cast("bigint").alias("report_id"), "products", "heads")


@query
def json_dataset(spark, sf):
    """Products of the shop pages written as a dataset and read back."""
    path = new_path(spark, "dataset")
    D.write_dataset(extract_products(A.shop_pages(spark, sf), StoreRegistry()), path, F.lit(SCANNED_AT))
    back = D.read_dataset(spark, path)
    return back.select("product_id", "title", "price_numeric", F.size("specs").alias("n_specs"), "package_details.package_type")


# --- streams -----------------------------------------------------------------------------------


# Files that a stream's batch reads.
_FILES = 8


@query
def click_replay(spark, sf):
    return clicks.replay(clicks.clean_clicks(A.click_log(spark, sf)))


@query
def click_stream(spark, sf):
    """The click log replayed as a stream of five batches or more, each user's events in order of the log."""
    log, out = new_path(spark, "clicks"), new_path(spark, "lists")
    source = clicks.clean_clicks(A.click_log(spark, sf))
    edges = source.approxQuantile("seq", [0.2, 0.4, 0.6, 0.8], 0.01) or [0] * 4
    fifth = sum(F.when(F.col("seq") > edge, 1).otherwise(0) for edge in edges)
    for i in range(5):  # files of one step hold whole users, so any cut between batches keeps their order
        source.where(fifth == i).repartition("user_id").write.mode("append").parquet(log)
    files = len(spark.read.schema(source.schema).parquet(log).inputFiles())
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", max(1, files // 5)).parquet(log)
    q = clicks.collect_stream(stream, out, new_path(spark, "state"))
    q.awaitTermination()
    assert q.lastProgress["batchId"] >= 4 and clicks.late_clicks(spark, out).isEmpty()
    return clicks.latest_lists(spark, out)


@query
def click_rejects(spark, sf):
    """Events of the log that name no click on a product, with the reason."""
    return clicks.click_rejects(A.click_log(spark, sf)).select("user_id", "seq", "action", "reason")


@query
def watch_stream(spark, sf):
    """Watched lists of page URLs, each file read as one batch."""
    pages = A.shop_pages(spark, sf)
    folder, out = new_path(spark, "watched"), new_path(spark, "products")
    urls = pages.select(F.concat(F.col("url"), F.lit(" ")).alias("value"))
    urls.repartition(3 * _FILES).write.text(folder)
    pages = page_store(pages, StoreRegistry(), buckets=64)
    stream = W.clean_lines(spark.readStream.option("maxFilesPerTrigger", _FILES).text(folder))
    q = W.watch(stream, pages, out, new_path(spark, "state"))
    q.awaitTermination()
    assert q.lastProgress["batchId"] >= 2
    return spark.read.parquet(out).select("product_id", "title", "price", "url")


@query
def watch_saved_again(spark, sf):
    """Lists of page URLs in folders; two are saved again between polls, with other pages, and drop their old products."""
    pages = A.shop_pages(spark, sf)
    folder, out = new_path(spark, "lists"), new_path(spark, "polls")
    number = F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint") % 40
    listed = pages.select("url", F.floor(number / 10).alias("list"), (number % 10).alias("part"))
    save = lambda rows, mode: rows.select("list", F.col("url").alias("value")).write.mode(mode).partitionBy("list").text(folder)
    store = page_store(pages, StoreRegistry(), buckets=64)
    name = F.regexp_extract("path", "/list=([0-9]+)/", 1)
    save(listed.where("part < 6"), "append")
    W.poll_lists(spark, folder, store, out, 0, name)
    again = listed.where("list in (1, 2) and part >= 3")
    for n in (1, 2):
        again.where(F.col("list") == n).select(F.col("url").alias("value")).write.mode("overwrite").text(f"{folder}/list={n}")
    W.poll_lists(spark, folder, store, out, 1, name)
    W.poll_lists(spark, folder, store, out, 2, name)
    return W.latest_products(spark, out).select("list", "product_id", "title", "price", "url")


@query
def stream_dedupe(spark, sf):
    """Inputs that arrive in several files, each product once over the whole stream."""
    source, out = new_path(spark, "inputs"), new_path(spark, "unique")
    df = _inputs(spark, sf).select(F.col("input").alias("value"))
    df.repartition(3 * _FILES).write.text(source)
    unique = W.dedupe_stream(W.clean_lines(spark.readStream.option("maxFilesPerTrigger", _FILES).text(source)))
    q = (
        unique.select("store_id", "unique_key")
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", new_path(spark, "state"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    assert q.lastProgress["batchId"] >= 2
    return spark.read.schema("store_id string, unique_key string").parquet(out)


@query
def stream_dedupe_bounded(spark, sf):
    """Inputs of four days, each seen twice a day, as four batches: what a day leaves behind is gone two days later.

    A batch is compared with the state that the batch before left, so inputs of the second and fourth day are repeats; those of
    the third count anew. The last two batches also bring inputs that are too late and are left out.
    """
    source, out, state = (new_path(spark, n) for n in ("inputs", "unique", "state"))
    schema, sizes, late = "value string, at timestamp, day int", [], 0
    rows = stored(_inputs(spark, sf).select(F.col("input").alias("value"), "part", "oid"), "day-inputs")  # read on each of the days
    at = lambda day: F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(day), F.col("part"))
    for day in range(4):
        today = rows.select("value", at(day).alias("at"), F.lit(day).alias("day"))
        old = rows.where("oid % 5 = 0").select("value", at(max(day - 2, 0)).alias("at"), F.lit(-1).alias("day"))
        (today.unionByName(old) if day > 1 else today).write.mode("append").parquet(source)
        inputs = W.clean_lines(spark.readStream.schema(schema).parquet(source))
        q = (
            W.dedupe_stream(inputs, event_time="at", delay="2 hours").select("store_id", "unique_key", "day")
            .writeStream.option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        states = [s for p in q.recentProgress for s in p["stateOperators"]]
        sizes.append(max(s["numRowsTotal"] for s in states))
        late += sum(s["numRowsDroppedByWatermark"] for s in states)
    assert max(sizes) == sizes[0] and late == 2 * rows.where("oid % 5 = 0").count(), (sizes, late)
    return spark.read.schema("store_id string, unique_key string, day int").parquet(out)
