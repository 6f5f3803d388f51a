"""Page extraction on hand-written pages, lookups, payloads, routing."""

import json

import pytest
from pyspark.sql import functions as F

from offerlens.operators import filters as FL
from offerlens.operators.lookup import lookup_products
from offerlens.operators.routing import AMAZON, TAKEALOT, StorePlugin, StoreRegistry, route_table
from offerlens.plans.search import direct_run
from offerlens.sources.page_tree import PageTree
from offerlens.sources.pages import extract_products, finish
from offerlens.sources.payload import payload_products, payload_rejects

ASIN_URL = "https://www.amazon.co.za/Some-Name/dp/B0DLT1WSHY"
AMAZON_PAGE = """<html><head><title>Ignored : Amazon.co.za</title></head><body>
<div id="wayfinding-breadcrumbs_feature_div"><a> Home </a><a>Pets</a><a>Pets</a></div>
<span id="productTitle"> Nice <b>Tool</b> </span>
<div class="a-price"><span class="a-offscreen">R1 249,00</span></div><span class="a-price"><span class="a-offscreen">R5</span></span>
<span class="a-text-price"><span class="a-offscreen">R1 500,00</span></span>
<i class="a-icon-star"><span class="a-icon-alt">4,5 out of 5</span></i><span id="acrCustomerReviewText">1,234 ratings</span>
<div id="main-image-container"><img src="small.jpg" data-dynamic-image='{"https://m.media-amazon.com/i/a.jpg":[1,2],"b":[3]}'></div>
<div id="altImages"><img src="https://m.media-amazon.com/i/b._AC_US40_.jpg"><img src="https://m.media-amazon.com/sprite.png"><img></div>
<div id="feature-bullets"><ul><li><span class="a-list-item">First bullet</span></li><li><span class="a-list-item">abc</span></li>
<li><span class="a-list-item">Make sure this fits x</span></li></ul></div>
<div id="productOverview_feature_div"><table><tr><td>Brand:</td><td>Acme</td></tr></table><div class="po-row"><span class="po-break-word">Size</span><span class="po-break-word">XL</span></div></div>
<table class="prodDetTable"><tr><th>Brand</th><td>Other</td></tr><tr><th>Ingredients</th><td>‎water, salt</td></tr><tr><td>One</td></tr>
<tr><td class="a-color-secondary">Colour</td><td>Red</td></tr></table>
<div id="detailBullets_feature_div"><ul><li><span class="a-list-item"><span>Unit : Count:</span><span>2 count</span></span></li></ul></div>
<div id="aplus"><table><tr><th>Long</th><td>v</td></tr><tr><th>a</th><td>b</td><td>c</td></tr></table></div>
<div id="aplus_feature_div">From   the <br> brand and more</div>
<div id="productDescription"><p>Product description Directions: Mix. Stir 1.5 times. Wait. Rest. Safety Information: none.</p></div>
<div id="important-information"><h4>Ingredients</h4><p>sugar, milk</p><h4>Directions</h4><p>use it\nwell</p><h4>Legal</h4><p>x</p></div>
<div id="availability"><span>Only 2 left</span></div>
<div id="includedComponents_feature_div"><ul><li>Tool</li><li>Case</li></ul></div>
<div id="merchant-info"><span>Sold by</span><a>Shop X</a></div><i class="a-icon-prime"></i>
<div id="iconfarmv2_feature_div"><span>Free</span><span>10 Days Returnable</span></div>
<div id="social-proofing-faceout-title-tk_bought">50+ bought</div>
<script>var x = "<span id='productTitle'>no</span>";</script>
</body></html>"""

PLID_URL = "https://www.takealot.com/nice/PLID777"
TAKEALOT_PAGE = """<body><h1>Whey</h1><span class="currency plus">1,299</span><del>R 1,500</del>
<div class="star-rating-x">4.8</div><a href="/x#reviews">12 Reviews</a><img src="https://media.takealot.com/covers_images/a.jpg">
<div class="breadcrumbs"><a>Home</a><a>Food</a></div>
<div id="outer"><section><p>Product Information</p><p>Brand</p><p>Acme</p><p>Warranty</p><p>Gender</p><p>Male</p><p>Made: here: now</p>
<table><tr><td>Flavour:</td><td>Vanilla</td></tr><tr><td>a</td><td>b</td><td>c</td></tr></table></section>
<table><tr><td>Flavour</td><td>Mint</td></tr><tr><td>What's in the box</td><td>1 x Tub</td></tr></table></div>
<div class="x-description">Description Good food. Suggested Use: One scoop. Daily. With water. Later. Warning: hot. - creamy taste • rich flavour note</div>
</body>"""


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        (ASIN_URL, AMAZON_PAGE),
        (PLID_URL, TAKEALOT_PAGE),
        ("https://www.amazon.co.za/My-Thing_x/dp/B000000001", "<p>price <span class='a-price-whole'>12.</span><span class='a-price-fraction'>50</span> ZAR"),
        ("https://www.amazon.com/dp/B000000002", ""),
        ("https://www.amazon.com/dp/B000000003", "Type the characters you see in this image"),
        ("https://www.takealot.com/x/PLID5", "<h1>Thing<p>for R 1 200.50 only</h1>"),
        ("https://other.example/dp/B000000004", "<h1>x</h1>"),
    ]
    df = spark.createDataFrame(rows, "url string, html string")
    return {r.url: r for r in extract_products(df, StoreRegistry()).collect()}


def test_first_shop(products):
    p = products[ASIN_URL]
    assert (p.title, p.brand, p.source, p.product_id) == ("NiceTool", "Acme", "Amazon", "B0DLT1WSHY")
    assert (p.price, p.price_numeric, p.original_price_numeric, p.discount_percentage, p.currency) == ("R1 249,00", 1249.0, 1500.0, 17, "ZAR")
    assert (p.rating_numeric, p.review_count_numeric, p.availability, p.social_proof) == (4.5, 1234, "Only 2 left", "50+ bought")
    assert p.breadcrumbs == ["Home", "Pets"] and p.bullet_points == ["First bullet"]
    assert p.gallery_images == ["https://m.media-amazon.com/i/a.jpg", "https://m.media-amazon.com/i/b.jpg"]
    assert [(s.key, s.value) for s in p.specs] == [
        ("Brand", "Acme"), ("Size", "XL"), ("Ingredients", "water, salt"), ("Colour", "Red"), ("Unit  Count", "2 count"), ("Long", "v"),
    ]
    assert p.description.startswith("Directions: Mix.")
    assert p.directions == "use it\nwell"
    assert p.safety_warning == "none"
    assert p.ingredients == "Ingredients: water, salt | sugar, milk"
    assert p.aplus_content == "From the brand and more"
    assert p.whats_in_the_box == ["Tool", "Case"]
    assert tuple(p.seller_info) == ("Shop X", "Shop X", True, "10 Days Returnable")


def test_second_shop(products):
    p = products[PLID_URL]
    assert (p.title, p.brand, p.price, p.price_numeric, p.original_price_numeric) == ("Whey", "Acme", "R 1,299", 1299.0, 1500.0)
    specs = {s.key: s.value for s in p.specs}
    assert specs == {"Flavour": "Mint", "Brand": "Acme", "Gender": "Male", "Made": "here: now", "What's in the box": "1 x Tub"}
    assert p.whats_in_the_box == ["1 x Tub"] and p.breadcrumbs == ["Food"]
    assert p.directions == "One scoop. Daily. With water" and p.safety_warning.startswith("hot")
    assert p.bullet_points == ["creamy taste", "rich flavour note"]
    assert (p.currency, p.rating_numeric, p.review_count_numeric, p.aplus_content) == ("ZAR", 4.8, 12, None)
    assert p.gallery_images == ["https://media.takealot.com/covers_images/a.jpg"]


def test_fallbacks(products):
    slug = products["https://www.amazon.co.za/My-Thing_x/dp/B000000001"]
    assert (slug.title, slug.price, slug.price_numeric) == ("My Thing X", "R12.50", 12.5)
    empty = products["https://www.amazon.com/dp/B000000002"]
    assert (empty.title, empty.price, empty.availability) == ("Amazon Product (B000000002)", "Price unavailable", "Unknown")
    assert "https://www.amazon.com/dp/B000000003" not in products and "https://other.example/dp/B000000004" not in products
    loose = products["https://www.takealot.com/x/PLID5"]
    assert (loose.title, loose.price, loose.price_numeric, loose.brand) == ("Thingfor R 1 200.50 only", "R 1 200.50", 1200.5, "Takealot")


def test_tree_with_unclosed_tags():
    tree = PageTree("<div id=a><p>x<b>y<br>z</div>w<p class='c d'>v</i></p><style>q</style>")
    assert [tree.text(n, "|") for n in tree.select("#a, .c.d")] == ["x|y|z", "v"]
    assert [n.tag for n in tree.select("div > p, div > b")] == ["p"]
    assert tree.pieces == ["x", "y", "z", "w", "v"]


def test_blocked_reason(spark):
    df = spark.createDataFrame([("https://www.amazon.com/dp/B000000003", "Robot Check")], "url string, html string")
    row = extract_products(df, StoreRegistry(), with_reason=True).first()
    assert row.reason == "blocked"


def test_lookup_and_direct_run(spark):
    pages = spark.createDataFrame(
        [("https://www.amazon.co.za/dp/B0DLT1WSHY", AMAZON_PAGE), (PLID_URL, TAKEALOT_PAGE), ("https://www.amazon.co.za/dp/B000000009", "<i>x</i>")],
        "url string, html string",
    )
    texts = ["b0dlt1wshy", ASIN_URL, PLID_URL + "?a=b", "B000000009", "https://www.takealot.com/x/PLID7770", "https://shop.example/x", "two words"]
    inputs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, input string")
    rows = {r.input: r for r in direct_run(inputs, pages, [F.col("n")]).collect()}
    assert set(rows) == {"b0dlt1wshy", PLID_URL + "?a=b", "B000000009", "https://www.takealot.com/x/PLID7770"}
    assert rows["b0dlt1wshy"].title == "NiceTool"
    assert rows["B000000009"].title == "Amazon Product (B000000009)"  # the page holds no product
    assert rows["https://www.takealot.com/x/PLID7770"].price == "Price unavailable"
    cheap = direct_run(inputs, pages, [F.col("n")], high=1260.0)
    assert [r.title for r in cheap.collect()] == ["NiceTool"]
    urls = spark.createDataFrame([("https://www.amazon.co.za/Big-Toy/dp/B000000010", "amazon")], "url string, store_id string")
    lost = lookup_products(urls, pages, StoreRegistry()).first()
    assert (lost.title, lost.brand, lost.specs, lost.price_numeric) == ("Big Toy", "Big", [], None)


def test_payload(spark):
    full = {
        "asin": "B0DLT1WSHY", "title": "T", "rating": 4.5, "ratings_total": 12, "feature_bullets": ["a"],
        "specifications": [{"name": "Brand", "value": "x"}, {"name": "", "value": "y"}],
        "attributes": [{"name": "Brand", "value": "z"}, {"name": "E", "value": ""}],
        "buybox_winner": {"price": {"value": 1299}, "rrp": {"raw": "R 1 500"}, "availability": {"raw": "yes"}},
    }
    df = spark.createDataFrame([(ASIN_URL, json.dumps(full)), (ASIN_URL, "{}"), (ASIN_URL, "not json")], "url string, payload string")
    rows = finish(payload_products(df)).collect()
    assert [(r.price, r.rating, r.review_count, r.availability) for r in rows] == [
        ("R1299", "4.5", "12 ratings", "In Stock"), ("R0.00", "N/A", "0 ratings", "Unknown"), ("R0.00", "N/A", "0 ratings", "Unknown"),
    ]
    assert [(s.key, s.value) for s in rows[0].specs] == [("Brand", "z")]
    assert rows[0].original_price_numeric == 1500.0 and rows[1].product_id == "B0DLT1WSHY"


def test_payloads_that_hold_no_product(spark):
    reasons = {
        None: "empty", " ": "empty", "not json": "no JSON", '{"asin": 1': "no JSON", "7": "no object", "null": "no object", "[{}]": "no object",
        '{"attributes": {"name": "x"}}': "attributes: no list", '{"main_image": "x.jpg"}': "main_image: no object",
        "{}": None, '{"title": null, "attributes": null}': None, '{"title": "a", "title": "b"}': None, '{"other": [1, {"x": "é"}]}': None,
    }
    df = spark.createDataFrame([(ASIN_URL, text) for text in reasons], "url string, payload string")
    assert {r.payload: r.reason for r in payload_rejects(df).collect()} == {k: v for k, v in reasons.items() if v}
    assert payload_products(df, skip_rejects=True).count() == sum(v is None for v in reasons.values())
    assert payload_products(df).count() == len(reasons)


def test_route_table_is_route(spark):
    """Clashing columns, nulls, hosts shorter than domains, and domains within domains."""
    none = lambda u: F.lit(None).cast("string")
    shops = StoreRegistry((AMAZON, TAKEALOT, StorePlugin("long", "Long", ("shop.long.example",), none), StorePlugin("short", "Short", ("g.example", "AB.test"), none)))
    urls = [
        None, "", "text", "see takealot.com", "https://www.amazon.com/x", "http://X.SHOP.LONG.EXAMPLE:80/a", "https://long.example", "https://a", "//ab.test",
        "https://g.example.amazon.co.za/", "https://user@ab.test?x", "https://www.amazon.com/x", "ftp://g.exampl",
    ]
    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "n int, url string, store_id string")
    for unknown in (None, "amazon"):
        wanted = df.select("n", shops.route(F.col("url"), unknown).alias("store_id")).orderBy("n").collect()
        found = route_table(df, "url", shops, unknown=unknown)
        assert found.columns == ["n", "url", "store_id"]
        assert found.select("n", "store_id").orderBy("n").collect() == wanted


def test_registry(spark, evaluate):
    registry = StoreRegistry()
    assert registry.store_ids() == ["amazon", "takealot"] and registry.get(" Amazon ").store_name == "Amazon"
    with pytest.raises(ValueError):
        registry.get("nope")
    urls = ["https://www.amazon.com/dp/B0B8MXPRDB", "https://www.takealot.com/x", "https://www.unknown-domain.com/item/123", "see takealot.com"]
    assert evaluate(registry.route, urls) == ["amazon", "takealot", None, "takealot"]
    assert evaluate(lambda c: registry.route(c, "amazon"), urls)[2] == "amazon"
    registry.register(StorePlugin("unknown", "Unknown", ("unknown-domain.com",), lambda u: F.lit("7")))
    assert evaluate(registry.route, urls)[2] == "unknown"
    assert registry.as_table(spark).count() == 6
    assert evaluate(lambda c: registry.identifier(registry.route(c), c), urls) == ["B0B8MXPRDB", None, "7", None]


def test_validity(spark):
    rows = [
        ("T", "Price unavailable", [], [], ""), ("T", "R1", [], [], ""), ("T", "", [("a", "b")], [], ""),
        (" ", "R1", [], [], "i"), ("Amazon Product (X)", "R1", [], [], "i"), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "title string, price string, specs array<struct<key:string,value:string>>, b array<string>, image string")
    c = F.col
    out = df.select(FL.valid_amazon(c("title"), c("price"), c("specs"), c("b"), c("image")).alias("a"), FL.valid_takealot(c("title"), c("price")).alias("t")).collect()
    assert [r.a for r in out] == [False, True, True, False, False, False]
    assert [r.t for r in out] == [False, True, False, False, True, False]


def test_price_bounds(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (None,)], "p double")
    count = lambda **b: df.where(FL.in_price_range(F.col("p"), **b)).count()
    assert (count(), count(high=5), count(low=2.0), count(low=1.0, high=1.0)) == (3, 2, 1, 1)
