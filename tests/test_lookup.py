"""Page lookup, result pages, rejects and plugin stores."""

import time

import pytest
from pyspark.sql import functions as F

from offerlens.operators.lookup import lookup_products, newest_pages, open_page_store, page_store
from offerlens.operators.routing import AMAZON, TAKEALOT, StorePlugin, StoreRegistry
from offerlens.plans.search import direct_rejects, direct_run
from offerlens.sources.pages import extract_products
from offerlens.sources.anchors import anchors
from offerlens.sources.result_pages import hrefs, page_links
from offerlens.sources.shop_fields import FIELD_TABLES

PAGE = '<html><body><span id="productTitle">{}</span><span class="a-price"><span class="a-offscreen">R{}.00</span></span></body></html>'


@pytest.mark.parametrize("stored", [False, True])
def test_raw_links_meet_and_the_newest_snapshot_counts(spark, stored):
    rows = [
        ("https://www.amazon.co.za/Nice-Lamp/dp/B000000001?ref=x", PAGE.format("New lamp", 20), 5),
        ("https://www.amazon.co.za/dp/B000000001", PAGE.format("Old lamp", 10), 4),
        ("https://www.amazon.co.za/gp/product/B000000001", PAGE.format("Undated lamp", 9), None),
        ("https://www.takealot.com/x/PLID7?src=mail", "<h1>Cup</h1><span class='currency plus'>R 30</span>", 1),
    ]
    pages = spark.createDataFrame(rows, "url string, html string, fetched_at int")
    if stored:
        pages = page_store(pages, StoreRegistry(), buckets=4)
    asked = spark.createDataFrame(
        [("https://www.amazon.co.za/dp/B000000001", "amazon"), ("https://www.takealot.com/x/PLID7", "takealot"), ("https://www.takealot.com/x/PLID8", "takealot")],
        "url string, store_id string",
    )
    found = {r.product_id: r.title for r in lookup_products(asked, pages, StoreRegistry()).collect()}
    assert found == {"B000000001": "New lamp", "PLID7": "Cup", "PLID8": "Takealot Product"}


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_a_lookup_reads_the_buckets_it_needs(spark, tmp_path, broadcast):
    rows = [(f"https://www.takealot.com/x/PLID{i}", f"<h1>Cup {i}</h1>", at) for i in range(200) for at in (1, 2)]
    pages = spark.createDataFrame(rows, "url string, html string, fetched_at int")
    page_store(pages, StoreRegistry(), str(tmp_path / "store"), buckets=64)
    store = open_page_store(spark, str(tmp_path / "store"), "url string, html string, fetched_at int", buckets=64)
    assert store.count() == 400
    canon = StoreRegistry().canonical(F.lit("takealot"), F.col("url"))
    wanted = pages.where("url like '%PLID5' or url like '%PLID77'").select(canon.alias("canon"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = newest_pages(wanted, store, StoreRegistry())
        plan = executed(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.html for r in found.collect()) == ["<h1>Cup 5</h1>", "<h1>Cup 77</h1>"]
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line and "bucket" in line)
    assert "bucket" in scan.split("PartitionFilters:")[1].split("]")[0] and (" IN " in scan or "INSET" in scan)
    # The pages themselves go through no exchange: what is shuffled or broadcast has no html.
    assert not [line for line in plan.split("Initial Plan")[0].splitlines() if "Exchange" in line and "html" in line]


def test_one_product_for_each_input_and_rejects_for_the_rest(spark):
    pages = spark.createDataFrame([("https://www.amazon.co.za/a/dp/B000000001/r", PAGE.format("Lamp", 20)), ("https://www.amazon.co.za/dp/B000000001?x", PAGE.format("Lamp", 20))], "url string, html string")
    inputs = spark.createDataFrame([("B000000001",), ("https://www.amazon.co.za/dp/B000000001?tag=1",), ("https://nowhere.example/1",), ("some words",), (None,)], "input string")
    assert [r.title for r in direct_run(inputs, pages, [F.col("input")]).collect()] == ["Lamp"]
    lost = {r.input: r.reason for r in direct_rejects(inputs).collect()}
    assert lost == {"https://nowhere.example/1": "unknown shop", "some words": "unknown shop", None: "unknown shop"}


def test_plugin_store_with_its_own_selectors(spark):
    own = StorePlugin("tins", "Tins", ("tins.example",), lambda url: F.nullif(F.regexp_extract(url, r"/t(\d+)", 1), F.lit("")), fields=FIELD_TABLES["takealot"])
    registry = StoreRegistry((AMAZON, TAKEALOT, own))
    pages = spark.createDataFrame([("https://tins.example/t5?x=1", "<h1>Tin</h1><span class='currency plus'>R 30</span>")], "url string, html string")
    assert [(r.product_id, r.store_id) for r in extract_products(pages, registry).collect()] == [("5", "tins")]
    inputs = spark.createDataFrame([("https://tins.example/t5",), ("https://tins.example/t5#a",), ("https://tins.example/t6",)], "input string")
    found = {r.product_id: r.title for r in direct_run(inputs, pages, [F.col("input")], registry).collect()}
    assert set(found) == {"5", "6"} and found["6"] == "Tins Product"
    with pytest.raises(ValueError, match="bad"):
        extract_products(pages, StoreRegistry((StorePlugin("bad", "Bad", ("bad.example",), F.upper, selectors="nothing"),)))


def test_links_of_result_pages(spark, evaluate):
    html = (
        '<a href="/first/dp/B000000001?a=1&amp;b=2">x</a><A class=q HREF=\'/gp/product/B000000002\'>y</A><!-- <a href="/dp/B000000003">no</a> -->'
        '<script>var a = \'<a href="/dp/B000000004">\';</script><a data-x="1" href=/dp/B000000005>z</a><a name="top">t</a><abbr href="/dp/B000000006">'
    )
    assert [list(anchors(h)) for h in (html, None, "")] == [["/first/dp/B000000001?a=1&b=2", "/gp/product/B000000002", "/dp/B000000005"], [], []]
    pages = spark.createDataFrame([(1, "amazon", 0, 1, html + '<a href="/help">h</a>'), (1, "takealot", 0, 1, html), (1, "amazon", 0, 2, None)], "run_id int, store_id string, query_idx int, page_num int, html string")
    rows = page_links(pages).orderBy("pos").collect()
    assert [(r.store_id, r.pos) for r in rows] == [("amazon", 0), ("amazon", 1), ("amazon", 2)]


@pytest.mark.parametrize(
    ("html", "found"),
    [
        ("<a title='a>b' href='/1'>", ["/1"]),
        ("<a class='x'href='/1'>", ["/1"]),
        ("<a href='/1?a&#61;2&nbsp;'>", ["/1?a=2\u00a0"]),
        ("<a href=/1?a=1&copy=2&amp;b=3&lt>", ["/1?a=1&copy=2&b=3<"]),
        ("<a\thref = \"/1\"/><a/href=/2><A HREF=/3>", ["/1", "/2", "/3"]),
        ("<a href='/1' href='/2'><a data-href='/3'><a name=x><abbr href='/4'><a href><a href=''>", ["/1", "", ""]),
        ("<a =href=/0 href=/1>", ["/1"]),
        ("<img alt='<a href=/0>'><a href=/1>", ["/1"]),
        ("<!-- <a href=/0> --><!--><a href=/1><!---><a href=/2><!-- --!><a href=/3><!-- <a href=/0>", ["/1", "/2", "/3"]),
        ("<!doctype html><?x <a href=/0><a href=/1></a href=/0><a href=/2", ["/1"]),
        ("<script>'<a href=/0>'</scripty></SCRIPT ><a href=/1><style><a href=/0>", ["/1"]),
        ("<a href=' /1\n/2 '><a href='/3", ["/1/2"]),
        ("a < b <a href=/1> <3 <> <a href=\"/2'>x</a><a href='/0'>\">", ["/1", "/2'>x</a><a href='/0'>"]),
        ("<plaintext><a href=/0>", []),
    ],
)
def test_anchor_forms(html, found):
    assert list(anchors(html)) == found


def test_anchor_scan_is_linear():
    start = time.time()
    for piece in ("<a ", "<a href='", "<", "<!--", "<script>", "<a x=", "&amp", "<a href=/1>", "<a " + "x " * 50):
        sum(1 for _ in anchors(piece * 200_000))
        sum(1 for _ in anchors("<a href='" + piece * 200_000))
    assert time.time() - start < 60


def test_hrefs_keep_other_columns(spark):
    pages = spark.createDataFrame([(1, None, "k"), (2, "<a href=/1><a href=/2>", None)], "id int, html string, note string")
    assert sorted(map(tuple, hrefs(pages).collect())) == [(1, "k", []), (2, None, ["/1", "/2"])]
    assert hrefs(pages.limit(0)).count() == 0


def test_pages_are_never_broadcast(spark):
    """Spark takes a table of pages for small, as its estimate of a text is a few bytes."""
    pages = spark.createDataFrame([("https://www.amazon.co.za/dp/B000000001", PAGE.format("Lamp", 5))], "url string, html string")
    inputs = spark.createDataFrame([("B000000001",)], "input string")
    found = direct_run(inputs, pages, [F.col("input")])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.title, r.price_numeric) for r in found.collect()] == [("Lamp", 5.0)]


def test_a_route_reads_the_url_once(spark):
    r = StoreRegistry()
    df = spark.range(1).select(F.concat(F.lit("https://www.takealot.com/x/PLID"), F.col("id").cast("string")).alias("url")).where(r.route(F.col("url")) == "takealot")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
    assert df.count() == 1
