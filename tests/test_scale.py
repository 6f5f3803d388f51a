"""What findings on disk and time were about: how much is made, shuffled and stored for a result."""

import glob

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from conftest import TINY
from offerlens.functions.text import specs_last_wins
from offerlens.operators import allocate as AL
from offerlens.operators.filters import likely_among
from offerlens.plans.search import direct_run
from offerlens.sinks.dataset import json_lines, json_parts
from offerlens.sinks.markdown import markdown_lines, markdown_parts, write_lines
from offerlens.sources import candidates as CA
from offerlens.sources.pages import raw_fields
from offerlens.sources.shop_fields import FIELD_TABLES
from offerlens.storage import new_path, shared_folder

LINK = "run_id int, store_id string, query_idx int, page_num int, pos int, href string"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def links(spark, pages=3, per_page=4):
    rows = [(r, s, q, p, i, f"/x/PLID{p * 10 + i}" if s == "takealot" else f"/dp/B{p:04d}{i:05d}")
            for r in (1, 2) for s in ("amazon", "takealot") for q in (0, 1) for p in range(1, pages + 1) for i in range(per_page)]
    rows += [(1, "amazon", 0, 2, 9, "https://www.amazon.com/dp/B000100000"), (1, "takealot", 0, 3, 9, "/y/PLID10")]
    return spark.createDataFrame(rows, LINK)


def test_pages_behind_enough_links_are_left_out(spark):
    first = CA.first_links(links(spark))
    pages = lambda df: {r.page_num for r in df.where("run_id = 2").select("page_num").distinct().collect()}
    assert pages(CA.before_dry_page(first)) == {1, 2, 3}
    assert pages(CA.before_dry_page(first, F.lit(5))) == {1, 2}
    assert pages(CA.before_dry_page(first, F.lit(8))) == {1, 2}
    ranked = CA.result_links(links(spark), F.lit(5)).where("run_id = 2 and store_id = 'takealot' and query_idx = 0")
    assert [(r["rank"], r.product_id) for r in ranked.orderBy("rank").collect()] == [(1, "PLID10"), (2, "PLID11"), (3, "PLID12"), (4, "PLID13"), (5, "PLID20")]


def test_key_filter_reaches_the_rows_below_an_aggregate(spark):
    df = spark.range(1000).groupBy((F.col("id") % 500).alias("k")).agg(F.max("id").alias("m"))
    kept = likely_among(df, spark.createDataFrame([(3,), (7,), (None,)], "k bigint"), ["k"])
    plan = optimized(kept)
    assert plan.index("Aggregate") < plan.index("scalar-subquery")
    rows = {r.k: r.m for r in kept.collect()}
    assert rows[3] == 503 and rows[7] == 507 and len(rows) < 250


def test_large_terms_are_parted_with_the_same_rows(spark, monkeypatch):
    rows = [(1, "amazon", q, 1 + i // 10, i, f"u{i}-{q}", f"p{i % 23}", 7, 2, i % 3 > 0) for q in (0, 1) for i in range(40)]
    schema = "run_id int, store_id string, query_idx int, page_num int, pos int, url string, product_id string, target int, n_queries int, eligible boolean"
    found = []
    for most in (1 << 16, 5):
        monkeypatch.setattr(AL, "LARGE_TERM", most)
        found.append(sorted(map(str, AL.within_reach(spark.createDataFrame(rows, schema)).collect())))
    assert found[0] == found[1] and found[0]


def test_ranking_stores_what_it_returns_only(spark):
    tables = lambda: set(glob.glob(f"{shared_folder(spark)}/scored-*"))
    before = tables()
    entry_points.queries()["ranking"](spark, TINY)
    (path,) = tables() - before
    assert set(spark.read.parquet(path).columns) == {"comparison_id", "idx", "product_id", "overall_score"}


def test_capped_prefix_is_parted_by_one_shuffle_for_first_links_and_ranks(spark):
    keyed = CA.first_links(links(spark), CA.LIVE_CAPS, salt=True)
    plain = CA.first_links(links(spark), CA.LIVE_CAPS)
    assert sorted(map(str, keyed.drop("_salt").collect())) == sorted(map(str, plain.collect()))
    targets = spark.createDataFrame([(1, "amazon", 2, 3), (2, "takealot", 2, 3)], "run_id int, store_id string, n_queries int, target int")
    cut = AL.candidate_prefix(links(spark), targets, CA.LIVE_CAPS, few_runs=True)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(run_id") == 3  # parts, whole terms, and the few asked shops


PRODUCTS = "report_id int, idx int, store_id string, source string, product_id string, title string, description string, bullet_points array<string>, specs array<struct<key:string,value:string>>"


@pytest.mark.parametrize("parts, lines", [(json_parts, json_lines), (markdown_parts, markdown_lines)])
def test_documents_are_shuffled_as_whole_texts(spark, parts, lines):
    columns = "brand price rating review_count availability url original_price ingredients directions safety_warning".split()
    rows = [(r, i, "amazon", "Amazon", f"P{i}", "Two\nlines", "a\n\nb", ["x", "y"], [("k", "v")]) for r in (1, 2) for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, PRODUCTS).withColumns({c: F.lit("-") for c in columns})
    path = new_path(spark, "documents")
    write_lines(parts(df, F.lit("2024-01-01")), path)
    wanted = [r.text for r in lines(df, F.lit("2024-01-01")).where("report_id = 2").orderBy("section", "idx", "line").collect()]
    text = "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/report_id=2/part-*")))
    assert text == "".join(f"{line}\n" for line in wanted)


def test_last_values_are_found_without_a_pass_over_all_entries_for_each_key(spark):
    rows = [([("a", "1"), ("b", "2"), ("a", "3"), ("c", None), ("b", "")],), ([],), (None,)]
    df = spark.createDataFrame(rows, "specs array<struct<key:string,value:string>>").select(specs_last_wins(F.col("specs")).alias("s"))
    assert "filter(" not in optimized(df.repartition(1)).lower()
    found = [r.s and [tuple(e) for e in r.s] for r in df.collect()]
    assert found == [[("a", "3"), ("b", ""), ("c", None)], [], None]


def test_missing_pages_pass_the_reader_without_being_parsed(spark):
    pages = spark.createDataFrame([("u1", "amazon", ""), ("u2", "takealot", ""), ("u3", "amazon", "<h1>Lamp</h1>")], "url string, selectors string, html string")
    raw = raw_fields(pages, FIELD_TABLES)
    assert "MapInArrow" in raw._jdf.queryExecution().executedPlan().toString()
    rows = {r.url: r for r in raw.collect()}
    assert rows["u1"].title_text is None and rows["u1"].spec_rows == [] and rows["u1"].error is None and rows["u3"].h1_text == "Lamp"


def test_direct_inputs_are_derived_once(spark):
    pages = spark.createDataFrame([("https://www.amazon.co.za/dp/B000000001", "<span id='productTitle'>Lamp</span>")], "url string, html string")
    inputs = spark.createDataFrame([("https://www.amazon.co.za/x/dp/B000000001?a",), ("B000000001",)], "input string")
    found = direct_run(inputs, pages, [F.col("input")])
    assert "windowspecdefinition(unique_key" not in optimized(found)
    assert [r.product_id for r in found.collect()] == ["B000000001"]
