"""Product listings derived from the given test tables.

The listing table is written once as SQL that Spark and DuckDB both read, so the checks compare the
operators and not two versions of the test data. ``[[a|b]]`` stands for integer division and
``[[base36]]`` for the base-36 form of the listing number, both written differently by the engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from offerlens.operators.ranking import spread

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

TITLE_ENDINGS = [
    " Starter Kit with Charger and Battery",
    " 18V Drill Bare Tool (Body Only)",
    " Protective Case for Phone",
    " Liquid Refill Twin Pack, 2 x 33 ml",
    " Electric Mosquito Lamp",
    " Water Filter 3 Pack",
    " Oil Diffuser Bottle 6 pack",
    " 4 Pack Towels",
    " Camera Body with 18-55mm lens",
    " Wall Mount compatible with Monitor",
    " Clamp | Strap Set",
    " Café Coffee Pods 12pack",
    " Résumé Paper",
    "",
    " Espresso Machine + Grinder",
]
DESCRIPTIONS = [
    "Plugs into standard outlet. Automatic shut-off after 12 hours. LED indicator shows the state.",
    "For your existing diffuser. Directions: Use daily. Keep dry. Store cool. Then rest.",
    "Includes rechargeable battery and OLED display with 20 watts power.",
    "Active Ingredients: citronella oil, water. Safety Warning: Keep away from children. Do not swallow.",
    "Ingredients: cocoa, sugar, milk 3.5% fat. Made with care.",
    "",
    "Variable speed motor. Requires existing machine.",
    "Plain text without claims. Directions for use inside. Ingredients: cocoa, sugar, milk 3.5% fat",
]
BULLETS = [
    "",
    "USB-C charging\nEasy to clean",
    "Automatic shut-off\nComposition: pure cotton\nSoft",
    "A long line about this product that goes on and on so that it must be cut somewhere behind ninety letters\nShort one",
    "Ingredients: citronella\nDurable steel body",
]
CONTEXTS = ["", "best brand with oil volume", "large size steel note", "résumé durable brand brand BRAND"]

# Entries of the specs text by position: a listing has the first (pk modulo 13) of them.
SPEC_LINES = [
    "concat('Brand: ', p_brand)",
    "concat('Type: ', p_type)",
    "concat('Size: ', cast(p_size as string))",
    "concat('Unit Count: ', cast(1 + sk % 6 as string), ' count')",
    "concat('Item form: ', case sk % 3 when 0 then 'Oil' when 1 then 'Liquid' else 'Solid' end)",
    "concat('Item volume: ', cast(10 * (1 + sk % 9) as string), ' Milliliters')",
    "'Key Ingredients: aloe | zinc'",
    "'Note 8: steel'",
    "'Note 9: large'",
    "'Note 10: é'",
    "'Note 11: x'",
    "'Note 12: y'",
]


def _pick(values: list[str], number: str) -> str:
    quoted = ["'" + v.replace("'", "''") + "'" for v in values]
    quoted = [" || chr(10) || ".join(f"'{p}'" for p in q.strip("'").split("\n")) if "\n" in q else q for q in quoted]
    cases = " ".join(f"when {i} then {q}" for i, q in enumerate(quoted))
    return f"(case {number} {cases} end)"


def _base36(number: str) -> str:
    places = [f"({number} // {36 ** k}) % 36 + 1" for k in range(9, -1, -1)]
    return "concat(" + ", ".join(f"substr('{_DIGITS}', cast({p} as int), 1)" for p in places) + ")"


def _grouped(sep: str) -> str:
    return (
        f"(case when th > 0 then concat(cast(th as string), '{sep}', lpad(cast(rest as string), 3, '0')) "
        "else cast(rest as string) end)"
    )


OFFERS_SQL = f"""
with base as (
  select l_partkey as pk, l_suppkey as sk, cast(floor(min(l_extendedprice) * 100 + 0.5) as bigint) as cents
  from {{lineitem}} group by l_partkey, l_suppkey
), facts as (
  select pk, sk, pk * 1000000 + sk as oid, cents, [[cents|100000]] as th, [[cents|100]] % 1000 as rest,
    lpad(cast(cents % 100 as string), 2, '0') as c2, p_name, p_brand, p_type, p_size,
    case when sk % 2 = 0 then 'amazon' else 'takealot' end as store_id
  from base join {{part}} on p_partkey = pk
), named as (
  select *, case when store_id = 'amazon' then [[base36]] else concat('PLID', cast(oid as string)) end as product_id
  from facts
)
select pk, sk, oid, cents, store_id, product_id,
  case when store_id = 'takealot' then
      case when pk % 2 = 1 then concat('/item/', product_id, '?src=x')
        else concat('https://www.takealot.com/item/', product_id) end
    else case (pk + sk) % 4
      when 0 then concat('https://www.amazon.co.za/dp/', product_id)
      when 1 then concat('https://www.amazon.com/gp/product/', product_id, '?ref=x')
      when 2 then concat('/', replace(p_name, ' ', '-'), '/dp/', product_id, '/ref=sr_1')
      else concat('https://aax-eu.amazon.co.za/x/c/AbC/https://www.amazon.co.za/dp/', product_id, '?psc=1') end
    end as href,
  case when store_id = 'takealot' then concat('https://www.takealot.com/item/', product_id)
    when (pk + sk) % 4 = 1 then concat('https://www.amazon.com/dp/', product_id)
    else concat('https://www.amazon.co.za/dp/', product_id) end as url,
  case (pk + sk) % 6
    when 0 then concat('R', {_grouped(' ')}, '.', c2)
    when 1 then concat('R ', {_grouped(',')}, '.', c2)
    when 2 then concat('R', cast([[cents|100]] as string), ',', c2)
    when 3 then concat('R', {_grouped(chr(160))}, '.', c2)
    when 4 then concat('R', {_grouped(' ')}, '.', c2, ' - R', cast([[cents|100]] + 50 as string), '.', c2)
    else case when pk % 4 = 1 then 'Price unavailable' else concat('R', {_grouped(chr(0x202F))}, '.', c2) end
  end as price,
  case when pk % 3 = 0 then concat('R', cast([[cents * 5|400]] as string), '.', lpad(cast([[cents * 5|4]] % 100 as string), 2, '0'))
    else '' end as original_price,
  case when pk % 17 = 0 then 'N/A' when pk % 19 = 0 then '4,5 out of 5'
    else concat(cast([[20 + (pk + sk) % 31|10]] as string), '.', cast((20 + (pk + sk) % 31) % 10 as string), ' out of 5 stars') end as rating,
  case when (sk * 37) % 5000 >= 1000
    then concat(cast([[(sk * 37) % 5000|1000]] as string), ',', lpad(cast((sk * 37) % 1000 as string), 3, '0'), ' ratings')
    else concat(cast((sk * 37) % 5000 as string), ' ratings') end as review_count,
  case when (pk + sk) % 29 = 0 then concat('Amazon Product (', product_id, ')')
    when pk % 23 = 0 and sk % 3 = 0 then ''
    else concat(p_name, {_pick(TITLE_ENDINGS, f'(pk + p_size) % {len(TITLE_ENDINGS)}')}) end as title,
  {_pick(DESCRIPTIONS, f'(pk + sk) % {len(DESCRIPTIONS)}')} as description,
  {_pick(BULLETS, f'sk % {len(BULLETS)}')} as bullets_text,
  concat({', '.join(f"case when pk % 13 > {i} then concat({line}, chr(10)) else '' end" for i, line in enumerate(SPEC_LINES))}) as specs_text,
  case when oid % 11 = 0 then '' else concat('https://m.media-amazon.com/images/I/', cast(oid as string), '._AC_SX300_.jpg') end as image_url
from named
"""


#: Slugs of links and the start of the title they give.
ESCAPED = [
    ("caf%C3%A9-bar-", "Café Bar "),
    ("a%zzb-", "A%Zzb "),
    ("cut%4-", "Cut%4 "),
    ("x%C3-y_", "X\ufffd Y "),
    ("%E2%82%AC9-", "€9 "),
    ("100%25-pure+", "100% Pure+"),
    ("%41%zz%42-", "A%Zzb "),
]

#: Payloads and why they can't be read; ``@`` stands for the identifier.
PAYLOADS = [
    ('{"asin": "@", "title": "Good"}', None),
    ('{"asin": "@", "title": "Cut', "no JSON"),
    ("", "empty"),
    ('["@"]', "no object"),
    ('{"asin": "@", "specifications": "none"}', "specifications: no list"),
    ('{"asin": "@", "title": "Nulls", "specifications": null, "buybox_winner": null}', None),
    ('{"asin": "@", "buybox_winner": [1]}', "buybox_winner: no object"),
    ('{"asin": "@", "title": "First", "title": "Twice"}', None),
    ("null", "no object"),
]


def spark_sql(sql: str) -> str:
    sql = sql.replace("[[base36]]", "lpad(conv(cast(oid as string), 10, 36), 10, '0')")
    return re.sub(r"\[\[(.+?)\|(\d+)\]\]", r"((\1) div \2)", sql)


def duck_sql(sql: str) -> str:
    sql = sql.replace("[[base36]]", _base36("oid"))
    return re.sub(r"\[\[(.+?)\|(\d+)\]\]", r"((\1) // \2)", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per (part, supplier) pair of ``lineitem``."""
    df = spark.sql(
        # By part at once: one shuffle serves the aggregate and the join.
        spark_sql(OFFERS_SQL), lineitem=table(spark, sf_dir, "lineitem").repartition("l_partkey"), part=table(spark, sf_dir, "part")
    )
    lines = lambda c: F.array_remove(F.split(c, "\n"), "")
    entry = lambda l: F.struct(
        F.substring_index(l, ": ", 1).alias("key"), F.substring(l, F.instr(l, ": ") + 2, F.length(l)).alias("value")
    )
    return df.withColumns(
        {
            "bullet_points": lines("bullets_text"),
            "specs": F.transform(lines("specs_text"), entry),
            "aplus_content": F.lit(""),
        }
    ).drop("bullets_text", "specs_text")


def runs(spark: SparkSession, sf_dir: str, terms: int = 0) -> DataFrame:
    """One search run per 25 parts, with two or three terms, or with one to ``terms``."""
    run = F.col("run_id")
    return (
        table(spark, sf_dir, "part")
        .select(F.expr("p_partkey div 25").alias("run_id"))
        .distinct()
        .select(
            run,
            (F.lit(10) + run % 40).cast("int").alias("limit"),
            F.when(run % 3 == 0, "both").when(run % 3 == 1, "amazon").otherwise("takealot").alias("source"),
            F.when(run % 4 == 3, F.lit(20000.0)).alias("min_price"),
            F.when(run % 4 == 3, F.lit(30000.0)).when(run % 4 == 1, F.lit(35000.0)).alias("max_price"),
            (run % terms + 1 if terms else F.when(run % 5 == 0, 2).otherwise(3)).cast("int").alias("n_queries"),
        )
    )


def links(offer_table: DataFrame, terms: int = 3) -> DataFrame:
    """Stored result pages: every listing under one or two of the search terms of its run.

    In every fourth run the fourth page only repeats the third, so the reading must stop there.
    """
    pk, sk = F.col("pk"), F.col("sk")
    run, page = F.expr("pk div 25"), F.expr("(pk % 25) div 5 + 1")
    stale = run % 4 == 1
    pages = (
        F.when(stale & (page == 3), F.array(F.lit(3), F.lit(4)))
        .when(stale & (page > 3), F.array(page.cast("int") + 1))
        .otherwise(F.array(page.cast("int")))
    )
    queries = F.array_distinct(F.array((pk % terms).cast("int"), ((pk + sk) % terms).cast("int")))
    return offer_table.select(
        run.alias("run_id"), "store_id", "href", ((pk % 5) * 1000000 + sk).alias("pos"), F.explode(queries).alias("query_idx"), pages.alias("pages")
    ).select("run_id", "store_id", "query_idx", F.explode("pages").alias("page_num"), "pos", "href")


def full_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per part with the fields that :func:`shop_pages` leaves out; every fiftieth is empty."""
    pk, n = F.col("p_partkey"), F.col("p_partkey").cast("string")
    even = pk % 2 == 0
    prime = F.when(pk % 4 == 0, F.lit("<i class='a-icon-prime'></i>")).otherwise(F.lit(""))
    amazon = F.concat(
        F.lit("<html><body><h1 id='title'><span id='productTitle'>"), F.col("p_name"), F.lit("</span></h1><span class='a-price'><span class='a-offscreen'>R90.00</span></span>"),
        F.lit("<span class='a-price a-text-price'><span class='a-offscreen'>R"), (pk + 100).cast("string"), F.lit(".50</span></span>"),
        F.lit("<div id='imageBlock'><img id='landingImage' data-old-hires='https://m.media-amazon.com/i/"), n, F.lit(".jpg' src='s.jpg'></div>"),
        F.lit("<div id='altImages'><img src='https://m.media-amazon.com/i/b"), n, F.lit("._SS40_.jpg'><img src='https://m.media-amazon.com/i/sprite.png'></div>"),
        F.lit("<div id='availability'><span>Only "), (pk % 9).cast("string"), F.lit(" left</span></div>"),
        F.lit("<div id='important-information'><h4>Safety Information</h4><p>Keep dry.</p></div><div id='aplus_feature_div'><p>From the brand</p> number "), n,
        F.lit("</div><div id='whatIsInTheBox_feature_div'><ul><li>Tool "), n, F.lit("</li><li>Case</li></ul></div>"),
        F.lit("<div id='merchantInfoFeature_feature_div'><span>Sold by</span><span>Shop "), (pk % 7).cast("string"), F.lit("</span><span>Mover</span></div>"),
        F.lit("<div id='productSupportAndReturnPolicy_feature_div'><span>Support</span><span>"), (pk % 30 + 1).cast("string"), F.lit(" Days Returnable</span></div>"),
        prime, F.lit("<div id='socialProofingAsinFaceout_feature_div'>"), n, F.lit("+ bought</div></body></html>"),
    )
    takealot = F.concat(
        F.lit("<html><body><h1>"), F.col("p_name"), F.lit("</h1><span class='currency'>R 90</span><s>R "), (pk + 100).cast("string"),
        F.lit("</s><img src='https://media.takealot.com/covers_images/"), n, F.lit(".jpg'><div><table><tr><td>Seller</td><td>Shop "), (pk % 7).cast("string"),
        F.lit("</td></tr><tr><td>What's in the box</td><td>Tub "), n, F.lit("</td></tr></table></div></body></html>"),
    )
    url = F.when(even, F.concat(F.lit("https://www.amazon.co.za/dp/"), F.lpad(n, 10, "0"))).otherwise(F.concat(F.lit("https://www.takealot.com/x/PLID"), n))
    parts = table(spark, sf_dir, "part")
    html = F.when(pk % 50 == 0, F.lit("")).otherwise(F.when(even, amazon).otherwise(takealot))
    return parts.repartition(spread(parts), "p_partkey").select(url.alias("url"), html.alias("html"))


def result_pages(link_table: DataFrame) -> DataFrame:
    """The links of every result page written as HTML, between links to other things."""
    link = F.concat(F.lit("<div><a class=x\n href='"), F.replace("href", F.lit("&"), F.lit("&amp;")), F.lit("'>item</a><a href=\"/help\">help</a></div>"))
    keys = ["run_id", "store_id", "query_idx", "page_num"]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", link.alias("a")))), lambda x: x["a"]), "")
    html = F.concat(F.lit('<html><body><!-- <a href="/dp/0000000000">old</a> --><a href="/">home</a>'), body, F.lit("</body></html>"))
    return link_table.groupBy(*keys).agg(html.alias("html"))


def odd_result_pages(link_table: DataFrame) -> DataFrame:
    """The links of every result page, each written in one of the ways that browsers read."""
    href = F.replace("href", F.lit("&"), F.lit("&amp;"))
    coded = F.replace(F.replace(href, F.lit("="), F.lit("&#61;")), F.lit("/"), F.lit("&#x2F;"))
    wrap = lambda before, value, after: F.concat(F.lit(before), value, F.lit(after))
    ways = [
        wrap("<a title='a>b' href=\"", href, '">item</a>'),
        wrap("<a class='x'href='", href, "'>item</a>"),
        wrap("<A\nHREF = ", href, " data-x=1>item"),
        wrap('<a href="', coded, '"/>item'),
        wrap('<a data-href="/dp/0000000000" href="\t', href, '\n" href="/dp/0000000001">item</a>'),
        wrap("<textarea><a href='/dp/0000000002'></textarea><!--><a href='", href, "'>item</a>"),
    ]
    way = F.element_at(F.array(*ways), (F.pmod(F.hash("href"), F.lit(len(ways))) + 1).cast("int"))
    keys = ["run_id", "store_id", "query_idx", "page_num"]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href", way.alias("a")))), lambda x: F.concat(x["a"], F.lit("<a href=/help>help</a>"))), "")
    noise = "<!doctype html><title><a href='/dp/0000000003'></title><script>'<a href=\"/dp/0000000004\">'</script><a href='/'>home</a>"
    return link_table.groupBy(*keys).agg(F.concat(F.lit(noise), body, F.lit("<a href='/dp/0000000005")).alias("html"))


def part_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of every part whose page :func:`shop_pages` writes."""
    pk = F.col("p_partkey")
    even = pk % 2 == 0
    asin = F.lpad(pk.cast("string"), 10, "0")
    href = F.when(even, F.concat(F.lit("/Nice-Lamp/dp/"), asin, F.lit("/ref=sr?a=1&b=2"))).otherwise(F.concat(F.lit("/x/PLID"), pk.cast("string"), F.lit("?src=s")))
    return table(spark, sf_dir, "part").select(pk.alias("pk"), pk.alias("sk"), F.when(even, "amazon").otherwise("takealot").alias("store_id"), href.alias("href"))


#: Which of every five runs asks for which shops.
SHOPS_ASKED = ["all", "both", "amazon, village", "Village", "takealot,nowhere"]


def three_shop_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs, asking for one to three shops, some for one that nobody knows."""
    asked = F.element_at(F.array(*[F.lit(s) for s in SHOPS_ASKED]), (F.col("run_id") % len(SHOPS_ASKED) + 1).cast("int"))
    return runs(spark, sf_dir).withColumn("source", asked)


def three_shop_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`part_listings`, of which every third is a third shop's."""
    third = F.col("pk") % 3 == 0
    href = F.concat(F.when(F.col("pk") % 2 == 0, "https://village.example").otherwise(""), F.lit("/item/"), F.col("pk").cast("string"), F.lit("?ref=s#top"))
    df = part_listings(spark, sf_dir)
    return df.withColumn("store_id", F.when(third, "village").otherwise(F.col("store_id"))).withColumn("href", F.when(third, href).otherwise(F.col("href")))


def three_shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`shop_pages` and those of the third shop, of which every fiftieth isn't stored."""
    n = F.col("p_partkey")
    cents = F.expr("cast(round(p_retailprice * 100) as bigint)")
    price = F.format_string("R%d.%02d", F.expr("cast(round(p_retailprice * 100) as bigint) div 100"), cents % 100)
    html = F.concat(F.lit("<html><body><h1>Village "), F.col("p_name"), F.lit("</h1><span class='currency'>"), price, F.lit("</span></body></html>"))
    url = F.concat(F.lit("https://village.example/item/"), n.cast("string"))
    own = table(spark, sf_dir, "part").where((n % 3 == 0) & (n % 50 != 0)).select(url.alias("url"), html.alias("html"))
    return shop_pages(spark, sf_dir).unionByName(own)


def comparisons(offer_table: DataFrame) -> DataFrame:
    """Every part is one comparison set of the listings that sell it."""
    context = F.element_at(F.array(*[F.lit(c) for c in CONTEXTS]), (F.col("pk") % len(CONTEXTS) + 1).cast("int"))
    return offer_table.select(
        F.col("pk").alias("comparison_id"),
        F.col("sk").alias("idx"),
        context.alias("user_context"),
        "product_id", "title", "price", "rating", "specs", "bullet_points",
    )


def sparse(sets: DataFrame) -> DataFrame:
    """Comparison sets whose listings lack one thing or another."""
    lack = {"title": 5, "price": 7, "specs": 3, "bullet_points": 4, "product_id": 6, "rating": 11}
    return sets.withColumns({c: F.when(F.col("idx") % n != 0, F.col(c)) for c, n in lack.items()})


def click_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as clicks on product links."""
    action = (
        F.when(F.col("event_type") == "click", "toggle")
        .when(F.col("event_type").isin("view", "purchase"), "add")
        .when(F.col("event_type") == "signup", "clear")
        .otherwise(F.col("event_type"))  # no click; the operators leave such events out
    )
    kind = F.col("event_id") % 6
    href = F.concat(
        F.when(kind == 5, F.lit("https://www.other.example/item/")).otherwise(F.lit("https://www.amazon.com/nice-item/dp/")),
        F.lpad(kind.cast("string"), 10, "B0"),
        F.lit("/ref=x?e="),
        F.col("event_id").cast("string"),
    )
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("seq"), action.alias("action"), href.alias("url")
    )


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shop page per part, written as HTML; even parts for the first shop, odd ones for the second."""
    pk = F.col("p_partkey")
    text = lambda c: c.cast("string")
    price = F.format_string("R%d.%02d", F.expr("cast(round(p_retailprice * 100) as bigint) div 100"), F.expr("cast(round(p_retailprice * 100) as bigint) % 100"))
    rows = lambda tag: F.array_join(
        F.transform(F.sequence(F.lit(1), (pk % 6 + 1).cast("int")), lambda i: F.concat(
            F.lit(f"<tr><{tag}>Note "), text(i), F.lit(f":</{tag}><td class=\"a-size-base\">"), text(pk + i), F.lit("</td></tr>")
        )), ""
    )
    amazon = F.concat(
        F.lit("<html><head><title>x : Amazon.co.za</title><script>var p='</p>';</script></head><body><div id=\"title\"><span id=\"productTitle\"> "),
        F.col("p_name"), F.lit(" Refill 2 x 5 ml</span></div><a id=\"bylineInfo\">Visit the "), F.col("p_brand"),
        F.lit(" Store</a><span class=\"a-price\"><span class=\"a-offscreen\">"), price,
        F.lit("</span></span><i class=\"a-icon-star\"><span class=\"a-icon-alt\">4.5 out of 5</span></i><span id=\"acrCustomerReviewText\">"),
        text(pk), F.lit(" ratings</span><div id=\"feature-bullets\"><ul><li><span class=\"a-list-item\">Size "), text(F.col("p_size")),
        F.lit("</span></li><li><span class=\"a-list-item\">Built-in battery &amp; <b>case</b></span></li></ul></div>"
              "<table class=\"prodDetTable\">"), rows("th"),
        F.lit("</table><div id=\"productDescription\"><p>Product description Directions: Use daily. Rest.</p></div></body></html>"),
    )
    takealot = F.concat(
        F.lit("<html><body><h1>"), F.col("p_name"), F.lit("</h1><div class=\"breadcrumbs\"><a>Home</a><a>"), F.col("p_type"),
        F.lit("</a></div><span class=\"currency plus\">"), F.expr("substr(p_brand, 1, 0)"), price,
        F.lit("</span><div class=\"product-info\">Product Information<p>Brand</p><p>"), F.col("p_brand"),
        F.lit("</p><p>Size: "), text(F.col("p_size")), F.lit("</p></div><table>"), rows("td"),
        F.lit("</table><div class=\"description\">Description Good.<ul><li>First item</li><li>Second item</li></ul></div></body></html>"),
    )
    even = pk % 2 == 0
    url = F.when(even, F.concat(F.lit("https://www.amazon.co.za/dp/"), F.lpad(text(pk), 10, "0"))).otherwise(
        F.concat(F.lit("https://www.takealot.com/x/PLID"), text(pk))
    )
    # The parts are spread before they grow into pages, as a small table is one file and so one task.
    parts = table(spark, sf_dir, "part")
    return parts.repartition(spread(parts), "p_partkey").select(
        url.alias("url"), F.when(pk % 50 == 0, F.lit("<p>Robot Check</p>")).otherwise(F.when(even, amazon).otherwise(takealot)).alias("html")
    )
