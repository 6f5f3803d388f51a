"""SQL twins of the named queries, for DuckDB over the same tables.

They are written against the facts the listings were made from wherever possible (the known product
number instead of parsing it from a link, joins instead of windows), so that an error in an operator
does not repeat itself here.
"""

from __future__ import annotations

from offerlens import adapters as A
from offerlens.operators import classify as C
from offerlens.sources.shop_fields import INGREDIENT_KEYS

ORACLES: dict[str, str] = {}

_OFFERS = A.duck_sql(A.OFFERS_SQL).format(lineitem="lineitem", part="part")


def offers(select: str, *more: tuple[str, str]) -> str:
    """A statement over ``offers`` and further named subqueries."""
    ctes = [("offers", _OFFERS), *more]
    return "with " + ", ".join(f"{n} as ({q})" for n, q in ctes) + " " + select


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def display(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({c}, '\p{{Cf}}', '', 'g'), '{WS}+', ' ', 'g'))"


def parse_price(c: str) -> str:
    t = display(c)
    t = rf"regexp_replace({t}, '(\d+)\s+(\d+)', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '(\d+),(\d{{3}})', '\1\2', 'g')"
    t = rf"regexp_replace({t}, '(\d+),(\d{{2}})\b', '\1.\2', 'g')"
    numbers = rf"list_transform(regexp_extract_all({t}, '\d+(?:\.\d+)?'), lambda x: cast(x as double))"
    return f"(case when contains(lower({c}), 'unavailable') then null else list_max({numbers}) end)"


def loose(c: str) -> str:
    return rf"coalesce(try_cast(regexp_replace({c}, '[^\d.]', '', 'g') as double), 0.0e0)"


def tenths(x: str) -> str:
    return f"cast(format('{{:.1f}}', {x}) as double)"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A{WS}+|{WS}+\z', '', 'g')"


def words(c: str, wordings: list[str]) -> str:
    return "regexp_matches(" + c + ", " + q(r"\b(?:" + "|".join(wordings) + r")\b") + ")"


def spec(key: str) -> str:
    """Value of a key in the specs text, null if absent."""
    return rf"nullif(regexp_extract(specs_text, '(?m)^{key}: (.*)$', 1), '')"


N_SPECS = "len(list_filter(string_split(specs_text, chr(10)), lambda x: x <> ''))"
BULLETS = "list_filter(string_split(bullets_text, chr(10)), lambda x: x <> '')"
SPECS = "list_filter(string_split(specs_text, chr(10)), lambda x: x <> '')"
ABSOLUTE = "case when href like '/%' then concat('https://www.amazon.co.za', href) else href end"

# --- prices, ratings ---------------------------------------------------------------------------

ORACLES["price_parse"] = offers(
    f"select oid, {parse_price('price')} as price_numeric, {parse_price('original_price')} as original_price_numeric from offers"
)
ORACLES["price_display"] = offers(f"select oid, {display('price')} as price_display from offers")
ORACLES["price_loose"] = offers(f"select oid, {loose('price')} as price_loose from offers")

_SYMBOL = """case when oid % 9 = 0 or oid % 7 in (0, 1) then 'R' when oid % 9 = 1 then '£' when oid % 9 in (2, 3, 4, 5) then '€'
  when oid % 9 = 6 then 'CA$' when oid % 9 = 7 then 'A$' else '$' end"""
ORACLES["currency_detect"] = offers(f"select oid, {_SYMBOL} as symbol from offers")
ORACLES["currency_code"] = offers(
    f"""select oid, case when symbol = 'R' then 'ZAR' when symbol in ('$', 'CA$', 'A$') then 'USD' else symbol end as currency
    from (select oid, {_SYMBOL} as symbol from offers)"""
)
ORACLES["discount_pct"] = offers(
    f"""select oid, case when o > p then cast(format('{{:.0f}}', (o - p) / o * 100) as int) end as discount_percentage
    from (select oid, {parse_price('price')} as p, {parse_price('original_price')} as o from offers)"""
)
ORACLES["rating_numeric"] = offers(
    r"select oid, try_cast(replace(regexp_extract(rating, '\d+(?:[.,]\d+)?'), ',', '.') as double) as rating_numeric from offers"
)
ORACLES["review_count_numeric"] = offers("select oid, cast((sk * 37) % 5000 as bigint) as review_count_numeric from offers")
ORACLES["rand_prefix"] = offers(
    """select oid, case when oid % 2 = 1 or price = 'Price unavailable' then price
      when substr(price, 2, 1) = ' ' then price else concat('R ', substr(price, 2)) end as price from offers"""
)
ORACLES["split_price"] = offers(
    """select oid, case when oid % 5 <> 0 then concat('R', cast(cents // 100 as varchar),
      case when oid % 3 <> 0 then concat('.', lpad(cast(cents % 100 as varchar), 2, '0')) else '' end) end as price from offers"""
)

# --- identity, URLs, text ----------------------------------------------------------------------

ORACLES["asin_extract"] = offers(
    "select oid, case when store_id = 'amazon' then product_id "
    "when oid % 5 = 0 and length(product_id) = 10 then product_id end as asin from offers"
)
ORACLES["plid_extract"] = offers("select oid, case when store_id = 'takealot' then product_id end as plid from offers")
ORACLES["unwrap_url"] = offers("select oid, url from offers where store_id = 'amazon'")
ORACLES["takealot_url"] = offers("select oid, url from offers where store_id = 'takealot'")
ORACLES["click_url"] = offers(
    """select oid, case when store_id = 'takealot' then null
      when (pk + sk) % 4 = 1 then concat('https://www.amazon.com/gp/product/', product_id)
      when (pk + sk) % 4 = 2 then regexp_extract(concat('https://www.amazon.co.za', href), '^(.*/dp/.{10})', 1)
      when (pk + sk) % 4 = 3 then concat('https://www.amazon.co.za/dp/', product_id)
      else href end as url from offers"""
)
ORACLES["unique_key"] = offers(
    # A title is its own key, unless it is a bare identifier or names the listing's number.
    "select oid, case when oid % 9 <> 0 or (store_id = 'takealot' and (pk + sk) % 29 = 0) then product_id "
    "when store_id = 'amazon' and regexp_full_match(title, '(?i)[a-z0-9]{10}') then upper(title) "
    "else title end as unique_key from offers"
)
ORACLES["target_url"] = offers(
    """select oid, case when oid % 2 = 0 then
        case when length(product_id) = 10 then concat('https://www.amazon.co.za/dp/', product_id) end
      when href like 'http%' then href
      when store_id = 'amazon' then concat('https://www.amazon.co.za/dp/', product_id) end as url from offers"""
)
ORACLES["title_from_url"] = offers(
    r"""select oid, case when length(t) > 3 then t else '' end as title from (
      select oid, list_aggregate(list_transform(regexp_extract_all(s, '\pL+|\PL+'),
        lambda w: concat(upper(substr(w, 1, 1)), lower(substr(w, 2)))), 'string_agg', '') as t
      from (select oid, case when store_id = 'takealot' then case when href like 'http%' then 'item' else 'item' end
        when (pk + sk) % 4 = 2 then replace(split_part(href, '/', 2), '-', ' ')
        when (pk + sk) % 4 = 3 then 'x' else '' end as s from offers)) """
)
ORACLES["page_title_clean"] = offers(
    """select oid, case when oid % 4 = 3 then null else nullif(trim(title), '') end as title from offers"""
)
ORACLES["image_choice"] = offers(
    """select oid, case when oid % 3 = 2 then 'https://x/src.jpg' when oid % 3 = 0 then
        case when image_url = '' then 'https://x/src.jpg' else image_url end
      else image_url end as image_url from offers"""
)
ORACLES["gallery"] = offers(
    """select oid, case when image_url = '' then 'https://x/main.jpg'
      else concat('https://x/main.jpg https://m.media-amazon.com/images/I/', case when cast(oid as varchar) like '%300%' then
        concat(cast(oid as varchar), '.jpg https://m.media-amazon.com/images/I/', replace(cast(oid as varchar), '300', '1500'), '.jpg')
        else concat(cast(oid as varchar), '.jpg') end) end as gallery from offers"""
)
ORACLES["cell_text"] = offers("select oid, replace(title, '|', '-') as title from offers")

def _terms(parts: str) -> str:
    return f"""select conv_id, turn, term, min(p) as p from (
    select conv_id, turn, {strip('term')} as term, p from (
      select conv_id, turn, unnest(parts) as term, generate_subscripts(parts, 1) as p
      from (select conv_id, turn, {parts} as parts from conversations)))
  where term <> '' group by conv_id, turn, term"""

ORACLES["search_terms"] = (
    "select conv_id, turn, cast(row_number() over (partition by conv_id, turn order by p) - 1 as int) as pos, term from ("
    + _terms("list_concat(string_split(text, ','), ['whey', ' casein'])")
    + ")"
)
ORACLES["output_name"] = (
    r"""select conv_id, turn, concat(case when name is null or name = '' then 'scraped_products'
      when length(name) > 40 then rtrim(substr(name, 1, 40), '_') else name end, '.json') as file_name
    from (select c.conv_id, c.turn, max(n.name) as name from conversations c left join (
      select conv_id, turn, string_agg(part, '_' order by p) as name from (
        select conv_id, turn, p, trim(regexp_replace(lower(term), '[^a-z0-9]+', '_', 'g'), '_') as part from ("""
    + _terms("string_split(text, ',')")
    + r""")) where part <> '' group by conv_id, turn) n on n.conv_id = c.conv_id and n.turn = c.turn
      group by c.conv_id, c.turn)"""
)
ORACLES["text_urls"] = """with d as (select doc_id, lpad(cast(doc_id as varchar), 10, '0') as a from documents)
  select doc_id, 0 as pos, concat('https://www.amazon.co.za/dp/', a) as url from d where doc_id % 3 <> 0
  union all select doc_id, 1, concat('https://www.amazon.com/dp/', a) from d where doc_id % 3 <> 0
  union all select doc_id, cast(row_number() over (partition by doc_id order by p) - 1 as int), url from (
    select doc_id, url, min(p) as p from (
      select doc_id, split_part(""" + strip("piece") + """, '?', 1) as url, p from (
        select doc_id, unnest(parts) as piece, generate_subscripts(parts, 1) as p from (
          select doc_id, string_split_regex(concat(text, chr(10), a, ', ', a, chr(10), chr(10), 'https://a.example/x?y=1,'), '[\r\n,]+') as parts
          from documents join d using (doc_id) where doc_id % 3 = 0)))
    where url <> '' group by doc_id, url)"""
ORACLES["url_list"] = offers("select 0 as part, href as input from offers union all select 1, 'https://www.takealot.com/x/PLID1'")

# --- routing, filters --------------------------------------------------------------------------

_PAGE_STORE = r"""case when regexp_matches(url, '^https?://[^/?#]*example\.com') then 'example_com'
  when regexp_matches(url, '^https?://[^/?#]*example\.net') then 'example_net'
  when regexp_matches(url, '^https?://[^/?#]*example\.org') then 'example_org' end"""
ORACLES["route_store"] = f"select page_id, {_PAGE_STORE} as store_id from pages"
ORACLES["route_offers"] = offers(
    """select oid, case when oid % 10 = 0 then 'takealot' when oid % 10 = 1 then null else store_id end as store_id,
      case when oid % 10 = 0 then 'takealot' when oid % 10 = 1 then 'amazon' else store_id end as parser from offers"""
)
ORACLES["url_matches_store"] = f"select page_id, coalesce({_PAGE_STORE} = 'example_com', false) as is_com, false as is_amazon from pages"
ORACLES["store_identifier"] = rf"""select page_id, nullif(regexp_extract(url, '/(\d+)', 1), '') as product_id,
  replace({_PAGE_STORE}, 'example_', 'Example ') as store_name from pages"""
ORACLES["blocked_pages"] = """select page_id, case when html = '' then 'empty'
  when page_id % 10 = 3 or contains(html, 'Robot Check') then 'blocked' end as reason from pages
  union all select -page_id - 1, 'empty' from pages"""

_VALID_AMAZON = """(trim(title) <> '' and not (trim(title) like 'Amazon Product (%)') and
  (price <> 'Price unavailable' or specs_text <> '' or bullets_text <> '' or image_url <> ''))"""
_VALID_TAKEALOT = "(trim(title) <> '' and price <> 'Price unavailable')"
ORACLES["valid_amazon"] = offers(f"select oid, {_VALID_AMAZON} as is_valid from offers where store_id = 'amazon'")
ORACLES["valid_takealot"] = offers(f"select oid, {_VALID_TAKEALOT} as is_valid from offers where store_id = 'takealot'")
ORACLES["validity_by_store"] = offers(
    f"select oid, case when store_id = 'amazon' then {_VALID_AMAZON} else {_VALID_TAKEALOT} end as is_valid from offers"
)
ORACLES["price_range"] = offers(f"select oid from offers where {parse_price('price')} between 20000 and 30000")

# --- classification ----------------------------------------------------------------------------

_TEXTS = (
    "texts",
    "select *, lower(trim(title)) as t, lower(concat(trim(description), ' ', replace(bullets_text, chr(10), ' '), ' ')) as d from offers",
)
_FLAGS = (
    "flags",
    f"""select *, {words('t', C.STARTER_KIT)} as is_starter, {words('t', C.BARE_UNIT)} as is_bare,
      {words('t', C.ACCESSORY)} as is_accessory, {words('t', C.REFILL)} as by_word,
      {words('t', C.MULTI_PACK)} and ({words('t', C.CONSUMABLE)} or coalesce({spec('Item form')} in ('Oil', 'Liquid'), false)) as by_pack,
      regexp_matches(d, {q(C.EXISTING_UNIT.replace('(?U)', ''))}) as requires_existing,
      regexp_matches(t, {q('|'.join(C.APPLIANCE_PARTS))}) as is_appliance from texts""",
)
_KINDS = (
    "kinds",
    f"""select *, case when is_starter then {q(C.STARTER)} when is_bare then {q(C.BARE)} when is_accessory then {q(C.ACCESSORY_TYPE)}
      when is_refill then {q(C.REFILL_TYPE)} when is_appliance then {q(C.APPLIANCE)} else {q(C.STANDARD)} end as package_type
      from (select *, by_word or ((by_pack or requires_existing) and not is_starter) as is_refill from flags)""",
)
ORACLES["package_flags"] = offers(
    "select oid, is_starter, is_bare, is_accessory, is_refill, requires_existing, is_appliance from kinds", _TEXTS, _FLAGS, _KINDS
)
ORACLES["package_type"] = offers(
    f"""select oid, package_type,
      case when package_type in ({q(C.ACCESSORY_TYPE)}, {q(C.REFILL_TYPE)}) then false when package_type = {q(C.STANDARD)} then null else true end as device_included,
      package_type = {q(C.REFILL_TYPE)} as is_refill_only,
      package_type in ({q(C.ACCESSORY_TYPE)}, {q(C.REFILL_TYPE)}) as requires_base_device from kinds""",
    _TEXTS, _FLAGS, _KINDS,
)
_QUANTITY = (
    r"coalesce(nullif(regexp_replace(regexp_extract(title, '(?i)\d+\s*x\s*\d+(?:\.\d+)?\s*(?:ml|g|count|liters?)'), '(?i)^(\d+)\s*x\s*', '\1 x '), ''), "
    + spec("Unit Count")
    + ", '1')"
)
ORACLES["pack_quantity"] = offers(
    f"select oid, {_QUANTITY} as pack_quantity, coalesce({spec('Item volume')}, '') as net_volume from offers"
)
_CLAIMS = (
    "claimed",
    "select *, case when package_type = "
    + q(C.REFILL_TYPE)
    + " then concat_ws('|', "
    + ", ".join(f"case when {words('d', ws)} then {q(label)} end" for label, ws in C.CLAIMS)
    + ") else '' end as claims from kinds",
)
ORACLES["claims"] = offers("select oid, claims from claimed", _TEXTS, _FLAGS, _KINDS, _CLAIMS)
_ALERTS = (
    "alerted",
    f"""select oid, package_type, case when package_type = {q(C.BARE)} then {q(C.BARE_ALERT)}
      when package_type = {q(C.ACCESSORY_TYPE)} and {words('d', C.HOST_DEVICE)} then {q(C.ACCESSORY_ALERT)}
      when package_type = {q(C.REFILL_TYPE)} and claims <> '' then concat({q(C.MISMATCH_ALERT[0])}, '''', replace(claims, '|', ''', '''), '''',
        {q(C.MISMATCH_ALERT[1])}, {_QUANTITY}, {q(C.MISMATCH_ALERT[2])})
      when package_type = {q(C.REFILL_TYPE)} and requires_existing then {q(C.REFILL_ALERT)} end as alert from claimed""",
)
_ANALYSED = (_TEXTS, _FLAGS, _KINDS, _CLAIMS, _ALERTS)
ORACLES["alerts"] = offers("select oid, alert from alerted where alert is not null", *_ANALYSED)
ORACLES["alert_rollup"] = offers(
    "select package_type, coalesce(split_part(alert, ':', 1), '') as alert_code, count(*) as listings from alerted group by 1, 2",
    *_ANALYSED,
)

# --- inputs, search runs, allocation -----------------------------------------------------------

ORACLES["dedupe_first"] = offers("select oid, 0 as part, product_id as unique_key from offers")
ORACLES["anti_seen"] = offers(
    """select oid, product_id from offers where not exists
      (select 1 from lineitem where l_partkey = pk and l_suppkey = sk and l_returnflag = 'R')"""
)
_RUNS = (
    "runs",
    """select run_id, cast(10 + run_id % 40 as int) as lim, case run_id % 3 when 0 then 'both' when 1 then 'amazon' else 'takealot' end as source,
      case when run_id % 4 = 3 then 20000.0e0 end as min_price,
      case when run_id % 4 = 3 then 30000.0e0 when run_id % 4 = 1 then 35000.0e0 end as max_price,
      case when run_id % 5 = 0 then 2 else 3 end as nq from (select distinct p_partkey // 25 as run_id from part)""",
)
_TARGETS = (
    "targets",
    """select run_id, 'amazon' as store_id, case source when 'both' then lim // 2 else lim end as target, min_price, max_price, nq
        from runs where source <> 'takealot'
      union all select run_id, 'takealot', case source when 'both' then lim - lim // 2 else lim end, min_price, max_price, nq
        from runs where source <> 'amazon'""",
)
ORACLES["store_split"] = "with " + ", ".join(f"{n} as ({s})" for n, s in (_RUNS, _TARGETS)) + " select run_id, store_id, target from targets"

_PLACED = (
    "placed",
    """select *, pk // 25 as run_id, (pk % 25) // 5 + 1 as page, (pk % 5) * 1000000 + sk as pos,
      pk // 25 % 4 = 1 as stale from offers""",
)
_ASKED = (
    "asked",
    "select *, pk % 3 as query_idx from placed union all select *, (pk + sk) % 3 from placed where (pk + sk) % 3 <> pk % 3",
)
_LINKS = (
    "links",
    """select run_id, store_id, query_idx, case when stale and page > 3 then page + 1 else page end as page_num, pos, product_id, url from asked
      union all select run_id, store_id, query_idx, 4, pos, product_id, url from asked where stale and page = 3""",
)
_FIRST = (
    "firsts",
    """select run_id, store_id, query_idx, product_id, url, min(page_num) as page_num, min(pos) as pos from links
      group by run_id, store_id, query_idx, product_id, url""",
)
_BASE = (_PLACED, _ASKED, _LINKS, _FIRST)
ORACLES["candidate_links"] = offers("select run_id, store_id, query_idx, page_num, pos, product_id, url from firsts", *_BASE)


def live(table: str) -> str:
    """Rows of a link table on pages before the first gap in the page numbers."""
    return f"""select c.* from {table} c where page_num <= (
      select count(*) from (select distinct page_num from {table} d
        where d.run_id = c.run_id and d.store_id = c.store_id and d.query_idx = c.query_idx and d.page_num <= c.page_num))"""


ORACLES["result_links"] = offers(
    """select run_id, store_id, query_idx, cast(rank as bigint) as rank, product_id, url from (
      select *, row_number() over (partition by run_id, store_id, query_idx order by page_num, pos) as rank from alive) where rank <= 30""",
    *_BASE,
    ("alive", live("firsts")),
)


def _allocation(terms: int = 3, capped: bool = True) -> tuple[tuple[str, str], ...]:
    facts = (
        "facts",
        f"""select f.*, t.target, t.nq, (f.store_id <> 'amazon' or {_VALID_AMAZON})
          and (t.min_price is null or coalesce({parse_price('o.price')} >= t.min_price, false))
          and (t.max_price is null or coalesce({parse_price('o.price')} <= t.max_price, false)) as ok
          from firsts f join targets t on t.run_id = f.run_id and t.store_id = f.store_id
          join offers o on o.product_id = f.product_id where f.query_idx < t.nq""",
    )
    steps: list[tuple[str, str]] = [
        facts,
        ("acc0", "select run_id, store_id, query_idx, page_num, pos, product_id, 1 as pass_no from facts where false"),
    ]
    for k in range(terms):
        steps += [
            (
                f"share{k}",
                f"""select t.run_id, t.store_id, t.target, greatest(0, t.target - count(a.product_id)) as missing,
                  (greatest(0, t.target - count(a.product_id)) + greatest(t.nq - {k}, 1) - 1) // greatest(t.nq - {k}, 1) as quota
                  from targets t left join acc{k} a on a.run_id = t.run_id and a.store_id = t.store_id group by t.run_id, t.store_id, t.target, t.nq""",
            ),
            (
                f"open{k}",
                f"""select f.*, s.quota from facts f join share{k} s on s.run_id = f.run_id and s.store_id = f.store_id
                  where f.query_idx = {k} and s.quota > 0 and (f.store_id <> 'amazon' or not exists (select 1 from acc{k} a
                    where a.run_id = f.run_id and a.store_id = f.store_id and a.product_id = f.product_id))""",
            ),
            (f"alive{k}", live(f"open{k}")),
            (
                f"listed{k}",
                f"""select * from (select *, row_number() over (partition by run_id, store_id order by page_num, pos) as rn from alive{k})
                  {"where rn <= greatest(4 * quota, 30)" if capped else ""}""",
            ),
            (
                f"acc{k + 1}",
                f"""select * from acc{k} union all select run_id, store_id, query_idx, page_num, pos, product_id, 1 from (
                  select *, row_number() over (partition by run_id, store_id order by page_num, pos) as take from listed{k} l
                  where ok and not exists (select 1 from acc{k} a
                    where a.run_id = l.run_id and a.store_id = l.store_id and a.product_id = l.product_id)) where take <= quota""",
            ),
        ]
    left = " union all ".join(f"select run_id, store_id, query_idx, page_num, pos, product_id, target, ok from listed{k}" for k in range(terms))
    steps += [
        (
            "spare",
            f"""select run_id, store_id, product_id, any_value(target) as target, min((query_idx, page_num, pos)) as place from ({left}) l
              where ok and not exists (select 1 from acc{terms} a where a.run_id = l.run_id and a.store_id = l.store_id and a.product_id = l.product_id)
              group by run_id, store_id, product_id""",
        ),
        (
            "accepted",
            f"""select * from acc{terms} union all select run_id, store_id, place[1], place[2], place[3], product_id, 2 from (
              select s.*, row_number() over (partition by run_id, store_id order by place) as rn,
                (select count(*) from acc{terms} a where a.run_id = s.run_id and a.store_id = s.store_id) as n from spare s) where rn <= target - n""",
        ),
        (
            "numbered",
            """select *, cast(row_number() over (partition by run_id order by store_id, pass_no, query_idx, page_num, pos) as int) as accept_idx
              from accepted""",
        ),
    ]
    return tuple(steps)


_ALLOCATED = (_RUNS, _TARGETS, *_BASE, *_allocation())
_UNCAPPED = (_RUNS, _TARGETS, *_BASE, *_allocation(capped=False))
_EVERY = "run_id, accept_idx, store_id, query_idx, pass_no, product_id"
ORACLES["allocation_uncapped"] = offers(f"select {_EVERY} from numbered", *_UNCAPPED)
_MANY = tuple(
    (name, sql.replace("case when run_id % 5 = 0 then 2 else 3 end as nq", "run_id % 8 + 1 as nq").replace("% 3 as query_idx", "% 8 as query_idx")
     .replace("(pk + sk) % 3", "(pk + sk) % 8").replace("<> pk % 3", "<> pk % 8"))
    for name, sql in (_RUNS, _TARGETS, *_BASE)
)
ORACLES["allocation_many_terms"] = offers(f"select {_EVERY} from numbered", *_MANY, *_allocation(8, capped=False))
ORACLES["quota_pass"] = offers("select run_id, store_id, query_idx, product_id from accepted where pass_no = 1", *_ALLOCATED)
ORACLES["rollover"] = offers("select run_id, store_id, query_idx, product_id from accepted where pass_no = 2", *_ALLOCATED)
ORACLES["allocation_full"] = offers("select run_id, accept_idx, store_id, query_idx, pass_no, product_id from numbered", *_ALLOCATED)
ORACLES["run_counts"] = offers(
    """select run_id, count(*) as total_products, count(*) filter (where store_id = 'amazon') as amazon_count,
      count(*) filter (where store_id = 'takealot') as takealot_count from accepted group by run_id""",
    *_ALLOCATED,
)
ORACLES["flagship"] = offers(
    f"""select n.run_id, accept_idx, n.store_id, n.product_id, title, price, {parse_price('price')} as price_numeric, {N_SPECS} as spec_count
      from numbered n join offers o on o.product_id = n.product_id""",
    *_UNCAPPED,
)
ORACLES["top_offers"] = offers(
    f"""select store_id, rn, product_id, p as price_numeric from (
      select *, row_number() over (partition by store_id order by p, oid) as rn from (select *, {parse_price('price')} as p from offers)
      where p is not null) where rn <= 10"""
)
ORACLES["multi_store_union"] = offers(
    """select oid, store_id, case when store_id = 'amazon' then product_id end as asin,
      case when store_id = 'takealot' then product_id end as plid from offers"""
)

# --- comparison --------------------------------------------------------------------------------

_CONTEXT = "case pk % 4 " + " ".join(f"when {i} then {q(c)}" for i, c in enumerate(A.CONTEXTS)) + " end"


def _hits(pk: int) -> str:
    """How many context words of a set occur in the listing."""
    terms = [t for t in A.CONTEXTS[pk].lower().split() if len(t) > 3 and t.isascii()]
    text = "lower(concat(specs_text, bullets_text))"
    return " + ".join(f"cast(contains({text}, {q(t)}) as int)" for t in terms) or "0"


_BONUS = "least(1.2e0, (case pk % 4 " + " ".join(f"when {i} then {_hits(i)}" for i in range(4)) + " end) * 0.4e0)"


def _scored(price: str, where: str = "true", table: str = "offers") -> tuple[tuple[str, str], ...]:
    return (
        (
            "priced",
            rf"""select *, {price} as p, coalesce(try_cast(nullif(regexp_extract(rating, '[\d.]+'), '') as double), 4.5e0) as r,
              {_BONUS} as bonus, {_CONTEXT} as context, {N_SPECS} as n_specs from {table}""",
        ),
        (
            "ranged",
            f"""select *, coalesce(min(p) filter (where p > 0) over (partition by pk), 100.0e0) as lo,
              coalesce(max(p) filter (where p > 0) over (partition by pk), 1000.0e0) as hi from priced where {where}""",
        ),
        (
            "part_scored",
            f"""select *, least(9.5e0, greatest(6.0e0, 7.0e0 + n_specs * 0.3e0)) as specs_score,
              case when hi > lo then {tenths('9.5e0 - (p - lo) / (hi - lo) * 3.5e0')} else 8.5e0 end as value_score,
              {tenths('least(10.0e0, r * 2.0e0)')} as performance_score from ranged""",
        ),
        ("built", f"select *, {tenths('least(10.0e0, performance_score * 0.95e0 + 0.5e0)')} as build_score from part_scored"),
        (
            "scored",
            f"""select *, {tenths('least(9.9e0, performance_score * 0.35e0 + value_score * 0.25e0 + specs_score * 0.25e0 + build_score * 0.15e0 + bonus)')}
              as overall_score from built""",
        ),
    )


_SCORED = _scored(loose("price"))
ORACLES["price_extremes"] = offers(
    f"""select pk as comparison_id, coalesce(min(p) filter (where p > 0), 100.0e0) as min_price, coalesce(max(p) filter (where p > 0), 1000.0e0) as max_price
      from (select pk, {loose('price')} as p from offers) group by pk"""
)
ORACLES["context_bonus"] = offers(f"select product_id, {_BONUS} as context_bonus from offers")
ORACLES["scores"] = offers(
    """select pk as comparison_id, product_id, specs_score, value_score, r as rating_val, performance_score, build_score, overall_score
      from scored""",
    *_SCORED,
)
ORACLES["strict_scores"] = offers(
    "select pk as comparison_id, product_id, value_score, overall_score from scored",
    *_scored(f"coalesce({parse_price('price')}, 0.0e0)", "p > 0"),
)
_CUT = "list_transform(list_slice({b}, 1, 2), lambda b: case when length(b) > 90 then concat(substr(b, 1, 90), '...') else b end)"
_PROS = f"""list_concat(list_filter([
    case when p = lo and lo > 0 then concat('Lowest price in comparison matrix (', price, ')') end,
    case when r >= 4.7e0 then concat('Outstanding user satisfaction rating (', cast(r as varchar), '/5.0)') end,
    case when n_specs >= 5 then concat('Comprehensive technical specs dataset (', cast(n_specs as varchar), ' attributes verified)') end],
  lambda x: x is not null), {_CUT.format(b=BULLETS)})"""
def _pros_cons(keys: str) -> str:
    return f"""select {keys}, array_to_string(list_slice(case when len(found) < 2 then
        list_append(found, 'Solid feature baseline with positive market feedback') else found end, 1, 3), chr(10)) as pros, cons
      from (select {keys}, {_PROS} as found, case when p = hi and hi > lo then concat('Highest cost item in selected dataset (', price, ')')
        else 'Slightly higher weight/footprint depending on your portability needs' end as cons from scored)"""


ORACLES["pros_cons"] = offers(_pros_cons("product_id"), *_SCORED)
_PLACES = (
    "places",
    """select *, row_number() over (partition by pk order by overall_score desc, sk) as position,
      row_number() over (partition by pk order by value_score desc, overall_score desc, sk) as by_value from scored""",
)
ORACLES["ranking"] = offers("select pk as comparison_id, position, product_id, overall_score from places", *_SCORED, _PLACES)
ORACLES["winner"] = offers(
    "select pk as comparison_id, product_id as winner_id, overall_score as winner_score from places where position = 1", *_SCORED, _PLACES
)
ORACLES["best_value"] = offers(
    "select pk as comparison_id, product_id as best_value_id, value_score as best_value_score from places where by_value = 1", *_SCORED, _PLACES
)
def _verdict(asked: str, more: str = "") -> str:
    return f"""select a.id as comparison_id, {more}w.title as winner_title, b.title as best_value_title,
      case when w.pk is not null then concat('Based on comprehensive spec analysis, pricing efficiency, and feature density, **', w.title,
        '** emerges as the top recommendation', case when w.context <> '' then concat(' tailored to your preference ''', w.context, '''') else '' end, '.',
        chr(10), chr(10), 'Key Deciding Factors:', chr(10), '1. **Overall Performance Score:** ', cast(w.overall_score as varchar),
        '/10 across verified technical benchmarks.', chr(10),
        '2. **Spec Density:** Delivers high value with strong component features relative to price.', chr(10),
        '3. **User Satisfaction:** Holds top customer feedback scores.') end as recommendation_reason,
      case when w.pk is null then 'No products provided for comparison.' else concat('If budget is your top priority, go with **', b.title, '** (', b.price,
        '). If maximum performance and spec completeness are required, **', w.title, '** is the clear winner.') end as verdict_summary
      from ({asked}) a
      left join places w on w.pk = a.id and w.position = 1 left join places b on b.pk = a.id and b.by_value = 1"""


ORACLES["verdict"] = offers(_verdict("select p_partkey as id from part union all select -1"), *_SCORED, _PLACES)
_LACKING = (
    "lacking",
    """select * replace (case when sk % 5 = 0 then 'Product' else title end as title, case when sk % 7 = 0 then '$0.00' else price end as price,
      case when sk % 3 = 0 then '' else specs_text end as specs_text, case when sk % 4 = 0 then '' else bullets_text end as bullets_text,
      case when sk % 6 = 0 then concat('PROD_', cast(sk as varchar)) else product_id end as product_id,
      case when sk % 11 = 0 then '' else rating end as rating) from offers""",
)
_LACKING_SCORED = (_LACKING, *_scored(loose("price"), table="lacking"))
ORACLES["scores_sparse"] = offers(
    "select pk as comparison_id, sk as idx, product_id, specs_score, value_score, r as rating_val, overall_score from scored", *_LACKING_SCORED
)
ORACLES["pros_cons_sparse"] = offers(_pros_cons("pk as comparison_id, sk as idx").replace("from (select pk as comparison_id, sk as idx", "from (select pk, sk"), *_LACKING_SCORED)
ORACLES["verdict_sparse"] = offers(
    _verdict("select p_partkey * 2 as id from part", "w.product_id as winner_id, "), *_LACKING_SCORED, _PLACES
)

# --- pages, payloads, sections -----------------------------------------------------------------

_ING = r"(?i)(?:Active\s+)?Ingredients:?\s*([^.\n]+(?:\.[^.\n]+){0,2})"
_SPEC_ING = ", ".join(f"case when {spec(k)} is not null then concat('{k}: ', {spec(k)}) end" for k in INGREDIENT_KEYS)


def ingredients(text: str, sure: str) -> str:
    """Statements found in a text that no earlier one contains, after the sure ones."""
    fold = (
        "list_reduce(list_concat([{sure}], list_transform(list_filter(list_transform(regexp_extract_all({text}, {p}, 1), lambda m: {strip}), "
        "lambda m: length(m) > 5), lambda m: [m])), lambda found, m: case when len(list_filter(found, lambda f: contains(f, m[1]))) > 0 then found "
        "else list_append(found, m[1]) end)"
    ).format(sure=sure, text=text, p=q(_ING), strip=strip("m"))
    return f"coalesce(nullif(array_to_string({fold}, ' | '), ''), 'Not specified on main detail page')"


ORACLES["ingredients_text"] = offers(
    f"""select oid, {ingredients("concat(description, ' ', replace(bullets_text, chr(10), ' '))",
        f"list_filter([{_SPEC_ING}], lambda x: x is not null)")} as ingredients from offers"""
)
ORACLES["directions_text"] = offers(
    rf"""select oid, {strip(r"regexp_extract(description, '(?i)Directions:?\s*([^.]+(?:\.[^.]+){0,2})', 1)")} as directions,
      {strip(r"regexp_extract(description, '(?i)Safety (?:Warning|Information):?\s*([^.]+(?:\.[^.]+){0,2})', 1)")} as safety_warning,
      {strip(r"regexp_extract(description, '(?i)(?:Suggested Use|Directions|How to use):?\s*([^.\n]+(?:\.[^.\n]+){0,2})', 1)")} as suggested_use,
      {strip(r"regexp_extract(description, '(?i)(?:Disclaimer|Safety Warning|Warnings?|Caution):?\s*([^.\n]+(?:\.[^.\n]+){0,3})', 1)")} as disclaimer
      from offers"""
)
_DOC = "case when doc_id % 2 = 0 then concat(text, ' Ingredients: salt, ', lang, '. Directions: stir. Wait.') else text end"
ORACLES["document_sections"] = rf"""select doc_id, {ingredients("concat(t, ' ')", "[]::varchar[]")} as ingredients,
  length(case when contains(t, 'Directions') then {strip(r"regexp_extract(t, '(?i)Directions:?\s*([^.]+(?:\.[^.]+){0,2})', 1)")} else '' end) as directions_length
  from (select doc_id, {_DOC} as t from documents)"""

_PAY_PRICE = f"case when oid % 3 <> 0 then {display('price')} else concat(case when url like '%.co.za%' then 'R' else '$' end, cast(cents // 100 as varchar)) end"
_PAY_LINES = f"list_transform({SPECS}, lambda s: regexp_replace(s, ': ', '='))"
_PAY_KIND = tuple(
    (n, s.replace("trim(description)", "''")) if n == "texts" else (n, s) for n, s in (_TEXTS, _FLAGS, _KINDS)
)
ORACLES["api_payload"] = offers(
    f"""select product_id, title, {_PAY_PRICE} as price, {parse_price(_PAY_PRICE)} as price_numeric, {display('original_price')} as original_price,
      case when oid % 4 = 0 then 'N/A' else '4.5' end as rating, cast(sk as bigint) as review_count_numeric,
      case when oid % 5 <> 0 then 'In Stock' else 'Unknown' end as availability,
      array_to_string(case when pk % 13 = 0 then ['Brand=Overlay'] else list_concat(['Brand=Overlay'], list_slice({_PAY_LINES}, 2, 99)) end, ';') as specs,
      package_type from kinds""",
    *_PAY_KIND,
)

_PAGE_PRICE = "concat('R', cast(c // 100 as varchar), '.', lpad(cast(c % 100 as varchar), 2, '0'))"
_PAGE_NOTES = "list_transform(range(1, pk % 6 + 2), lambda i: concat('Note ', cast(i as varchar), '=', cast(pk + i as varchar)))"
ORACLES["page_extract"] = f"""with p as (select *, p_partkey as pk, cast(round(p_retailprice * 100) as bigint) as c from part where p_partkey % 50 <> 0),
  e as (select 'Amazon' as source, lpad(cast(pk as varchar), 10, '0') as product_id, concat(p_name, ' Refill 2 x 5 ml') as title, p_brand as brand,
    {_PAGE_PRICE} as price, c / 100.0e0 as price_numeric, 'ZAR' as currency, 4.5e0 as rating_numeric, pk as review_count_numeric,
    'In Stock' as availability, 'Directions: Use daily. Rest.' as description, 'Use daily. Rest' as directions, '' as breadcrumbs,
    concat('Size ', cast(p_size as varchar), '|Built-in battery &case') as bullets, array_to_string({_PAGE_NOTES}, ';') as specs,
    {q(C.REFILL_TYPE)} as package_type, 1 as n_alerts, p_brand as seller, concat('https://www.amazon.co.za/dp/', lpad(cast(pk as varchar), 10, '0')) as url
    from p where pk % 2 = 0),
  o as (select 'Takealot' as source, concat('PLID', cast(pk as varchar)) as product_id, p_name as title, p_brand as brand,
    {_PAGE_PRICE} as price, c / 100.0e0 as price_numeric, 'ZAR' as currency, null as rating_numeric, 0 as review_count_numeric,
    'In stock' as availability, 'Good. First item Second item' as description, '' as directions, p_type as breadcrumbs,
    'First item|Second item' as bullets, array_to_string(list_concat([concat('Brand=', p_brand), concat('Size=', cast(p_size as varchar))], {_PAGE_NOTES}), ';') as specs,
    {q(C.STANDARD)} as package_type, 0 as n_alerts, 'Takealot' as seller, concat('https://www.takealot.com/x/PLID', cast(pk as varchar)) as url
    from p where pk % 2 = 1)
  select * from e union all select * from o"""
ORACLES["page_products"] = rf"""select url, {_PAGE_STORE} as store_id,
  {strip(r"replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&amp;', '&')")} as title,
  'Price unavailable' as price, cast(null as double) as price_numeric, 'In Stock' as availability from pages"""

_LOOKED = """asked as (select distinct case when sk % 2 = 1 then url when pk % 2 = 0 then concat('https://www.amazon.co.za/dp/', lpad(cast(pk as varchar), 10, '0'))
      else concat('https://www.takealot.com/x/PLID', cast(pk as varchar)) end as url from offers)"""
_STORED = f"""stored as (select case when p_partkey % 2 = 0 then concat('https://www.amazon.co.za/dp/', lpad(cast(p_partkey as varchar), 10, '0'))
      else concat('https://www.takealot.com/x/PLID', cast(p_partkey as varchar)) end as url,
      case when p_partkey % 2 = 0 then concat(p_name, ' Refill 2 x 5 ml') else p_name end as title, p_brand as brand,
      concat('R', cast(cast(round(p_retailprice * 100) as bigint) // 100 as varchar), '.',
        lpad(cast(cast(round(p_retailprice * 100) as bigint) % 100 as varchar), 2, '0')) as price
      from part where p_partkey % 50 <> 0)"""
_IS_TAKEALOT = "contains(a.url, 'takealot')"
ORACLES["page_lookup"] = (
    offers("", )[:-1]
    + f""", {_LOOKED}, {_STORED}
  select a.url, case when {_IS_TAKEALOT} then 'takealot' else 'amazon' end as store_id,
    regexp_extract(a.url, '[^/]+$') as product_id,
    coalesce(s.title, case when {_IS_TAKEALOT} then 'Takealot Product' else concat('Amazon Product (', regexp_extract(a.url, '[^/]+$'), ')') end) as title,
    coalesce(s.price, 'Price unavailable') as price,
    coalesce(s.brand, case when {_IS_TAKEALOT} then null else 'Amazon' end) as brand
  from asked a left join stored s on s.url = a.url"""
)
ORACLES["page_lookup_snapshots"] = ORACLES["page_lookup"]
ORACLES["direct_rejects"] = offers(
    """select oid, case oid % 3 when 0 then concat('https://nowhere.example/', product_id) else concat('free text ', title) end as input,
      'unknown shop' as reason from offers where oid % 3 <> 2"""
)
ORACLES["direct_products"] = (
    offers("")[:-1]
    + f""", {_STORED}, given as (select 0 as part, case when p_partkey % 2 = 0 then concat('https://www.amazon.co.za/dp/', lpad(cast(p_partkey as varchar), 10, '0'))
      else concat('https://www.takealot.com/x/PLID', cast(p_partkey as varchar)) end as url from part
      union all select 1, url from offers where oid % 3 <> 0),
    firsts as (select regexp_extract(url, '[^/]+$') as unique_key, contains(url, 'takealot') as t, min((part, url)) as f from given group by 1, 2)
  select f[2] as input, case when t then 'takealot' else 'amazon' end as store_id, unique_key, unique_key as product_id,
    coalesce(s.title, case when t then 'Takealot Product' else concat('Amazon Product (', unique_key, ')') end) as title,
    cast(substr(s.price, 2) as double) as price_numeric
  from firsts left join stored s on s.url = case when t then f[2] else concat('https://', split_part(f[2], '/', 3), '/dp/', unique_key) end"""
)

ORACLES["result_page_links"] = offers(
    """select run_id, store_id, query_idx, page_num, cast(2 * row_number() over (partition by run_id, store_id, query_idx, page_num order by pos, href) - 1 as int) as pos, href
      from (select run_id, store_id, query_idx, case when stale and page > 3 then page + 1 else page end as page_num, pos, href from asked
        union all select run_id, store_id, query_idx, 4, pos, href from asked where stale and page = 3)""",
    _PLACED, _ASKED,
)
ORACLES["result_page_forms"] = ORACLES["result_page_links"]
_PART_LISTINGS = """select p_partkey as pk, p_partkey as sk, case when p_partkey % 2 = 0 then 'amazon' else 'takealot' end as store_id,
  case when p_partkey % 2 = 0 then lpad(cast(p_partkey as varchar), 10, '0') else concat('PLID', cast(p_partkey as varchar)) end as product_id,
  case when p_partkey % 50 = 0 then concat('Amazon Product (', lpad(cast(p_partkey as varchar), 10, '0'), ')')
    when p_partkey % 2 = 0 then concat(p_name, ' Refill 2 x 5 ml') else p_name end as title,
  case when p_partkey % 50 = 0 then 'Price unavailable' else concat('R', cast(cast(round(p_retailprice * 100) as bigint) // 100 as varchar), '.',
    lpad(cast(cast(round(p_retailprice * 100) as bigint) % 100 as varchar), 2, '0')) end as price,
  'x' as specs_text, 'x' as bullets_text, '' as image_url,
  case when p_partkey % 2 = 0 then concat('https://www.amazon.co.za/dp/', lpad(cast(p_partkey as varchar), 10, '0'))
    else concat('https://www.takealot.com/x/PLID', cast(p_partkey as varchar)) end as url from part"""
ORACLES["search_pages"] = "with " + ", ".join(
    f"{n} as ({sql})" for n, sql in (("offers", _PART_LISTINGS), _RUNS, _TARGETS, *_BASE, *_allocation(capped=False))
) + """ select n.run_id, accept_idx, n.store_id, query_idx, pass_no, n.product_id, title, price
  from numbered n join offers o on o.product_id = n.product_id"""

ORACLES["page_fields"] = """with p as (select *, cast(p_partkey as varchar) as n, p_partkey % 2 = 0 as even, p_partkey % 50 = 0 as bare from part)
  select case when even then lpad(n, 10, '0') else concat('PLID', n) end as product_id,
    case when bare then concat('Amazon Product (', lpad(n, 10, '0'), ')') else p_name end as title,
    case when bare then '' when even then concat('R', cast(p_partkey + 100 as varchar), '.50') else concat('R ', cast(p_partkey + 100 as varchar)) end as original_price,
    case when bare then '' when even then concat('https://m.media-amazon.com/i/', n, '.jpg') else concat('https://media.takealot.com/covers_images/', n, '.jpg') end as image_url,
    case when bare then '' when even then concat('https://m.media-amazon.com/i/', n, '.jpg https://m.media-amazon.com/i/b', n, '.jpg')
      else concat('https://media.takealot.com/covers_images/', n, '.jpg') end as gallery,
    case when bare then 'Unknown' when even then concat('Only ', cast(p_partkey % 9 as varchar), ' left') else 'In stock' end as availability,
    case when even and not bare then concat('Safety Information', chr(10), 'Keep dry.') else '' end as important_information,
    case when bare then '' when even then concat('From the brand number ', n) end as aplus_content,
    case when bare then '' when even then concat('Tool ', n, '|Case') else concat('Tub ', n) end as box,
    case when bare then 'Amazon.co.za' else concat('Shop ', cast(p_partkey % 7 as varchar)) end as seller,
    case when bare then 'Amazon.co.za' when even then 'Mover' else 'Takealot' end as shipper,
    p_partkey % 4 = 0 and not bare as is_prime,
    case when bare then 'Standard 30-day return policy' when even then concat(cast(p_partkey % 30 + 1 as varchar), ' Days Returnable')
      else 'Takealot 30-day return policy' end as return_policy,
    case when bare then '' when even then concat(n, '+ bought') end as social_proof
  from p"""

# --- sinks -------------------------------------------------------------------------------------

ORACLES["json_document"] = offers(
    "select run_id as report_id, count(*) as products, cast(1 as bigint) as heads from accepted group by run_id", *_ALLOCATED
)
ORACLES["json_dataset"] = f"""select case when p_partkey % 2 = 0 then lpad(cast(p_partkey as varchar), 10, '0') else concat('PLID', cast(p_partkey as varchar)) end as product_id,
  case when p_partkey % 2 = 0 then concat(p_name, ' Refill 2 x 5 ml') else p_name end as title, cast(round(p_retailprice * 100) as bigint) / 100.0e0 as price_numeric,
  cast(p_partkey % 6 + 1 + case when p_partkey % 2 = 0 then 0 else 2 end as int) as n_specs,
  case when p_partkey % 2 = 0 then {q(C.REFILL_TYPE)} else {q(C.STANDARD)} end as package_type from part where p_partkey % 50 <> 0"""

_USE = strip(r"regexp_extract(description, '(?i)(?:Suggested Use|Directions|How to use):?\s*([^.\n]+(?:\.[^.\n]+){0,2})', 1)")
_REPORT = (
    (
        "listed",
        f"""select n.run_id as report_id, n.accept_idx as idx, case n.store_id when 'amazon' then 'Amazon' else 'Takealot' end as store, o.*,
          coalesce({spec('Brand')}, '') as brand, {_USE} as directions from numbered n join offers o on o.product_id = n.product_id""",
    ),
    ("sizes", "select report_id, count(*) as n from listed group by report_id"),
    (
        "blocks",
        r"""select report_id, 0 as section, 0 as idx, concat('# Scraped Product Metadata Spec Document', chr(10), chr(10),
            '**Date:** 2024-01-01 00:00:00', chr(10), '**Total Products:** ', cast(n as varchar), chr(10), chr(10), '---', chr(10), chr(10),
            '## 📊 Products Metadata Summary Table', chr(10), chr(10),
            '| # | Store | Product Name | Brand | Price | Rating | ID / ASIN | Link |', chr(10), '| :--- | :--- | :--- | :--- | :--- | :--- | :--- | :--- |') as body from sizes
        union all select report_id, 1, idx, concat('| ', cast(idx as varchar), ' | **', store, '** | **', replace(title, '|', '-'), '** | ', brand, ' | `', price, '` | ',
            rating, ' | `', product_id, '` | [Link](', url, ') |') from listed
        union all select report_id, 2, 0, concat(chr(10), '---', chr(10), chr(10), '## 🔍 Detailed Product Metadata & Technical Specifications', chr(10)) from sizes
        union all select report_id, 3, idx, concat_ws(chr(10), concat('### Product ', cast(idx as varchar), ': [', store, '] ', title),
            concat('- **Brand:** ', brand), concat('- **ASIN:** `', product_id, '`'),
            concat('- **Price:** **', price, '**', case when original_price <> '' then concat(' *(Original Price: ', original_price, ')*') else '' end),
            concat('- **Rating:** ', rating, ' (', review_count, ')'), '- **Availability:** In Stock', concat('- **URL:** ', url), '',
            case when description <> '' then concat('#### Product Description:', chr(10), description, chr(10)) end,
            case when directions <> '' then concat('#### Directions:', chr(10), directions, chr(10)) end,
            case when bullets_text <> '' then concat('#### Key Features / Highlights:', chr(10), '- ', replace(bullets_text, chr(10), concat(chr(10), '- ')), chr(10)) end,
            case when specs_text <> '' then concat('#### Product Information, Features & Technical Specs:', chr(10), '| Attribute | Value |', chr(10), '| :--- | :--- |', chr(10),
              array_to_string(list_transform(string_split(rtrim(specs_text, chr(10)), chr(10)),
                lambda s: concat('| **', replace(split_part(s, ': ', 1), '|', '-'), '** | ', replace(split_part(s, ': ', 2), '|', '-'), ' |')), chr(10)), chr(10)) end,
            '---', '') from listed""",
    ),
)
ORACLES["markdown_report"] = offers(
    """select report_id, section, cast(idx as bigint) as idx, cast(line - 1 as int) as line, text from (
      select report_id, section, idx, unnest(lines) as text, generate_subscripts(lines, 1) as line
      from (select report_id, section, idx, string_split(body, chr(10)) as lines from blocks))""",
    *_ALLOCATED,
    *_REPORT,
)

# --- streams -----------------------------------------------------------------------------------

# The lists by definition: the state of each link after every event, found by going through its events
# in order with a recursive query.
_REPLAY = """with recursive log as (select user_id, event_id as seq, event_id % 6 as kind,
    case when event_type = 'click' then 'toggle' when event_type in ('view', 'purchase') then 'add' when event_type = 'signup' then 'clear' end as action
    from events where event_type in ('click', 'view', 'purchase', 'signup')),
  pairs as (select distinct user_id, kind from log where action <> 'clear' and kind <> 5),
  steps as (select p.user_id, p.kind, l.seq, l.action, row_number() over (partition by p.user_id, p.kind order by l.seq) as n
    from pairs p join log l on l.user_id = p.user_id and (l.action = 'clear' or l.kind = p.kind)),
  state as (select user_id, kind, 0::bigint as n, null::bigint as added_at from pairs
    union all select s.user_id, s.kind, s.n, case s.action when 'clear' then null when 'add' then coalesce(state.added_at, s.seq)
      else case when state.added_at is null then s.seq end end
    from state join steps s on s.user_id = state.user_id and s.kind = state.kind and s.n = state.n + 1),
  final as (select user_id, kind, arg_max(coalesce(added_at, -1), n) as added_at from state group by user_id, kind)
  select user_id, concat('https://www.amazon.com/nice-item/dp/', lpad(cast(kind as varchar), 10, 'B0')) as url, added_at from final where added_at >= 0"""
ORACLES["click_replay"] = _REPLAY
ORACLES["click_stream"] = _REPLAY
ORACLES["click_rejects"] = """select user_id, event_id as seq,
    case event_type when 'click' then 'toggle' when 'view' then 'add' when 'purchase' then 'add' when 'signup' then 'clear' else event_type end as action,
    case when event_type not in ('click', 'view', 'purchase', 'signup') then 'unknown action' else 'no product link' end as reason
  from events where event_type not in ('click', 'view', 'purchase', 'signup') or (event_type <> 'signup' and event_id % 6 = 5)"""
ORACLES["watch_stream"] = f"""select case when p_partkey % 2 = 0 then lpad(cast(p_partkey as varchar), 10, '0') else concat('PLID', cast(p_partkey as varchar)) end as product_id,
  case when p_partkey % 50 = 0 then concat('Amazon Product (', lpad(cast(p_partkey as varchar), 10, '0'), ')')
    when p_partkey % 2 = 0 then concat(p_name, ' Refill 2 x 5 ml') else p_name end as title,
  case when p_partkey % 50 = 0 then 'Price unavailable' else concat('R', cast(cast(round(p_retailprice * 100) as bigint) // 100 as varchar), '.',
    lpad(cast(cast(round(p_retailprice * 100) as bigint) % 100 as varchar), 2, '0')) end as price,
  case when p_partkey % 2 = 0 then concat('https://www.amazon.co.za/dp/', lpad(cast(p_partkey as varchar), 10, '0'))
    else concat('https://www.takealot.com/x/PLID', cast(p_partkey as varchar)) end as url from part"""
ORACLES["watch_saved_again"] = ORACLES["watch_stream"].replace("select ", "select cast(p_partkey % 40 // 10 as varchar) as list, ", 1) + (
    " where case when p_partkey % 40 // 10 in (1, 2) then p_partkey % 10 >= 3 else p_partkey % 10 < 6 end"
)
ORACLES["stream_dedupe"] = offers(
    "select store_id, product_id as unique_key from offers"
)
ORACLES["markdown_files"] = f"select report_id, text from ({ORACLES['markdown_report']})"
ORACLES["rewritten_runs"] = ORACLES["allocation_full"]

# --- three shops -------------------------------------------------------------------------------

_VILLAGE = f"""select pk, sk, case when pk % 3 = 0 then 'village' else store_id end as store_id,
  case when pk % 3 = 0 then cast(pk as varchar) else product_id end as product_id,
  case when pk % 3 <> 0 then title when pk % 50 = 0 then 'Village Product' else concat('Village ', (select p_name from part where p_partkey = pk)) end as title,
  price, specs_text, bullets_text, image_url,
  case when pk % 3 = 0 then concat('https://village.example/item/', cast(pk as varchar)) else url end as url from ({_PART_LISTINGS})"""
# Which of a run's shops come first, and how many it has, by the last digit of what it asks for.
_THREE_TARGETS = (
    "targets",
    """select run_id, store_id, cast(lim * (n + 1) // k - lim * n // k as int) as target, min_price, max_price, nq
      from (select r.*, s.store_id, s.n, s.k from runs r join (values
        (0, 'amazon', 0, 3), (0, 'takealot', 1, 3), (0, 'village', 2, 3), (1, 'amazon', 0, 2), (1, 'takealot', 1, 2),
        (2, 'amazon', 0, 2), (2, 'village', 1, 2), (3, 'village', 0, 1), (4, 'takealot', 0, 1)) s(kind, store_id, n, k) on kind = run_id % 5)""",
)
ORACLES["three_shops"] = "with " + ", ".join(
    f"{n} as ({sql})" for n, sql in (("offers", _VILLAGE), _RUNS, _THREE_TARGETS, *_BASE, *_allocation(capped=False))
) + """ select n.run_id, accept_idx, n.store_id, query_idx, pass_no, n.product_id, title, price
  from numbered n join offers o on o.product_id = n.product_id and o.store_id = n.store_id"""
ORACLES["three_shop_counts"] = "with " + ", ".join(f"{n} as ({s})" for n, s in (_RUNS, _THREE_TARGETS)) + """
  select run_id, store_id, target, cast(null as varchar) as reason from targets
  union all select run_id, 'nowhere', null, 'unknown shop' from runs where run_id % 5 = 4"""
ORACLES["link_rejects"] = "with " + ", ".join(f"{n} as ({sql})" for n, sql in (("offers", _VILLAGE), *_BASE)) + """
  select run_id, store_id, query_idx, cast(page_num as int) as page_num, pos, case when store_id = 'village' then 'unknown shop' else 'no product' end as reason
  from links where store_id = 'village' or pos % 7 = 0"""

# --- escapes, SQL functions, payloads, bounded streams -----------------------------------------

_CASES = lambda values: " ".join(f"when {i} then {q(v) if v is not None else 'null'}" for i, v in enumerate(values))
ORACLES["title_escapes"] = offers(f"select oid, concat(case pk % {len(A.ESCAPED)} {_CASES([w for _, w in A.ESCAPED])} end, cast(oid as varchar)) as title from offers")
ORACLES["sql_functions"] = offers(
    f"""select oid, {parse_price('price')} as price_numeric, {display('price')} as price_display,
      case when store_id = 'amazon' then product_id end as asin, case when store_id = 'takealot' then product_id end as plid from offers"""
)
_TITLES = [{0: "Good", 5: "Nulls", 7: "Twice"}.get(i) for i in range(len(A.PAYLOADS))]
ORACLES["payload_rejects"] = offers(
    f"""select url, case when reason is null then product_id end as product_id, title, reason from (
      select url, product_id, case pk % {len(A.PAYLOADS)} {_CASES(_TITLES)} end as title,
        case pk % {len(A.PAYLOADS)} {_CASES([r for _, r in A.PAYLOADS])} end as reason from offers)"""
)
ORACLES["stream_dedupe_bounded"] = offers(
    "select store_id, product_id as unique_key, day from offers cross join (values (0), (2)) d(day)"
)
ORACLES["route_many"] = offers(
    """select oid, case when oid % 11 = 0 then null when pk * 7 % 4000 < 3000 then concat('s', cast(pk * 7 % 4000 as varchar))
      else concat('d', cast(pk * 7 % 10 as varchar)) end as store_id from offers"""
)
