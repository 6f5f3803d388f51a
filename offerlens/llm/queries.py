"""Named queries of the training-data operators over the test tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerlens.llm import decontaminate, language, line_dedup, merkle, mixing, ngram_lm, pii, quality, repair, simhash, toxicity, url_filter, warc
from offerlens.llm.common import ascii_lower, fold, id_type
from offerlens.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_decontamination(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op2_toxicity(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    scorer = toxicity.train(docs, table(spark, sf, "labels").select("doc_id", "toxic"))
    found = toxicity.score(docs, scorer)
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# The rules of the url query.
URL_RULES = (
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
)


@query
def op3_url_filter(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"), URL_RULES, url_filter.labelled_urls(spark))


@query
def op4_lm_scores(spark, sf):
    found = ngram_lm.lm_scores(table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log", 6).alias("mean_log"))


@query
def op5_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.train(docs)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op6_quality(spark, sf):
    return quality.judge(table(spark, sf, "documents"))


@query
def op7_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op8_warc(spark, sf):
    path, pages = new_path(spark, "warc"), table(spark, sf, "pages")
    warc.write_archive(pages, path)
    return warc.read_archive(spark, path, id_type(pages, "page_id")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_line_dedup(spark, sf):
    found = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return found.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


@query
def op10_mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _listed(spans) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op11_pii(spark, sf):
    found = pii.find_pii(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))


@query
def op12_merkle(spark, sf):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = merkle.manifest(table(spark, sf, "documents"), tampered=F.when(tampered, merkle.leaf(text=ascii_lower(F.col("text")))))
    return merkle.verify(found, F.coalesce("tampered", "leaf"))


@query
def op13_repair(spark, sf):
    return repair.audit(repair.damage(table(spark, sf, "conversations")), "gone")


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _crc32(ascii_text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    byte = f"list_transform(range(1, length({ascii_text}) + 1), lambda p: cast(ascii({ascii_text}[p]) as bigint))"
    bits = "list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {byte}), lambda c, b: {bits}), 4294967295)"


def _tree(first: str, name: str, levels: int) -> tuple[str, str, str]:
    """CTEs of the trees over ``first(tree, pos, n, hash, leaf, path)``, the leaves at their roots, and the roots.

    Each level keeps, per leaf, the node that the leaf has reached and what stood beside it on the way.
    """
    ctes, last = [], first
    for k in range(levels):
        runs, up = f"{name}_runs{k}", f"{name}_up{k}"
        ctes.append(f"""{runs} as (
    select tree, pos // 16 run, string_agg(hash, '' order by pos) slots from (select distinct tree, pos, hash from {last} where n > 1) group by 1, 2),
{up} as (
    select tree, run pos, (n + 15) // 16 n, sha256(slots) hash, leaf, list_append(path, {{
        'before': substr(slots, 1, 64 * (l.pos % 16)), 'after': substr(slots, 64 * (l.pos % 16 + 1) + 1)}}) path
    from {last} l join {runs} r using (tree) where n > 1 and run = l.pos // 16
    union all select * from {last} where n = 1)""")
        last = up
    return ",\n".join(ctes), last, f"(select distinct tree, hash from {last})"


_LEAF = "sha256(" + " || ".join(
    f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
) + ")"
_EMPTY_PATH = "cast([] as struct(before varchar, after varchar)[])"
_DOC_LEVELS, _DOC_PATHS, _DOC_ROOTS = _tree("doc", "doc", 8)
_TOP_LEVELS, _TOP_PATHS, _TOP_ROOTS = _tree("top", "top", 8)

# States of a repaired conversation: n(othing), s(ystem), u(ser), a(ssistant).
_INSERTS = """('n', 'n', 0, '', null), ('n', 'u', 5, 'I', 'user:'), ('n', 'a', 10, 'II', 'user:' || chr(10) || 'assistant:'),
    ('s', 's', 0, '', null), ('s', 'u', 5, 'I', 'user:'), ('s', 'a', 10, 'II', 'user:' || chr(10) || 'assistant:'),
    ('u', 'u', 0, '', null), ('u', 'a', 5, 'I', 'assistant:'), ('a', 'a', 0, '', null), ('a', 'u', 5, 'I', 'user:')"""
_OWN = """('n', 's', 's', 'K', 0, null), ('n', 'u', 'u', 'K', 0, null), ('s', 'u', 'u', 'K', 0, null), ('a', 'u', 'u', 'K', 0, null),
    ('u', 'a', 'a', 'K', 0, null), ('n', null, 'u', 'R', 1, 'user'), ('s', null, 'u', 'R', 1, 'user'), ('a', null, 'u', 'R', 1, 'user'),
    ('u', null, 'a', 'R', 1, 'assistant'), ('n', null, 'n', 'D', 2, null), ('s', null, 's', 'D', 2, null),
    ('u', null, 'u', 'D', 2, null), ('a', null, 'a', 'D', 2, null)"""

ORACLES: dict[str, str] = {
    "op1_decontamination": rf"""
with word as (
    select doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
item as (
    select cast(item_id as varchar) item, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
    from benchmark where text is not null),
win as (
    select distinct item, least(len(w), 10) n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') win
    from item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) where len(w) > 0),
lens as (select distinct n from win),
place as (
    select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') win
    from word, lens, unnest(range(1, len(w) - n + 2)) t(i)),
hit as (select doc_id, i, p.n, item from place p join win using (n, win)),
covered as (select doc_id, count(distinct j) n_hit from (select distinct doc_id, i, n from hit), unnest(range(i, i + n)) t(j) group by 1),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) listed from (select distinct doc_id, item from hit) group by 1)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
    sha256(coalesce(listed, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from word left join covered using (doc_id) left join items using (doc_id)""",
    "op4_lm_scores": rf"""
with word as (
    select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w from documents),
place as (select doc_id, unnest(w) w, generate_subscripts(w, 1) i from word),
pair as (select doc_id, i, lag(w) over (partition by doc_id order by i) v, w from place),
one as (select w, count(*) c from place group by 1),
own_one as (select doc_id, w, count(*) c from place group by 1, 2),
two as (select v, w, count(*) c from pair where v is not null group by 1, 2),
own_two as (select doc_id, v, w, count(*) c from pair where v is not null group by 1, 2, 3),
rest as (select doc_id, len(w) n, sum(len(w)) over () - len(w) others from word),
counted as (
    select p.doc_id, p.i, n, others, one.c - o1.c c1, ctx.c - oc.c cc, two.c - o2.c c2
    from pair p join rest using (doc_id) join one on one.w = p.w join own_one o1 on o1.doc_id = p.doc_id and o1.w = p.w
    left join one ctx on ctx.w = p.v left join own_one oc on oc.doc_id = p.doc_id and oc.w = p.v
    left join two on two.v = p.v and two.w = p.w left join own_two o2 on o2.doc_id = p.doc_id and o2.v = p.v and o2.w = p.w),
scored as (
    select doc_id, case when c2 > 0 then ln(c2 / cc)
        else ln(case when c1 > 0 then c1 / others else 0.5 / greatest(others, 1) end) + case when i > 1 then ln(0.4) else 0 end end s
    from counted)
select doc_id, cast(n as bigint) n_words, round(coalesce(sum(s), 0), 4) log_score, round(sum(s) / n, 6) mean_log
from rest left join scored using (doc_id) group by doc_id, n""",
    "op8_warc": """
with page as (
    select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
first as (select payload_digest, min(page_id) first_id from page where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
    case when first_id is not null and page_id <> first_id then 'revisit' else 'response' end record_type,
    case when page_id <> first_id then first_id end refers_to
from page left join first using (payload_digest)""",
    "op9_line_dedup": f"""
with line as (
    select doc_id, l, i, {_LOWER.format(f'trim(l, {_BLANKS})')} k
    from (select doc_id, unnest(parts) l, generate_subscripts(parts, 1) i
          from (select doc_id, string_split(coalesce(text, ''), chr(10)) parts from documents))),
key as (select k, max(doc_id) keeper from line where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select doc_id, l, i, keeper is not null and keeper <> doc_id as gone from line left join key using (k))
select doc_id, count(*) n_lines, cast(count(*) filter (gone) as bigint) n_dropped,
    sha256(coalesce(string_agg(l, chr(10) order by i) filter (not gone), '')) kept_sha256
from marked group by doc_id""",
    "op10_mixing": r"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) size,
        cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) h
    from documents),
total as (select source, cast(sum(size) as bigint) source_size from sized group by source),
weighed as (
    select *, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] weight from total),
levels as (
    select *, 1.5::double * sum(source_size) over () budget,
        2.0::double * coalesce(sum(source_size) over (o rows between unbounded preceding and 1 preceding), 0) stopped,
        sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0) open_weight
    from weighed window o as (order by source_size / weight, source nulls last)),
level as (
    select max((budget - stopped) / open_weight) level from levels
    where (budget - stopped) / open_weight * weight < 2.0::double * source_size),
goal as (
    select source, source_size, coalesce(least(weight * level, 2.0::double * source_size), 2.0::double * source_size) target
    from weighed, level),
cut as (
    select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end whole from goal),
running as (
    select doc_id, s.size, c.*, target - whole * source_size rest,
        sum(s.size) over (partition by s.source order by h) upto
    from sized s join cut c on s.source is not distinct from c.source),
ends as (select source, min(upto) at_end from running where upto >= rest group by source),
last as (
    select r.source, max(upto) filter (upto < at_end) before, any_value(at_end) at_end
    from running r join ends e on r.source is not distinct from e.source group by r.source)
select doc_id, size, source_size, target,
    cast(size * (whole + case when rest > 0 and (upto < at_end
        or upto = at_end and at_end - rest < rest - coalesce(before, 0)) then 1 else 0 end) as bigint) taken
from running r join last l on r.source is not distinct from l.source""",
    "op12_merkle": f"""
with leaf as (
    select doc_id, source, {_LEAF.format(text='text')} hash, case when {_crc32('cast(doc_id as varchar)')} % 5 = 0
        then {_LEAF.format(text=_LOWER.format('text'))} end tampered, row_number() over (order by doc_id, text) as id
    from documents),
doc as (
    select coalesce('=' || source, '') tree, row_number() over (partition by source order by doc_id nulls first, hash, id) - 1 as pos,
        count(*) over (partition by source) n, hash, {{'id': id, 'doc_id': doc_id, 'hash': hash, 'tampered': tampered}} leaf, {_EMPTY_PATH} path
    from leaf),
{_DOC_LEVELS},
top as (
    select 1 tree, row_number() over (order by s.tree) - 1 as pos, count(*) over () n, hash, s.tree leaf, {_EMPTY_PATH} path from {_DOC_ROOTS} s),
{_TOP_LEVELS},
whole as (
    select d.leaf.doc_id doc_id, d.leaf.hash leaf, d.hash subroot, t.hash root, list_concat(d.path, t.path) path, coalesce(d.leaf.tampered, d.leaf.hash) claimed
    from {_DOC_PATHS} d join {_TOP_PATHS} t on t.leaf = d.tree),
folded as (
    select *, list_reduce(list_prepend({{'before': '', 'after': claimed}}, path),
        lambda h, s: {{'before': '', 'after': sha256(s.before || h.after || s.after)}}).after folded_root from whole)
select doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s.before || s.after), ''), '')) proof_sha256,
    folded_root, folded_root = root verified
from folded""",
    "op13_repair": f"""
with recursive raw as (
    select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t,
        {_crc32("(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))")} % 20 fault
    from conversations),
damaged as (
    select conv_id, turn, case when fault = 4 then 'user' else r end r,
        case when fault = 1 then '' when fault = 2 then replace(replace(replace(t, '.', ''), '!', ''), '?', '') else t end t,
        unnest(case when fault = 3 then [1, 2] else [1] end) again
    from raw where fault <> 0),
placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, r, t, again) i, trim(t, {_BLANKS}) bare from damaged),
marked as (
    select *, lag(r[1]) over (partition by conv_id order by i) || r[1] pair,
        case when bare = '' then 'b' when row_number() over (partition by conv_id, r, t order by i) > 1 then 'd'
            when right(bare, 1) not in ('.', '!', '?') then 't' else '' end fault
    from placed),
facts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) n, count(*) filter (fault = 'b') blank,
        count(*) filter (fault = 'd') duplicate, count(*) filter (fault = 't') truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal
    from marked group by 1),
ins as (from (values {_INSERTS}) v(before, mid, cost, letters, added)),
own as (from (values {_OWN}) v(mid, initial, after, letter, cost, role)),
path as (
    select distinct conv_id, 0::bigint i, 'n' state, {{'cost': 0::bigint, 'audit': '', 'repaired': null::varchar}} best from raw
    union all
    select m.conv_id, m.i, own.after, min({{
        'cost': cast(best.cost + ins.cost + own.cost + case when letter <> 'D' and fault = 't' then 5 else 0 end as bigint),
        'audit': best.audit || letters || letter,
        'repaired': nullif(concat_ws(chr(10), best.repaired, added, case when letter <> 'D' then coalesce(role, r) || ':' || t end), '')}})
    from path p join marked m on m.conv_id is not distinct from p.conv_id and m.i = p.i + 1
        join ins on before = state join own on own.mid = ins.mid
    where (letter = 'D' or fault not in ('b', 'd')) and (initial is null or initial = r[1])
    group by 1, 2, 3),
ended as (
    select p.conv_id, min({{'cost': best.cost + tail.cost, 'audit': best.audit || letters, 'repaired': concat_ws(chr(10), best.repaired, added)}}) best
    from path p left join facts f on f.conv_id is not distinct from p.conv_id
        join (from ins where mid = 'a' or before = 'n' and mid = 'n') tail on before = state
    where i = coalesce(n, 0) and (state <> 'n' or mid = 'n') group by 1)
select e.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
    coalesce(illegal, 0) illegal, cast(best.cost as bigint) cost, best.audit as audit, sha256(best.repaired) repaired_sha256
from ended e left join facts f on f.conv_id is not distinct from e.conv_id""",
}
