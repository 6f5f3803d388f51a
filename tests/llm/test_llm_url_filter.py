"""URL filter: parts and rules against plain Python, the model on unseen hosts."""

from pyspark.sql import functions as F

from offerlens.llm import url_filter as U
from offerlens.llm.queries import URL_RULES

PAGES = "page_id bigint, url string"
URLS = [
    "http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://notexample.org/en/12", "http://org/", "http://org", "x://com/fr/",
    "http://b.com/FR/1", "http://b.com/fr", "HTTP://B.COM/de/?q", "http://b.net#://c.org/", "no scheme", "", None, "://", "a://b://c/d", "http://é.ÉCOM/de/\nz",
    "http://x.com?u=http://org/", "http://x.com/de/\n", "line\nfeed://k.org/p\nq?r", "http://example.org/en/1" + "0" * 50_000,
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    stop = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:stop], rest[stop:]
    end = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host.translate(low), rest[:end]


def rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def test_parts_and_rules(spark):
    rows = list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[1])]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit(1), "features": F.lit(2), "probability": F.lit(3), "score": F.lit("s")})
    found = U.judge(pages, URL_RULES, U.labelled_urls(spark)).collect()
    assert len(found) == len(rows)
    for r in found:
        host, path = parts(URLS[1] if r.page_id is None else URLS[r.page_id])
        want = rule(host, path, URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, want and want.host + want.path)
        assert r.verdict == (want.verdict if want else "block" if r.score >= 0.5 else "allow")


def test_model_on_unseen_hosts(spark):
    urls = [(i, f"https://www.{h}.example.net/en/7") for i, h in enumerate(["casino-royal", "cheap-pills-shop", "porn-videos", "spam-site", "local-news", "wether-map", "thother", "history"])]
    verdicts = [r.verdict for r in U.judge(spark.createDataFrame(urls, PAGES), (), U.labelled_urls(spark)).orderBy("page_id").collect()]
    assert verdicts == ["block"] * 4 + ["allow"] * 4


def test_no_labels_no_rows(spark):
    labels = spark.createDataFrame([("http://a.b/", 1.0), (None, None)], "url string, label double")
    pages = spark.createDataFrame([(1, "http://x.y/z")], PAGES)
    assert [(r.verdict, r.score) for r in U.judge(pages, (), labels).collect()] == [("allow", 0.0)]
    assert U.judge(pages.limit(0), URL_RULES, U.labelled_urls(spark)).count() == 0
