import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from offerlens import adapters as A
from offerlens.operators.routing import StoreRegistry
from offerlens.sinks import dataset as D
from offerlens.sinks.markdown import markdown_lines
from offerlens.sources.pages import extract_products
from offerlens.sources.urls import read_url_list
from offerlens.streaming import clicks, watch as W

from conftest import TINY

AT = "2024-01-01 00:00:00"


@pytest.fixture(scope="module")
def numbered(spark):
    df = extract_products(A.shop_pages(spark, TINY).limit(12), StoreRegistry()).cache()
    rows = df.orderBy("url").collect()
    order = spark.createDataFrame([(r.url, i % 2, i // 2 + 1) for i, r in enumerate(rows)], "url string, report_id int, idx int")
    return df.join(order, "url")


def test_json_document_is_valid(spark, numbered, tmp_path):
    path = str(tmp_path / "out.json")
    D.export(numbered, path, F.lit(AT))
    for report in (0, 1):
        folder = f"{path}/report_id={report}"
        text = "".join(open(f"{folder}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(folder)) if f.endswith(".txt"))
        doc = json.loads(text)
        assert doc["metadata"]["total_products"] == len(doc["products"])
        assert doc["products"][0]["title"] and isinstance(doc["products"][0]["specs"], dict)


def test_markdown_export(spark, numbered, tmp_path):
    path = str(tmp_path / "out.MD")
    D.export(numbered, path, F.lit(AT))
    folder = f"{path}/report_id=0"
    text = "".join(open(f"{folder}/{f}", encoding="utf-8").read() for f in sorted(os.listdir(folder)) if f.endswith(".txt"))
    assert text.startswith("# Scraped Product Metadata Spec Document\n\n**Date:** 2024-01-01 00:00:00\n**Total Products:** ")
    assert text.index("### Product 1:") < text.index("### Product 2:") and "#### 🌿" not in text
    assert text.count("| **Note 1** |") == text.count("\n### Product ")


def test_table_cells_are_escaped(spark, numbered):
    odd = numbered.withColumns({"title": F.lit("a|b"), "specs": F.expr("array(named_struct('key', 'k|1', 'value', 'v|2'))")})
    lines = [r.text for r in markdown_lines(odd, F.lit(AT)).collect()]
    assert any("**a-b**" in x for x in lines) and any(x == "| **k-1** | v-2 |" for x in lines)


def test_dataset_round_trip(spark, numbered, tmp_path):
    path = str(tmp_path / "set")
    products = numbered.drop("report_id", "idx")
    D.write_dataset(products, path, F.lit(AT))
    back = D.read_dataset(spark, path)
    key = lambda df: sorted((r.url, r.title, r.price_numeric, tuple(map(tuple, r.specs)), r.package_details) for r in df.collect())
    assert key(back) == key(products)
    assert spark.read.json(path + "/metadata").first().total_products == products.count()


def test_url_list(spark, tmp_path):
    (tmp_path / "urls.txt").write_text(" a \n\n \nb\n", encoding="utf-8")
    rows = read_url_list(spark, str(tmp_path / "urls.txt"), ["c", " "]).orderBy("part", "file", "line").collect()
    assert [r.input.strip() for r in rows] == ["a", "b", "c"]


def replay_plain(events):
    lists = {}
    for user, seq, action, url in sorted(events, key=lambda e: e[1]):
        own = lists.setdefault(user, {})
        if action == "clear":
            own.clear()
        elif url not in own:
            own[url] = seq
        elif action == "toggle":
            del own[url]
    return sorted((u, url, at) for u, own in lists.items() for url, at in own.items())


def random_clicks(n=4000):
    rng = random.Random(11)
    actions = ["add"] * 4 + ["toggle"] * 6 + ["clear"]
    return [(0 if rng.random() < 0.4 else rng.randint(1, 60), i, rng.choice(actions), f"u{rng.randint(0, 6)}") for i in range(n)]


CLICKS = "user_id bigint, seq bigint, action string, url string"


def test_click_replay(spark):
    events = random_clicks()
    found = clicks.replay(spark.createDataFrame(events, CLICKS), block=64).collect()
    assert sorted((r.user_id, r.url, r.added_at) for r in found) == replay_plain(events)


def test_click_stream_equals_batch(spark, tmp_path):
    """Six batches; the last has one user's events only and writes nothing of others."""
    events = random_clicks(600)
    last_seq = events[-1][1]
    events += [(3, last_seq + 1, "add", "new"), (3, last_seq + 2, "toggle", "u1"), (3, last_seq + 3, "add", "other"), (3, last_seq + 4, "toggle", "other")]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(6):
        rows = events[k * 120 : (k + 1) * 120] if k < 5 else events[600:]
        spark.createDataFrame(rows, CLICKS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CLICKS).option("maxFilesPerTrigger", 1).parquet(source)
    query = clicks.collect_stream(stream, out, str(tmp_path / "state"))
    query.awaitTermination()
    found = clicks.latest_lists(spark, out).collect()
    assert sorted((r.user_id, r.url, r.added_at) for r in found) == replay_plain(events)
    assert clicks.late_clicks(spark, out).isEmpty()
    sixth = spark.read.parquet(f"{out}/batch_id=5").collect()
    assert {(r.user_id, r.url) for r in sixth} == {(3, "new"), (3, "u1")}
    assert len([p for p in query.recentProgress if p.numInputRows]) == 6


def test_late_and_repeated_clicks(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, 1, "add", "a"), (1, 2, "add", "b")], [(1, 2, "add", "b"), (1, 5, "clear", None)], [(1, 3, "toggle", "a"), (1, 6, "add", "b"), (2, 1, "add", "a")]]
    for rows in batches:
        spark.createDataFrame(rows, CLICKS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CLICKS).option("maxFilesPerTrigger", 1).parquet(source)
    clicks.collect_stream(stream, out, str(tmp_path / "state"), parts=4).awaitTermination()
    assert sorted(map(tuple, clicks.latest_lists(spark, out).collect())) == [(1, "b", 6), (2, "a", 1)]
    assert sorted(map(tuple, clicks.late_clicks(spark, out).collect())) == [(1, 2, "add", "b"), (1, 3, "toggle", "a")]


def test_lists_are_kept_over_many_batches(spark, tmp_path):
    """Twelve batches, the lists written as a whole after every third; a batch with the log's old events changes nothing."""
    events = random_clicks(600)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for k in range(12):
        rows = events[k * 50 : (k + 1) * 50] + (events[:50] if k == 8 else [])
        spark.createDataFrame(rows, CLICKS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CLICKS).option("maxFilesPerTrigger", 1).parquet(source)
    for k in (5, 12):  # stopped once on the way
        query = clicks.collect_stream(stream, out, state, parts=4, whole_every=3, processingTime="0 seconds")
        while query.isActive and (query.lastProgress or {"batchId": -1})["batchId"] < k - 1:
            time.sleep(0.2)
        query.stop()
        assert query.exception() is None
    found = clicks.latest_lists(spark, out).collect()
    assert sorted((r.user_id, r.url, r.added_at) for r in found) == replay_plain(events)
    late = {tuple(r) for r in clicks.late_clicks(spark, out).collect()}
    assert late and late <= set(events[:50])
    kept = sorted(int(f.split("=")[1]) for f in os.listdir(f"{state}/lists") if "=" in f)
    assert len(kept) <= 7 and kept[-1] == 11


def test_no_python_call_per_user(spark, tmp_path):
    """Many users and a user with a third of the clicks; no step of the stream calls Python on its rows."""
    events = [(i % 3 and i, i, ("add", "toggle", "add", "clear")[i % 4], f"u{i % 7}") for i in range(6000)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame(events[k * 3000 : (k + 1) * 3000], CLICKS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(CLICKS).option("maxFilesPerTrigger", 1).parquet(source)
    query = clicks.collect_stream(stream, out, str(tmp_path / "state"))
    query.awaitTermination()
    assert not any(p.stateOperators for p in query.recentProgress)
    found = clicks.latest_lists(spark, out).collect()
    assert sorted((r.user_id, r.url, r.added_at) for r in found) == replay_plain(events)
    assert clicks.late_clicks(spark, out).isEmpty()


def test_click_rejects(spark):
    good = "https://www.amazon.com/x/dp/B000000001/ref=1"
    rows = [(None, 1, "add", good), (1, None, "add", good), (1, 2, "open", good), (1, 3, None, good), (1, 4, "add", "https://e.org/"), (1, 5, "toggle", None), (1, 6, "clear", None), (1, 7, "add", good)]
    events = spark.createDataFrame(rows, CLICKS)
    assert [r.seq for r in clicks.clean_clicks(events).orderBy("seq").collect()] == [6, 7]
    lost = [(r.seq, r.reason) for r in clicks.click_rejects(events).orderBy("seq").collect()]
    assert lost == [(None, "no place in the log"), (1, "no user"), (2, "unknown action"), (3, "unknown action"), (4, "no product link"), (5, "no product link")]


def test_watch(spark, tmp_path):
    pages = A.shop_pages(spark, TINY)
    folder = tmp_path / "in"
    folder.mkdir()
    urls = [r.url for r in pages.where("url like '%PLID%'").orderBy("url").limit(3).collect()]
    (folder / "urls.txt").write_text("\n".join([urls[0], urls[1] + "?x=1", urls[1], " ", urls[2]]))
    stream = W.input_stream(spark, str(folder))
    W.watch(stream, pages, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.url for r in rows) == sorted(urls) and all(r.price.startswith("R") for r in rows)


def test_a_list_saved_again_replaces_its_products(spark, tmp_path):
    pages = A.shop_pages(spark, TINY)
    urls = [r.url for r in pages.where("url like '%PLID%'").orderBy("url").limit(4).collect()]
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def save(name, lines, at):
        (folder / name).write_text("\n".join(lines))
        os.utime(folder / name, (at, at))

    def poll(n):
        W.poll_lists(spark, str(folder), pages, out, n)
        rows = W.latest_products(spark, out).collect()
        return sorted((r.list.rsplit("/", 1)[1], urls.index(r.url)) for r in rows)

    save("a.txt", [urls[0], urls[1] + "?x=1", urls[1], " "], 1000)
    save("b.txt", [urls[0]], 1000)
    assert poll(0) == [("a.txt", 0), ("a.txt", 1), ("b.txt", 0)]
    save("a.txt", [urls[1], urls[2]], 2000)
    assert poll(1) == [("a.txt", 1), ("a.txt", 2), ("b.txt", 0)]
    assert poll(1) == [("a.txt", 1), ("a.txt", 2), ("b.txt", 0)]  # a repeated poll replaces itself
    save("b.txt", ["no product here"], 3000)
    assert poll(2) == [("a.txt", 1), ("a.txt", 2)]
    assert poll(3) == [("a.txt", 1), ("a.txt", 2)]
    assert spark.read.parquet(f"{out}/products/batch_id=3").count() == 0  # nothing is read again
    save("c.txt", [urls[3]], 4000)
    assert poll(4) == [("a.txt", 1), ("a.txt", 2), ("c.txt", 3)]


def test_lists_are_watched(spark, tmp_path):
    pages = A.shop_pages(spark, TINY)
    url = pages.where("url like '%PLID%'").first().url
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(url)
    out = str(tmp_path / "out")
    query = W.watch_lists(spark, str(tmp_path / "in"), pages, out, str(tmp_path / "state"), interval="1 second")
    try:
        for _ in range(120):
            if (query.lastProgress or {"batchId": -1})["batchId"] >= 1 or query.exception():
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert query.exception() is None
    assert [r.url for r in W.latest_products(spark, out).collect()] == [url]


def test_stream_dedupe(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("https://www.takealot.com/x/PLID1\nhttps://www.takealot.com/y/PLID1?z\nB0DLT1WSHY\n")
    unique = W.dedupe_stream(W.input_stream(spark, str(folder)))
    q = unique.writeStream.format("memory").queryName("unique_inputs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("unique_inputs").count() == 2


def test_runs_are_rewritten_one_by_one(spark, tmp_path):
    path = str(tmp_path / "runs")
    D.rewrite_runs(spark.createDataFrame([(1, "a"), (2, "b")], "run_id int, title string"), path)
    for _ in range(2):
        D.rewrite_runs(spark.createDataFrame([(2, "b"), (2, "c")], "run_id int, title string"), path)
    assert sorted((r.run_id, r.title) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (2, "c")]


def test_many_runs_share_folders(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs = spark.range(200).select(F.col("id").alias("run_id"), F.lit("a").alias("title")).union(spark.sql("select cast(null as bigint), 'a'"))
    D.rewrite_runs(runs, path, buckets=8)
    D.rewrite_runs(runs.where("run_id % 2 = 0 or run_id is null").withColumns({"title": F.lit("b"), "more": F.lit(1)}), path, buckets=8)
    assert len([f for f in os.listdir(path) if "=" in f]) <= 8
    rows = spark.read.option("mergeSchema", "true").parquet(path).collect()
    assert len(rows) == 201
    assert all((r.title, r.more) == (("b", 1) if r.run_id is None or r.run_id % 2 == 0 else ("a", None)) for r in rows)
