"""Click logs -> each user's collected links.

Events are ``(user_id, seq, action, url)`` with ``seq`` a total order. ``add`` puts a link at the end
unless it is there, ``toggle`` removes it if it is there and else adds it, ``clear`` empties the list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from offerlens.functions.identity import clicked_url
from offerlens.operators.ranking import keep_first, with_group_facts
from offerlens.storage import write_batch


def _reason(link: Column) -> Column:
    """Why an event can't be replayed; null for those that can."""
    return (
        F.when(F.col("user_id").isNull(), "no user")
        .when(F.col("seq").isNull(), "no place in the log")
        .when(~F.coalesce(F.col("action").isin("add", "toggle", "clear"), F.lit(False)), "unknown action")
        .when((F.col("action") != "clear") & link.isNull(), "no product link")
    )


def clean_clicks(events: DataFrame) -> DataFrame:
    """Events with canonical links, without those of :func:`click_rejects`."""
    link = clicked_url(F.col("url"))
    return events.where(_reason(link).isNull()).withColumn("url", F.when(F.col("action") != "clear", link))


def click_rejects(events: DataFrame) -> DataFrame:
    """The events that :func:`clean_clicks` leaves out, as they came, with a ``reason``."""
    return events.withColumn("reason", _reason(clicked_url(F.col("url")))).where("reason is not null")


# Stretch of ``seq`` that may meet in one task.
BLOCK = 1 << 20


def replay(events: DataFrame, block: int = BLOCK, owner: Sequence[str] = ("user_id",)) -> DataFrame:
    """Final lists as rows ``(user_id, url, added_at)``; a list is ordered by ``added_at``. ``owner`` tells lists apart.

    A link's last toggle decides: before it, the last add (if any) and the parity of the toggles since
    give its state; after it, only adds can follow. All of this is aggregated per stretch of ``seq`` first,
    so neither a busy user nor a popular link is worked off in one task.
    """
    key = [*owner, "url"]
    stretch = F.floor(F.col("seq") / block)
    add, toggle, seq = F.col("action") == "add", F.col("action") == "toggle", F.col("seq")
    last_toggle, add_before = F.col("last_toggle"), F.col("add_before")

    clears = {"cleared": (F.max(F.when(F.col("action") == "clear", seq)), F.max("cleared"))}
    live = (
        with_group_facts(events.where("seq is not null"), [*owner], stretch, clears)
        .where("action <> 'clear' and (cleared is null or seq > cleared)")
        .select(*key, "seq", "action")
    )
    toggles = {"last_toggle": (F.max(F.when(toggle, seq)), F.max("last_toggle"))}
    live = with_group_facts(live, key, stretch, toggles)
    after = F.when(add & (last_toggle.isNull() | (seq > last_toggle)), seq)
    adds = {
        "add_before": (F.max(F.when(add & (seq < last_toggle), seq)), F.max("add_before")),
        "add_after": (F.min(after), F.min("add_after")),
    }
    live = with_group_facts(live, key, stretch, adds)
    flips = F.count(F.when(toggle & (add_before.isNull() | (seq > add_before)), F.lit(1)))
    state = live.groupBy(*key, stretch.alias("stretch")).agg(
        flips.alias("n"), *[F.first(c).alias(c) for c in ("last_toggle", "add_before", "add_after")]
    )
    state = state.groupBy(*key).agg(
        F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("last_toggle", "add_before", "add_after")]
    )
    on = (F.col("n") + add_before.isNotNull().cast("int")) % 2 == 1
    added_at = F.when(last_toggle.isNull(), F.col("add_after")).otherwise(
        F.when(on, last_toggle).otherwise(F.col("add_after"))
    )
    return state.select(*key, added_at.alias("added_at")).where("added_at is not null")


def export_lists(lists: DataFrame, path: str) -> None:
    """One folder of text per user, links in list order, one per line."""
    order = ["user_id", "added_at"]
    (
        lists.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("user_id", F.col("url").alias("value"))
        .write.mode("overwrite")
        .partitionBy("user_id")
        .text(path)
    )


CHANGES = "user_id bigint, url string, added_at bigint, seq bigint, action string, late boolean"
# A user's links are kept in parts; ``PLACES`` without a link says when the part's last event was.
OWNER = ["user_id", "part"]
EVENTS = "user_id bigint, seq bigint, action string, url string, part int"
PLACES = "user_id bigint, part int, url string, before bigint, added_at bigint, last bigint"


def _numbers(spark: SparkSession, folder: str, whole: int) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path(f"{folder}/batch_id=*/whole={whole}"))
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def _places(spark: SparkSession, folder: str, since: int, batches: list[int]) -> tuple[DataFrame, DataFrame]:
    """The parts of the lists with their last event, and the links in them, as the last of the ``batches`` has left them.

    ``since`` is the batch whose lists were written as a whole, -1 if there is none.
    """
    paths = [f"{folder}/batch_id={n}/whole=0" for n in batches if n > since] + [f"{folder}/batch_id={since}/whole=1"] * (since >= 0)
    schema = PLACES + ", batch_id bigint, whole int"
    none = [f"cast(null as {kind}) as {name}" for name, kind in (c.split() for c in schema.split(", "))]
    rows = spark.read.schema(schema).option("basePath", folder).parquet(*paths) if paths else spark.range(0).selectExpr(*none)
    known = rows.where("url is null").groupBy(*OWNER).agg(F.max("batch_id").alias("batch_id"), F.max("last").alias("last"))
    links = rows.where("added_at is not null").select(*OWNER, "batch_id", "url", "added_at")
    return known, links.join(known.drop("last"), [*OWNER, "batch_id"]).drop("batch_id")


def _keep(spark: SparkSession, batch: DataFrame, batch_id: int, out: str, folder: str, parts: int, whole_every: int) -> None:
    """Work off one micro-batch; repeated, it reads what the batches before it left and replaces itself.

    What the lists hold takes part in the replay as links added at their places, so the batch needs no order of its own and no
    user is worked off in one task. ``folder/batch_id=N`` gets the parts of the lists that the batch touches, and after every
    ``whole_every`` batches all of them, so that a batch reads a bounded number of such tables.
    """
    batches = [n for n in _numbers(spark, folder, 0) if n < batch_id]
    since = max((n for n in _numbers(spark, folder, 1) if n < batch_id), default=-1)
    if batch_id and batch_id - 1 not in batches:
        raise ValueError(f"{folder} has no lists of batch {batch_id - 1}; start with a new checkpoint")
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    own = F.array(F.pmod(F.xxhash64("url"), F.lit(parts)).cast("int"))
    part = F.explode(F.when(F.col("action") == "clear", every).otherwise(own))
    batch.select("user_id", "seq", "action", "url", part.alias("part")).write.mode("overwrite").parquet(f"{folder}/events")

    events = spark.read.schema(EVENTS).parquet(f"{folder}/events")
    known, links = _places(spark, folder, since, batches)
    nth = F.row_number().over(Window.partitionBy(*OWNER, "seq").orderBy(F.col("action") != "clear", "url", "action"))
    late = (F.col("nth") > 1) | F.coalesce(F.col("seq") <= F.col("last"), F.lit(False))
    judged = events.withColumn("nth", nth).join(known.drop("batch_id"), OWNER, "left").withColumn("late", late).drop("nth", "last")
    held = links.join(events.select(*OWNER).distinct(), OWNER, "left_semi")
    held = held.select(*OWNER, F.col("added_at").alias("seq"), F.lit("held").alias("action"), "url", F.lit(False).alias("late"))
    judged.unionByName(held).write.mode("overwrite").parquet(f"{folder}/log")

    log = spark.read.schema(EVENTS + ", late boolean").parquet(f"{folder}/log")
    live, none = log.where("not late"), F.lit(None).cast("bigint")
    touched = live.where("action <> 'held'").groupBy(*OWNER).agg(F.max("seq").alias("last"))
    now = replay(live.withColumn("action", F.when(F.col("action") == "held", "add").otherwise(F.col("action"))), owner=OWNER)
    before = live.where("action = 'held'").select(*OWNER, "url", F.col("seq").alias("before"), none.alias("added_at"))
    both = before.unionByName(now.withColumn("before", none)).groupBy(*OWNER, "url").agg(*[F.max(c).alias(c) for c in ("before", "added_at")])
    marks = touched.withColumns({"url": F.lit(None).cast("string"), "before": none, "added_at": none})
    both.join(touched, OWNER).unionByName(marks).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}/whole=0")

    new = spark.read.schema(PLACES).parquet(f"{folder}/batch_id={batch_id}/whole=0").where("url is not null and not before <=> added_at")
    changes = new.select("user_id", "url", "added_at", F.col("last").alias("seq"), F.lit(None).cast("string").alias("action"), F.lit(False).alias("late"))
    left_out = log.where("late").select("user_id", "url", none.alias("added_at"), "seq", "action", "late")
    write_batch(changes.unionByName(left_out), out, batch_id)
    if batch_id - since >= whole_every:
        known, links = _places(spark, folder, since, [*batches, batch_id])
        both = links.withColumn("last", none).unionByName(known.drop("batch_id").withColumns({"url": F.lit(None).cast("string"), "added_at": none}))
        both.withColumn("before", none).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}/whole=1")
        path = spark._jvm.org.apache.hadoop.fs.Path
        for n in (n for n in batches if n < since):  # a repeated batch still needs those from ``since`` on
            path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(f"{folder}/batch_id={n}"), True)


def collect_stream(events: DataFrame, out: str, checkpoint: str, parts: int = 16, whole_every: int = 16, **trigger) -> StreamingQuery:
    """Replay a stream of clean events, and write what each micro-batch changes in the users' lists under ``out/batch_id=N``.

    A row names a link that is new in its user's list, or moved, with its place ``added_at``; null means that it left. Only
    links that changed are written, whatever the lists hold; a repeated batch replaces itself.
    The lists are kept by (user, part of the links) as tables in ``checkpoint/lists``: a batch reads them, writes the parts it
    touches, and after every ``whole_every`` batches all of them. An event that clears goes to all ``parts`` of its user. The
    ``seq`` of a user's events has to grow from batch to batch: one that isn't behind the last of its part comes back with
    ``late`` and its action, and changes nothing; so an event delivered twice counts once.
    """
    spark, folder = events.sparkSession, f"{checkpoint}/lists"
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: _keep(spark, batch, batch_id, out, folder, parts, whole_every))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _written(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(CHANGES + ", batch_id bigint").parquet(out)


def latest_lists(spark: SparkSession, out: str) -> DataFrame:
    """The lists ``(user_id, url, added_at)`` after the last batch that :func:`collect_stream` wrote."""
    last = keep_first(_written(spark, out).where("not late"), ["user_id", "url"], [F.desc("batch_id")])
    return last.where("added_at is not null").select("user_id", "url", "added_at")


def late_clicks(spark: SparkSession, out: str) -> DataFrame:
    """Events that came after a later one of their user, and were left out; clears stand there once for each part."""
    return _written(spark, out).where("late").select("user_id", "seq", "action", "url").distinct()
