"""URL lists and free text as sources of product inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerlens.functions.identity import unique_key, urls_in_text
from offerlens.functions.text import let, strip_u
from offerlens.operators.ranking import keep_first
from offerlens.operators.routing import StoreRegistry


def read_url_list(spark: SparkSession, path: str, extra: list[str] | None = None) -> DataFrame:
    """Inputs ``(part, line, input)`` of text files, one per line, blank lines dropped.

    ``line`` grows with the position in the files; inputs given in ``extra`` come after all of them.
    """
    lines = spark.read.text(path).select(
        F.lit(0).alias("part"),
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("line"),
        strip_u(F.col("value")).alias("input"),
    )
    if extra:
        given = spark.createDataFrame([(i, v.strip()) for i, v in enumerate(extra)], "line bigint, input string")
        lines = lines.unionByName(given.withColumn("part", F.lit(1)).withColumn("file", F.lit("")))
    return lines.where(F.col("input") != "")


def dedupe_inputs(
    inputs: DataFrame,
    order: list[Column],
    text: str = "input",
    store_id: str | None = None,
    scope: tuple[str, ...] = (),
    registry: StoreRegistry | None = None,
) -> DataFrame:
    """First input of every product, by identifier where the text holds one, else by the text.

    ``scope`` names columns inside which the search for repeats happens. With a ``registry``, every store's own
    identifier rule counts.
    """
    store = F.col(store_id) if store_id else None
    key = unique_key(F.col(text), store)
    if registry and store is not None:
        key = F.coalesce(let(registry.identifier(store, F.col(text)), lambda own: F.when(own != "", own)), F.col(text))
    keyed = inputs.withColumn("unique_key", key)
    keys = [*scope, "unique_key"] + ([store_id] if store_id else [])
    return keep_first(keyed, keys, order)


def explode_text_urls(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row ``(…, pos, url)`` per distinct product URL of each text."""
    return texts.select(
        *[c for c in texts.columns if c != text], F.posexplode(urls_in_text(F.col(text))).alias("pos", "url")
    )
