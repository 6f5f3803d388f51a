"""Stored search-result pages -> the links on them, in page order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from offerlens.operators.routing import StoreRegistry
from offerlens.sources import anchors as reader

# The tokeniser travels with the job, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(reader)


def hrefs(pages: DataFrame, column: str = "html", out: str = "hrefs") -> DataFrame:
    """``pages`` with the addresses of all anchors of ``column``, in order, in its place; null pages have none."""
    kept = [f for f in pages.schema.fields if f.name not in (column, out)]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.StringType()))])
    names, arrow, anchors = [f.name for f in kept], to_arrow_schema(schema), reader.anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(anchors(html)) for html in batch.column(column).to_pylist()]
            columns = [batch.column(n).cast(arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, arrow.field(out).type)], schema=arrow)

    return pages.select(*names, column).mapInArrow(run, schema)


def page_links(pages: DataFrame, registry: StoreRegistry | None = None) -> DataFrame:
    """Pages ``(run_id, store_id, query_idx, page_num, html)`` -> links ``(…, pos, href)`` to products.

    ``pos`` counts all anchors of a page from 0. A page without a product link gives no row, which later ends its
    term's list like a page that was never stored. Null pages have no links, nor have pages of unknown stores.
    """
    registry = registry or StoreRegistry()
    keys = ["run_id", "store_id", "query_idx", "page_num"]
    links = hrefs(pages.select(*keys, "html")).select(*keys, F.posexplode("hrefs").alias("pos", "href"))
    return links.where(registry.is_product_link(F.col("store_id"), F.col("href")))
