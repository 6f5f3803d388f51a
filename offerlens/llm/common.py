"""What several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLANK = " \t\n\x0b\x0c\r"  # what parts words
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def pick(batch: pa.RecordBatch, name: str, rows) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name)).take(pa.array(rows, pa.int64()))


class Sent:
    """A broadcast object of this package's own classes; tasks unpack it once."""

    def __init__(self, spark: SparkSession, value):
        self._packed, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"_packed": self._packed, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._packed.value)
        return self._value


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[list]], ddl: str | T.StructType) -> DataFrame:
    """``mapInArrow`` for a function that yields lists of columns in the order of the schema."""
    schema = T.StructType.fromDDL(ddl) if isinstance(ddl, str) else ddl
    arrow = to_arrow_schema(schema)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(it):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

    return df.mapInArrow(batches, schema)


def add_columns(df: DataFrame, compute: Callable[[pa.RecordBatch], list], ddl: str) -> DataFrame:
    """All rows and columns of ``df`` with further columns; new columns replace old ones of the same name."""
    new = T.StructType.fromDDL(ddl)
    taken = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in taken]
    names = [f.name for f in kept]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in it:
            yield [batch.column(batch.schema.get_field_index(n)) for n in names] + compute(batch)

    return map_rows(df, run, T.StructType(kept + new.fields))


def ascii_lower(c: Column) -> Column:
    """A-Z become small; all other characters stay, unlike with ``lower``."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words between blanks; an empty array for null and blank texts."""
    bare = F.btrim(c, F.lit(BLANK))
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(bare, F.lit("")) == "", none).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def fold(doc_id: Column) -> Column:
    """Fold of a document, 0 to 4, from its id alone; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def salted_join(rows: DataFrame, facts: DataFrame, on: str, by: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Rows joined with facts, unique in ``on``, that many rows may share: rows part by a hash of ``by``, facts go to each part."""
    parted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    everywhere = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return parted.join(everywhere, [on, "_salt"], how).drop("_salt")
