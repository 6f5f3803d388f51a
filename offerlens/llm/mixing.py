"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash of its id. Per source, sizes are summed by the top bits of the hash; the running sum
shows in which bucket the budget ends. Only the documents of that boundary bucket are summed again by the next bits,
until the bucket holds one document or the bits are used up. The end is a threshold on the hash, so the choice is a
filter: no sort of documents, and a larger budget takes a superset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from offerlens.llm.common import WORD
from offerlens.storage import stored

HASH_BITS, STEP_BITS = 60, 10
SALTS = 16  # parts of a source in the join, as one source may hold a third of all rows
WEIGHTS = (5, 2, 1)  # by the sources' order, repeating


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def id_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id's text; a null id hashes like an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def source_key(source: Column) -> Column:
    """Sortable and never null: sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """``(src, source_size)`` -> with ``target``: shares by weight, none above ``limit`` times the source's size.

    The level at which the shares add up is found in one pass over the sources in order of the size at which they
    stop, which is where resharing the excess again and again would end. One row for each source is handled here.
    """
    order = W.orderBy("src")
    nth = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight)
    stops = W.orderBy(F.col("source_size") / F.col("weight"), "src")
    everything = W.partitionBy(F.lit(0))
    before = stops.rowsBetween(W.unboundedPreceding, -1)
    filled = weighed.withColumns(
        {
            "budget": share * F.sum("source_size").over(everything),
            "stopped": limit * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("open"))
    fits = F.col("level") * F.col("weight") < limit * F.col("source_size")
    # The first source that doesn't stop has the level; those after it would give lower ones.
    level = F.max(F.when(fits, F.col("level"))).over(everything)
    least = F.least(F.col("weight") * level, limit * F.col("source_size"))
    return filled.select("src", "source_size", F.coalesce(least, limit * F.col("source_size")).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(src, size, h)`` and ``(src, rest)`` -> ``(src, cut)``: documents with ``h < cut`` take about ``rest`` words.

    The boundary document is taken if that comes nearer to the budget.
    """
    sized = sized.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int"))
    # low: start of the boundary bucket; rest: what is left of the budget there
    bounds = stored(budgets.select("src", F.lit(0).cast("bigint").alias("low"), F.col("rest").cast("double").alias("rest")), "mix-bounds")
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        width = 1 << shift + STEP_BITS
        salted = bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        inside = sized.join(salted, ["src", "salt"]).where((F.col("h") >= F.col("low")) & (F.col("h") - F.col("low") < F.lit(width)))
        bucket = F.shiftright(F.col("h") - F.col("low"), shift).alias("bucket")
        sums = inside.groupBy("src", bucket).agg(
            F.sum("size").alias("size"), F.count("*").alias("docs"), F.first("low").alias("low"), F.first("rest").alias("rest")
        )
        upto = F.sum("size").over(W.partitionBy("src").orderBy("bucket"))
        # The boundary is the first bucket in which the budget ends; without one, all is taken.
        ends = sums.withColumn("upto", upto).where("upto >= rest").groupBy("src").agg(
            F.min_by(F.struct("bucket", "size", "docs", (F.col("upto") - F.col("size")).alias("before"), "low", "rest"), "bucket").alias("at")
        )
        found = ends.select(
            "src", (F.col("at.low") + F.col("at.bucket") * F.lit(1 << shift)).alias("low"),
            (F.col("at.rest") - F.col("at.before")).alias("rest"), F.col("at.size").alias("last"), F.col("at.docs").alias("docs"),
        )
        bounds = stored(found, "mix-bounds")
        if bounds.where("docs > 1").isEmpty():
            break
    take = F.col("last") - F.col("rest") < F.col("rest")
    # Documents of the boundary bucket share it down to the last bit, or it holds one: it is taken as a whole or not.
    return bounds.select("src", (F.col("low") + F.when(take, F.lit(1 << shift)).otherwise(F.lit(0))).alias("cut"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    limit: float = 2.0,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """One row for each row of ``docs``: id, ``src``, ``size``, ``source_size``, ``target``, ``taken``, ``copies``.

    A source's budget is its target; ``floor(target / source_size)`` copies of all its documents are taken, and the
    rest by the hash threshold. ``copies`` is how often a document is taken, ``limit`` times at most. The taken words
    are off the target by half the size of one document at most (rows with one id are taken together). Null and
    blank texts have size 0 and are taken like others. A source without words has the target 0. Null sources are one
    source, the last; a null id is an id. Other columns are ignored.
    """
    columns = [F.col(id_col), F.col(source_col), size_of(F.col(text_col)).alias("size")]
    sized = stored(docs.select(*columns), "mix-sizes")
    return take(sized, plan(sized, weights, share, limit, id_col, source_col), id_col, source_col).select(
        id_col, "src", "size", "source_size", "target", "taken", "copies"
    )


def plan(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0,
    id_col: str = "doc_id", source_col: str = "source",
) -> DataFrame:
    """Sizes of documents -> one row for each source: ``src``, ``source_size``, ``target``, ``whole``, ``cut``."""
    keyed = sized.select(source_key(F.col(source_col)).alias("src"), "size", id_hash(F.col(id_col)).alias("h"))
    totals = stored(keyed.groupBy("src").agg(F.sum("size").alias("source_size")), "mix-sources")
    goal = stored(targets(totals, weights, share, limit), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = thresholds(keyed, goal.where("rest > 0"))
    return stored(goal.join(cuts, "src", "left").drop("rest"), "mix-plan")


def take(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Apply a plan to rows with a ``size``: all their columns and the plan's, ``taken`` and ``copies``."""
    new = ("src", "source_size", "target", "whole", "cut", "taken", "copies")
    kept = docs.select(*[c for c in docs.columns if c.lower() not in new])
    copies = F.col("whole") + F.when(id_hash(F.col(id_col)) < F.col("cut"), 1).otherwise(0)
    return (
        kept.withColumn("src", source_key(F.col(source_col)))
        .join(plan, "src")
        .withColumn("copies", copies)
        .withColumn("taken", F.col("size") * F.col("copies"))
        .drop("whole", "cut")
    )
