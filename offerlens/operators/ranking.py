"""Row numbers and top-k that stay spread out when one group holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of every key in the given order.

    ``row_number() = 1`` lets Spark drop all but one row per key before the shuffle, so a hot key
    costs one row per input partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: Column | int,
    spread_on: list[str],
    count_distinct: bool = False,
    salts: int | None = None,
) -> DataFrame:
    """First ``k`` rows of every group, ``k`` being a number or a column that is constant within the group.

    For a number, ``row_number() <= k`` lets Spark keep ``k`` rows of a group per input partition before the shuffle.

    Each group is first cut into ``salts`` parts by a hash of ``spread_on``; only the best ``k`` of a
    part reach the final ranking, which is exact because no other row could be among the first ``k``.
    With ``count_distinct`` only the first row of every value of ``spread_on`` counts towards ``k``; the
    others stay as long as the count is not used up. Adds ``rn``, the 1-based count. The explicit
    repartition keeps a join before it free to split hot keys. Rows that :func:`salted` has cut by the same keys aren't
    shuffled again for it.
    """
    if isinstance(k, int) and not count_distinct:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("rn", place).where(F.col("rn") <= k)
    k = F.lit(k) if isinstance(k, int) else k
    parts = df if "_salt" in df.columns else salted(df, keys, spread_on, salts)
    first = Window.partitionBy(*keys, "_salt", *spread_on).orderBy(*order)
    one = (F.row_number().over(first) == 1).cast("int") if count_distinct else F.lit(1)
    running = lambda w: F.sum("_one").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (
        parts.withColumn("_one", one)
        .withColumn("_part_rn", running(Window.partitionBy(*keys, "_salt")))
        .where(F.col("_part_rn") <= k)
        .withColumn("rn", running(Window.partitionBy(*keys)))
        .where(F.col("rn") <= k)
        .drop("_one", "_salt", "_part_rn")
    )


def salted(df: DataFrame, keys: list[str], spread_on: list[str], salts: Column | int | None = None) -> DataFrame:
    """Shuffle every group in ``salts`` parts, told by ``_salt``, a hash of ``spread_on``.

    ``salts`` may be a column that is constant within the group.
    """
    salts = F.lit(spread(df) if salts is None else salts) if not isinstance(salts, Column) else salts
    salt = F.pmod(F.xxhash64(*spread_on), salts)
    return df.withColumn("_salt", salt).repartition(*keys, "_salt")


def with_group_facts(
    df: DataFrame, keys: list[str], block: Column, facts: dict[str, tuple[Column, Column]]
) -> DataFrame:
    """Add facts about whole groups to their rows without collecting a group anywhere.

    ``facts`` maps a name to (aggregate of the rows of a block, aggregate of that name over blocks). Rows
    are aggregated per (group, block), the few block rows are combined per group, and the result is
    joined back by (group, block), so that even what follows the join is spread over the blocks.
    """
    df = df.withColumn("_block", block)
    by_block = [*keys, "_block"]
    part = df.groupBy(*by_block).agg(*[agg.alias(name) for name, (agg, _) in facts.items()])
    group = Window.partitionBy(*keys)
    whole = part.select(*by_block, *[over.over(group).alias(name) for name, (_, over) in facts.items()])
    return df.join(whole, by_block).drop("_block")


def spread(df: DataFrame) -> int:
    """Number of parts for a hot group: the session's shuffle width, at least 8."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def rank_in_blocks(
    df: DataFrame, keys: list[str], blocks: list[Column], order: list[Column], name: str
) -> DataFrame:
    """``row_number`` per group without putting a group into one task.

    ``blocks`` are non-null columns ordered like the leading part of ``order`` (ascending): the rows of a
    group that share all block values are numbered among themselves, and the sizes of the group's earlier
    blocks are added. Only one row per block takes part in that running sum. ``df`` is read twice, for
    the sizes and for the numbering; store it first if it is costly.
    """
    names = [f"_b{i}" for i in range(len(blocks))]
    df = df.withColumns(dict(zip(names, blocks)))
    local = Window.partitionBy(*keys, *names).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, *names)
        .agg(F.count("*").alias("_n"))
        .select(*keys, *names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    return (
        df.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, *names])
        .withColumn(name, F.col("_off") + F.col("_local"))
        .drop("_off", "_local", *names)
    )
