"""Merkle manifest of a dataset, its leaves placed by rank queries on bitmaps.

1. *Bitmaps.* A source's document ids become bits of 64-bit words; a word without a bit isn't stored. Words are merged by
   ``bit_or``, so each task sends at most one row for each word it has seen.
2. *Popcount directory.* Rows are counted by word, by 1,024 words, and three times by 65,536 of these; the sums of what
   precedes an entry among its neighbours add up to the rows before a word. No step meets more than 65,536 entries.
3. *Rank queries.* A row joins its word: rows before the word plus the bits below its own give its place among the
   source's leaves. Rows are never sorted. Rows that share an id are ranked again, by the first 60 bits of their leaves, and
   equal ones by their place in the stored table. Rows without an id come first.
4. *Slot arrays.* Places divided by 16 key the runs; a run is an array of its slots. Levels shrink by 16 until each source
   has one node; the sources' nodes, in order of their names, form one more such tree.
5. *Paths.* From the root down, each run hands every slot what stands before and behind it at all levels above.

All of it is DataFrame operations. Tables between the steps lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerlens.llm.common import id_type
from offerlens.storage import stored

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SALTS = 64
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """Digest of a document's fields, each ``-`` or its length in bytes and its value; ``changed`` replaces fields."""
    texts = [changed.get(name, F.col(name)).cast("string") for name in FIELDS]
    return digest(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts])


# ---- rank queries ----

_BIT = "shiftleft(1L, cast(key & 63 as int))"
_LOWER_BITS = "bit_count(bits & ~shiftleft(-1L, cast(key & 63 as int)))"


def _preceding(counts: DataFrame, group: list[str], at: str, shifts: list[int]) -> DataFrame:
    """``counts`` with ``before``: the sum of ``n`` over smaller ``at`` of a group, by a directory of one level per shift."""
    order = lambda part: Window.partitionBy(*part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inner = lambda part: F.coalesce(F.sum("n").over(order(part)), F.lit(0))
    if not shifts:
        return counts.withColumn("before", inner(group))
    up = f"up{len(shifts)}"
    counts = counts.withColumn(up, F.shiftright(at, shifts[0]))
    totals = _preceding(counts.groupBy(*group, up).agg(F.sum("n").alias("n")), group, up, shifts[1:])
    inside = counts.withColumn("inside", inner([*group, up]))
    return inside.join(totals.drop("n"), [*group, up]).withColumn("before", F.col("before") + F.col("inside")).drop(up, "inside")


def ranked(rows: DataFrame, group: list[str], key: Column) -> DataFrame:
    """``rows`` with ``rank``, the rows of the group with a smaller key, and ``same``, those with its key.

    ``key`` is a bigint and, like the group, never null.
    """
    keyed = rows.withColumn("key", key).withColumn("word", F.shiftright("key", 6))
    words = stored(keyed.groupBy(*group, "word").agg(F.bit_or(F.expr(_BIT)).alias("bits"), F.count("*").alias("n")), "merkle-words")
    directory = _preceding(words, group, "word", [10, 16, 16])
    placed = keyed.join(directory, [*group, "word"])
    rank, same = F.col("before") + F.expr(_LOWER_BITS), F.lit(1).cast("bigint")
    crowded = words.where("n > bit_count(bits)").select(*group, "word")
    if not crowded.isEmpty():
        # Words with repeated keys: the rows of each key are counted, and those before it in its word summed.
        each = keyed.join(crowded, [*group, "word"], "left_semi").groupBy(*group, "word", "key").agg(F.count("*").alias("repeats"))
        below = Window.partitionBy(*group, "word").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        each = each.withColumn("below", F.coalesce(F.sum("repeats").over(below), F.lit(0)))
        placed = placed.join(each, [*group, "word", "key"], "left")
        rank, same = F.col("before") + F.coalesce("below", F.expr(_LOWER_BITS)), F.coalesce("repeats", same)
    return placed.select(*rows.columns, rank.alias("rank"), same.alias("same"))


def _places(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``at``, the place among the source's leaves in order of id, then leaf, then stored row."""
    known = ranked(leaves.where("id is not null"), ["tree"], F.col("id"))
    lost = leaves.where("id is null").withColumns({"rank": F.lit(0).cast("bigint"), "same": F.lit(2).cast("bigint")})
    missing = lost.groupBy("tree").agg(F.count("*").alias("missing"))
    first = known.where("same = 1")
    if missing.isEmpty() and known.where("same > 1").isEmpty():
        return first.select(*leaves.columns, F.col("rank").alias("at"))
    ties = known.where("same > 1").unionByName(lost).withColumns({"no_id": F.col("id").isNull(), "tied": F.coalesce("id", F.lit(0).cast("bigint"))})
    ties = stored(ties.withColumnRenamed("rank", "base").drop("same"), "merkle-ties")
    short = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("bigint")
    group = ["tree", "no_id", "tied"]
    by_leaf = ranked(ties, group, short).withColumn("base", F.col("base") + F.col("rank")).drop("rank")
    single, equal = by_leaf.where("same = 1").drop("same"), by_leaf.where("same > 1").drop("same").withColumn("short", short)
    equal = ranked(equal, [*group, "short"], F.col("row")).withColumn("base", F.col("base") + F.col("rank"))
    tied = single.select(*leaves.columns, F.col("base").alias("at")).unionByName(equal.select(*leaves.columns, F.col("base").alias("at")))
    every = first.select(*leaves.columns, F.col("rank").alias("at")).unionByName(tied)
    shifted = _with_tree(every, missing, "left")
    return shifted.withColumn("at", F.col("at") + F.when(F.col("id").isNotNull(), F.coalesce("missing", F.lit(0))).otherwise(0)).drop("missing")


def _with_tree(rows: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """Rows ``(tree, at, ...)`` with facts of their tree, which stand under every salt, as a tree may hold most rows."""
    salts = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(SALTS)])).alias("salt")
    return rows.withColumn("salt", F.col("at") % SALTS).join(facts.select("*", salts), ["tree", "salt"], how).drop("salt")


# ---- trees ----


def _levels(nodes: DataFrame, sizes: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Runs of the leaves, runs of each level above, and the trees' roots ``(tree, hash, level)``.

    ``nodes`` are ``(tree, at, hash, own)``, ``own`` being what a leaf carries; ``sizes`` are ``(tree, n)``. The slots of a
    leaf run are structs of place, hash and ``own``; those of other runs are hashes.
    """
    run = F.floor(F.col("at") / FAN).alias("run")
    bottom = nodes.groupBy("tree", run).agg(F.array_sort(F.collect_list(F.struct("at", "hash", "own"))).alias("slots"))
    bottom = stored(_with_tree(bottom.withColumnRenamed("run", "at"), sizes, "inner").withColumnRenamed("at", "run"), "merkle-leaf-runs")
    joined = F.array_join("slots.hash", "")
    fewer = F.ceil(F.col("n") / FAN).alias("n")
    lone = F.when(F.col("n") == 1, F.col("slots")[0]["hash"]).otherwise(digest(joined))
    nodes = bottom.select("tree", F.col("run").alias("at"), fewer, lone.alias("hash"))
    most, level, uppers = sizes.agg(F.max("n")).first()[0] or 1, 1, []
    most = -(-most // FAN)
    roots = nodes.where("n = 1").select("tree", "hash", F.lit(level).alias("level"))
    while most > 1:
        slots = F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda s: s["hash"])
        runs = stored(nodes.where("n > 1").groupBy("tree", run).agg(F.first("n").alias("n"), slots.alias("slots")), "merkle-runs")
        uppers.append(runs)
        nodes = runs.select("tree", F.col("run").alias("at"), fewer, digest(F.array_join("slots", "")).alias("hash"))
        most, level = -(-most // FAN), level + 1
        roots = roots.unionByName(nodes.where("n = 1").select("tree", "hash", F.lit(level).alias("level")))
    return bottom, uppers, roots


_SIDES = "array<struct<before: string, after: string>>"


def _beside(slots: Column, pos: Column) -> Column:
    before, after = F.slice(slots, F.lit(1), pos), F.slice(slots, pos + 2, F.lit(FAN))
    return F.array(F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after")))


def _paths(bottom: DataFrame, uppers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Leaves ``(own, hash, path, *facts)``; ``tops`` are ``(tree, level, path, *facts)`` of the trees' roots."""
    facts = [c for c in tops.columns if c not in ("tree", "level", "path")]
    rooted = lambda level: tops.where(F.col("level") == level).select("tree", F.lit(0).cast("bigint").alias("run"), "path", *facts)
    above = rooted(len(uppers) + 1)
    for i in range(len(uppers), 0, -1):
        slots = uppers[i - 1].join(above, ["tree", "run"]).select("tree", "run", "path", "slots", *facts, F.posexplode("slots").alias("pos", "hash"))
        path = F.concat(_beside(F.col("slots"), F.col("pos")), "path").alias("path")
        above = slots.select("tree", (F.col("run") * FAN + F.col("pos")).alias("run"), path, *facts).unionByName(rooted(i))
    slots = bottom.join(above, ["tree", "run"]).select("n", "path", *facts, F.col("slots.hash").alias("hashes"), F.posexplode("slots").alias("pos", "slot"))
    path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(_beside(F.col("hashes"), F.col("pos")), "path"))
    return slots.select("slot.own", "slot.hash", path.alias("path"), *facts)


def _numbered(names: DataFrame, by: str) -> DataFrame:
    """``names`` with ``at``, their place in order of ``by``: range partitions in order, and the rows of those before."""
    row = F.monotonically_increasing_id()
    whole = stored(names.orderBy(by).select("*", row.alias("row")), "merkle-sources")
    part, inside = F.shiftright("row", 33), F.col("row").bitwiseAND((1 << 33) - 1)
    counts = whole.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row for each partition of the sort
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return whole.withColumn("part", part).join(counts.select("part", before.alias("before")), "part").select(
        *names.columns, (F.col("before") + inside).alias("at")
    )


def manifest(docs: DataFrame, **carried: Column) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, path`` and the ``carried`` columns, computed from ``docs``.

    A leaf is the digest of ``FIELDS``; those of a source stand in order of the id (rows without one first, rows that
    share one by leaf). Sixteen consecutive nodes become their digest until one is left, the ``subroot``; the subroots,
    ordered by source (null first), likewise give the ``root``. ``path`` holds for each level, from the leaf to the root,
    the nodes of the run before and behind the document's own, joined.

    Null and empty sources differ. Repeated rows have one leaf each and differ in their path. Without documents there are
    no rows. Ids are integers; other columns of ``docs`` are ignored.
    """
    if id_type(docs, "doc_id") not in INTEGERS:
        raise ValueError(f"doc_id must be an integer, not {id_type(docs, 'doc_id')}")
    # A null source becomes the least name of all.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    own = F.struct("doc_id", *[c.alias(name) for name, c in carried.items()])
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("bigint").alias("id"), leaf().alias("leaf"), own.alias("own"))
    leaves = stored(leaves.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    nodes = _places(leaves).select("tree", "at", F.col("leaf").alias("hash"), "own")
    bottom, uppers, subroots = _levels(nodes, leaves.groupBy("tree").agg(F.count("*").alias("n")))

    top = _numbered(subroots, "tree").select(
        F.lit("").alias("tree"), "at", "hash", F.struct("tree", "level").alias("own")
    )
    top = stored(top, "merkle-subroots")
    top_bottom, top_uppers, root = _levels(top, top.groupBy("tree").agg(F.count("*").alias("n")))
    root = root.select("tree", "level", F.array().cast(_SIDES).alias("path"), F.col("hash").alias("root"))
    tops = _paths(top_bottom, top_uppers, root).select("own.tree", "own.level", "path", F.col("hash").alias("subroot"), "root")
    found = _paths(bottom, uppers, stored(tops, "merkle-tops"))
    return found.select("own.doc_id", F.col("hash").alias("leaf"), "subroot", "root", "path", *[f"own.{name}" for name in carried])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf has along its path."""
    return F.aggregate(path, leaf, lambda h, side: digest(side["before"], h, side["after"]))


def proof(path: Column) -> Column:
    """Digest of all nodes beside the path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def verify(found: DataFrame, claimed: Column) -> DataFrame:
    """Rows of a manifest with the digest of their proof, the root folded from a claimed leaf, and whether it is the root."""
    folded = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(claimed, F.col("path")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
