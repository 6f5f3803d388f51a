"""Quality rules: hard limits, then robust multivariate outliers by language and source.

The minimum covariance determinant is approached from medians by concentration steps: of each group, the share
``support`` of the rows with the smallest Mahalanobis distance gives the next mean and covariance. A step is one
aggregation: moments are summed by group and distance bin, so the subset's moments are sums over bins and nothing is
sorted. All steps are DataFrame operations; a group of any size is partial sums.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from offerlens.llm.common import BLANK, words
from offerlens.storage import stored

WINDOW = 5
DIMENSIONS = 5
#: Least standard deviation of each transformed statistic; below, differences don't matter.
FLOORS = (0.3, 0.1, 0.3, 0.1, 0.1)
BINS = 16  # distance bins for each doubling
SALT_ROWS = 500  # rows of a part of a group in a join, as one group may hold all rows
SIDES = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words`` and ``n_chars`` (input columns of these names are replaced).

    Windows of five words are compared by 64-bit hashes.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines")
    kept = [c for c in docs.columns if c != text_col and c.lower() not in new]
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != "")
    long = lambda c: c.cast("bigint")
    base = docs.select(
        *kept, words(F.col(text_col)).alias("__words"), lines.alias("__lines"), long(F.length(text)).alias("n_chars"),
        long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
    )
    counted = base.select(
        *kept, "n_chars", "n_symbols", long(F.size("__words")).alias("n_words"), long(F.size("__lines")).alias("n_lines"),
        long(F.length(F.array_join("__words", ""))).alias("word_chars"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hash"),
    )
    rest = [c for c in counted.columns if c != "__hash"]
    at = F.sequence(F.lit(0), F.size("__hash") - WINDOW)
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get("__hash", i + k) for k in range(WINDOW)]))
    windows = counted.select(*rest, F.when(F.size("__hash") >= WINDOW, hashed).alias("__win"))
    repeats = F.size(F.array_distinct("__win")) < F.size("__win")
    ordered = windows.select(
        *rest, F.when(repeats, F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__win")
    )
    same = lambda i, j: F.coalesce(F.get("__win", i)["h"] == F.get("__win", j)["h"], F.lit(False))
    twice = F.filter("__win", lambda s, i: same(i, i + 1) | ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))))
    starts = ordered.select(*rest, F.sort_array(F.transform(twice, lambda s: s["i"])).alias("__at"))
    # Each repeated window covers five words, or as many as there are up to the next one.
    covered = F.transform("__at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", i + 1), p + WINDOW) - p))
    return starts.select(*rest, F.coalesce(F.aggregate(covered, F.lit(0), lambda a, n: a + n), F.lit(0)).cast("bigint").alias("n_repeat_words"))


def vector() -> list[Column]:
    """Transformed statistics: lengths and symbols in logs, shares by their roots."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(n + 1.0),
        F.log((F.col("word_chars") + 1.0) / n),
        F.log(1.0 + 1000.0 * F.col("n_symbols") / F.greatest(F.col("n_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def grouped(rows: DataFrame, min_rows: int) -> DataFrame:
    """Add ``levels``: the groups ``(grp, salts)`` whose estimates a row counts for, its own first.

    The levels are language and source, language, and all rows. A row's own group is its first one with ``min_rows`` rows
    that pass the base rules. A level above the sources holds all rows below it, those of large groups too; it is left out
    where no row needs it.
    """
    passed = F.count_if(~F.col("base_failed"))
    sizes = stored(rows.groupBy("gl", "gs").agg(passed.alias("n"), F.count("*").alias("rows")), "quality-sizes")
    langs = sizes.groupBy("gl").agg(F.sum("n").alias("ln"), F.sum("rows").alias("lrows"), (F.min("n") < min_rows).alias("lused"))
    whole = langs.agg(F.sum("ln").alias("cn"), F.sum("lrows").alias("crows"), (F.min("ln") < min_rows).alias("cused"))
    level = lambda ok, name, n: F.when(ok, F.struct(name.alias("grp"), F.ceil(n / SALT_ROWS).cast("int").alias("salts")))
    lang = F.concat(F.length("gl").cast("string"), F.lit("\n"), "gl")
    levels = F.array_compact(F.array(
        level(F.col("n") >= min_rows, F.concat(lang, "gs"), F.col("rows")),
        level(F.col("lused") & (F.col("ln") >= min_rows), lang, F.col("lrows")),
        level(F.col("cused") & (F.col("cn") >= min_rows), F.lit("*"), F.col("crows")),
    ))
    names = stored(sizes.join(langs, "gl").crossJoin(whole).select("gl", "gs", levels.alias("levels")), "quality-groups")
    return rows.join(names, ["gl", "gs"])


def in_level(level: Column, *by: str) -> list[Column]:
    """``grp``, ``salts`` and a row's ``salt`` in that group."""
    salts = F.coalesce(level["salts"], F.lit(64))  # rows without a group don't fill one partition
    return [level["grp"].alias("grp"), salts.alias("salts"), F.pmod(F.xxhash64(*by), salts).cast("int").alias("salt")]


def distance(rows: DataFrame, shape: DataFrame, how: str = "inner") -> DataFrame:
    """Squared Mahalanobis distance ``d2`` under the mean and the triangular root of each group's covariance.

    ``rows`` have a ``salt`` below their group's ``salts``; the groups' rows, few beside theirs, go to every salt.
    """
    salted = shape.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    df = rows.join(salted, ["grp", "salt"], how)
    for i in range(DIMENSIONS):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}_{j}") * F.col(f"y{j}")
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}_{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, DIMENSIONS)), F.col("y0") * F.col("y0"))
    return df.withColumn("d2", d2).withColumn("bin", F.floor(BINS * F.log2(F.col("d2") + 1e-6)).cast("int"))


def roots(moments: DataFrame) -> DataFrame:
    """``(grp, salts, m*, c*_*)`` -> ``(grp, salts, m*, l*_*)``: Cholesky factors as columns; ``FLOORS`` keep them regular."""
    df = moments.withColumns({f"c{i}_{i}": F.greatest(F.col(f"c{i}_{i}"), F.lit(0.0)) + FLOORS[i] ** 2 for i in range(DIMENSIONS)})
    for j in range(DIMENSIONS):
        left = lambda i: sum((-F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.col(f"c{j}_{i}"))  # noqa: E731, B023
        df = df.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(left(j), F.lit(1e-6))))
        df = df.withColumns({f"l{i}_{j}": left(i) / F.col(f"l{j}_{j}") for i in range(j + 1, DIMENSIONS)})
    return df.select("grp", "salts", *[f"m{i}" for i in range(DIMENSIONS)], *[f"l{j}_{i}" for i, j in SIDES])


def chi_square(p: float, d: int = DIMENSIONS) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty's approximation)."""
    a = 2 / (9 * d)
    return d * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


def fit(rows: DataFrame, support: float, steps: int) -> DataFrame:
    """``(grp, salts, salt, x*)`` -> ``(grp, salts, m*, l*_*, scale)``, one row for each group; ``scale`` brings the median to chi-square's."""
    quartiles = rows.groupBy("grp").agg(
        F.max("salts").alias("salts"), *[F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(DIMENSIONS)]
    )
    start = quartiles.select(
        "grp", "salts", *[F.get(f"q{i}", F.lit(1)).alias(f"m{i}") for i in range(DIMENSIONS)],
        *[
            (((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349) ** 2 if i == j else F.lit(0.0)).alias(f"c{i}_{j}")
            for i, j in SIDES
        ],
    )
    shape = stored(roots(start), "quality-shape")
    in_order = W.partitionBy("grp").orderBy("bin")
    for _ in range(steps):
        sums = distance(rows, shape).groupBy("grp", "bin").agg(
            F.max("salts").alias("salts"), F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(DIMENSIONS)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in SIDES],
        )
        before = F.coalesce(F.sum("n").over(in_order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        near = sums.withColumn("before", before).withColumn("all", F.sum("n").over(W.partitionBy("grp"))).where(F.col("before") < support * F.col("all"))
        added = near.groupBy("grp").agg(
            F.max("salts").alias("salts"), F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(DIMENSIONS)], *[F.sum(f"s{i}_{j}").alias(f"s{i}_{j}") for i, j in SIDES]
        )
        mean = lambda i: F.col(f"s{i}") / F.col("n")
        moments = added.select(
            "grp", "salts", *[mean(i).alias(f"m{i}") for i in range(DIMENSIONS)],
            *[(F.col(f"s{i}_{j}") / F.col("n") - mean(i) * mean(j)).alias(f"c{i}_{j}") for i, j in SIDES],
        )
        shape = stored(roots(moments), "quality-shape")
    counts = distance(rows, shape).groupBy("grp", "bin").agg(F.count("*").alias("n"))
    middle = counts.withColumn("upto", F.sum("n").over(in_order)).withColumn("all", F.sum("n").over(W.partitionBy("grp")))
    medians = middle.where(F.col("upto") * 2 >= F.col("all")).groupBy("grp").agg(F.min("bin").alias("bin"))
    scale = F.lit(chi_square(0.5)) / F.pow(F.lit(2.0), (F.col("bin") + 1) / BINS)
    return stored(shape.join(medians.select("grp", F.least(scale, F.lit(1.0)).alias("scale")), "grp"), "quality-fit")


def judge(
    docs: DataFrame,
    min_words: int = 10,
    max_repeat_pct: int = 20,
    support: float = 0.75,
    steps: int = 3,
    cut: float = 1 - 1e-9,
    min_rows: int = 100,
    text_col: str = "text",
    id_col: str = "doc_id",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """One row for each row of ``docs``: id, the statistics, ``base_failed``, ``kept`` and ``d2`` (scaled distance).

    Rows that fail the base rules are out and don't count for the estimates. Where a source has less than ``min_rows`` rows
    that pass them, its rows are measured against their whole language, large sources included; where the language has less,
    against all rows. Only where the whole table has less, nothing more is rejected and ``d2`` is null.
    A null language or source is a value of its own. Null texts have no words. Other columns are ignored.
    """
    columns = [F.col(id_col).alias("id"), key(F.col(lang_col)).alias("gl"), key(F.col(source_col)).alias("gs"), F.col(text_col).alias("text")]
    stats = statistics(docs.select(*columns), "text")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    facts = stored(stats.select("*", failed.alias("base_failed"), *[x.alias(f"x{i}") for i, x in enumerate(vector())]), "quality-facts")
    axes = [f"x{i}" for i in range(DIMENSIONS)]
    rows = grouped(facts, min_rows)
    fitted = rows.where("not base_failed").select("id", *axes, F.explode("levels").alias("level"))
    shape = fit(stored(fitted.select(*axes, *in_level(F.col("level"), "id", *axes)), "quality-rows"), support, steps)
    own = rows.select("*", *in_level(F.get("levels", F.lit(0)), "id", *axes)).drop("salts", "levels")
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "scaled"]
    found = distance(own, shape, "left").withColumn("scaled", F.col("d2") * F.col("scale")).select(*names)
    kept = ~F.col("base_failed") & F.coalesce(F.col("scaled") <= chi_square(cut), F.lit(True))
    return found.select(F.col("id").alias(id_col), *names[1:-1], kept.alias("kept"), F.col("scaled").alias("d2"))
