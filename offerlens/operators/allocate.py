"""Fair allocation of a fixed number of results over stores and search terms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from offerlens.operators.filters import in_price_range
from offerlens.operators.ranking import keep_first, salted, spread, top_k
from offerlens.operators.routing import StoreRegistry
from offerlens.sources.candidates import GROUP, NO_CAPS, RANK, Caps, first_links
from offerlens.storage import stored

# Rows up to which a term's candidates may meet in one task; those of larger terms are parted.
LARGE_TERM = 1 << 16

# Fixed value: the shops that the mode ``both`` stands for.
BOTH = ["amazon", "takealot"]


def hides_used(registry: StoreRegistry) -> Column:
    """Whether a row's store leaves products already taken out of a term's list before it looks for the list's end."""
    return F.col("store_id").isin([p.store_id for p in registry.plugins() if p.hides_used])


def _asked(registry: StoreRegistry) -> Column:
    """The shops that a run's ``source`` names, as lower-case ids."""
    named = F.transform(F.split(F.lower("source"), ","), lambda s: F.trim(s))
    both, every = ([F.lit(s.lower()) for s in ids] for ids in (BOTH, registry.store_ids()))
    return F.when(F.lower("source") == "both", F.array(*both)).when(F.lower("source") == "all", F.array(*every)).otherwise(named)


def store_targets(runs: DataFrame, registry: StoreRegistry | None = None) -> DataFrame:
    """Runs -> one row per (run, store) with the number of results wanted from the store.

    A run's ``source`` names shops: one or, between commas, several; ``both`` the two shops known from the start, ``all``
    every shop of the registry. The limit is split evenly in the registry's order: up to its n-th of k shops a run takes
    n k-ths of the limit, rounded down, so of two shops the second gets what the first leaves. Shops without a share have no
    row; names of no shop are those of :func:`run_rejects`, and the other shops share the limit.
    """
    registry = registry or StoreRegistry()
    shops = F.filter(F.array(*[F.lit(s) for s in registry.store_ids()]), lambda s: F.array_contains("_asked", F.lower(s)))
    rest = [c for c in runs.columns if c not in ("limit", "source")]
    placed = runs.withColumn("_asked", _asked(registry)).withColumn("_shops", shops)
    split = placed.select(*rest, "limit", F.size("_shops").alias("_k"), F.posexplode("_shops").alias("_n", "store_id"))
    upto = lambda n: F.floor(F.col("limit").cast("bigint") * n / F.col("_k"))
    target = (upto(F.col("_n") + 1) - upto(F.col("_n"))).cast("int")
    return split.select(*rest, "store_id", target.alias("target")).where("target > 0")


def run_rejects(runs: DataFrame, registry: StoreRegistry | None = None) -> DataFrame:
    """The shops that runs ask for and the registry doesn't know: ``runs`` with ``shop`` and ``reason``, one row for each.

    A run without any shop's name has one row with a null ``shop``.
    """
    registry = registry or StoreRegistry()
    known = F.array(*[F.lit(s.lower()) for s in registry.store_ids()])
    lost = F.array_except(_asked(registry), known)
    shop = F.explode(F.coalesce(lost, F.array(F.lit(None).cast("string"))))
    return runs.select("*", shop.alias("shop")).withColumn("reason", F.lit("unknown shop"))


def candidate_prefix(
    links: DataFrame, targets: DataFrame, caps: Caps = NO_CAPS, registry: StoreRegistry | None = None, few_runs: bool = False
) -> DataFrame:
    """The links that an allocation can possibly look at, with their run's ``target``; ``few_runs`` sends the targets to every task.

    Without a cap on candidates, all links of the runs' terms. With one, a query sees at most ``cap`` links, besides those of up to ``target`` products that earlier queries
    took; anything behind the first ``cap + target`` products is out of reach whatever the earlier
    queries do. The size of the result is bounded by the limits of the runs, not by the links. Links that no run asks for are
    left out before any is shuffled.
    """
    asked = targets.groupBy(F.col("run_id").alias("_run"), F.col("store_id").alias("_store")).agg(F.max("n_queries").alias("_terms"))
    asked = F.broadcast(asked) if few_runs else asked
    targets = F.broadcast(targets) if few_runs else targets
    on = (F.col("run_id") == F.col("_run")) & (F.col("store_id") == F.col("_store")) & (F.col("query_idx") < F.col("_terms"))
    capped = caps.min_candidates is not None
    wanted = first_links(links.join(asked, on, "left_semi"), caps, registry, salt=capped)
    wanted = wanted.join(targets, ["run_id", "store_id"]).where("query_idx < n_queries")
    if not capped:
        return wanted
    reach = F.greatest(F.col("target") * 4, F.lit(caps.min_candidates)) + F.col("target")
    order = [F.col(c) for c in RANK]
    return top_k(wanted, GROUP, order, reach, ["product_id"], count_distinct=True).drop("rn")


def with_eligibility(candidates: DataFrame, products: DataFrame) -> DataFrame:
    """Join candidates to product facts and add ``eligible``.

    ``products`` holds ``store_id, url, is_valid, price_numeric``; ``min_price`` and ``max_price`` are
    columns of the run. Candidates without a stored page are not eligible.
    """
    ok = F.coalesce(F.col("is_valid"), F.lit(False)) & in_price_range(
        F.col("price_numeric"), F.col("min_price"), F.col("max_price")
    )
    return candidates.join(products, ["store_id", "url"], "left").withColumn("eligible", ok)


def within_reach(candidates: DataFrame, registry: StoreRegistry | None = None) -> DataFrame:
    """What decides an allocation without caps: of each run and store, rows bounded by targets and terms, not by links.

    * Of each term, the first ``target`` eligible products, each at its first eligible link. Whatever earlier terms took, they
      took ``t <= target`` products, so among these are the first ``target - t`` that are left: enough for the term's
      quota and, later, for the rollover.
    * The number of the term's pages before the first that is missing.
    * ``thin`` rows: the list of a store with ``hides_used`` ends at a page of which every product is taken. Only a product that is within
      reach of an earlier term can be; pages made of such products alone are kept whole.

    No term of more than ``LARGE_TERM`` links meets in one task: its first links and prefix are chosen from salted parts, and pages are
    counted by partial aggregates. Large terms are few, a row of theirs for every ``LARGE_TERM`` links at most, and are sent to every task. Columns: ``run_id, store_id, query_idx, page_num, pos, url, product_id, target, n_queries,
    thin, n_pages``; ``thin`` rows have no ``pos`` and ``url``.
    """
    return _near_and_reach(candidates, registry)[1]


def _near_and_reach(candidates: DataFrame, registry: StoreRegistry | None) -> tuple[DataFrame, DataFrame]:
    """The first eligible products of each term with all columns of the candidates, and :func:`within_reach`."""
    hides = hides_used(registry or StoreRegistry())
    columns = [*GROUP, *RANK, "url", "product_id", "target", "n_queries"]
    rows = stored(candidates, "candidates")
    order = [F.col(c) for c in RANK]
    page = [*GROUP, "page_num"]
    pages = stored(rows.groupBy(*page).agg(F.count("*").alias("n")), "candidate-pages")
    large = pages.groupBy(*GROUP).agg(F.sum("n").alias("_n")).where(F.col("_n") > LARGE_TERM).select(*GROUP, F.lit(spread(rows)).alias("_parts"))
    eligible = rows.where("eligible").join(F.broadcast(large), GROUP, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    first = keep_first(salted(eligible, GROUP, ["product_id"], F.col("_parts")), [*GROUP, "_salt", "product_id"], order)
    near = stored(top_k(first, GROUP, order, F.col("target"), ["product_id"]).select(*candidates.columns), "near")

    nth = F.row_number().over(Window.partitionBy(*GROUP).orderBy("page_num"))
    unbroken = pages.withColumn("nth", nth).where("nth = page_num").groupBy(*GROUP).agg(F.max("page_num").alias("n_pages"))

    # Of the links only those to products within reach of an earlier term are gathered by page.
    facts = [F.min("query_idx").alias("since"), F.max("target").alias("target"), F.max("n_queries").alias("n_queries")]
    taken_by = near.where(hides).groupBy("run_id", "store_id", "product_id").agg(*facts)
    again = rows.where(hides).select(*page, "product_id").join(taken_by, ["run_id", "store_id", "product_id"]).where("since < query_idx")
    again = again.withColumn("n_again", F.count("*").over(Window.partitionBy(*page)))
    missing = {c: F.lit(None).cast(rows.schema[c].dataType) for c in ("pos", "url")}
    thin = again.join(pages, page).where("n_again = n").withColumns(missing).select(*columns)
    both = near.select(*columns, F.lit(False).alias("thin")).unionByName(thin.withColumn("thin", F.lit(True)))
    return near, both.join(unbroken, GROUP)


def allocate_all(candidates: DataFrame, registry: StoreRegistry | None = None) -> DataFrame:
    """:func:`allocate` without caps, in one pass over what is :func:`within_reach`, however many terms there are.

    How much a term may take depends on what earlier terms took, so a run and store is worked off by one task, its rows
    in order; they are bounded by the run's limit and terms.
    """
    keys = ["run_id", "store_id"]
    read = [*keys, "query_idx", *RANK, "url", "product_id", "target", "n_queries", "thin", "n_pages"]
    written = [*keys, "query_idx", "url", "pass_no"]

    def pick(run, store, terms: dict[int, list], target: int, n_queries: int) -> list[tuple]:
        used, picked, lists = set(), [], []

        def take(query: int, url: str, product: str, number: int) -> None:
            used.add(product)
            picked.append((run, store, query, url, number))

        for query, rows in terms.items():
            missing, left = target - len(picked), max(n_queries - query, 1)
            if missing <= 0:
                break
            open_pages = {page for page, _, product, thin, _ in rows if thin and product not in used}
            end = min([rows[0][-1] + 1, *(page for page, _, _, thin, _ in rows if thin and page not in open_pages)])
            lists.append([(query, url, product) for page, url, product, thin, _ in rows if not thin and page < end])
            for row in [row for row in lists[-1] if row[2] not in used][: -(-missing // left)]:
                take(*row, 1)
        for row in (row for rows in lists for row in rows):
            if len(picked) < target and row[2] not in used:
                take(*row, 2)
        return picked

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, terms, size = None, {}, (0, 0)
        for frame in frames:
            out = []
            for run, store, query, page, _, url, product, target, n_queries, thin, n_pages in zip(*(frame[c].tolist() for c in read)):
                if (run, store) != group:
                    out += pick(*group, terms, *size) if group else []
                    group, terms, size = (run, store), {}, (target, n_queries)
                terms.setdefault(query, []).append((page, url, product, thin, n_pages))
            yield pd.DataFrame(out, columns=written, dtype=object)
        if group:
            yield pd.DataFrame(pick(*group, terms, *size), columns=written, dtype=object)

    near, rows = _near_and_reach(candidates, registry)
    ordered = rows.repartition(spread(rows), *keys).sortWithinPartitions(*keys, "query_idx", *RANK, "url").select(*read)
    types = {f.name: f.dataType.simpleString() for f in rows.schema} | {"pass_no": "int"}
    picked = ordered.mapInPandas(fold, ", ".join(f"{c} {types[c]}" for c in written))
    return in_result_order(near.join(picked, [*GROUP, "url"]), registry)


def allocate(
    candidates: DataFrame, n_queries: int, caps: Caps = NO_CAPS, registry: StoreRegistry | None = None
) -> DataFrame:
    """Accepted candidates with ``pass_no`` (1 quota, 2 rollover) and ``accept_idx`` per run.

    Without a cap on candidates, see :func:`allocate_all`.

    ``n_queries`` is the largest number of terms of any run (no term is left out for it).
    Needs ``run_id, store_id, query_idx, page_num, pos, product_id, eligible, target, n_queries``, one
    row per product and query, already cut by :func:`candidate_prefix`. How much a query may take
    depends on what earlier queries took, and a product is used up only once taken, so a run and store is worked off by
    one task, its rows in order, term by term; they are bounded by the run's limit and terms. One shuffle serves all of it; it
    has the session's full width.
    """
    if caps.min_candidates is None:
        return allocate_all(candidates, registry)
    least = caps.min_candidates
    keys = ["run_id", "store_id"]
    read = ["query_idx", "page_num", "product_id", "eligible", "target", "n_queries", "_hides"]

    def pick(rows: pa.Table) -> list[tuple[int, int]]:
        """Places of the accepted rows of a run and store, and their pass."""
        query_of, page_of, product_of, eligible, targets, n_terms, hides = (rows[c].to_pylist() for c in read)
        terms, used, picked, listed = {}, set(), [], []
        target, hide = targets[0], hides[0]
        for i, query in enumerate(query_of):
            terms.setdefault(query, []).append(i)
        for query in range(n_queries):
            missing, left = max(target - len(picked), 0), max(n_terms[0] - query, 1)
            quota = -(-missing // left)
            if not quota or query not in terms:
                continue
            # Some stores hide used products before they count pages and links, the others afterwards.
            seen = [i for i in terms[query] if not (hide and product_of[i] in used)]
            nth = {page: n for n, page in enumerate(dict.fromkeys(page_of[i] for i in seen), 1)}
            live = [i for i in seen if nth[page_of[i]] == page_of[i]][: max(4 * quota, least)]
            listed += live
            open_rows = {}  # a product may stand in one list under two URLs; only its first can be taken
            for i in live:
                if eligible[i] and product_of[i] not in used:
                    open_rows.setdefault(product_of[i], i)
            for product, i in list(open_rows.items())[:quota]:
                used.add(product)
                picked.append((i, 1))
        # What is still missing comes from listed candidates nobody took, in query and rank order.
        for i in listed:
            if len(picked) >= target:
                break
            if eligible[i] and product_of[i] not in used:
                used.add(product_of[i])
                picked.append((i, 2))
        return picked

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def taken(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            picked = pick(rows)
            chosen = rows.drop_columns(["_hides"]).take(pa.array([i for i, _ in picked], pa.int64()))
            yield from chosen.append_column("pass_no", pa.array([n for _, n in picked], pa.int32())).to_batches()

        group, parts = None, []
        for batch in batches:
            names = list(zip(*(batch[k].to_pylist() for k in keys)))
            starts = [i for i, name in enumerate(names) if name != (names[i - 1] if i else group)]
            for start, end in zip([0, *starts], [*starts, len(names)]):
                if parts and start in starts:
                    yield from taken(parts)
                    parts = []
                if end > start:
                    parts.append(batch.slice(start, end - start))
            group = names[-1] if names else group
        if parts:
            yield from taken(parts)

    rows = candidates.withColumn("_hides", hides_used(registry or StoreRegistry()))
    ordered = rows.repartition(spread(rows), *keys).sortWithinPartitions(*keys, "query_idx", *RANK, "url")
    written = StructType([*candidates.schema.fields, StructField("pass_no", IntegerType())])
    return in_result_order(ordered.mapInArrow(fold, written), registry)


def in_result_order(accepted: DataFrame, registry: StoreRegistry | None = None) -> DataFrame:
    """Number the accepted rows of a run: by store in the registry's order, then quota before rollover, then query and rank."""
    stores = F.array(*[F.lit(s) for s in (registry or StoreRegistry()).store_ids()])
    w = Window.partitionBy("run_id").orderBy(F.array_position(stores, F.col("store_id")), "pass_no", "query_idx", *RANK)
    return accepted.withColumn("accept_idx", F.row_number().over(w))


def run_counts(accepted: DataFrame, registry: StoreRegistry | None = None) -> DataFrame:
    """Accepted products per run, in total and per store."""
    by_store = [
        F.count(F.when(F.col("store_id") == s, F.lit(1))).alias(f"{s}_count") for s in (registry or StoreRegistry()).store_ids()
    ]
    return accepted.groupBy("run_id").agg(F.count("*").alias("total_products"), *by_store)


def drop_seen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def union_stores(*parts: DataFrame) -> DataFrame:
    """Results of several stores as one table; columns a store lacks become null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def dedupe_products(products: DataFrame, order: list[Column]) -> DataFrame:
    """First row of every product of a store."""
    return keep_first(products, ["store_id", "product_id"], order)
