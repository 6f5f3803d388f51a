"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments; the vector of their bit counts is its place in a grid. The Manhattan
distance of two places is never more than the Hamming distance of the fingerprints. The grid's axes form ``blocks``
groups; two places within ``radius`` differ on ``radius`` of these groups at most, so they agree on all the others.
Every choice of ``blocks - radius`` groups gives a cell key, and the range join meets each pair in some cell. In a
cell, the Manhattan bound thins the candidates and the exact distance decides.

Exact copies share a fingerprint and are joined before. A cell gives a spanning forest of its links, never all pairs.
A cell with more than ``cell_rows`` fingerprints is cut into parts; each pair of parts is searched in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from offerlens.llm.common import add_columns, map_rows, salted_join, texts
from offerlens.storage import stored

SHINGLE = 4
RADIUS = 4
SEGMENTS = 32
# All blanks become spaces, A-Z small.
FOLD = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
CHUNK = 1 << 14
SMALL = 8  # rows of a cell whose pairs are compared by shifts of the whole batch
#: Bits of a segment's count on which two random segments agree: -log2(1/16 + 1/4 + 1/16).
SEGMENT_BITS = 1.415


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of a text's shingles; zero for a text without words."""
    own = [w for w in (text or b"").translate(FOLD).split(b" ") if w]
    if not own:
        return 0
    line = b" ".join(own)
    starts = np.zeros(len(own) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in own], out=starts[1:])
    places = starts.tolist()
    n = max(1, len(own) - shingle + 1)
    digest, step = xxhash.xxh64_intdigest, min(shingle, len(own))
    total = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = [digest(line[places[i] : places[i + step] - 1], 42) for i in range(at, min(n, at + CHUNK))]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * total > n).tolist()))


def places(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the segments, one row for each fingerprint."""
    pairs = fp - ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return np.stack([(pairs >> np.uint64(2 * i)) & np.uint64(3) for i in range(SEGMENTS)], axis=1).astype(np.int8)


def blocks_for(n: int, radius: int = RADIUS, cell: int = 32) -> int:
    """Least number of groups by which a cell of the grid is expected to hold ``cell`` of ``n`` fingerprints or fewer."""
    for blocks in range(radius + 2, radius + 8):
        if n / 2 ** (SEGMENT_BITS * SEGMENTS * (blocks - radius) / blocks) <= cell:
            return blocks
    return radius + 8


def cell_keys(fp: np.ndarray, blocks: int, radius: int = RADIUS) -> np.ndarray:
    """The keys of the grid cells of each fingerprint, one column for each choice of groups."""
    grid = places(fp).astype(np.uint64)
    groups = np.array_split(np.arange(SEGMENTS), blocks)
    codes = np.stack([(grid[:, g] << (2 * np.arange(len(g), dtype=np.uint64))).sum(axis=1, dtype=np.uint64) for g in groups], axis=1)
    out = np.empty((len(fp), comb(blocks, blocks - radius)), np.uint64)
    for j, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = np.full(len(fp), j + 1, np.uint64)
        for b in chosen:
            key = (key ^ codes[:, b]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, j] = key
    return out


def forest(fp: np.ndarray, other: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join whatever is within the radius: inside ``fp``, or between ``fp`` and ``other``.

    The search spreads over what isn't reached yet, so a dense group costs little more than one look at each row.
    """
    values = fp if other is None else np.concatenate([fp, other])
    side = None if other is None else np.arange(len(values)) < len(fp)
    grid, left, links = places(values), np.ones(len(values), bool), []
    for start in range(len(values)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            p = queue.pop()
            rest = np.flatnonzero(left if side is None else left & (side != side[p]))
            if not len(rest):
                continue
            near = rest[np.abs(grid[rest] - grid[p]).sum(axis=1, dtype=np.int64) <= radius]
            near = near[np.bitwise_count(values[near] ^ values[p]) <= radius]
            left[near] = False
            links.extend((p, int(q)) for q in near)
            queue.extend(near.tolist())
    return [(int(values[p]), int(values[q])) for p, q in links]


def near_in_small(fp: np.ndarray, keys: np.ndarray, wanted: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the same small cell within the radius, by comparing each row with the next ones."""
    grid, left, right = places(fp), [], []
    for d in range(1, SMALL):
        a = np.flatnonzero(wanted[:-d] & (keys[:-d] == keys[d:]))
        a = a[np.abs(grid[a] - grid[a + d]).sum(axis=1, dtype=np.int64) <= radius]
        a = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= radius]
        left.append(a)
        right.append(a + d)
    return np.concatenate(left), np.concatenate(right)


def signed(v) -> np.ndarray:
    return np.asarray(v, np.uint64).view(np.int64)


def candidate_links(fps: DataFrame, blocks: int, cell_rows: int = 4096, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``(fp)``, enough to join all that are within the radius."""

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in it:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                keys = cell_keys(part, blocks, radius)
                yield [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, keys.shape[1]).view(np.int64))]

    def searched(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        """Rows arrive by cell; a cell that is too large is passed on, row by row, under its key."""
        held_key, held, passing = None, [], False

        def flush(key, parts, large):
            fp = np.concatenate(parts)
            if large:
                return [[signed(np.full(len(fp), key, np.int64).view(np.uint64)), signed(fp), np.full(len(fp), True)]]
            links = forest(fp, radius=radius)
            return [[signed([a for a, _ in links]), signed([b for _, b in links]), np.full(len(links), False)]] if links else []

        for batch in it:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys))
            out: list[list] = []
            # Small cells that touch no neighbouring batch are searched all at once.
            starts = np.insert(ends[:-1], 0, 0)
            inner = ends - starts <= SMALL
            inner[0] = inner[-1] = False
            busy = np.flatnonzero(~inner)
            a, b = near_in_small(fp, keys, np.repeat(inner, ends - starts), radius)
            if len(a):
                out.append([signed(fp[a]), signed(fp[b]), np.full(len(a), False)])
            for r in busy.tolist():
                a, b = int(starts[r]), int(ends[r])
                if held and keys[a] == held_key:
                    held.append(fp[a:b])
                else:
                    if held:
                        out += flush(held_key, held, passing)
                    held_key, held, passing = keys[a], [fp[a:b]], False
                if sum(map(len, held)) > cell_rows:
                    passing = True
                    out += flush(held_key, held, True)
                    held = [fp[:0]]
            yield from ([pa.array(c) for c in cols] for cols in out)
        if held:
            yield from ([pa.array(c) for c in cols] for cols in flush(held_key, held, passing))

    def paired(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        """Rows arrive by (cell, part, other part)."""
        for key, rows in runs(it):
            first = rows[:, 0] == 1
            links = forest(rows[first, 1], None if key[1] == key[2] else rows[~first, 1], radius)
            if links:
                yield [pa.array(signed([a for a, _ in links])), pa.array(signed([b for _, b in links]))]

    cells = map_rows(fps, keyed, "cell bigint, fp bigint")
    # A given number of partitions: the search is long for its few bytes, so tasks aren't to be merged by size.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_cells = cells.repartition(tasks, "cell").sortWithinPartitions("cell")
    found = stored(map_rows(sorted_cells, searched, "a bigint, b bigint, large boolean"), "cell-links")
    links = found.where("not large").select("a", "b")
    large = found.where("large").select(F.col("a").alias("cell"), F.col("b").alias("fp"))
    sizes = large.groupBy("cell").agg(F.ceil(F.count("*") / (cell_rows // 2)).cast("int").alias("parts"))
    part = large.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    spread = part.select(
        "cell", "fp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    ).select(
        "cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") <= F.col("other")).cast("bigint").alias("first"), "fp",
    )
    by_pair = spread.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return links.union(map_rows(by_pair, paired, "a bigint, b bigint")).distinct()


def runs(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Groups of sorted rows ``(cell, i, j, first, fp)`` as ``(key, [first, fp])``."""
    held_key, held = None, []
    for batch in it:
        cell, i, j, first, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        changes = (np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        ends = np.append(np.flatnonzero(changes) + 1, len(cell)).tolist()
        for a, b in zip([0, *ends[:-1]], ends):
            key = (int(cell[a]), int(i[a]), int(j[a]))
            rows = np.stack([first[a:b].view(np.uint64), fp[a:b].view(np.uint64)], axis=1)
            if held and key != held_key:
                yield held_key, np.concatenate(held)
                held = []
            held_key = key
            held.append(rows)
    if held:
        yield held_key, np.concatenate(held)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Links ``(a, b)`` -> ``(node, root)`` for every linked node, ``root`` the smallest node of its component.

    Every round points each node to its smallest neighbour, follows the pointers some steps and contracts the links
    to those between the joined groups. Tables are written between steps; a hub's links meet in a ``min``, and what is
    known of a hub goes to the parts of its links.
    """
    edges, tree = stored(links.where("a <> b"), f"{name}-links"), None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        step = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))
        for _ in range(2):
            step = stored(step, f"{name}-step")
            above = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
            step = salted_join(step, above, "up", F.col("node")).select("node", F.col("top").alias("up"))
        step = stored(step, f"{name}-step")
        if tree is None:
            tree = step.select("node", F.col("up").alias("root"))
        else:
            moved = step.select(F.col("node").alias("root"), "up")
            tree = salted_join(tree, moved, "root", F.col("node"), "left").select("node", F.coalesce("up", "root").alias("root"))
        tree = stored(tree, f"{name}-tree")
        a = step.select(F.col("node").alias("a"), F.col("up").alias("a2"))
        b = step.select(F.col("node").alias("b"), F.col("up").alias("b2"))
        edges = stored(
            salted_join(salted_join(edges, a, "a", F.col("b")), b, "b", F.col("a")).where("a2 <> b2")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(),
            f"{name}-links",
        )
        if edges.isEmpty():
            return tree


def component_ids(copies: DataFrame, cell_rows: int = 4096, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints ``(fp, first)`` -> ``(fp, component_id)``, the least ``first`` of what is linked."""
    links = candidate_links(copies.select("fp"), blocks_for(copies.count(), radius), cell_rows, radius)
    linked = components(links).select(F.col("node").alias("fp"), "root")
    smallest = linked.join(copies, "fp").groupBy("root").agg(F.min("first").alias("least"))
    by_print = salted_join(linked, smallest, "root", F.col("fp")).select("fp", "least")
    return copies.join(by_print, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))


def _printed(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    return add_columns(docs, lambda batch: [pa.array(signed([fingerprint(t, shingle) for t in texts(batch, text_col)]))], "fp bigint")


def near_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", cell_rows: int = 4096, shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row for each row of ``docs``: ``(id, fingerprint, component_id)``.

    ``fingerprint`` has 16 lower-case hex digits. Documents link when their fingerprints differ in ``radius`` bits or
    fewer; ``component_id`` is the smallest id reachable. Null, empty and blank texts have the fingerprint zero and
    are linked like any other. Rows with a null id get a component, but give their id to none; it is null where no row of the
    component has an id. Repeated rows stay. Other columns are ignored; an empty table gives an empty one.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    prints = stored(_printed(base, "text", shingle).select("id", "fp", "row"), "fingerprints")
    copies = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "copies")
    ids = component_ids(copies, cell_rows, radius)
    return salted_join(prints, ids, "fp", F.col("row")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest id stays, of several one.

    Rows are told apart by their place, not by their id: equal rows leave one, and where an id names two texts, each is
    judged by its own. Rows without an id all stay, as nothing names them. All columns are kept.
    """
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("words"))
    rows = stored(_printed(held.withColumn("row", F.monotonically_increasing_id()), "words", shingle).drop("words"), "printed")
    copies = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "copies")
    ids = component_ids(copies, radius=radius).withColumnRenamed("component_id", "component")
    # Only the rows of a component's smallest id can stay; where several have it, the first of them does.
    owners = rows.select("id", "fp", "row").where("id is not null")
    placed = stored(salted_join(owners, ids, "fp", F.col("row")).select("row", "component", (F.col("id") == F.col("component")).alias("least")), "placed")
    kept = placed.where("least").groupBy("component").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("kept"))
    gone = placed.join(kept, "row", "left").where("kept is null").select("row")
    return rows.join(gone, "row", "left_anti").select("doc.*")
