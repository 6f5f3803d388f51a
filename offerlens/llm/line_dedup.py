"""Repeated lines: two Bloom filters find the suspects, only these are shuffled and checked exactly.

1. Every document's line keys become 64-bit hashes, packed and shuffled to shards. A shard holds a *once-seen* filter
   that grows with its lines and never leaves the task, and a *twice-seen* filter of a fixed share of ``twice_bits``.
2. The twice-seen filters, ``twice_bits`` in all at every input size, go to all tasks. A line that isn't in them occurs
   in one document only. If they fill up, more lines become suspects; the result stays exact.
3. The suspects' 128-bit digests and document ids are grouped; keys found in enough documents lose their lines in all
   but the largest id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from offerlens.llm.common import BLANK, add_columns, id_type, map_rows, pick, texts
from offerlens.storage import stored

_BLANK = BLANK.encode()
ROUNDS = 4  # bits set for each hash
SALTS = 16


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()  # bytes.lower changes A-Z only


def long_keys(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """The key of every line, None where it is too short to count."""
    keys = [line_key(line) for line in (text or b"").split(b"\n")]
    return [k if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars) else None for k in keys]


def key_hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def key_digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class Bloom:
    """A Bloom filter over arrays of 64-bit hashes."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits, self.held = bits, 0
        self.cells = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(ROUNDS):
            yield (h + step * np.uint64(i)) & np.uint64(self.bits - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for p in self.places(h):
            found &= (self.cells[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    def add(self, h: np.ndarray) -> None:
        for p in self.places(h):
            np.bitwise_or.at(
                self.cells, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)
            )
        self.held += len(h)


class Growing:
    """A once-seen filter that adds a larger one whenever the last is full."""

    def __init__(self, bits: int = 1 << 17):
        self.parts = [Bloom(bits)]

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h), bool)
        for part in self.parts:
            found |= part.has(h)
        return found

    def add(self, h: np.ndarray) -> None:
        if self.parts[-1].held + len(h) > self.parts[-1].bits // 12:
            self.parts.append(Bloom(max(4 * self.parts[-1].bits, 1 << (24 * len(h)).bit_length())))
        self.parts[-1].add(h)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def twice_seen(docs: DataFrame, text_col: str, min_chars: int, shards: int, bits: int) -> DataFrame:
    """Rows ``(shard, filter)``: the compressed twice-seen filter of every shard."""

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for batch in it:
            found: list[int] = []
            for text in texts(batch, text_col):
                found.extend({key_hash(k) for k in long_keys(text, min_chars) if k is not None})
            h = np.array(found, np.uint64)
            shard = shard_of(h, shards)
            order = np.argsort(shard, kind="stable")
            ends = np.flatnonzero(np.diff(shard[order])) + 1
            parts = [p for p in np.split(order, ends) if len(p)]
            yield [[int(shard[p[0]]) for p in parts], [h[p].tobytes() for p in parts]]

    def filtered(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        state: dict[int, tuple[Growing, Bloom]] = {}
        for batch in it:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                once, twice = state.setdefault(shard, (Growing(), Bloom(bits)))
                h, n = np.unique(np.frombuffer(data, np.uint64), return_counts=True)
                known = once.has(h)
                once.add(h[~known])
                twice.add(h[known | (n > 1)])
        for shard, (_, twice) in state.items():
            if twice.held:
                yield [[shard], [zlib.compress(twice.cells.tobytes(), 1)]]

    packed = map_rows(docs.select(text_col), hashed, "shard int, hashes binary")
    return map_rows(packed.repartition(shards, "shard"), filtered, "shard int, filter binary")


def dedup_lines(
    docs: DataFrame,
    min_chars: int = 20,
    min_docs: int = 3,
    text_col: str = "text",
    id_col: str = "doc_id",
    twice_bits: int = 1 << 27,
) -> DataFrame:
    """Drop lines whose key occurs in ``min_docs`` or more documents, but for the largest id that holds it.

    Returns all columns of ``docs`` with the lines left, joined by newlines, and ``n_lines`` and ``n_dropped`` (long;
    input columns of these names are replaced). A null text is one empty line and stays null. Rows with one id are
    one document. A null id is no document: such rows keep all lines and don't count. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1 << 10, 1 << (twice_bits // shards).bit_length() - 1)
    filters = {r.shard: r["filter"] for r in twice_seen(docs, text_col, min_chars, shards, bits).collect()}
    sent = spark.sparkContext.broadcast(filters)  # twice_bits at most

    def suspects(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        known = {shard: Bloom(bits, zlib.decompress(data)) for shard, data in sent.value.items()}
        for batch in it:
            rows: list[int] = []
            keys: list[bytes] = []
            for i, text in enumerate(texts(batch, text_col)):
                own = list({k for k in long_keys(text, min_chars) if k is not None})
                rows.extend([i] * len(own))
                keys.extend(own)
            h = np.fromiter(map(key_hash, keys), np.uint64, len(keys))
            shard, seen = shard_of(h, shards), np.zeros(len(h), bool)
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(part) and (twice := known.get(int(shard[part[0]]))):
                    seen[part] = twice.has(h[part])
            at = np.flatnonzero(seen)
            yield [[key_digest(keys[i]) for i in at], pick(batch, id_col, [rows[i] for i in at])]

    with_id = docs.select(id_col, text_col).where(F.col(id_col).isNotNull())
    suspected = stored(map_rows(with_id, suspects, f"line binary, doc {id_type(docs, id_col)}"), "suspected-lines")
    repeated = (
        suspected.groupBy("line")
        .agg(F.count_distinct("doc").alias("docs"), F.max("doc").alias("keeper"))
        .where(F.col("docs") >= min_docs)
        .select("line", "keeper")
    )
    # A line that very many documents hold would fill one task of the join: the documents are parted by a salt, and
    # the repeated lines, few beside their uses, go to every part.
    salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")
    drops = (
        suspected.withColumn("salt", salt)
        .join(repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["line", "salt"])
        .where(F.col("doc") != F.col("keeper"))
        .groupBy(F.col("doc").alias("__doc"))
        .agg(F.collect_set("line").alias("__drop"))
    )

    def rewrite(batch: pa.RecordBatch) -> list:
        kept, lines, dropped = [], [], []
        for text, drop in zip(texts(batch, text_col), batch.column(batch.schema.get_field_index("__drop")).to_pylist()):
            parts = (text or b"").split(b"\n")
            lines.append(len(parts))
            if drop:
                gone = set(drop)
                keys = long_keys(text, min_chars)
                parts = [p for p, k in zip(parts, keys) if k is None or key_digest(k) not in gone]
                text = b"\n".join(parts)
            kept.append(text if text is None else text.decode())
            dropped.append(lines[-1] - len(parts))
        return [kept, lines, dropped]

    joined = docs.join(drops, F.col(id_col) == F.col("__doc"), "left").drop("__doc")
    out = add_columns(joined, rewrite, f"{text_col} string, n_lines bigint, n_dropped bigint").drop("__drop")
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
