"""Stupid-backoff scores from n-gram counts of the whole corpus.

Count tables are partitioned by hash; exploded n-grams are joined to them and summed per document:

1. Documents are gathered into blocks of about ``block_words`` words. A block's distinct n-grams, with their counts in
   the block, go to the partitions of their hashes, so an n-gram costs a row for each block and not for each use.
2. A partition sums the counts of an n-gram over all blocks and answers each block that asked for it.
3. A block joins the answers to its documents' n-grams and sums the scores of each document.

A block is named by its partition of the input and its number there. The input is a plain scan of files or a table stored
first, so a task that runs again, after an executor is lost, makes the same blocks under the same names.

Rows of a frequent n-gram are as many as blocks; no step needs all documents that hold it. N-grams and answers travel
as packed arrays in order of their hashes, each row of a bounded size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from offerlens.llm.common import id_type, map_rows, texts
from offerlens.storage import stored

FOLD = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The n-gram of no words; it is counted once for each word, so its count is the size of the corpus.
EMPTY = np.uint64(0x2545F4914F6CDD1D)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
TEXT_ROW = -1  # in place of a partition's number: the row holds a block's documents


def word_list(text: bytes | None) -> list[bytes]:
    return [w for w in (text or b"").translate(FOLD).split(b" ") if w]


def extend(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams longer by a word."""
    x = (h ^ (word + MULTIPLIER)) * MULTIPLIER
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def ngram_hashes(words: np.ndarray, doc: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 0 to ``order``: the places at which an n-gram ends, and their hashes; none crosses a document."""
    out = [(np.arange(len(words)), np.full(len(words), EMPTY))]
    for n in range(1, order + 1):
        ends = np.arange(n - 1, len(words))
        ends = ends[doc[ends] == doc[ends - n + 1]]
        h = np.full(len(ends), np.uint64(n))
        for k in range(n - 1, -1, -1):
            h = extend(h, words[ends - k])
        out.append((ends, h))
    return out


def part_bounds(parts: int) -> np.ndarray:
    """First hashes of the partitions."""
    return np.array([(k << 64) // parts for k in range(parts)], np.uint64)


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted hashes: the first, then differences of as few bytes as the largest one needs."""
    steps = np.diff(h)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + h[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_hashes(data: bytes) -> np.ndarray:
    width, first = data[0], np.frombuffer(data[1:9], "<u8")
    short = np.frombuffer(data, np.uint8, offset=min(9, len(data))).reshape(-1, width)
    steps = np.zeros((len(short), 8), np.uint8)
    steps[:, :width] = short
    return np.cumsum(np.concatenate([first, steps.reshape(-1).view("<u8")]), dtype=np.uint64)


def pack_counts(n: np.ndarray) -> bytes:
    return zlib.compress(n.astype("<u8" if len(n) and n.max() >= 1 << 32 else "<u4").tobytes(), 1) + bytes([8 if len(n) and n.max() >= 1 << 32 else 4])


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[:-1]), f"<u{data[-1]}").astype(np.int64)


def pack_codes(codes: np.ndarray, words: int) -> tuple[bytes, np.ndarray]:
    """Word numbers by falling frequency, byte by byte compressed; and the old number of each new one."""
    old = np.argsort(-np.bincount(codes, minlength=words), kind="stable")
    new = np.empty(words, np.uint32)
    new[old] = np.arange(words, dtype=np.uint32)
    planes = new[codes].astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(codes).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True), old


def unpack_codes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(n)


def block_scores(words: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, counts: np.ndarray, order: int, alpha: float) -> np.ndarray:
    """Sum of log scores of each document; counts are those of all other documents."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    grams = ngram_hashes(words, doc, order)
    others = []  # for each n: counts, without the document's own, of the n-gram that ends at a place
    for ends, h in grams:
        at = np.searchsorted(hashes, h)
        key = doc[ends].astype(np.int64) * len(hashes) + at
        _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
        full = np.zeros(len(words), np.int64)
        full[ends] = counts[at] - own[inverse]
        others.append(full)
    score = np.full(len(words), np.nan)
    for n in range(order, 0, -1):
        ends = grams[n][0]
        ends = ends[np.isnan(score[ends])]
        found = others[n][ends]
        # The context of a unigram is the empty n-gram at its own place, else the shorter n-gram that ends before.
        context = others[0][ends] if n == 1 else others[n - 1][ends - 1]
        ends, found, context = ends[found > 0], found[found > 0], context[found > 0]
        # Steps back are counted from the longest n-gram that fits in front of the word.
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))[doc[ends]]
        longest = np.minimum(order, ends - first + 1)
        score[ends] = np.log(found / context) + (longest - n) * math.log(alpha)
    unseen = np.flatnonzero(np.isnan(score))
    if len(unseen):
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))[doc[unseen]]
        longest = np.minimum(order, unseen - first + 1)
        score[unseen] = np.log(0.5 / np.maximum(others[0][unseen], 1)) + (longest - 1) * math.log(alpha)
    return np.bincount(doc, weights=score, minlength=len(lengths)) if len(words) else np.zeros(len(lengths))


def repeats(docs: DataFrame) -> bool:
    """Whether each partition has the same rows in the same order when it is read again: a plain scan of files."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"


def lm_scores(
    docs: DataFrame, order: int = 2, alpha: float = 0.4, block_words: int = 2_000_000, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """One row for each row of ``docs``: id, ``n_words``, ``log_score`` and ``mean_log`` (null without words).

    A word's score is count(n-gram) / count(its first n-1 words) for the longest n up to ``order`` that other documents
    have, times ``alpha`` for each shorter n it takes; for a word no other document has, half a count. A document's own
    uses don't count (repeated rows are others to each other). Words are parted by blanks, A-Z lower-cased; null and empty
    texts have none. Counts are kept by 64-bit hashes. Other columns are ignored.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doc_id = id_type(docs, id_col)
    layout = f"block string, part int, body binary, extra binary, ids array<{doc_id}>, lengths array<bigint>"

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        ids: list = []
        lengths: list[int] = []
        codes: list[np.ndarray] = []
        vocab: dict[bytes, int] = {}
        held = made = 0
        task = TaskContext.get().partitionId()

        def flush() -> Iterator[list]:
            block = f"{task}-{made}"
            digest = np.fromiter(map(xxhash.xxh64_intdigest, vocab), np.uint64, len(vocab))
            at = np.concatenate(codes)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            body, order_of = pack_codes(at, len(vocab))
            yield [[block], [TEXT_ROW], [body], [digest[order_of].tobytes()], pa.array([ids], pa.list_(id_arrow)), [lengths]]
            grams = np.concatenate([h for _, h in ngram_hashes(digest[at], doc, order)])
            hashes, counts = np.unique(grams, return_counts=True)
            cuts = np.append(np.searchsorted(hashes, part_bounds(parts)), len(hashes)).tolist()
            for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    yield [[block], [part], [pack_hashes(hashes[a:b])], [pack_counts(counts[a:b])], pa.array([None], pa.list_(id_arrow)), [None]]

        id_arrow = None
        for batch in it:
            id_arrow = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch, "text")):
                own = word_list(text)
                codes.append(np.array([vocab.setdefault(w, len(vocab)) for w in own], np.int32))
                ids.append(doc)
                lengths.append(len(own))
                held += len(own)
                if held >= block_words or len(ids) >= 100_000:
                    yield from flush()
                    ids, lengths, codes, vocab, held, made = [], [], [], {}, 0, made + 1
        if ids:
            yield from flush()

    def answered(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        """Rows arrive by partition; block rows pass through."""
        now, asked = None, []

        def answers(id_arrow) -> Iterator[list]:
            lists = [unpack_hashes(body) for _, body, _ in asked]
            _, inverse = np.unique(np.concatenate(lists), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate([unpack_counts(extra) for _, _, extra in asked]))
            found = total[inverse].astype(np.int64)
            at = 0
            for (block, _, _), own in zip(asked, lists):
                yield [[block], [now], [pack_counts(found[at : at + len(own)])], [None], pa.array([None], id_arrow), [None]]
                at += len(own)

        id_arrow = None
        for batch in it:
            id_arrow = batch.column(4).type
            for i in range(batch.num_rows):
                block, part, body, extra = (batch.column(k)[i].as_py() for k in range(4))
                if part == TEXT_ROW:
                    yield [[block], [part], [body], [extra], batch.column(4).slice(i, 1), batch.column(5).slice(i, 1)]
                    continue
                if part != now and asked:
                    yield from answers(id_arrow)
                    asked = []
                now = part
                asked.append((block, body, extra))
        if asked:
            yield from answers(id_arrow)

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[list]:
        """Rows arrive by block: its documents first, then the answers in order of their hashes."""
        now, text, counts = None, None, []

        def flush() -> list:
            body, extra, ids, lengths = text
            words, size = np.frombuffer(extra, np.uint64)[unpack_codes(body)], np.array(lengths, np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            hashes = np.unique(np.concatenate([h for _, h in ngram_hashes(words, doc, order)]))
            total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            if len(total) != len(hashes):
                raise ValueError(f"block {now}: {len(total)} answers for {len(hashes)} n-grams")
            return [ids, lengths, block_scores(words, size, hashes, total, order, alpha).tolist()]

        for batch in it:
            for i in range(batch.num_rows):
                block, is_text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() == TEXT_ROW
                if (block == now) == is_text:
                    raise ValueError(f"block {block}: its documents are " + ("there twice" if is_text else "missing"))
                if is_text:
                    if text:
                        yield flush()
                    ids = batch.column(4).slice(i, 1).flatten()
                    text, counts = (batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), ids, batch.column(5)[i].as_py()), []
                    now = block
                else:
                    counts.append(unpack_counts(batch.column(2)[i].as_py()))
        if text:
            yield flush()

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not repeats(base):
        base = stored(base, "lm-documents")
    # A block's documents go anywhere; spread by the block, they don't fill one partition.
    where = F.when(F.col("part") == TEXT_ROW, F.xxhash64("block")).otherwise(F.col("part").cast("bigint"))
    asked = map_rows(base, blocks, layout).repartition(parts, where).sortWithinPartitions("part")
    answers = map_rows(asked, answered, layout).repartition(parts, "block").sortWithinPartitions("block", "part")
    found = map_rows(answers, scored, f"id {doc_id}, n_words bigint, log_score double")
    return found.select(
        F.col("id").alias(id_col), "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log")
    )
