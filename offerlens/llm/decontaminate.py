"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the items' words. A document's words are streamed through it; the state holds the longest
suffix read so far that occurs in some item. Where that match reaches ``window`` words, or contains a whole shorter
item, the matched words are hit. The items travel in shards of at most ``max_shard_bytes`` of text, so what a task
holds is bounded whatever the size of the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlens.llm.common import Sent, add_columns, texts
from offerlens.storage import stored

SPANS = "__spans"
WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# Letters of ASCII become small, other ASCII characters but digits become blanks, the rest stays.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def item_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over words; ``scan`` reports hit words and items of a document."""

    def __init__(self, items: Iterable[tuple[str | None, bytes | None]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str | None] = []
        coded = []
        for name, text in items:
            if own := item_words(text):
                coded.append([self.vocab.setdefault(w, len(self.vocab)) for w in own])
                self.names.append(name)
        for codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self.shortest = min([window, *map(len, coded)])
        self._mark(coded)

    def _extend(self, last: int, c: int) -> int:
        """Add one word after ``last``; a state that exists already is used again."""
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, c, known)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _mark(self, coded: list[list[int]]) -> None:
        """For each state: where its suffix of ``window`` words lives, whose windows these are, which short items end here."""
        w = self.window
        at = [0] * len(self.link)
        for v in sorted(range(len(self.link)), key=self.length.__getitem__):
            up = self.link[v]
            at[v] = at[up] if up > 0 and self.length[up] >= w else v
        self.window_at = at
        self.items_of: dict[int, set[int]] = {}
        ends: dict[int, list[tuple[int, int]]] = {}
        for item, codes in enumerate(coded):
            v = 0
            for n, c in enumerate(codes, 1):
                v = self.next[v][c]
                if n >= w:
                    self.items_of.setdefault(at[v], set()).add(item)
            if len(codes) < w:
                ends.setdefault(v, []).append((len(codes), item))
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if own := ends.get(v, []) + self.short.get(self.link[v], []):
                self.short[v] = own

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches ``[start, end)`` of the words, and the items that occur."""
        get = self.vocab.get
        codes = [get(w, -1) for w in own]
        known = np.concatenate(([0], (np.array(codes, np.int64) >= 0).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        runs = edges.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= self.shortest]
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for start, end in runs.tolist():
            v = matched = 0
            for i in range(start, end):
                c = codes[i]
                while v and c not in self.next[v]:
                    v = self.link[v]
                    matched = self.length[v]
                if c in self.next[v]:
                    v = self.next[v][c]
                    matched += 1
                hit = matched if matched >= self.window else 0
                if hit:
                    found |= self.items_of.get(self.window_at[v], set())
                for n, item in self.short.get(v, ()):
                    if n <= matched:
                        hit = max(hit, n)
                        found.add(item)
                if hit:
                    first = i + 1 - hit
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i + 1))
        return spans, found


def shard_count(benchmark: DataFrame, text_col: str, max_shard_bytes: int) -> int:
    return -(-(benchmark.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0) // max_shard_bytes)


def automata(benchmark: DataFrame, window: int, item_col: str, text_col: str, max_shard_bytes: int, shards: int | None = None) -> Iterable[Automaton]:
    """One automaton for each shard of the items, built one after the other."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    shards = shard_count(items, "text", max_shard_bytes) if shards is None else shards
    for k in range(shards):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k).collect() if shards > 1 else items.collect()
        yield Automaton([(r.item, r.text.encode() if r.text is not None else None) for r in part], window)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    max_shard_bytes: int = 4 << 20,
) -> DataFrame:
    """All columns of ``docs`` and ``n_words``, ``n_hit`` (long), ``spans`` (hit word stretches) and ``items``.

    ``items`` are the ids, as strings, of the items with an occurring window, sorted. An item without words has no
    window; an item with a null id hits words but isn't listed; repeated items count once. A null or empty text has
    no words. Input columns of the new names are replaced. No benchmark rows: nothing is hit.
    """
    ddl = "n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    out = None
    for automaton in automata(benchmark, window, item_col, "text", max_shard_bytes) if benchmark is not None else ():
        sent = Sent(docs.sparkSession, automaton)
        if out is not None:
            out = stored(out, "contamination")  # one shard is read through before the next

        def scan(batch: pa.RecordBatch, sent=sent, first=out is None) -> list:
            machine = sent.value
            columns: list[list] = [[], [], [], []]
            before = [None] * batch.num_rows if first else list(
                zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("spans", "items")))
            )
            for text, old in zip(texts(batch, text_col), before):
                own = item_words(text)
                spans, found = machine.scan(own)
                names = {machine.names[i] for i in found} - {None}
                if old:
                    spans = merged(spans + [(s["start"], s["end"]) for s in old[0]])
                    names |= set(old[1])
                row = (len(own), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], sorted(names))
                for column, value in zip(columns, row):
                    column.append(value)
            return columns

        out = add_columns(docs if out is None else out, scan, ddl)
    if out is None:
        count = lambda batch: [[len(item_words(t)) for t in texts(batch, text_col)], *([v] * batch.num_rows for v in (0, [], []))]
        out = add_columns(docs, count, ddl)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given word stretches; a line end stands for each."""
    bounds = [m.span() for m in WORD_BYTES.finditer(text)]
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : bounds[a][0]])
        at = bounds[b - 1][1]
    return b"\n".join([*parts, text[at:]])


def clean(text: bytes, machine: Automaton) -> bytes:
    """Cut hit stretches until none is left; a cut may bring words together that hit again."""
    while spans := machine.scan(item_words(text))[0]:
        text = cut(text, spans)
    return text


def clean_in_rounds(docs: DataFrame, machines: Callable[[], Iterable[Automaton]], text_col: str) -> DataFrame:
    """``clean`` with one shard's automaton in a task at a time; ``n_cut`` counts the words cut.

    A round unites the spans of all shards on the uncut text, as one automaton of all items would find them, and cuts once.
    Documents that were hit are looked at again, by all shards, until a round hits nothing.
    """
    done, rest = None, docs
    while True:
        for k, automaton in enumerate(machines()):
            sent = Sent(docs.sparkSession, automaton)

            def scan(batch: pa.RecordBatch, sent=sent, first=k == 0) -> list:
                before = [None] * batch.num_rows if first else batch.column(batch.schema.get_field_index(SPANS)).to_pylist()
                return [[
                    [{"start": a, "end": b} for a, b in merged(sent.value.scan(item_words(text))[0] + [(s["start"], s["end"]) for s in old or []])]
                    for text, old in zip(texts(batch, text_col), before)
                ]]

            rest = stored(add_columns(rest, scan, f"{SPANS} array<struct<start:bigint,end:bigint>>"), "hits")
        clear = rest.where(F.size(SPANS) == 0).drop(SPANS)
        done = clear if done is None else done.unionByName(clear)
        hit = rest.where(F.size(SPANS) > 0)
        if hit.isEmpty():
            return done

        def strip(batch: pa.RecordBatch) -> list:
            kept, gone = [], []
            at = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (SPANS, "n_cut")]
            for text, spans, before in zip(texts(batch, text_col), *at):
                kept.append(cut(text, [(s["start"], s["end"]) for s in spans]).decode())
                gone.append(before + sum(s["end"] - s["start"] for s in spans))
            return [kept, gone]

        rest = add_columns(hit, strip, f"{text_col} string, n_cut bigint").drop(SPANS)


def remove_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    max_coverage: float = 0.5,
    text_col: str = "text",
    item_col: str = "item_id",
    max_shard_bytes: int = 4 << 20,
) -> DataFrame:
    """Cut the hit stretches out of the texts; drop documents of which more than ``max_coverage`` of the words goes.

    Returns the columns of ``docs`` and ``n_cut`` (long), the number of words cut; an input column of this name is
    replaced. Texts without a hit stay as they are, null and empty ones too. The size of shards changes no result.
    """
    out = docs.withColumn("n_cut", F.lit(0).cast("bigint"))
    shards = shard_count(benchmark, "text", max_shard_bytes)
    machines = partial(automata, benchmark, window, item_col, "text", max_shard_bytes, shards)
    if shards > 1:
        out = clean_in_rounds(out, machines, text_col)
    elif shards:
        sent = Sent(docs.sparkSession, *machines())

        def strip(batch: pa.RecordBatch) -> list:
            kept, gone = [], []
            for text in texts(batch, text_col):
                left = text if text is None else clean(text, sent.value)
                kept.append(left if left is None else left.decode())
                gone.append(0 if left is text else len(item_words(text)) - len(item_words(left)))
            return [kept, gone]

        out = add_columns(out, strip, f"{text_col} string, n_cut bigint")
    names = [c for c in docs.columns if c != "n_cut"]
    left = F.regexp_count(F.col(text_col), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    whole = F.col("n_cut") <= max_coverage * (F.col("n_cut") + F.coalesce(left, F.lit(0)))
    return out.where((F.col("n_cut") == 0) | whole).select(*names, "n_cut")
