"""Conversation structure: faults of each conversation, and the cheapest edits that make its roles alternate.

Rows are repartitioned by conversation and sorted by turn; ``mapInPandas`` goes through them once and carries the state of
a dynamic program from one Arrow batch to the next. A repaired conversation is empty or holds an optional system row
and then user and assistant rows in turn. So four states suffice: nothing yet, behind the system row, behind a user row,
behind an assistant row. For each state the task keeps the cost so far, the rank of its edits among those of the other
states (ties take the ASCII-least edits), and a SHA-256 of the repaired text, copied where paths part.

How a state was reached takes one byte, four for each row. Every ``block`` rows of a conversation these are spilled: for
each state at the block's end, the state at its start and the edits between go out as a row of the stored result.
A second pass reads a giant conversation's blocks backwards and picks the edits. So a task holds the backpointers of one
block at most, whatever the conversation's length.

Edits are Delete, Insert, Keep and Rerole; a row that is blank, or repeats an earlier role and text, has to go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from offerlens.llm.common import BLANK, id_type
from offerlens.storage import stored

START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Rows inserted at the end to finish a conversation.
TAIL = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
BLOCK = 1 << 16
#: Edits at one row: inserted rows, then what becomes of the row itself.
EDITS = [inserts + own for inserts in ("", "I", "II") for own in "DKR"]


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults and ``gone``, true for dropped ones; null roles and texts become one space.

    CRC-32 of ``conv_id:turn`` modulo 20, nulls written as one space, says which: 0 drops the row, 1 empties its text, 2
    takes out ``.!?``, 3 repeats it, 4 makes it the user's. Rows with one turn are damaged alike.
    """
    plain = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    times = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    role = F.when(fault == 4, "user").otherwise(plain("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), F.explode(times).alias("time")).drop("time")


# ---- the dynamic program ----


def _moves(initial: str, truncated: bool, usable: bool) -> list[tuple]:
    """What can be done at a row: state before, state after, cost, number of the edits, roles put in, the row's new role.

    The last is None for a deleted row and empty for a kept one.
    """
    found = []
    for before in range(4):
        at, roles = before, ()
        # More inserts than these lead back to a state already met, at a higher cost.
        for n in range(3 if before in (START, SYSTEM) else 2):
            if n:
                at, roles = NEXT[at], (*roles, ROLE[NEXT[at]])
            own = [("D", at, DELETE, None)]
            if usable:
                more = TRUNCATED if truncated else 0
                kept = {"s": SYSTEM if at == START else None, "u": USER if at != USER else None, "a": ASSISTANT if at == USER else None}
                if kept.get(initial) is not None:
                    own.append(("K", kept[initial], more, ""))
                own.append(("R", NEXT[at], REROLE + more, ROLE[NEXT[at]]))
            for letter, after, cost, role in own:
                found.append((before, after, INSERT * n + cost, EDITS.index("I" * n + letter), roles, role))
    return found


_UNUSABLE = _moves("", False, False)
_USABLE = {(i, t): _moves(i, t, True) for i in ("s", "u", "a", "") for t in (False, True)}


class Conversation:
    """The state after some rows of a conversation."""

    def __init__(self, key: str):
        self.key = key
        self.paths = {START: (0, 0, hashlib.sha256())}  # by state: cost, rank, digest
        self.back, self.blocks = bytearray(), 0
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last_initial = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, again: bool, open_end: bool) -> None:
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn = self.turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        again, open_end = again and not blank, open_end and not blank and not again
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + again, self.truncated + open_end
        self._step(_UNUSABLE if blank or again else _USABLE[initial if initial in "sua" else "", open_end], role, text)

    def _step(self, moves: list[tuple], role: str, text: str) -> None:
        best: dict[int, tuple] = {}
        for move in moves:
            path = self.paths.get(move[0])
            if path is None:
                continue
            claim = (path[0] + move[2], path[1], EDITS[move[3]])
            if move[1] not in best or claim < best[move[1]][0]:
                best[move[1]] = (claim, move)
        # Edits so far end with a row's own edit, so none is the beginning of another: the first difference ranks them.
        order = sorted(best, key=lambda state: best[state][0][1:])
        paths, back = {}, [0, 0, 0, 0]
        for rank, state in enumerate(order):
            (cost, *_), (before, _, _, edits, roles, new) = best[state]
            added = [f"{r}:" for r in roles]
            if new is not None:
                added.append(f"{new or role}:{text}")
            paths[state] = (cost, rank, self._extended(before, added))
            back[state] = edits << 2 | before
        self.paths = paths
        self.back += bytes(back)

    def _extended(self, state: int, added: list[str]):
        digest = self.paths[state][2]
        if added:
            digest = digest.copy()
            digest.update((("" if state == START else "\n") + "\n".join(added)).encode())
        return digest

    def trace(self, state: int) -> tuple[int, str]:
        """The state before the rows held, and the edits since, of the path that ends in ``state``."""
        edits = []
        for i in range(len(self.back) - 4, -1, -4):
            step = self.back[i + state]
            edits.append(EDITS[step >> 2])
            state = step & 3
        return state, "".join(reversed(edits))

    def spill(self) -> list[tuple]:
        """One row for each state at the block's end; the backpointers start anew."""
        rows = [(self.key, self.blocks, state, *self.trace(state), *[None] * 7) for state in self.paths]
        self.back.clear()
        self.blocks += 1
        return rows

    def finish(self) -> tuple:
        """The summary, with the edits since the last spilled block."""
        end = min(self.paths, key=lambda s: (self.paths[s][0] + INSERT * len(TAIL[s]), self.paths[s][1]))
        digest = self._extended(end, [f"{ROLE[s]}:" for s in TAIL[end]])
        start, edits = self.trace(end)
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        cost = self.paths[end][0] + INSERT * len(TAIL[end])
        facts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, digest.hexdigest())
        return (self.key, self.blocks, end, start, edits + "I" * len(TAIL[end]), *facts)


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PASS = "key string, block bigint, ending int, starting int, edits string, " + ", ".join(f"{c} bigint" for c in FACTS) + ", repaired_sha256 string"
_PASS_COLUMNS = [f.split()[0] for f in _PASS.split(", ")]


def _ordered(rows: DataFrame, gone: str | None) -> DataFrame:
    """Rows of each conversation together and by turn, with their faults; one shuffle."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    # Null conversations get a name that no other has.
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    lost = F.lit(False) if gone is None else F.coalesce(F.col(gone), F.lit(False))
    kept = rows.select(key.alias("key"), F.col("turn").try_cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), lost.alias("lost"))
    kept = kept.repartition("key")
    earlier = F.row_number().over(Window.partitionBy("key", "lost", "role", "text").orderBy("turn")) > 1
    bare = F.btrim("text", F.lit(BLANK))
    return kept.select("*", earlier.alias("again"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open_end"))


_ORDER = ("key", "turn", "role", "text", "again")


def audit(rows: DataFrame, gone: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and their cost, a digest of what they give.

    ``rows`` are ``(conv_id, turn, role, text)`` and may have a column ``gone`` that marks rows which only name their
    conversation. Rows stand by turn, null first; those of one turn by role and text. Null roles and texts count as one
    space, turns that aren't whole numbers as null; null conversations are one. ``gaps`` are whole turns missing between
    the first and the last. A row's first fault counts of blank, duplicate (role and text seen earlier) and truncated (no
    ``.!?`` at its end). ``illegal`` counts neighbours other than system-user, user-assistant and assistant-user, by
    initial. Keeping a row costs 0, changing its role 1, deleting 2, inserting an empty one 5, not deleting a truncated
    one 5 more. Other columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Conversation | None = None
        for frame in frames:
            out = []
            for key, turn, role, text, lost, again, blank, open_end in zip(*(frame[c].tolist() for c in frame.columns)):
                if now is None or key != now.key:
                    if now:
                        out.append(now.finish())
                    now = Conversation(key)
                if not lost:
                    now.add(None if turn is None else int(turn), role, text, blank, again, open_end)
                    if len(now.back) >= 4 * block:
                        out += now.spill()
            yield pd.DataFrame(out, columns=_PASS_COLUMNS, dtype=object)
        if now:
            yield pd.DataFrame([now.finish()], columns=_PASS_COLUMNS, dtype=object)

    flags = ("lost", "again", "blank", "open_end")
    ready = _ordered(rows, gone).sortWithinPartitions(*_ORDER).select("key", F.col("turn").cast("string").alias("turn"), "role", "text", *flags)
    passed = stored(ready.mapInPandas(run, _PASS), "repair-pass")
    ends = passed.where("repaired_sha256 is not null")
    long = _chosen(passed.join(ends.where("block > 0").select("key"), "key", "left_semi"))
    whole = ends.join(long, "key", "left")
    return whole.select(_conv_id(rows), *FACTS, F.coalesce("long", "edits").alias("audit"), "repaired_sha256")


def _conv_id(rows: DataFrame) -> Column:
    named = F.expr("substring(key, 2)").cast(id_type(rows, "conv_id"))
    return F.when(F.col("key") != "", named).alias("conv_id")


def _chosen(pieces: DataFrame) -> DataFrame:
    """``(key, long)``: the edits of giant conversations, their blocks read backwards from the summary."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, block, state = None, 0, 0
        for frame in frames:
            out = []
            for k, b, ending, starting, edits in zip(*(frame[c].tolist() for c in frame.columns)):
                if k != key or (b == block and ending == state):
                    key, block, state = k, b - 1, starting
                    out.append((k, b, edits))
            yield pd.DataFrame(out, columns=["key", "block", "edits"], dtype=object)

    backwards = pieces.repartition("key").sortWithinPartitions("key", F.desc("block")).select("key", "block", "ending", "starting", "edits")
    parts = F.array_sort(F.collect_list(F.struct("block", "edits")))
    return backwards.mapInPandas(run, "key string, block bigint, edits string").groupBy("key").agg(
        F.array_join(F.transform(parts, lambda p: p["edits"]), "").alias("long")
    )


def repair(rows: DataFrame, gone: str | None = None, block: int = BLOCK) -> DataFrame:
    """The repaired conversations as rows ``(conv_id, place, role, text, edit)``, ``place`` from 0.

    Each conversation's edits stream ahead of its rows through a second pass in the same order. Deleted rows are left
    out; a conversation of which nothing stays has no rows.
    """

    columns = ["key", "place", "role", "text", "edit"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, edits, at, place, last, out = None, "", 0, 0, START, []

        def put(role: str, text: str, edit: str) -> None:
            nonlocal place, last
            last = USER if role[:1] == "u" else ASSISTANT if role[:1] == "a" else SYSTEM
            out.append((key, place, role, text, edit))
            place += 1

        def inserts() -> None:
            nonlocal at
            while edits[at : at + 1] == "I":
                put(ROLE[NEXT[last]], "", "I")
                at += 1

        for frame in frames:
            out = []
            for k, ahead, role, text in zip(*(frame[c].tolist() for c in frame.columns)):
                if ahead:
                    inserts()  # those at the end of the conversation before
                    key, edits, at, place, last = k, text, 0, 0, START
                    continue
                inserts()
                if edits[at] != "D":
                    put(role if edits[at] == "K" else ROLE[NEXT[last]], text, edits[at])
                at += 1
            yield pd.DataFrame(out, columns=columns, dtype=object)
        out = []
        inserts()
        yield pd.DataFrame(out, columns=columns, dtype=object)

    audits = audit(rows, gone, block).select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), F.col("audit").alias("text"))
    ordered = _ordered(rows, gone).where("not lost").select(*_ORDER, F.lit(False).alias("ahead"))
    both = ordered.unionByName(audits.withColumn("ahead", F.lit(True)), allowMissingColumns=True)
    both = both.repartition("key").sortWithinPartitions("key", F.desc("ahead"), "turn", "role", "text", "again").select("key", "ahead", "role", "text")
    found = both.mapInPandas(run, "key string, place bigint, role string, text string, edit string")
    return found.select(_conv_id(rows), "place", "role", "text", "edit")
