"""Conversation repair against a search over whole edit strings."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from offerlens.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, Audit string, key int, again boolean"
BLANK = " \t\n\x0b\x0c\r"
FULL = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def cheapest(rows, faults):
    """Cost, edits and rows of the cheapest repair: the least (cost, edits) first, edits as whole strings."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, i, roles, kept = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, edits, kept
        if (i, roles[-1:]) in done:
            continue
        done.add((i, roles[-1:]))
        due = "a" if roles[-1:] == "u" else "u"
        heapq.heappush(heap, (cost + 5, edits + "I", i, roles + due, (*kept, FULL[due] + ":")))
        if i == len(rows):
            continue
        role, text = rows[i][2:]
        heapq.heappush(heap, (cost + 2, edits + "D", i + 1, roles, kept))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = 5 if faults[i] == "truncated" else 0
        if role[:1] == due or role[:1] == "s" and not roles:
            heapq.heappush(heap, (cost + more, edits + "K", i + 1, roles + role[:1], (*kept, f"{role}:{text}")))
        heapq.heappush(heap, (cost + more + 1, edits + "R", i + 1, roles + due, (*kept, f"{FULL[due]}:{text}")))


def plain(rows):
    out, left = {}, damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, role, text in own:
            bare = text.strip(BLANK)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {r[1] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, edits, kept = cheapest(own, faults)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = ((gaps, *counts, illegal, cost, edits, hashlib.sha256("\n".join(kept).encode()).hexdigest()), kept)
    return out


def conversations():
    rnd = random.Random(5)
    texts = [None, "", "a.", "b", "c!", " \n", "d? ", "é.", "\x0b x. \t", "e.", "f.", "g.", "h.", "😀"]
    rows = []
    for conv in range(150):
        for _ in range(rnd.randint(1, 13)):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", None, "", "x", "ä", "ugly"])
            rows.append((conv or None, rnd.choice([None, *range(12), 10**15, -3]), role, rnd.choice(texts)))
    rows += rows[:40]
    rows += [(1000, i, rnd.choice(["user", "assistant", "system"]), rnd.choice([f"m{i}.", f"m{i}", "z."])) for i in range(400)]
    return rows + [(2000, 1, "user", "x" * 400_000 + "."), (2000, 2, "assistant", "y" * 400_000 + "?")]


@pytest.mark.parametrize("block", [3, 64, repair.BLOCK])
def test_audit_and_repair(spark, block):
    rows = conversations()
    df = repair.damage(spark.createDataFrame([(*r, "x", 1, True) for r in rows], SCHEMA))
    wanted = plain(rows)
    got = {r.conv_id: tuple(r)[1:] for r in repair.audit(df, "gone", block).collect()}
    assert got == {conv: facts for conv, (facts, _) in wanted.items()}
    texts = {}
    for r in repair.repair(df, "gone", block).collect():
        texts.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}", r.edit))
    for conv, (facts, kept) in wanted.items():
        own = sorted(texts.get(conv, []))
        assert [p for p, *_ in own] == list(range(len(kept)))
        assert tuple(t for _, t, _ in own) == kept
        assert "".join(e for *_, e in own) == facts[6].replace("D", "")


def test_state_over_many_batches(spark):
    """One conversation over many Arrow batches; every block is spilled and found again."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(1000)]
    rows[500] = (1, 500, "assistant", "odd.")
    rows += [(2, 0, "user", "hi."), (2, 1, "assistant", "ho.")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r.conv_id: r for r in repair.audit(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), block=50).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[1].audit == "K" * 500 + "R" + "K" * 499 and got[1].cost == 1 and got[1].illegal == 2
    assert got[2].audit == "KK" and got[2].cost == 0


def test_ties_take_the_least_edits(spark):
    # One user row alone: D (2) is cheaper than KI (5). A truncated pair: two deletions (4), not KK (10).
    rows = [(1, 1, "user", "a."), (2, 1, "user", "a"), (2, 2, "assistant", "b"), (3, 1, "user", "a."), (3, 2, "user", "b.")]
    got = {r.conv_id: (r.audit, r.cost) for r in repair.audit(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert got == {"1": ("D", 2), "2": ("DD", 4), "3": ("KR", 1)}


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.audit(repair.damage(empty), "gone").count() == repair.repair(empty).count() == 0
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    lost = repair.damage(spark.createDataFrame([(conv, 1, "user", "a.", "x", 1, True)], SCHEMA))
    row = repair.audit(lost, "gone").first()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
