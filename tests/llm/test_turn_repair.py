"""Conversation repair against a plain search over whole conversations."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tests.llm.helpers import clashing, empty
from weektide.llm import turn_repair as R
from weektide.llm.common import table
from weektide.llm.queries import LLM_QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        fault = zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest and then least edits by a search over (cost, edits); rows are of one conversation, damaged."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, *r[2:]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        kept = text.strip(SPACE)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
    legal = re.compile(r"(s?(ua)*u?)?|s")
    queue, best = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, at, initials, out = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            break
        last = initials[-1:]
        if (at, last) in best:
            continue
        best.add((at, last))
        moves = [("I", INSERT, at, r, (r, "")) for r in ("user", "assistant") for INSERT in [2]]
        if at < len(rows):
            role, text = rows[at][2:]
            more = faults[at] == "truncated"
            moves.append(("D", 3, at + 1, None, None))
            if faults[at] not in ("blank", "duplicate"):
                moves.append(("K", more, at + 1, role, (role, text)))
                moves += [("R", 2 + more, at + 1, r, (r, text)) for r in ("user", "assistant")]
        for letter, price, to, role, row in moves:
            new = initials if role is None else initials + role[:1]
            if role is not None and (not role[:1] or not legal.fullmatch(new)):
                continue
            heapq.heappush(queue, (cost + price, edits + letter, to, new, out if row is None else (*out, row)))
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    turns = {r[1] for r in rows} - {None}
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": edits,
        "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def plain_report(rows):
    by_conv = {r[0]: [] for r in rows}
    for r in plain_damage(rows):
        by_conv[r[0]].append(r)
    return {c: plain_repair(part) for c, part in by_conv.items()}


def asdict(frame):
    found = [r.asDict() for r in frame.collect()]
    out = {r.pop("conv_id"): r for r in found}
    assert len(out) == len(found)
    return out


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        turn = 0
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", " \n", "", None, "é…", "Fine. \t", f"{turn}.", f"{turn}"])
            rows.append((conv, rng.choice([turn] * 9 + [None]), role, text))
    return rows


@pytest.mark.parametrize("bounds", [{}, {"block_rows": 3}, {"block_rows": 1}, {"block_chars": 5}])
def test_equals_a_plain_search(spark, bounds):
    rows = random_rows(5, 150, 14) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (None, 2, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert asdict(R.report(frame, R.damaged(frame), **bounds)) == plain_report(rows)


def test_query_on_the_table(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = LLM_QUERIES["op13_turn_repair"](spark, small)
    assert dict(found.dtypes)["cost"] == "bigint"
    assert asdict(found) == plain_report(rows)


def test_a_long_conversation_is_cut_into_blocks(spark):
    """One conversation with nearly all rows; the cut never shows."""
    rows = random_rows(8, 40, 6) + [(1000, i, ["user", "assistant"][i % 2], f"Text {i % 700}.") for i in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    blocks = R.blocks(R.damaged(frame), 100, 10**6)
    assert max(len(r["turns"]) for r in blocks.collect()) <= 100
    short, long = (asdict(R.report(frame, R.damaged(frame), block_rows=n)) for n in (100, 4096))
    assert short == long
    assert short[1000]["duplicate"] > 1800
    small = [r for r in rows if r[0] != 1000]
    assert {c: v for c, v in short.items() if c != 1000} == plain_report(small)


def test_repaired_rows_are_the_result(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "user", "Hi."), (1, 5, "assistant", "Well")]
    piece = R.repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(piece) == 1
    assert piece[0]["audit"] == "KIKKDK"
    assert [(r["role"], r["text"]) for r in piece[0]["repaired"]] == [
        ("system", "Be kind."), ("user", ""), ("assistant", "Hello."), ("user", "Hi."), ("assistant", "Well")
    ]
    assert (piece[0]["cost"], piece[0]["duplicate"], piece[0]["truncated"], piece[0]["illegal"]) == (6, 1, 1, 2)


def test_awkward_rows(spark):
    rows = [(1, None, None, None)] * 3 + [(2, 1, "user", "x" * 300_000)] + [(3, 7, "user", "Same.")] * 500 + [(4, -(2**63), "user", "A."), (4, 2**63 - 1, "user", "B.")]
    frame = clashing(spark.createDataFrame(rows, SCHEMA), ["block", "whole", "fault", "audit", "repaired", "copy"])
    found = asdict(R.report(frame, R.damaged(frame)))
    assert set(found) == {1, 2, 3, 4}
    expected = plain_report(rows)
    assert {c: found[c] for c in (1, 2, 3)} == {c: expected[c] for c in (1, 2, 3)}
    assert found[4]["audit"] == expected[4]["audit"]
    none = empty(frame)
    assert R.report(none, R.damaged(none)).count() == 0
    dropped = [(i, 0, "user", "Hi.") for i in range(400) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    only = spark.createDataFrame(dropped, SCHEMA)
    rows = R.report(only, R.damaged(only)).collect()
    assert len(rows) == len(dropped) > 5
    assert all((r["audit"], r["cost"], r["repaired_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest()) for r in rows)
