"""Conversation repair against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from tagloom.llm import conversations
from tagloom.llm.common import table
from tagloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
FOLLOWS = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """``(cost, audit)`` by uniform-cost search; ``rows`` are ``(role initial, must go, truncated)``."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        heapq.heappush(heap, (cost + 2, audit + "I", i, FOLLOWS[state]))
        if i < len(rows):
            role, must_go, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not must_go:
                if role == FOLLOWS[state] or (state, role) == ("", "s"):
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, role))
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, FOLLOWS[state]))


def brute(rows):
    by_id = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by_id[conv]
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    result = {}
    for conv, own in by_id.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = {t for t, _, _ in own if t is not None}
        seen, faults = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = cheapest([(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, faults)])
        out, at, state = [], 0, ""
        for edit in audit:
            name = {"u": "user", "a": "assistant"}[FOLLOWS[state]]
            if edit == "I":
                out.append((name, ""))
            else:
                _, role, text = own[at]
                at += 1
                if edit != "D":
                    out.append((role if edit == "K" else name, text))
            if edit != "D":
                state = out[-1][0][:1]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        result[conv] = (gaps, *counts, illegal, cost, audit, digest)
    return result


def answers(df):
    found = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def test_search_is_cheapest_and_ascii_least():
    rng = random.Random(1)
    for _ in range(4000):
        rows = [(rng.choice("suuuaaax"), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randint(0, 9))]
        codes = bytes(
            conversations.Tally.ROLES.get(r, conversations.OTHER) | conversations.MUST_GO * m | conversations.CUT_OFF * c
            for r, m, c in rows
        )
        assert conversations.cheapest_edits(codes) == cheapest(rows), rows


def test_long_conversation_takes_linear_time():
    rng = random.Random(2)
    rows = [("ua"[i % 2] if rng.random() > 0.1 else "u", rng.random() < 0.05, rng.random() < 0.3) for i in range(3000)]
    codes = bytes({"u": 2, "a": 3}[r] | 8 * m | 4 * c for r, m, c in rows)
    assert conversations.cheapest_edits(codes) == cheapest(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert answers(QUERIES["op12_conversations"](spark, SF)) == brute(rows)


def cases():
    rng = random.Random(7)
    texts = ["Yes.", "No", "Why? ", " \t\n", "", None, "Wait!\n\x0b", "\u2028", "Ende.\u2028", "é.", "x" * 5000 + "."]
    rows = []
    for conv in [*range(60), None, -5]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, None if rng.random() < 0.1 else turn, role, rng.choice(texts)))
    rows += rng.sample(rows, 20)  # repeated rows
    rows += [(999, i, "user" if i % 2 == 0 else "assistant", f"t{i}.") for i in range(700)]
    return rows


def test_edge_cases(spark):
    rows = cases()
    data = [(*r, "plan", 1) for r in rows]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, audit string, gaps int")
    assert answers(conversations.repair_report(df.repartition(5))) == brute(rows)
    assert conversations.repair_report(df.filter("false")).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "So?"), (2, 0, "tool", " ")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversations.plans(turns).cache()
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {1: (5, "KKDR"), 2: (3, "D")}
    fixed = sorted(tuple(r) for r in conversations.repaired(turns, found).collect())
    assert fixed == [
        (1, 0, "K", "system", "Be kind."),
        (1, 1, "K", "user", "Hi."),
        (1, 2, "R", "assistant", "So?"),
    ]


@pytest.mark.parametrize("codes, expected", [(b"", (0, "")), (b"\x02", (2, "KI")), (b"\x0a", (3, "D"))])
def test_short_conversations(codes, expected):
    assert conversations.cheapest_edits(codes) == expected
