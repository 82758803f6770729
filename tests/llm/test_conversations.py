"""Conversation repair against every edit string of small conversations and a plain shortest path over whole tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quillon.llm import conversations

LEGAL = re.compile("(s?(ua)+)?")


def every_audit(codes):
    """The cheapest (cost, audit), by trying all edit strings with at most len + 2 insertions."""
    best = None

    def go(i, roles, cost, audit, inserted):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(codes) and LEGAL.fullmatch(roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < len(codes) + 2:
            for role in "ua":
                go(i, roles + role, cost + 3, audit + "I", inserted + 1)
        if i < len(codes):
            initial, fault = codes[i]
            go(i + 1, roles, cost + 4, audit + "D", inserted)
            if fault not in ("b", "d"):
                charge = 3 if fault else 0
                go(i + 1, roles + (initial or "-"), cost + charge, audit + "K", inserted)
                for role in "ua":
                    go(i + 1, roles + role, cost + charge + 3, audit + "R", inserted)

    go(0, "", 0, "", 0)
    return best


def test_edits_are_the_cheapest_of_all_and_the_least_audit():
    draw = random.Random(3)
    for _ in range(300):
        codes = [(draw.choice("suauaxua") if draw.random() < 0.95 else "", draw.choice(["", "", "", "b", "d", "t"])) for _ in range(draw.randrange(0, 5))]
        (found,) = conversations.edits(codes, conversations.EMPTY, True).values()
        assert found == every_audit(codes), codes


@pytest.mark.parametrize("size", [1, 2, 7])
def test_chunks_chain_to_the_same_edits(size):
    draw = random.Random(size)
    for _ in range(60):
        codes = [(draw.choice("suauaxua"), draw.choice(["", "", "", "b", "d", "t"])) for _ in range(draw.randrange(0, 30))]
        (whole,) = conversations.edits(codes, conversations.EMPTY, True).values()
        chain = conversations.Chain()
        for low in range(0, len(codes), size):
            part = codes[low : low + size]
            chain.add((a, b, *way) for a in range(4) for b, way in conversations.edits(part, a, False).items())
        assert chain.end() == whole


def plain(rows, ids):
    """The contract, conversation by conversation: a table over (rows done, roles so far by their automaton)."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        part = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if part == 0:
            continue
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        role = "user" if part == 4 else role
        held[conv] += [(turn, role, text)] * (2 if part == 3 else 1)
    out = {}
    for conv in ids:
        own = sorted(held[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, codes = set(), []
        for _, role, text in own:
            body = text.strip(" \t\n\x0b\x0c\r")
            codes.append((role[:1], "b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t"))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        states = {(0, ""): (0, "", ())}  # (rows done, roles as a class) -> (cost, audit, lines)
        after = {"": "u", "s": "u", "u": "a", "a": "u"}
        for i in range(len(own) + 1):
            for _ in range(3):  # insertions at this place: more than two in a row never pay
                for (j, state), (cost, audit, lines) in list(states.items()):
                    if j == i:
                        to = (i, after[state])
                        way = (cost + 3, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[to[1]]))
                        states[to] = min(states.get(to, way), way)
            if i == len(own):
                break
            for (j, state), (cost, audit, lines) in list(states.items()):
                if j != i:
                    continue
                (initial, fault), (_, role, text) = codes[i], own[i]
                ways = [(state, (cost + 4, audit + "D", lines))]
                if fault not in ("b", "d"):
                    more = cost + 3 * (fault == "t")
                    to = after[state]
                    ways.append((to, (more + 3, audit + "R", (*lines, {"u": "user:", "a": "assistant:"}[to] + text))))
                    if initial == to or (initial == "s" and state == ""):
                        ways.append((initial, (more, audit + "K", (*lines, f"{role}:{text}"))))
                for to, way in ways:
                    states[i + 1, to] = min(states.get((i + 1, to), way), way)
        cost, audit, lines = min(way for (j, state), way in states.items() if j == len(own) and state in ("", "a"))
        count = lambda f: sum(x == f for _, x in codes)  # noqa: B023, E731
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def compare(found, expected):
    rows = found.collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) == expected[r["conv_id"]], r["conv_id"]


def test_repairs_equal_the_contract_on_hard_rows(spark):
    draw = random.Random(11)
    texts = ["Yes.", "No", "", None, "  \t", "What now? ", "Fine!\n", "yes.", "a\x0b", "é.…", "Long text. " * 50]
    rows = [(draw.choice([None, *range(40)]), draw.choice([None, *range(9)]), draw.choice(["user", "assistant", "system", None, "", "tool", "User"]), draw.choice(texts)) for _ in range(900)]
    rows += [(77, t, draw.choice(["user", "assistant"]), f"turn {t}.") for t in range(1500)] + [(77, 5, "user", "again.")] * 30  # more than one chunk
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    compare(conversations.repairs(conversations.damaged(frame), frame), plain(rows, {r[0] for r in rows}))


def test_repairs_equal_the_contract_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    compare(conversations.repairs(conversations.damaged(frame), frame), plain(rows, {r[0] for r in rows}))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, kind string, part int")
    assert conversations.repairs(conversations.damaged(empty), empty).collect() == []
