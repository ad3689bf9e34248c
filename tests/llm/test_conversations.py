"""Repair of conversations against a plain dynamic programme over whole audits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mistgrove.llm.conversations import damaged, repair_conversations, repaired, repairs

SCHEMA = "conv_id long, turn long, role string, text string, head long, i int, key binary, codes string, audit string, pos long"


def damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        order = (turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest())
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for copy in range((kind != 0) + (kind == 3)):
            yield conv, (*order, copy), turn, role, text


def brute(rows):
    """Per conversation (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)."""
    talks = defaultdict(list)
    out = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in rows}
    for conv, *rest in damage(rows):
        talks[conv].append(rest)
    for conv, talk in talks.items():
        talk.sort(key=lambda x: x[0])
        turns = [t for _, t, _, _ in talk if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, _, role, text in talk:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not letters else 2 if (role, text) in seen else 3 if letters[-1] not in ".!?" else 0)
            seen.add((role, text))
        starts = [r[:1] for _, _, r, _ in talk]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:]))
        # best (cost, audit, lines) by what came last: "" nothing, s, u, a
        best = {"": (0, "", ())}

        def offer(table, state, value):
            if state not in table or value[:2] < table[state][:2]:
                table[state] = value

        def inserts(table):
            for _ in range(3):
                for state, (cost, audit, lines) in list(table.items()):
                    to, role = ("a", "assistant") if state == "u" else ("u", "user")
                    offer(table, to, (cost + 5, audit + "I", (*lines, f"{role}:")))

        for (_, _, role, text), fault in zip(talk, faults):
            inserts(best)
            after = {}
            for state, (cost, audit, lines) in best.items():
                offer(after, state, (cost + 2, audit + "D", lines))
                if fault in (1, 2):
                    continue
                more = 5 * (fault == 3)
                if (state, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")):
                    offer(after, role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                to, due = ("a", "assistant") if state == "u" else ("u", "user")
                offer(after, to, (cost + 1 + more, audit + "R", (*lines, f"{due}:{text}")))
            best = after
        inserts(best)
        cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest)
    return out


@pytest.fixture(scope="module")
def rows():
    made = random.Random(11)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "Dots. in the middle", "Wide space.\x0b\x0c ", "Ünï.", None, "a\x1fb", "x" * 100_000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uncle", "s"]
    out = []
    for conv in range(120):
        for turn in range(made.choice([1, 2, 3, 5, 8, 13])):
            role = ("user", "assistant")[turn % 2] if made.random() < 0.6 else made.choice(roles)
            out.append((conv, made.choice([turn, turn, turn, turn + 1, None, 7]), role, made.choice(texts) if made.random() < 0.5 else f"Text {made.randrange(9)}."))
    out += [(None, t, "user", f"t{t}.") for t in (3, 1, None, None)] + out[:40]  # no id; repeated rows
    out += [(1000, t, made.choice(["user", "assistant", "system"]), made.choice([f"{t}.", f"{t}", "same."])) for t in range(-50, 550)]
    return out


@pytest.fixture(scope="module")
def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, b"k", "c", "a", 3) for r in rows], SCHEMA).repartition(4).cache()


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_repairs_are_the_cheapest_and_least(talks, rows, bits):
    out = {r["conv_id"]: tuple(r)[1:] for r in repair_conversations(talks, bits).collect()}
    assert out == brute(rows)


def test_repaired_turns(spark, talks):
    lost = damaged(talks)
    told = repairs(lost).cache()
    turns = defaultdict(list)
    for r in repaired(lost, told).collect():
        turns[r["conv_id"]].append((r["place"], r["edit"], r["role"], r["text"]))
    for r in told.collect():
        talk = sorted(turns[r["conv_id"]])
        assert [x[0] for x in talk] == list(range(len(talk)))
        assert "".join(x[1] for x in talk) == r["audit"].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[2][0] for x in talk))


def test_nothing_left_and_no_rows(spark, talks):
    assert repair_conversations(talks.limit(0)).count() == 0
    gone = next(n for n in range(1000) if zlib.crc32(f"{n}:1".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 1, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair_conversations(one).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    named = one.select(F.lit("a b").alias("conv_id"), F.lit(None).cast("long").alias("turn"), "role", "text")
    assert [(r["conv_id"], r["gaps"], r["audit"]) for r in repair_conversations(named).collect()] == [
        (k, v[0], v[6]) for k, v in brute([("a b", None, "user", "x.")]).items()]
