"""Conversation repair against a shortest-path search over (cost, audit)."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from slopeline.llm.conversations import damaged, repair_report, repaired_turns
from slopeline.llm.queries import QUERIES
from slopeline.llm.shared import table

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
GO = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        out += [] if k == 0 else [row, row] if k == 3 else [row]
    return out


def plain_repair(rows):
    """rows of one conversation: the report and the repaired turns"""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, s, turns = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(rows) and s in (0, 3):
            break
        to, role = GO[s]
        heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*turns, (role, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, s, turns))
            if faults[i] in ("", "truncated"):
                more = 5 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, to, (*turns, (role, rows[i][3]))))
                if (s, initials[i]) in STEP:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, STEP[s, initials[i]], (*turns, rows[i][2:])))
    known = {r[1] for r in rows if r[1] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), list(turns)


def plain_report(original):
    after = {r[0]: [] for r in original}
    for r in plain_damage(original):
        after[r[0]].append(r)
    return {conv: plain_repair(rows) for conv, rows in after.items()}


def conversations(seed=1, n=150):
    rnd = random.Random(seed)
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "tool", "", None, "User"]
    out = []
    for conv in range(n):
        texts = [rnd.choice(["Ça va?", "no", "", None, " \n", "so.", "x! ", "a\x00b", "日本。", f"t{k}."]) for k in range(4)]
        for k in range(rnd.choice([1, 1, 2, 3, 5, 8, 12, 30])):
            role = rnd.choice(roles) if rnd.random() < 0.5 else ("user", "assistant")[k % 2]
            out.append((conv * 5, rnd.choice([k, k, k, k * 2, None]), role, rnd.choice(texts) if rnd.random() < 0.3 else f"turn {k}."))
    out += [(None, k, r, "Good." + "!" * k) for k, r in enumerate(["system", "user", "assistant", "user"])]
    out += [(9001, k, ("user", "assistant")[k % 2], f"Line {k}" + "." * (k % 9 > 0)) for k in range(400)]
    out += [(9002, None, "user", "same.")] * 120 + [(9003, 1, None, None)]
    rnd.shuffle(out)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)


@pytest.mark.parametrize("large_bytes", [1 << 23, 1500, 1])
def test_reports_match_the_search(spark, large_bytes):
    rows = conversations()
    want = {k: v[0] for k, v in plain_report(rows).items()}
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair_report(damaged(frame(spark, rows)), "present", large_bytes).collect()}
    assert got == want


@pytest.mark.parametrize("large_bytes", [1 << 23, 900])
def test_repaired_turns_match_the_search(spark, large_bytes):
    rows = conversations(seed=4, n=40)
    want = plain_report(rows)
    found = {}
    for r in repaired_turns(damaged(frame(spark, rows)), "present", large_bytes).orderBy("conv_id", "part", "step").collect():
        found.setdefault(r["conv_id"], []).append(r)
    assert all(c in want for c in found)
    for conv, (report, turns) in want.items():
        mine = found.get(conv, [])
        assert "".join(r["edit"] for r in mine) == report[6]
        assert [(r["role"], r["text"]) for r in mine if r["edit"] != "D"] == turns


def test_whole_table(spark, sf_small):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in table(spark, sf_small, "conversations").collect()]
    want = {k: v[0] for k, v in plain_report(rows).items()}
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_path_ranking"](spark, sf_small).collect()}
    assert got == want


def test_no_rows_and_clashing_columns(spark):
    df = frame(spark, [(1, 1, "user", "a."), (1, 2, "assistant", "b.")]).selectExpr("*", "false as present", "'x' as tie", "1 as chunk", "2 as seq", "3 as part", "4 as _fault", "5 as audit")
    want = (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:a.\nassistant:b.").hexdigest())
    assert [tuple(r[c] for c in COLUMNS) for r in repair_report(df).collect()] == [want]
    assert [tuple(r[c] for c in COLUMNS) for r in repair_report(df, large_bytes=1).collect()] == [want]
    gone = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for size in (1 << 20, 1):
        assert [tuple(r[c] for c in COLUMNS) for r in repair_report(df, "present", size).collect()] == [gone]
        assert repair_report(df.filter("conv_id is null"), large_bytes=size).collect() == []
    assert repaired_turns(df.filter("conv_id is null")).collect() == [] and damaged(df).columns == ["conv_id", "turn", "role", "text", "present"]


def test_a_long_text(spark):
    long = "w " * 2_000_000 + "."
    rows = [(1, 1, "user", long), (1, 2, "assistant", long), (2, 1, "user", long)]
    want = {c: plain_repair([r for r in rows if r[0] == c])[0] for c in (1, 2)}
    for size in (1 << 23, 1 << 20):
        assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair_report(frame(spark, rows), large_bytes=size).collect()} == want
