"""Audits against trying all edits, digests against plain joining, blocks of few turns, collisions, odd turns, empty tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from bubblestat.llm import repair
from bubblestat.llm.queries import QUERIES

RNG = random.Random(11)
FULL = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 and text is not None else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def faults(turns):
    """[(role, text)] to what is wrong with each."""
    seen, out = set(), []
    for role, text in turns:
        bare = (text or "").rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, lines) by a table of whole strings over the states of what has been said."""
    wrong = faults(turns)

    def states(best):  # inserts, in any number
        changed = True
        while changed:
            changed = False
            for state, (cost, audit, lines) in list(best.items()):
                role, to = ("assistant", "a") if state == "u" else ("user", "u")
                new = (cost + 3, audit + "I", [*lines, role + ":"])
                if to not in best or new[:2] < best[to][:2]:
                    best[to], changed = new, True
        return best

    best = states({"": (0, "", [])})
    for (role, text), w in zip(turns, wrong):
        new = {}

        def offer(state, cost, audit, lines):
            if state not in new or (cost, audit) < new[state][:2]:
                new[state] = (cost, audit, lines)

        for state, (cost, audit, lines) in best.items():
            offer(state, cost + 4, audit + "D", lines)
            if w in ("blank", "duplicate"):
                continue
            more = 3 * (w == "truncated")
            first = (role or " ")[0]
            if first == "s" and state == "" or first == "u" and state != "u" or first == "a" and state == "u":
                offer(first, cost + more, audit + "K", [*lines, f"{role}:{text}"])
            other = "assistant" if state == "u" else "user"
            offer(other[0], cost + more + 3, audit + "R", [*lines, f"{other}:{text}"])
        best = states(new)
    return min(v for k, v in best.items() if k in ("", "a"))


def brute(turns):
    """The same by all edit strings, for few turns."""
    wrong, found = faults(turns), []
    for edits in itertools.product("DKR", repeat=len(turns)):
        if any(w in ("blank", "duplicate") and e != "D" for w, e in zip(wrong, edits)):
            continue
        for slots in itertools.product(range(4), repeat=len(turns) + 1):
            audit = "I" * slots[0] + "".join(e + "I" * n for e, n in zip(edits, slots[1:]))
            cost = sum(3 * (e == "R") + 4 * (e == "D") + 3 * (w == "truncated" and e != "D") for w, e in zip(wrong, edits)) + 3 * sum(slots)
            length = len(audit) - audit.count("D")
            roles = ("s" if length % 2 else "") + "ua" * (length // 2)
            if not FULL.fullmatch(roles):
                continue
            at = iter(turns)
            kept = [(e, next(at)[0] if e != "I" else None) for e in audit]
            kept = [(e, r) for e, r in kept if e != "D"]
            if all((r or " ")[0] == c if e == "K" else c != "s" for (e, r), c in zip(kept, roles)):
                found.append((cost, audit))
    return min(found)


def expected(rows, ids):
    out = []
    for conv in ids:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [r[2:] for r in own]
        numbers = [r[1] for r in own if r[1] is not None]
        wrong = faults(turns)
        illegal = sum((a[0] or " ")[0] + (b[0] or " ")[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((conv, gaps, *(wrong.count(w) for w in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def _turn():
    role = RNG.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "u"])
    text = RNG.choice(["Yes.", "No!", "cut", "Why?", "end.\n ", "", " \t", None, "é.", "x. y", RNG.choice("abcdefgh") + "."])
    return role, text


def test_the_plain_table_equals_all_edit_strings():
    for _ in range(150):
        turns = [_turn() for _ in range(RNG.randint(0, 3))]
        assert cheapest(turns)[:2] == brute(turns)


def test_strings_compare_and_collisions_stay_apart(monkeypatch):
    for mod in (repair.MOD, 7):  # 7: nearly all hashes collide
        monkeypatch.setattr(repair, "MOD", mod)
        audits, made = repair.Audits(), {0: ""}
        for _ in range(400):
            node = RNG.choice(list(made))
            piece = RNG.choice(["D", "K", "I", "DK", "KI", "R"])
            made[audits.extended(node, piece)] = made[node] + piece
        assert all(audits.text(n) == t for n, t in made.items())
        for _ in range(2000):
            a, b = RNG.choice(list(made)), RNG.choice(list(made))
            assert audits.less(a, b) == (made[a] < made[b])


@pytest.mark.parametrize("block", [1, 2, 10])
def test_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows, key = [], 0
    for conv in [*range(60), None]:
        for turn in [None, *sorted(RNG.sample(range(40), RNG.randint(0, 14)))][RNG.randint(0, 1) :]:
            rows.append((conv, turn, *_turn()))
    rows += [(500, t, "user" if t % 2 else "assistant", RNG.choice("abc") + RNG.choice(["", "."])) for t in range(120)]
    rows += [(501, 3, "user", "Same.")] * 40 + [(501, 4, "assistant", "Yes.")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, block string").repartition(4)
    ids = sorted({r[0] for r in rows}, key=str)
    got = sorted((tuple(r) for r in repair.repaired(frame).collect()), key=str)
    assert got == expected(rows, ids)
    hurt = repair.damaged(frame)
    plain = plain_damage(rows)
    assert sorted(map(tuple, hurt.collect()), key=str) == sorted(plain, key=str)
    monkeypatch.setattr(repair, "PIECE", 5)
    got = sorted((tuple(r) for r in repair.repaired(hurt, frame).collect()), key=str)
    assert got == expected(plain, ids)
    lines = {}
    for r in repair.repaired_turns(hurt).orderBy("conv_id", "block", "k").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {r[0]: hashlib.sha256("\n".join(lines.get(r[0], [])).encode()).hexdigest() for r in got} == {r[0]: r[-1] for r in got}


def test_sql_equals_the_plain_version():
    """Odd roles and texts, null conversations and turns, through the SQL that the query is held against."""
    import duckdb

    rng, rows = random.Random(15), []
    for conv in [*range(80), None]:
        for turn in [None, *sorted(rng.sample(range(30), rng.randint(0, 9)))][rng.randint(0, 1) :]:
            rows.append((conv, turn, *_turn()))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(repair.sql()).fetchall(), key=str) == expected(plain_damage(rows), {r[0] for r in rows})


def test_empty_and_long(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert repair.repaired(spark.createDataFrame([], schema)).count() == 0
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "conv_id string")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, repair.repaired(spark.createDataFrame([], schema), ids).collect()), key=str) == [("a", 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)]
    long = "word " * 300_000
    row = repair.repaired(spark.createDataFrame([("a", 0, "user", long), ("a", 1, "assistant", long + ".")], schema)).first()
    assert (row["audit"], row["cost"], row["truncated"]) == ("KK", 3, 1)
    assert row["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:{long}.".encode()).hexdigest()


def test_query(spark):
    import pyarrow.parquet as pq

    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    got = sorted((tuple(r) for r in QUERIES["op11_repair"](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == expected(plain_damage(rows), {r[0] for r in rows})
