"""Conversation repair against a plain version over whole tables, and its edge cases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from cohortis.llm import conversations as c

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")
# The role language as a machine: what may follow nothing, the system, the user, the assistant.
MOVES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else x
        harm = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if harm == 1:
            text = ""
        if harm == 2:
            text = re.sub("[.!?]", "", text)
        if harm == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    return out


def cheapest(rows):
    """``(cost, audit, lines)`` by dynamic programming over the machine's states."""
    best = {"": (0, "", [])}

    def more(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                for r, to in MOVES[state].items():
                    if r != "s":
                        new = (cost + 5, audit + "I", [*lines, {"u": "user:", "a": "assistant:"}[r]])
                        if to not in table or new[:2] < table[to][:2]:
                            table[to] = new

    for role, text, fault in rows:
        more(best)
        table = {}

        def put(to, new):
            if to not in table or new[:2] < table[to][:2]:
                table[to] = new

        for state, (cost, audit, lines) in best.items():
            put(state, (cost + 2, audit + "D", lines))
            if fault in ("", "truncated"):
                paid = cost + 5 * bool(fault)
                for r, to in MOVES[state].items():
                    if role[:1] == r:
                        put(to, (paid, audit + "K", [*lines, f"{role}:{text}"]))
                    if r != "s":
                        put(to, (paid + 1, audit + "R", [*lines, {"u": "user:", "a": "assistant:"}[r] + text]))
        best = table
    more(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def plain(rows):
    groups = defaultdict(list)
    for r in harmed(rows):
        groups[r[0]].append(r[1:])
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, judged, counts = set(), [], defaultdict(int)
        for _, role, text in own:
            letters = WORD.findall(text)
            fault = "blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else ""
            counts[fault] += 1
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for t, _, _ in own if t is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit, lines = cheapest(judged)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, counts["blank"], counts["duplicate"],
                    counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_tables(spark):
    for folder in (FOLDER, "/root/testdata/sf0.001"):
        turns = spark.read.parquet(f"{folder}/conversations.parquet")
        got = sorted((tuple(r) for r in c.repair_report(turns).collect()), key=str)
        assert got == plain([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


def test_random_shapes():
    rng = random.Random(5)
    repair = c.Repairer()
    faults = {"-": "", "b": "blank", "t": "truncated"}
    for _ in range(3000):
        shape = [(rng.choice("suax"), rng.choice("---bt")) for _ in range(rng.randrange(9))]
        cost, audit, roles = repair("".join(a + b for a, b in shape))
        want = cheapest([(a, "", faults[b]) for a, b in shape])
        assert (cost, audit, roles) == (*want[:2], "".join(line[0] for line in want[2])), shape


def test_other_grammars():
    pairs = c.Repairer((("D", ""), ("D", "uDa")))  # nested: as many answers as questions
    assert pairs("u-u-a-a-") == (0, "KKKK", "uuaa")
    assert pairs("u-a-u-a-") == (2, "KRRK", "uuaa")
    assert pairs("u-u-a-") == (2, "DKK", "ua")
    either = c.Repairer((("D", "X"), ("D", "Y"), ("X", "u"), ("Y", "u"), ("X", "Xa"), ("Y", "Ya")))  # ambiguous
    assert either("u-a-") == (0, "KK", "ua")


def test_edges(spark, rows):
    bad = [
        (None, None, None, None), (None, 3, "user", "x."), (None, 3, "user", "x."), (1, None, "assistant", "b"), (1, None, "assistant", "a!"),
        (1, 5, "", "y?"), (1, 5, "😀", "y?"), (2, 1, "user", "long. " * 100_000 + "\x0b\t"), (2, 2, "assistant", "né.\n"), (3, 0, "system", "s."),
        (4, 2, "user", "q."), (4, 2, "assistant", "r."), (4, 9, "user", "q."),
    ]
    turns = spark.createDataFrame(bad, SCHEMA).withColumns({k: F.lit("z") for k in ("at", "conv", "kind", "edit", "audit")})
    got = sorted((tuple(r) for r in c.repair_report(turns).collect()), key=str)
    assert got == plain(bad)
    assert c.repair_report(turns.limit(0)).collect() == []
    every = [(9, t, "user", "a.") for t in range(400) if zlib.crc32(f"9:{t}".encode()) % 20 == 0]  # all dropped
    (row,) = c.repair_report(spark.createDataFrame(every, SCHEMA)).collect()
    assert tuple(row) == (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns(spark):
    turns = spark.createDataFrame([(7, 0, "user", "a."), (7, 1, "user", "b."), (7, 2, "user", "c."), (7, 3, "assistant", "d.")], SCHEMA)
    found = c.reports(turns)
    (r,) = found.collect()
    got = [(x.place, x.turn, x.edit, x.role, x.text) for x in c.repaired_turns(turns, found).collect()]
    assert (r.cost, r.audit, r.illegal) == (1, "KRKK", 2)
    assert got == [(0, 0, "K", "user", "a."), (1, 1, "R", "assistant", "b."), (2, 2, "K", "user", "c."), (3, 3, "K", "assistant", "d.")]


def test_long_conversation(spark):
    turns = spark.range(60_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat(id, '.') AS text")
    (r,) = c.reports(turns).collect()
    assert (r.cost, r.audit) == (0, "K" * 60_000)
