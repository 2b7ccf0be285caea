"""Conversation repair next to an exhaustive search of edits and a plain dynamic program."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from citeweave.llm import repair
from citeweave.llm.queries import ORACLE, QUERIES
from tests.conftest import SMALL
from verify import compare, connect

LETTERS = {chr(65 + 3 * kind + fault): (kind, fault) for kind in range(4) for fault in range(3)}


def exhaustive(rows):
    """Cheapest (cost, audit) over every script with at most two insertions in a gap."""
    best = None
    gaps = ["", "I", "II"]
    for edits in itertools.product("KRD", repeat=len(rows)):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            audit, roles, cost, fine = "", [], 0, True
            for (kind, fault), edit, before in zip(rows, edits, inserts):
                audit += before + edit
                roles += ["?"] * len(before)
                cost += 2 * len(before) + {"K": 0, "R": 2, "D": 3}[edit]
                if edit != "D":
                    fine &= fault != repair.GONE
                    cost += fault == repair.TRUNCATED
                    roles.append("suao"[kind] if edit == "K" else "?")
            audit += inserts[-1]
            cost += 2 * len(inserts[-1])
            roles += ["?"] * len(inserts[-1])
            want = ("s" if len(roles) % 2 else "") + "ua" * (len(roles) // 2)
            if len(roles) == 1 or not fine or any(a != b and not (a == "?" and b in "ua") for a, b in zip(roles, want)):
                continue
            best = min(best or (cost, audit), (cost, audit))
    return best


def plain(rows):
    """The same by a dynamic program over rows and states."""
    states = {0: (0, "")}

    def better(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def open_up(table):
        for _ in range(3):
            for state, (c, t) in list(table.items()):
                for role in "ua":
                    if (state, role) in repair.STEP:
                        better(table, repair.STEP[state, role], (c + 2, t + "I"))

    for kind, fault in rows:
        open_up(states)
        after = {}
        for state, (c, t) in states.items():
            better(after, state, (c + 3, t + "D"))
            if fault != repair.GONE:
                for role in "sua":
                    if (state, role) in repair.STEP:
                        to, more = repair.STEP[state, role], fault == repair.TRUNCATED
                        if role != "s":
                            better(after, to, (c + 2 + more, t + "R"))
                        if "suao"[kind] == role:
                            better(after, to, (c + more, t + "K"))
        states = after
    open_up(states)
    return min(v for s, v in states.items() if s in (0, 3))


def crc(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def brute(rows):
    """conv -> report of (conv, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        damaged = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text, h = " " if role is None else role, " " if text is None else text, crc(conv, turn)
            if h:
                text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
                damaged += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in damaged:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        kinds = ["sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3 for _, role, _ in damaged]
        cost, audit = plain([(k, repair.GONE if f in ("blank", "duplicate") else repair.TRUNCATED if f else repair.SOUND) for k, f in zip(kinds, faults)])
        turns = [r[0] for r in damaged if r[0] is not None]
        left, lines, i = len(audit) - audit.count("D"), [], 0
        for edit in audit:
            if edit == "D":
                i += 1
                continue
            left -= 1
            role, text = ("", "") if edit == "I" else damaged[i][1:]
            lines.append(f"{role if edit == 'K' else ('user' if left % 2 else 'assistant')}:{text}")
            i += edit != "I"
        initials = [role[:1] for _, role, _ in damaged]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_agenda_finds_what_exhaustive_search_finds():
    rng = random.Random(3)
    for n in (1, 2, 3, 4):
        for _ in range(40):
            letters = "".join(rng.choice(list(LETTERS)) for _ in range(n))
            rows = [LETTERS[x] for x in letters]
            assert repair.close(repair.block_table(letters)) == exhaustive(rows) == plain(rows)


def test_blocks_join_in_any_way():
    rng = random.Random(4)
    for _ in range(60):
        letters = "".join(rng.choice(list(LETTERS)) for _ in range(rng.randrange(2, 60)))
        cut = rng.randrange(1, len(letters))
        whole = repair.block_table(letters)
        assert repair.join(repair.block_table(letters[:cut]), repair.block_table(letters[cut:])) == whole
        assert repair.close(whole) == plain([LETTERS[x] for x in letters])


def test_agenda_is_monotone():
    letters = "DGADGHBEDG"
    popped = []
    steps = {i: repair._row_edits(x) for i, x in enumerate(letters)}

    def conclude(item, weight, final):
        popped.append(weight)
        i, state = item
        for a, z, w in steps.get(i, ()):
            if a == state:
                yield (weight[0] + w[0], weight[1] + w[1]), (i + 1, z)

    repair.lightest([((0, ""), (0, repair.EMPTY))], conclude)
    assert popped == sorted(popped)


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", None), (1, None, "assistant", "Early!"), (1, 5, None, "who?"), (1, 6, "", " \n"), (2, None, None, None), (None, 3, "user", "no id."), (None, 4, "assistant", "no id"),
    (3, 1, "tool", "called."), (3, 2, "Ümlaut", "x" * 40_000 + "."), (4, 7, "user", "same."), (4, 7, "user", "same."), (4, 7, "user", "same."), (4, 9, "assistant", "Well! \t"), (5, 2, "system", "Be good."), (5, 3, "system", "Be good."),
    (6, -(2**62), "user", "far?"), (6, 2**62, "assistant", "away."),
]


def test_report_matches_brute_force(spark):
    rng = random.Random(8)
    rows = list(ODD)
    for conv in range(100, 160):
        for turn in range(rng.randrange(0, 9)):
            rows.append((conv, turn + rng.randrange(2), rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", "Why?", "", "ok!\n"])))
    got = {r[0]: tuple(r)[1:] for r in repair.report(table(spark, rows).repartition(5)).collect()}
    assert got == brute(rows)


def test_one_conversation_may_hold_most_rows(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice([f"t{i}.", f"t{i}", "again."])) for i in range(3000)] + [(2, 0, "user", "Hi?"), (2, 1, "assistant", "Yes.")]
    got = {r[0]: tuple(r)[1:] for r in repair.report(table(spark, rows)).collect()}
    assert got == brute(rows)


def test_repaired_rows_have_legal_roles(spark):
    rows = repair.ordered(repair.damage(spark.read.parquet(f"{SMALL}/conversations.parquet"))).cache()
    edits = repair.repairs(repair.faults(rows))
    by_conv = {}
    for r in repair.repaired(rows, edits).collect():
        by_conv.setdefault(r["conv_id"], []).append((r["turn_no"], r["role"][0]))
    assert by_conv and all(re.fullmatch("s?(ua)+", "".join(role for _, role in sorted(turns))) for turns in by_conv.values())


def test_empty_table_and_clashing_columns(spark):
    rows = table(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")])
    clash = rows.selectExpr("*", "1 AS conv", "'x' AS at", "2 AS m", "3 AS salt", "'f' AS fault", "0 AS audit")
    assert [tuple(r) for r in repair.report(clash).collect()] == [tuple(r) for r in repair.report(rows).collect()]
    assert repair.report(rows.limit(0)).collect() == []


@pytest.mark.parametrize("key", ["op13_conversation_repair"])
def test_query_matches_its_sql(spark, key):
    assert key in QUERIES and key in ORACLE
    assert compare(spark, connect(SMALL), SMALL, key) == "ok"
