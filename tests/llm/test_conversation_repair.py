import hashlib
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import duckdb
import pyarrow as pa
import pytest

from orogen.llm import conversation_repair as c


def best_edits(codes):
    """All ways, compared by cost and letters; more than three insertions in a row never help."""

    @lru_cache(None)
    def best(i, q, k):
        ways = [(0, "")] if i == len(codes) and q in (0, 3) else []
        on = {0: 2, 1: 2, 2: 3, 3: 2}[q]
        if k < 3:
            cost, s = best(i, on, k + 1)
            ways.append((cost + 5, "I" + s))
        if i < len(codes):
            cost, s = best(i + 1, q, 0)
            ways.append((cost + 2, "D" + s))
            role, must, short = codes[i]
            if not must:
                for r in {on, 1} if q == 0 else {on}:
                    cost, s = best(i + 1, r, 0)
                    if role == " sua"[r]:
                        ways.append((cost + 5 * short, "K" + s))
                    elif r != 1:
                        ways.append((cost + 5 * short + 1, "R" + s))
        return min(ways) if ways else (10**9, "")

    return best(0, 0, 0)


def plain(rows):
    """Row by row, as the contract says it."""
    blanks, talks = " \t\n\x0b\x0c\r", defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        talks[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, talk in talks.items():
        talk = sorted(talk, key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.sha256(m[2].encode()).hexdigest()))
        seen, codes, faults = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in talk:
            inner = text.strip(blanks)
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {t for t, _, _ in talk if t is not None}
        cost, letters = best_edits(tuple(codes))
        lines, i = [], 0
        for letter in letters:
            if letter in "RI":
                role = "assistant" if lines and lines[-1][:1] == "u" else "user"
                lines.append(f"{role}:{talk[i][2] if letter == 'R' else ''}")
            elif letter == "K":
                lines.append(f"{talk[i][1]}:{talk[i][2]}")
            i += letter != "I"
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults.values(), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed=5, conversations=250):
    r, rows = random.Random(seed), []
    for conv in [*range(conversations), None]:
        for turn in range(r.randint(1, 12)):
            text = r.choice(["Yes.", "No!", "Well, then", "ok.\n\t ", " \x0b", "", None, "Why?", f"{r.random()}.", "é\xa0", ".\x00"])
            rows.append((conv, r.choice([None, 1, turn, turn, turn, turn, turn]), r.choice(["user", "assistant"] * 3 + ["system", "tool", None, "agent", ""]), text))
    return rows + rows[:20]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_letters_are_the_least_of_the_cheapest():
    r = random.Random(2)
    for _ in range(3000):
        codes = tuple((r.choice("suuaaax"), r.random() < 0.2, r.random() < 0.3) for _ in range(r.randint(0, 9)))
        assert c.solve(bytes(c.INITIALS.get(x, 0) | must * c.FORCED | (short and not must) * c.CUT_SHORT for x, must, short in codes)) == best_edits(codes)


def test_equals_brute_force_and_sql(spark):
    rows = made()
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], SCHEMA + ", Copies int, digest string").repartition(5)
    got = sorted((tuple(x) for x in c.audit(c.damage(df)).collect()), key=repr)
    assert got == plain(rows)
    with duckdb.connect() as db:
        db.register("conversations", pa.table({n: pa.array([x[i] for x in rows], pa.int64() if i < 2 else pa.string()) for i, n in enumerate(("conv_id", "turn", "role", "text"))}))
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        said = db.execute(f"SELECT {', '.join(names)} FROM ({c.oracle_sql()})").fetchall()
    assert sorted(said, key=repr) == got


def test_lines_give_the_digest(spark):
    df = c.damage(spark.createDataFrame(made(6, 40), SCHEMA))
    report = {x.conv_id: x for x in c.audit(df).collect()}
    lines = defaultdict(list)
    for x in c.repaired(df).orderBy("position").collect():
        lines[x.conv_id].append(x)
    for conv, x in report.items():
        assert hashlib.sha256("\n".join(f"{m.role}:{m.text}" for m in lines[conv]).encode()).hexdigest() == x.repaired_sha256
        assert "".join(m.edit for m in lines[conv]) == x.audit.replace("D", "")


def test_many_copies_and_long_conversations(spark):
    rows = [(7, 1, "user", "Same.")] * 5000 + [(8, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {x.conv_id: x for x in c.audit(c.damage(df)).collect()}
    copies = zlib.crc32(b"7:1") % 20
    n = {0: 0, 3: 10000}.get(copies, 5000)
    assert len(found[7].audit.replace("I", "")) == n and found[7].duplicate == max(0, n - 1)
    assert found[8].cost > 0 and len(found[8].audit.replace("I", "")) > 2800


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, None, "user", "Hi.")], [(1, 2, "user", "x" * 300_000 + ".")]])
def test_edge_tables(spark, rows):
    got = sorted(tuple(x) for x in c.audit(c.damage(spark.createDataFrame(rows, SCHEMA))).collect())
    assert got == plain(rows)
