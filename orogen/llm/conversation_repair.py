"""Repair of conversations' structure by the cheapest edits: a directed graph of edits over messages and role states, whose optimal arcs are told by costs from both ends."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Costs of edits, of leaving a truncated message, and the white space that does not count.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
START, SYSTEM, USER, ASSISTANT = range(4)  # the role that the repaired conversation ends with so far
FINAL = (START, ASSISTANT)
#: From a state: the states that may follow, of which any but SYSTEM can be made by an inserted or reroled message.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: A message by a byte: state of its role's initial (0: another one), and flags.
FORCED, CUT_SHORT = 4, 8
_FAR = 1 << 60


def insertions(cost: list[int]) -> list[int]:
    """Least costs of states before any number of inserted messages, from the costs after them."""
    best = list(cost)
    for _ in range(2):  # two insertions reach every state that any number reaches
        for q in (START, SYSTEM, USER, ASSISTANT):
            best[q] = min([best[q], *(INSERT + best[r] for r in NEXT[q] if r != SYSTEM)])
    return best


def arcs(code: int, q: int):
    """(letter, state after it, cost) of the edits of one message."""
    extra = TRUNCATED if code & CUT_SHORT else 0
    if not code & FORCED:
        own = code & 3
        for r in NEXT[q]:
            if own == r:
                yield "K", r, extra
            if r != SYSTEM and own != r:
                yield "R", r, REROLE + extra
    yield "D", q, DELETE


_ARCS = {code: [list(arcs(code, q)) for q in range(4)] for code in range(16)}


def solve(codes: bytes) -> tuple[int, str]:
    """Least cost and the ASCII-least letters of the edits that give a conversation of role initials (s?(ua)+)?.

    to_go: least cost from every node (messages done, state) to an end, and so_far, from the start to it; an arc belongs to a cheapest way exactly where
    both and its own cost sum up to the total. The walk keeps all states that the letters so far can be in and takes the least letter on an optimal arc of any.
    """
    n = len(codes)
    to_go = np.empty((n + 1, 4), np.int64)
    row = insertions([0 if q in FINAL else _FAR for q in range(4)])
    to_go[n] = row
    for i in range(n - 1, -1, -1):
        own = _ARCS[codes[i]]
        row = insertions([min(cost + row[r] for _, r, cost in own[q]) for q in range(4)])
        to_go[i] = row
    total, letters = row[START], []
    so_far, i = {START: 0}, 0
    while not (i == n and any(q in FINAL and cost == total for q, cost in so_far.items())):
        after, own, here = {}, _ARCS[codes[i]] if i < n else None, to_go[i].tolist()
        further = to_go[i + 1].tolist() if i < n else None
        for q, cost in so_far.items():
            if own:
                for letter, r, price in own[q]:
                    if cost + price + further[r] == total:
                        after.setdefault(letter, {})[r] = cost + price
            for r in NEXT[q]:
                if r != SYSTEM and cost + INSERT + here[r] == total:
                    after.setdefault("I", {})[r] = cost + INSERT
        letter = min(after)
        letters.append(letter)
        so_far = after[letter]
        i += letter != "I"
    return total, "".join(letters)


def line_states(letters: str, codes: bytes):
    """For each letter, the state that the conversation ends with after it."""
    q, i = START, 0
    for letter in letters:
        if letter != "D":
            q = codes[i] & 3 if letter == "K" else next(r for r in NEXT[q] if r != SYSTEM)
        i += letter != "I"
        yield q


def _seen(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of every row: copies is 0 for a dropped row and 2 for a repeated one.

    By crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 sets its role to user. Nulls of the key, role and text are one blank.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _messages(rows: DataFrame) -> DataFrame:
    """A row for every different (conv_id, turn, role, text): its digest, how often it is there, the first of its faults, and whether all its role and text is met earlier.

    Equal rows are counted where they are read, so a message repeated without end is one row. Only digests of texts are sent.
    """
    seen = _seen(F.col("text"))
    marked = rows.select("conv_id", "turn", "role", "copies", F.sha2("text", 256).alias("digest"), (seen == "").alias("blank"), ((seen != "") & ~F.right(seen, F.lit(1)).isin(*ENDS)).alias("open"))
    each = marked.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.first("blank").alias("blank"), F.first("open").alias("open"))
    there = each.where("copies > 0")
    first = there.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))).alias("x")).select(
        F.col("conv_id").alias("c"), F.col("x.turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d")
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return each.join(first, same, "left").select("conv_id", "turn", "role", "digest", "copies", "blank", "open", F.col("d").isNull().alias("again"))


_REPORT = [*((n, "long") for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", "string"), ("repaired_sha256", "string")]
_LINES = [("conv_id", "long"), ("position", "long"), ("role", "string"), ("text", "string"), ("edit", "string")]
_ARROW = {"long": pa.int64(), "string": pa.string()}
LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is known of the conversation that a task reads: first its messages without texts, then its texts one by one."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.initial = conv_id, bytearray(), None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = self.turn = None
        self.turns, self.plan, self.position, self.hash = 0, None, 0, hashlib.sha256()

    def message(self, turn, role, copies, blank, cut_short, again) -> None:
        if not copies:
            return
        if turn is not None and turn != self.turn:
            self.turns, self.turn, self.most = self.turns + 1, turn, turn
            self.least = turn if self.least is None else self.least
        initial = role[:1]
        if self.codes and self.initial + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = initial
        self.counts["illegal"] += (copies - 1) * (initial + initial not in LEGAL)
        state = INITIALS.get(initial, 0)
        self.counts["blank"] += copies * blank
        self.counts["duplicate"] += 0 if blank else copies - (not again)
        self.counts["truncated"] += not blank and not again and cut_short
        one = not blank and not again
        self.codes += bytes([state | (CUT_SHORT if cut_short else 0) if one else state | FORCED]) + bytes([state | FORCED]) * (copies - 1)

    def settle(self) -> None:
        self.cost, self.letters = solve(bytes(self.codes))
        self.plan = iter(zip(self.letters, line_states(self.letters, bytes(self.codes))))

    def line(self, role, text, edit):
        said = f"{role}:{text}"
        self.hash.update(("\n" + said if self.position else said).encode())
        self.position += 1
        return self.conv_id, self.position - 1, role, text, edit

    def read(self, role, text, copies):
        """The repaired lines up to and with one message."""
        for _ in range(copies):
            yield from self.until_own(role, text)

    def until_own(self, role, text):
        for letter, state in self.plan:
            if letter != "I":
                if letter != "D":
                    yield self.line(role if letter == "K" else ROLES[state], text, letter)
                return
            yield self.line(ROLES[state], "", letter)

    def rest(self):
        for letter, state in self.plan:
            yield self.line(ROLES[state], "", letter)

    def report(self):
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *self.counts.values(), self.cost, self.letters, self.hash.hexdigest()


def _repair(rows: DataFrame, lines: bool) -> DataFrame:
    """Conversations one after another in every task: their messages' codes, then their texts in the same order, which are never held together."""
    texts = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.sha2("text", 256).alias("digest"), F.col("copies").cast("long").alias("copies"), F.lit(False).alias("blank"), F.lit(False).alias("open"), F.lit(False).alias("again"), "text")
    messages = _messages(rows).select("conv_id", F.lit(0).alias("kind"), "turn", "role", "digest", "copies", "blank", "open", "again", F.lit(None).cast("string").alias("text"))
    order = ["conv_id", "kind", "turn", "role", "digest"]
    dealt = messages.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order)
    columns = _LINES if lines else _REPORT
    schema = pa.schema([(n, _ARROW[t]) for n, t in columns])

    def run(batches):
        now, out = None, []

        def end():
            if now is not None:
                if now.plan is None:
                    now.settle()
                rest = list(now.rest())
                out.extend(rest if lines else [now.report()])

        def full():
            data = [list(c) for c in zip(*out)] or [[] for _ in columns]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, schema.types)], schema=schema)

        for batch in batches:
            for conv_id, kind, turn, role, copies, blank, cut_short, again, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv_id != now.conv_id:
                    end()
                    now = _Conversation(conv_id)
                if kind == 0:
                    now.message(turn, role, copies, blank, cut_short, again)
                else:
                    if now.plan is None:
                        now.settle()
                    for line in now.read(role, text, copies):
                        if lines:
                            out.append(line)
            if out:
                yield full()
        end()
        yield full()

    return dealt.select("conv_id", "kind", "turn", "role", "copies", "blank", "open", "again", "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in columns))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, position, role, text, edit: the messages of repaired conversations, with the letter of the edit that made each (K, R or I).

    rows: conv_id, turn, role, text, copies, as damage() gives them. See audit().
    """
    return _repair(rows, lines=True)


def audit(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of rows (conv_id, turn, role, text, copies).

    Messages stand by turn, null turns first; of one turn by role, then by the SHA-256 of the text, which no result but the order of such a tie depends on. Rows that are equal are copies next to each other. A null conv_id is a
    conversation of its own. Roles count by their first character. A conversation of whose rows none has copies has zeros, an empty audit and the hash of an empty text; no rows give no result. Other columns,
    whatever their names, are ignored. Texts of any length are streamed: a task holds some 50 bytes a message of one conversation (codes, costs and letters), as its audit is one string and its hash one sequence in any case.
    """
    return _repair(rows, lines=False)


_DUCK = """
WITH RECURSIVE
table_0 AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS BIGINT) + 1])), 4294967295) % 20 AS kind FROM keyed, table_0),
rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS n, left(role, 1) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen FROM rows),
faults AS (SELECT *, seen = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, right(seen, 1) NOT IN ('.', '!', '?') AS short, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (short AND NOT again AND NOT blank) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS m FROM faults GROUP BY conv_id),
-- from the end: for each state (start, s, u, a) the best of all ways on, as cost and letters; a way is compared by its cost, then by its letters, which is right from behind
steps AS (
  SELECT conv_id, m AS n, {closed} FROM (SELECT conv_id, m, {{'c': 0, 'e': ''}} AS z0, {{'c': 99999999, 'e': ''}} AS z1, {{'c': 99999999, 'e': ''}} AS z2, {{'c': 0, 'e': ''}} AS z3 FROM counts)
  UNION ALL
  SELECT conv_id, n - 1, {closed} FROM (
    SELECT s.conv_id, s.n, {moved} FROM steps s JOIN (SELECT conv_id AS f_conv, n AS f_n, blank OR again AS must, CASE WHEN short THEN 5 ELSE 0 END AS extra, i FROM faults) f ON s.conv_id IS NOT DISTINCT FROM f.f_conv AND s.n = f.f_n
  )
),
best AS (SELECT conv_id, s0.c AS cost, s0.e AS audit FROM steps WHERE n = 0),
letters AS (SELECT conv_id, p, substr(audit, p, 1) AS l, p - length(replace(substr(audit, 1, p), 'I', '')) AS inserted FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best)),
kept AS (SELECT l.conv_id, p, l, CASE WHEN l = 'I' THEN '' ELSE text END AS text, role, i, row_number() OVER (PARTITION BY l.conv_id ORDER BY p) AS place, first_value(CASE WHEN l = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id ORDER BY p) AS head
  FROM letters l LEFT JOIN faults f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l <> 'I' AND f.n = p - inserted WHERE l <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (place - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS said FROM kept GROUP BY conv_id),
known AS (SELECT DISTINCT conv_id FROM conversations)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM known k LEFT JOIN counts c ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON k.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN lines l ON k.conv_id IS NOT DISTINCT FROM l.conv_id
"""


def oracle_sql() -> str:
    """The same in SQL: whole ways from behind, compared by cost and letters, instead of optimal arcs."""
    way = lambda cost, edits: f"{{'c': {cost}, 'e': {edits}}}"
    insert = lambda z: way(f"{z}.c + 5", f"'I' || {z}.e")
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    twice = lambda z, y: insert(f"({insert(z)})") if y is None else least(insert(y), insert(f"({insert(z)})"))
    # states that an insertion leads to: start -> u, s -> u, u -> a, a -> u
    closed = ", ".join([f"{least('z0', insert('z2'), twice('z3', None))} AS s0", f"{least('z1', insert('z2'), twice('z3', None))} AS s1", f"{least('z2', insert('z3'), twice('z2', None))} AS s2", f"{least('z3', insert('z2'), twice('z3', None))} AS s3"])
    gone = lambda s: way(f"s.{s}.c + 2", f"'D' || s.{s}.e")
    keep = lambda s, i: f"CASE WHEN NOT must AND i = '{i}' THEN {way(f's.{s}.c + extra', f"'K' || s.{s}.e")} END"
    turn = lambda s, i: f"CASE WHEN NOT must AND i <> '{i}' THEN {way(f's.{s}.c + extra + 1', f"'R' || s.{s}.e")} END"
    moved = ", ".join([f"{least(gone('s0'), keep('s1', 's'), keep('s2', 'u'), turn('s2', 'u'))} AS z0", f"{least(gone('s1'), keep('s2', 'u'), turn('s2', 'u'))} AS z1", f"{least(gone('s2'), keep('s3', 'a'), turn('s3', 'a'))} AS z2", f"{least(gone('s3'), keep('s2', 'u'), turn('s2', 'u'))} AS z3"])
    return _DUCK.format(closed=closed, moved=moved)
