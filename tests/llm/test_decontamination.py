import hashlib
import random
import re
from collections import Counter

import pytest

from orogen.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        if i is not None and w:
            for s in range(max(1, len(w) - 12)):
                windows.setdefault(tuple(w[s : s + 13]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, names = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                k = tuple(w[s : s + n])
                if k in windows:
                    hit |= set(range(s, s + n))
                    names |= windows[k]
        out.append((str(i), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", broadcast)
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "ÀB", "naïve", "A", "1"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([13, 14, 20, 40])))) for i in range(12)]
    items += [(100, "Short one, here"), (101, ""), (102, None), (None, "the null item has thirteen words a b c d e f g h"), (100, "Short one, here"), (103, "same same same same same same same same same same same same same same same"), (104, items[0][1])]
    docs = []
    for i in range(80):
        w = r.choices(vocabulary, k=r.randint(0, 150))
        if r.random() < 0.6:
            own = (r.choice(items)[1] or "").split()
            at, a = r.randint(0, len(w)), r.randint(0, 5)
            w[at:at] = own[a : a + r.choice([5, 12, 13, 14, 30])]
        docs.append((i, r.choice(["", " ", "\n"]) + r.choice([" ", ", ", "\x01"]).join(w) + r.choice(["", ".", " "])))
    docs += [(200, None), (201, ""), (202, "..."), (203, "short ONE here"), (None, "a short one here"), (5, docs[5][1]), (204, "same " * 5000), (205, "x" * 50_000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_hit string")
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((str(g[0]), *g[1:6]) for g in d.decontaminate(df, it).collect())
    assert got == plain(docs, items)
    bad = {str(g[0]) for g in got if g[5]}
    kept = d.clean(df, it)
    assert kept.columns == df.columns
    assert sorted(str(k.doc_id) for k in kept.collect()) == sorted(str(i) for (i, _), p in zip(docs, docs) if str(i) not in bad)
    assert d.decontaminate(df.limit(0), it).count() == 0
    assert not any(g.contaminated for g in d.decontaminate(df, it.limit(0)).collect())


def test_proximity(spark):
    words = [f"w{i}" for i in range(13)]
    near = list(words)
    near[5] = "other"
    df = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(words)), (3, "w5 w5 " + " ".join(words[:6]))], "doc_id long, text string")
    it = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {g.doc_id: (g.n_hit, g.n_near) for g in d.decontaminate(df, it).collect()} == {1: (0, 1), 2: (13, 0), 3: (0, 0)}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_proximity_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", broadcast)
    r = random.Random(3)
    common = [f"c{i}" for i in range(30)]
    items = {i: [*r.choices(common, k=5), *(f"r{i}x{j}" for j in range(8)), *r.choices(common, k=3)] for i in range(6)}
    items[6] = "a b a b a b a b a b a b a".split()
    items[7] = [*(f"typo{j}" for j in range(3)), *(f"z{j}" for j in range(10))]
    items[8] = [*(f"gone{j}" for j in range(4)), *(f"z{j}" for j in range(9))]
    docs = [(100, items[7][3:] + ["q", "q", "q"]), (101, "a b a b a b a b a b x y z".split()), (102, "a b".split() * 2 + ["x"] * 20), (103, items[0][:12])]
    for i in range(60):
        w = list(items[r.randrange(8)])
        for _ in range(r.randint(0, 5)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = r.choice([[], ["edit"], [r.choice(common)]])
        docs.append((i, [*r.choices(common, k=r.randint(0, 9)), *w, *r.choices(common, k=r.randint(0, 9))]))
    want = {}
    for i, w in docs:
        stretches = [w[s : s + 13] for s in range(len(w) - 12)]
        windows = {n: [t[s : s + 13] for s in range(len(t) - 12)] for n, t in items.items()}
        near = {n for n, ws in windows.items() if any((Counter(x) & Counter(y)).total() >= 10 for x in ws for y in stretches)}
        want[i] = len(near - {n for n, ws in windows.items() if any(x == y for x in ws for y in stretches)})
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    it = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    assert {g.doc_id: g.n_near for g in d.decontaminate(df, it).collect()} == want
    assert want[100] == 1 and want[101] == 1 and sum(want.values()) > 20
