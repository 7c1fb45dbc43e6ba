import random
import re

import xxhash

from orogen.llm import simhash
from orogen.llm.common import connected_components


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(nodes, near):
    part = {n: n for n in nodes}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                part[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint():
    r = random.Random(1)
    for text in [None, "", " \n", "one", "Two Words", "É é A\xa0b\x1cc", *(" ".join(r.choices(["the", "A", "of", "süß", "x1"], k=r.randint(1, 90))) for _ in range(30))]:
        assert simhash.fingerprint(text) == plain(text)


def test_links_on_made_fingerprints(spark):
    r = random.Random(5)
    fps = [0, (1 << 64) - 1]
    for _ in range(40):
        base = r.getrandbits(64)
        for _ in range(6):
            fps.append(base)
            for b in r.sample(range(64), r.choice([0, 1, 2, 3, 3, 4])):
                base ^= 1 << b
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(set(fps))]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    two = {x.node: x.component for x in connected_components(simhash.links_within_two(df)).collect()}
    near = lambda d: lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= d
    assert {f: two.get(f, f) for f in signed} == components(signed, near(2))
    parts = spark.createDataFrame([(f, two.get(f, f)) for f in signed], "fp long, component long")
    three = {x.node: x.component for x in connected_components(simhash.links_at_three(parts)).collect()}
    whole = {f: two.get(f, f) for f in signed}
    assert {f: three.get(p, p) for f, p in whole.items()} == components(signed, near(3))


def test_near_duplicates(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    data, i = [], 100
    for _ in range(25):
        base = r.choices(words, k=r.choice([2, 5, 40, 200]))
        for _ in range(r.choice([1, 1, 3, 8])):
            copy = list(base)
            if r.random() < 0.7:
                copy[r.randrange(len(copy))] = r.choice(words)
            data.append((i, " ".join(copy), "x"))
            i -= 1
    data += [(500, None, "x"), (501, "", "x"), (502, "\n", None), (None, data[0][1], "y"), (7, "only one", "z"), (7, "only one", "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, component_id string")
    got = simhash.near_duplicates(docs).collect()
    fps = {d[0]: plain(d[1]) for d in data}
    nodes = sorted(k for k in fps if k is not None)
    want = components(nodes, lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 3)
    assert len(got) == len(data)
    for g in got:
        assert g.fingerprint == f"{fps[g.doc_id]:016x}"
        assert g.component_id == (want[g.doc_id] if g.doc_id is not None else want[data[0][0]])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(k.doc_id for k in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_without_usable_ids(spark):
    a, b, c, d = ("".join(f"{k}{i} " for i in range(40)) for k in "abcd")
    schema = "doc_id long, text string, lang string"
    texts = lambda rows: sorted((k.doc_id, k.text, k.lang) for k in simhash.keep_one(spark.createDataFrame(rows, schema)).collect())
    got = simhash.keep_one(spark.createDataFrame([(None, a, "x"), (None, b, "x"), (None, c, "x"), (None, c, "x"), (1, a, "y")], schema)).collect()
    assert sorted((str(k.doc_id), k.text) for k in got) == sorted([("1", a), ("None", b), ("None", c)])
    assert texts([(7, a, "x"), (7, b, "x"), (8, a, "y"), (9, d, "y")]) == [(7, a, "x"), (7, b, "x"), (9, d, "y")]
    rows = [(3, a, "y"), (3, a, "x"), (3, a, "x")]
    assert len(texts(rows)) == 1 and texts(rows) == texts(rows[::-1])
