import math
import random
import zlib

import numpy as np
import pytest

from orogen.llm import langid, toxicity

WORDS = {"en": "the of and ing tion er ly th wh ou re ea".split(), "de": "ung heit sch ich ein keit ß ü ver ge tz pf".split(), "es": "ción ado ñ ll rr que los mente ía ez oso ja".split()}


def text(r, lang, n):
    return " ".join("".join(r.choices(WORDS[lang], k=r.randint(1, 3))) for _ in range(n))


def test_grams_cover_all_ngrams_whatever_the_piece(monkeypatch):
    t = "Añb c" * 50
    whole = np.sort(np.concatenate(list(langid.grams(t))))
    assert len(whole) == 3 * len(t) - 3
    monkeypatch.setattr(langid, "_PIECE", 7)
    np.testing.assert_array_equal(np.sort(np.concatenate(list(langid.grams(t)))), whole)
    assert len(np.concatenate(list(langid.grams("a")))) == 1 and sum(map(len, langid.grams(""))) == 0


def test_language(spark):
    r = random.Random(1)
    data = [(i, text(r, lang := r.choice(list(WORDS)), r.randint(5, 60)), lang if r.random() < 0.9 else None, "s", 0.5) for i in range(600)]
    data += [(1000, None, "en", "s", 1.0), (1001, "", "en", "s", 1.0), (1002, "12 !? 34", "en", "s", 1.0), (None, text(r, "de", 20), "de", None, 1.0), (5, text(r, "en", 9), "en", "s", 1.0), (1003, text(r, "de", 60_000), None, None, 1.0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score double")
    got = langid.held_out_identification(docs).collect()
    assert len(got) == len(data)
    truth = {d[0]: d[2] for d in data[:600]}
    held = [g for g in got if g.held_out and truth.get(g.doc_id)]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got if g.doc_id is not None)
    assert len(held) > 100 and sum(g.lang_pred == truth[g.doc_id] for g in held) / len(held) > 0.95
    by = {g.doc_id: g for g in got}
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[1000].score == 0 and by[None].lang_pred == "de" and not by[None].held_out and by[1003].lang_pred == "de"
    assert all(0 <= g.score <= 1 for g in got)
    empty = docs.limit(0)
    assert langid.held_out_identification(empty).count() == 0
    assert {x.lang_pred for x in langid.held_out_identification(docs.withColumn("lang", docs["lang"].substr(1, 0)).replace("", None, "lang")).collect()} == {"und"}


def test_temperature():
    rng = np.random.default_rng(0)
    p = rng.random(4000)
    labels = (rng.random(4000) < p).astype(int)
    logits = np.stack([np.zeros(4000), np.log(p / (1 - p))], axis=1) * 3
    assert langid.best_temperature(logits, labels) == pytest.approx(3, rel=0.15)


def brute_segments(scores):
    """All maximal segments by their definition: the best segment, then what lies left and right of it."""
    if not scores or max(scores) <= 0:
        return []
    best = None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            s = sum(scores[i : j + 1])
            if best is None or s > best[0] + 1e-12 or (abs(s - best[0]) <= 1e-12 and j - i < best[2] - best[1]):
                best = (s, i, j)
    s, i, j = best
    right = brute_segments(scores[j + 1 :])
    return brute_segments(scores[:i]) + [(i, j, s)] + [(a + j + 1, b + j + 1, c) for a, b, c in right]


def test_maximal_segments():
    r = random.Random(3)
    for _ in range(200):
        scores = [r.choice([-0.5, -0.5, -0.5, r.uniform(0.1, 2)]) for _ in range(r.randint(0, 25))]
        items = [(i, s) for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(items, 0.5)
        want = brute_segments(scores)
        assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _ in want]
        assert all(math.isclose(a[2], b[2], abs_tol=1e-9) for a, b in zip(got, want))


def test_toxicity(spark):
    r = random.Random(2)
    bad = ["idiotax", "idiotin", "scumx", "trashy"]
    docs, labels = [], []
    for i in range(900):
        words = text(r, "en", r.randint(5, 200)).split()
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), r.choice(bad))
        docs.append((i, " ".join(words), "en", "s", "x"))
        if r.random() < 0.8:
            labels.append((i, 1, int(toxic if r.random() < 0.98 else not toxic)))
    truth = {d[0]: any(b in d[1].split() for b in bad) for d in docs}
    docs += [(2000, None, None, None, "x"), (2001, "", None, None, "x"), (None, "a scumx b", None, None, "x"), (3, docs[3][1], None, None, "x"), (2002, text(r, "en", 60_000) + " trashy idiotin scumx", None, None, "x")]
    labels += [(5000, 1, 1), (None, 1, 1), (7, 1, None), (8, None, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.held_out_toxicity(d, lab).collect()
    assert len(got) == len(docs) and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got)
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert sum(g.predicted == truth[g.doc_id] for g in held) / len(held) > 0.97
    by = {g.doc_id: g for g in got}
    assert by[2000].predicted == 0 and by[2001].predicted == 0 and by[2002].predicted == 1 and by[2002].passages.endswith("60000-60002")
    assert len({x.score for x in toxicity.held_out_toxicity(d, lab.limit(0)).collect()}) == 1
    assert toxicity.held_out_toxicity(d.limit(0), lab).count() == 0


def test_only_verified_copies_are_silent(spark):
    r = random.Random(4)
    rare = min((f"a{i} b{i}" for i in range(20_000)), key=lambda p: zlib.crc32(p.encode()))  # a pair with a small hash that unrelated texts share
    own = [f"{rare} " + " ".join(f"u{i}x{j}" for j in range(40)) for i in range(30)]
    base = [f"c{j}" for j in range(200)]
    near = [base] + [[*base[:k], f"new{k}", *base[k + 1 :]] for k in (50, 90, 130)]
    data = [(i, t, 0) for i, t in enumerate(own)] + [(100 + i, " ".join(w), 1) for i, w in enumerate(near)] + [(200, own[0], 0), (200, own[0], 0), (201, own[0], 1), (202, " ".join(base), 0), (300, "twice", 1), (300, "twice", 1), (300, "other", 1)]
    r.shuffle(data)
    got = {c.token: (c.toxic, c.clean) for c in toxicity.token_counts(spark.createDataFrame(data, "doc_id long, text string, toxic int")).collect()}
    assert got[rare.split()[0]] == (1, 30)  # every text that is no copy votes
    assert all(got[f"u{i}x0"] == (int(i == 0), 1) for i in range(30))
    assert got["c0"] == (1, 1) and "new50" not in got  # of near copies with one label, the first
    assert got["twice"] == (1, 0) and got["other"] == (1, 0)


def test_lexicon_holds_every_telling_token(spark):
    counts = spark.range(50_000).selectExpr("concat('t', id) token", "if(id < 25000, 50L, 0L) toxic", "if(id < 25000, 0L, 50L) clean")
    assert set(toxicity.lexicon(counts)[0]) == {f"t{i}" for i in range(25_000)}


def plain_toxicity(docs, labels):
    """Score and passages of every (doc_id, text), step by step and one text at a time."""
    words = lambda t: toxicity._TOKEN.findall(t.lower())
    pairs = lambda t: {zlib.crc32(" ".join(p).encode()) for p in zip(t.lower().split(), t.lower().split()[1:])}
    learned = [(labels[i], i, t) for i, t in docs if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
    voters = []
    for toxic, i, t in sorted(learned):
        if not any(v[0] == toxic and len(pairs(v[2]) & pairs(t)) >= 0.8 * len(pairs(v[2]) | pairs(t)) for v in voters):
            voters.append((toxic, i, t))
    counts = [{}, {}]
    for toxic, _, t in voters:
        for p in {p for w in words(t) for p in [w, *(w[:n] + "*" for n in range(5, 9) if n < len(w))]}:
            counts[toxic][p] = counts[toxic].get(p, 0) + 1
    total = [sum(c.values()) for c in counts]
    size = min(total)
    scores, law = {}, {}
    for p in counts[0].keys() | counts[1].keys():
        c, t = counts[0].get(p, 0), counts[1].get(p, 0)
        prior = size * (c + t) / sum(total)
        delta = math.log((t + prior) / (total[1] + size - t - prior)) - math.log((c + prior) / (total[0] + size - c - prior))
        if delta / math.sqrt(1 / (t + prior) + 1 / (c + prior)) >= 4 and delta > 0.5:
            scores[p] = delta
            law[round(delta * 1000)] = law.get(round(delta * 1000), 0) + (c + prior) / (total[0] + size)
    most = min(1.0, 0.5 / sum(law.values()))
    rest = 1 - most * sum(law.values())
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(most * p * math.exp(mid * s / 1000) for s, p in law.items()) + rest * math.exp(-mid / 2) > 1 else (mid, high)

    def evidence(t):
        per_token = [max((scores.get(p, 0.0) for p in [w, *(w[:n] + "*" for n in range(5, 9) if n < len(w))]), default=0) or -0.5 for w in words(t)]
        segments = brute_segments(per_token)
        best = total = fact = 0.0
        for r, s in enumerate(sorted((s for *_, s in segments), reverse=True), 1):
            total, fact = total + low * s - math.log(len(per_token) + 1), fact + math.log(r)
            best = max(best, total - fact)
        return best, segments, len(per_token)

    x = [(min(399, int(evidence(t)[0] / 0.25)), toxic) for toxic, _, t in learned]
    x = [((b + 0.5) * 0.25 if b else 0.0, toxic) for b, toxic in x]
    clean = [v for v, toxic in x if not toxic]
    scale = min(1.0, max(1e-4, math.exp(sum(clean) / len(clean) - 0.5772)))
    a, b = 0.5, -3.0
    for _ in range(300):
        p = [1 / (1 + math.exp(-(a * v + b))) for v, _ in x]
        g = [sum((q - y) * v for q, (v, y) in zip(p, x)) + 1e-2 * a, sum(q - y for q, (_, y) in zip(p, x)) + 1e-2 * b]
        h = np.array([[sum(q * (1 - q) * v * v for q, (v, _) in zip(p, x)) + 1e-2, sum(q * (1 - q) * v for q, (v, _) in zip(p, x))], [0, sum(q * (1 - q) for q in p) + 1e-2]])
        h[1, 0] = h[0, 1]
        step = np.linalg.solve(h, g)
        step *= min(1.0, 1 / max(1e-9, abs(step).max()))
        a, b = a - step[0], b - step[1]
    out = {}
    for i, t in docs:
        e, segments, n = evidence(t)
        out[i] = 1 / (1 + math.exp(-(a * e + b))), ",".join(f"{f}-{to}" for f, to, s in segments if scale * (n + 1) * math.exp(-low * s) < 0.05)
    return out


@pytest.mark.parametrize("limit", [toxicity.LEXICON_BYTES, 0])
def test_query_equals_plain_version(spark, monkeypatch, limit):
    """The whole query, with the lexicon sent to the workers and with the lexicon joined."""
    monkeypatch.setattr(toxicity, "LEXICON_BYTES", limit)
    r = random.Random(9)
    bad = ["idiotax", "idiotin", "scumx", "trashy"]
    docs, labels = [], {}
    for i in range(400):
        own = text(r, "en", r.randint(5, 60)).split()
        toxic = r.random() < 0.3
        for _ in range(r.randint(1, 4) if toxic else 0):
            own.insert(r.randrange(len(own)), r.choice(bad))
        docs.append((i, " ".join(own)))
        if r.random() < 0.8:
            labels[i] = int(toxic)
    docs += [(400 + i, docs[i][1]) for i in range(20)] + [(500, ""), (501, "scumx")]  # copies, an empty text and one that is all evidence
    labels |= {400 + i: labels[i] for i in range(20) if i in labels}
    want = plain_toxicity(docs, labels)
    got = toxicity.held_out_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, t) for i, t in labels.items()], "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    for g in got:
        assert g.score == pytest.approx(want[g.doc_id][0], abs=1e-6) and g.passages == want[g.doc_id][1] and g.predicted == int(g.score >= 0.3)
    assert sum(g.predicted for g in got) > 50 and any(g.passages for g in got)
