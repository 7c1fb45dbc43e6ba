import itertools
import json
import random
import re

import numpy as np
import pytest

from orogen.llm import chat, pii
from tests.llm import held_out_names


def test_links(spark):
    tools = json.dumps({"tools": [{"name": "add", "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "u": {"enum": ["x", "y"]}}, "additionalProperties": False}}]})
    call = lambda *cs: json.dumps({"content": None, "tool_calls": [dict(zip(("id", "name", "arguments"), c)) for c in cs]})
    result = lambda i, v: json.dumps({"tool_call_id": i, "content": v})
    data = [
        (1, 0, "system", tools, "z"), (1, 1, "user", "hi {", None), (1, 3, "assistant", call(("c1", "add", {"a": 1, "u": "x"}), ("c2", "add", '{"a": "no"}'), ("c3", "other", {})), None),
        (1, 2, "tool", result("c1", {"b": 1, "a": 2}), None), (1, 4, "tool", result("c2", "x"), None), (1, 5, "tool", result("none", "x"), None),
        (2, 0, "tool", result("c1", "other conversation"), None), (None, 0, "user", None, None), (3, None, None, "", None), (3, 0, "user", "same", None), (3, 0, "user", "same", None),
        (4, 0, "assistant", call((None, None, None)), None), (4, 1, "assistant", '{"tool_calls": 5}', None), (4, 2, "user", '{"a": NaN}', None),
    ]
    rows = chat.link(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, canonical string")).collect()
    assert len(rows) == len(data)
    by = {(r.conv_id, r.turn): r for r in rows}
    c = by[1, 3]
    assert (c.n_calls, c.n_answered, c.n_valid) == (3, 2, 2)
    assert by[1, 2].answers_turn == 3 and by[1, 4].answers_turn == 3 and by[1, 5].answers_turn is None and by[2, 0].answers_turn is None
    order = [r.turn for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [0, 1, 3, 2, 4, 5]
    assert by[1, 2].canonical == '{"content":{"a":2,"b":1},"role":"tool","tool_call_id":"c1"}'
    assert by[1, 1].canonical == '{"content":"hi {","role":"user"}'
    assert by[4, 0].n_calls == 1 and by[4, 0].n_valid == 0 and by[4, 0].n_answered == 0
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


ODD_MESSAGES = [
    '{"content":"\\ud800","tools":[]}', '{"tool_call_id":"\\udc00"}', '{"tool_calls":[{"id":"a","name":"f","arguments":{"n":' + "9" * 400 + "}}]}", '{"tool_calls":[{"id":"b","name":"f","arguments":{"n":1e400}}]}',
    '{"tools":[{"name":"f","parameters":{"required":5,"type":[{}],"properties":{"n":{"type":"integer","minimum":"x","pattern":5}}}}]}', "{" * 100_000, '{"tool_calls":' + "[" * 5000 + "]" * 5000 + "}",
    '{"tools":[{"name":"g","parameters":{"$ref":"#"}},{"name":"h","parameters":{"pattern":"(","anyOf":5,"enum":{},"allOf":[]}}], "tool_calls":[{"name":"g","arguments":{}},{"name":"h","arguments":{}}]}',
    '{"tool_calls":[{"id":{"a":1},"name":[1],"arguments":"{\\"a\\":1}"},7,null]}', "{}", "[]", "null", '{"tools":{}}', "{\"tool_call_id\":\"" + "9" * 5000 + "\"}", '{"tool_calls":[{"arguments":' + "9" * 5000 + "}]}",
]


def test_no_message_breaks_the_job(spark):
    r = random.Random(8)
    bits = ["{", "}", "[", "]", '"tool_calls"', '"tools"', '"id"', '"arguments"', '"parameters"', '"type"', '"name"', ":", ",", "1e999", "-0.0", '"\\ud83d"', "null", "true", "12"]
    data = [(i % 3, i, "tool", t) for i, t in enumerate([*ODD_MESSAGES, *("{" + "".join(r.choices(bits, k=r.randint(1, 25))) for _ in range(400))])]
    rows = chat.link(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    assert len(rows) == len(data)
    for row in rows:
        json.loads(row.canonical)
        assert "Infinity" not in row.canonical
    assert chat.parse("u", ODD_MESSAGES[0])[0] == '{"content":"\\ud800","role":"u"}'


def test_schema_keywords():
    cases = [
        ({"minimum": 2}, 2, 1), ({"exclusiveMaximum": 3}, 2.5, 3), ({"multipleOf": 3}, 9, 10), ({"type": "integer"}, 3, 3.5), ({"type": "number"}, 3.5, True), ({"const": {"a": [1]}}, {"a": [1]}, {"a": [2]}),
        ({"pattern": "^a+$"}, "aaa", "ab"), ({"minLength": 2, "maxLength": 3}, "ab", "a"), ({"anyOf": [{"type": "null"}, {"type": "string"}]}, None, 1), ({"oneOf": [{"minimum": 1}, {"minimum": 5}]}, 2, 6),
        ({"allOf": [{"minimum": 1}, {"maximum": 5}]}, 3, 6), ({"not": {"type": "string"}}, 1, "x"), ({"$defs": {"n": {"type": "integer"}}, "properties": {"a": {"$ref": "#/$defs/n"}}}, {"a": 1}, {"a": "1"}),
        ({"items": {"type": "string"}, "minItems": 1, "uniqueItems": True}, ["a"], ["a", "a"]), ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, {"x1": 1}, {"y": 1}), ({"required": ["a"]}, {"a": 1}, {}),
        ({"prefixItems": [{"const": 1}], "items": False}, [1], [1, 2]), ({"contains": {"const": 2}}, [1, 2], [1]), ({"if": {"minimum": 5}, "then": {"maximum": 9}}, 4, 10), ({"maxProperties": 1}, {"a": 1}, {"a": 1, "b": 2}), ({"enum": [1, "a"]}, "a", 2),
    ]
    for schema, good, bad in cases:
        assert chat.valid(good, schema) and not chat.valid(bad, schema), schema
    assert not chat.fine("{}", '{"$ref":"#"}') and chat.fine('{"n": 1.0}', '{"properties":{"n":{"type":"integer"}}}')


def test_numbers_by_their_digits():
    for schema, good, bad in [({"multipleOf": 0.1}, 0.3, 0.35), ({"multipleOf": 1e-7}, 0.3, 3e-8), ({"type": "integer"}, 1e30, 1e-30), ({"multipleOf": 10**400}, 10**401, 1.5), ({"dependentRequired": {"a": ["b"]}}, {"a": 1, "b": 1}, {"a": 1})]:
        assert chat.valid(good, schema) and not chat.valid(bad, schema), schema
    assert chat.fine('{"a":1.5}', '{"properties":{"a":{"multipleOf":1' + "0" * 400 + "}}}") is False
    assert chat.fine('{"a":1}', '{"allOf":[{"$ref":"#/allOf/' + "9" * 5000 + '"}]}') is True  # a reference to nothing fits everything


def test_schemas_that_double_end_soon():
    import time

    doubled = {"$defs": {f"d{i}": {"allOf": [{"$ref": f"#/$defs/d{i + 1}"}, {"$ref": f"#/$defs/d{i + 1}"}]} for i in range(60)} | {"d60": {"type": "object"}}, "$ref": "#/$defs/d0"}
    start = time.perf_counter()
    assert chat.fine("{}", json.dumps(doubled)) and not chat.fine("[]", json.dumps(doubled))
    many = {"properties": {"a": {"items": {"anyOf": [{"const": i} for i in range(2000)]}}}}
    assert not chat.fine(json.dumps({"a": [0.5] * 5}) , json.dumps(many)) and not chat.fine(json.dumps({"a": list(range(-3000, 0))}), json.dumps(many))
    wide = {"properties": {"a": {"items": {"anyOf": [{"enum": list(range(j, j + 300))} for j in range(1000)]}}}}
    chat.fine(json.dumps({"a": list(range(5000, 9000))}), json.dumps(wide))
    assert time.perf_counter() - start < 20
    assert not chat.fine("{}", json.dumps({"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"$ref": "#/$defs/a"}}, "$ref": "#/$defs/a"}))


def test_no_schema_breaks_the_job():
    r = random.Random(12)
    keys = ["type", "enum", "const", "$ref", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "minimum", "exclusiveMaximum", "multipleOf", "minLength", "pattern", "items", "prefixItems", "contains", "uniqueItems", "required", "dependentRequired", "properties", "patternProperties", "additionalProperties", "propertyNames", "maxProperties", "$defs"]
    leaves = [None, True, False, 0, -1, 0.1, 1e308, 10**400, 5e-324, "", "a", "(", "string", "integer", "#", "#/", "#/$defs/a", "#/allOf/0", "#/allOf/99999999999999999999", "%25", [], {}]

    def some(depth):
        kind = r.random() if depth else 0
        if kind < 0.3:
            return r.choice(leaves)
        if kind < 0.5:
            return [some(depth - 1) for _ in range(r.randint(0, 3))]
        return {r.choice([*keys, "a", "b"]): some(depth - 1) for _ in range(r.randint(0, 4))}

    for _ in range(4000):
        assert chat.fine(json.dumps({"a": some(3), "b": some(2)}), json.dumps(some(5))) in (True, False)


def plain_order(conversation):
    """Rows (turn, calls, answers) in order, by brute force: the key of a moved result is its call's key and one more."""
    n = len(conversation)
    own = [(turn, i) for i, (turn, _, _) in enumerate(conversation)]
    first_call, first_result = {}, {}
    for i in sorted(range(n), key=own.__getitem__):
        for at, c in enumerate(conversation[i][1]):
            first_call.setdefault(c, (i, at))
        if conversation[i][2] is not None:
            first_result.setdefault(conversation[i][2], i)
    parent = {i: first_call[c] for c, i in first_result.items() if c in first_call}
    for i in list(parent):  # circles: the link into the earliest message goes
        seen, at = [], i
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at][0]
        if at in seen:
            del parent[min(seen[seen.index(at) :], key=own.__getitem__)]

    def key(i):
        best, dist, at, d = own[i], 0, i, 0
        while at in parent:
            at, d = parent[at][0], d + 1
            if own[at] > best:
                best, dist = own[at], d
        return best, dist, parent[i][1] if i in parent else 0, i

    return sorted(range(n), key=key), parent


def test_order_equals_brute_force(spark):
    r = random.Random(9)
    conversations = [[(5, ["c1"], None), (3, ["c2"], "c1"), (4, [], "c2")], [(0, ["a"], "b"), (1, ["b"], "a"), (2, ["s"], "s")], [(50 - i, [f"k{i}"], f"k{i - 1}") for i in range(50)]]
    for _ in range(60):
        n = r.randint(1, 12)
        conversations.append([(r.randint(-3, 9), [f"c{r.randint(0, n)}" for _ in range(r.randint(0, 2))], f"c{r.randint(0, n)}" if r.random() < 0.6 else None) for _ in range(n)])
    data = []
    for c, conversation in enumerate(conversations):
        for i, (turn, calls, answers) in enumerate(conversation):
            body = {"content": i} | ({"tool_calls": [{"id": x, "name": "f", "arguments": {}} for x in calls]} if calls else {}) | ({"tool_call_id": answers} if answers else {"tools": []})
            data.append((c, turn, json.dumps(body)))
    df = spark.createDataFrame(data, "conv_id long, turn long, text string").coalesce(1)
    rows = chat.link(df.selectExpr("conv_id", "turn", "'x' as role", "text")).collect()
    for c, conversation in enumerate(conversations):
        got = [json.loads(x.canonical)["content"] for x in sorted((x for x in rows if x.conv_id == c), key=lambda x: x.position)]
        want, parent = plain_order(conversation)
        assert got == want, c
        assert all(got.index(p) < got.index(i) for i, (p, _) in parent.items())
        assert sorted(x.position for x in rows if x.conv_id == c) == list(range(1, len(conversation) + 1))


def plain(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    r = random.Random(4)
    for alphabet in ("a@.-b @", "0125. -+()", "+1 (23)-4.", "aé@9.x+ 4-"):
        for _ in range(1500):
            t = "".join(r.choices(alphabet, k=r.randint(0, 45)))
            assert pii.base_spans(t) == plain(t), t
    for _ in range(300):
        t = "".join(r.choices("4 -", k=r.randint(10, 30))) + " 4111 1111 1111 1111 "
        assert pii.base_spans(t) == plain(t), t
    pii.base_spans("a" * 200_000 + " @ " + "1" * 200_000 + "." + "+1" * 100_000)  # linear


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.read_labelled())


def decode(model, words):
    """The best tags of one sentence, without the tagger's tables."""
    kinds = [model.kind(w) for w in words]
    e = pii.emissions(np.arange(1, len(words) + 1)[None], np.array([[k[0] for k in kinds]]), model.rows(kinds), model.pairs)
    return pii.viterbi(e, np.array([len(words)]), model.step, model.first)[0].tolist()


def test_names_and_masks(spark, model):
    tagger = pii.Tagger(model)
    found = {(t[s:e], pii.KINDS[k]) for t in ["Hello, my name is Robert Fox and I stay.", "Madame Louise Blanc habite 3 rue Pasteur."] for s, k, e in tagger([t])[0]}
    assert found == {("Robert Fox", "name"), ("Louise Blanc", "name"), ("3 rue Pasteur", "address")}
    right = total = 0
    for words, tags in pii.read_labelled():
        got = decode(model, words)
        right += sum(g == t for g, t in zip(got, tags))
        total += len(tags)
    assert right / total > 0.95
    data = [(1, "Mail a.b@c.de or +1 (017) 555-7713, my name is Robert Fox.", 5), (1, "plain", 1), (2, "", 0), (None, None, None), (3, "x " * 50_000 + "1.2.3.4", 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, spans int")
    got = {(r.doc_id, r.n_chars if "n_chars" in r else 0): r for r in pii.find(docs).collect()}
    assert len(got) == 4 and pii.find(docs).count() == 5 and pii.find(docs.limit(0)).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask(docs.where("doc_id is null or doc_id <> 1 or length(text) > 10")).collect()}
    assert masked[1] == "Mail <EMAIL> or <PHONE>, my name is <NAME>." and masked[None] is None and masked[2] == "" and masked[3].endswith("<IP>")


#: Not among the learned sentences; words of names and most contexts are new.
HELD_OUT = """
Tonight my friend [Robert Fox|name] will cook for us .
The contract was signed by [Emily Watson|name] in March .
Mr [Arthur Penn|name] left the room .
We spoke with [Daniel de Vries|name] about the price .
Contact Dr [Yusuf Khan|name] if it hurts .
My name is [Ruth Abbot|name] and this is my dog .
It was sent to [Victor Hale|name] by post .
Our neighbour [Tina Moss|name] has a cat .
She lives at [77 Willow Road|address] with her son .
Send it to [3 Harbour Street|address] today .
Frau [Ilse Krone|name] kommt morgen .
Gestern traf ich [Uwe Sommer|name] im Park .
Mein Name ist [Greta Holm|name] und ich singe .
Er wohnt in der [Lindenstraße 90|address] im Norden .
Monsieur [Alain Rives|name] est malade .
Hier j'ai vu [Julie Caron|name] au marché .
Elle habite [2 rue Voltaire|address] avec son chat .
El señor [Pablo Ortiz|name] llega tarde .
Ayer vi a [Rosa Marín|name] en el mercado .
Vive en la [calle Real 8|address] con su madre .
The Museum of Bath opens at 10 on Tuesday .
We saw 4 Swans and the Lake . It was Spring .
Der Zug nach Hamburg hat 5 Wagen .
Le train pour Nice part à 8 heures .
El tren a Toledo sale a las 7 .
The Council met in Leeds and the Mayor spoke .
Over Over Over Over Over Over
"""


def entities(tags):
    """(first, last, kind) of a row of tags."""
    out = []
    for i, t in enumerate(tags):
        if t % 2:
            out.append([i, i, t])
        elif t and out and out[-1][1] == i - 1:
            out[-1][1] = i
    return set(map(tuple, out))


def test_held_out_spans(model):
    """Precision and recall of whole spans on lines that were not learned from."""
    right = found = there = 0
    for words, tags in pii.read_labelled(HELD_OUT.splitlines()):
        got = entities(decode(model, words))
        right, found, there = right + len(got & entities(tags)), found + len(got), there + len(entities(tags))
    print(f"precision {right / found:.2f}, recall {right / there:.2f} of {there}")
    assert right / found >= 0.85 and right / there >= 0.8


def test_held_out_frames(model):
    """The same through the tagger, on over a hundred lines whose frames and nearly all of whose names the table does not have."""
    tagger = pii.Tagger(model)
    right = found = there = 0
    lines = list(filter(None, held_out_names.HELD_OUT.splitlines()))
    assert len(lines) > 100
    for line in lines:
        text, want, at = "", set(), 0
        for m in pii._MARK.finditer(line):
            text += line[at : m.start()]
            want.add((len(text), pii.KINDS.index(m[2]), len(text) + len(m[1])))
            text, at = text + m[1], m.end()
        got = set(tagger([text + line[at:]])[0])
        right, found, there = right + len(got & want), found + len(got), there + len(want)
    print(f"precision {right / found:.2f}, recall {right / there:.2f} of {there}")
    assert right / found >= 0.85 and right / there >= 0.85


def random_field(r, n_rows, wide):
    """Emissions from random tables, by the operator and by plain sums, of random rows whose words are 0 from their length on."""
    k, kinds = len(pii.TAGS), 7
    rows, pairs = r.normal(size=(len(pii.AROUND), kinds, k)), r.normal(size=(2, 4, 4, k))
    rows[:, 0] = 0
    lengths = r.integers(1, wide + 1, n_rows)
    ids = np.where(np.arange(wide) < lengths[:, None], r.integers(1, kinds, (n_rows, wide)), 0)
    shapes = np.where(ids > 0, ids % 3 + 1, 0)
    plain = np.zeros((n_rows, wide, k))
    for row in range(n_rows):
        for i in range(lengths[row]):
            at = lambda table, j: table[row, j] if 0 <= j < lengths[row] else 0  # noqa: B023, E731
            plain[row, i] = sum(rows[o, at(ids, i + d)] for o, d in enumerate(pii.AROUND)) + pairs[0, at(shapes, i - 1), shapes[row, i]] + pairs[1, at(shapes, i + 1), shapes[row, i]]
    return lengths, pii.emissions(ids, shapes, rows, pairs), plain, r.normal(size=(k, k)), r.normal(size=k)


def test_decoding_and_chances_equal_exhaustive_search():
    r = np.random.default_rng(3)
    k = len(pii.TAGS)
    for wide in range(1, 6):
        lengths, e, plain, step, first = random_field(r, 3, wide)
        inside = np.arange(wide) < lengths[:, None]
        assert np.allclose(e[inside], plain[inside])
        got = pii.viterbi(e, lengths, step, first)
        own, both, start = pii._posteriors(e, inside, step, first)
        pair_sum, first_sum = np.zeros((k, k)), np.zeros(k)
        for row in range(3):
            n = int(lengths[row])
            ways = list(itertools.product(range(k), repeat=n))
            scores = np.array([first[w[0]] + sum(e[row, i, t] for i, t in enumerate(w)) + sum(step[a, b] for a, b in zip(w, w[1:])) for w in ways])
            assert tuple(got[row, :n]) == ways[int(scores.argmax())]
            chance = np.exp(scores - scores.max())
            chance /= chance.sum()
            want = np.zeros((n, k))
            for w, c in zip(ways, chance):
                want[range(n), w] += c
                first_sum[w[0]] += c
                np.add.at(pair_sum, (list(w[:-1]), list(w[1:])), c)
            assert np.allclose(own[row, :n], want) and not own[row, n:].any()
        assert np.allclose(both, pair_sum) and np.allclose(start, first_sum)


def test_titles_initials_possessives_and_rules():
    assert pii._TOKEN.findall("Mr. J. R. Hill's O'Hara, 5 %%% a.b A.") == ["Mr.", "J.", "R.", "Hill", "'", "s", "O'Hara", ",", "5", "%%%", "a", ".", "b", "A", "."]
    assert pii.ends("%%%") and pii.ends(".") and not pii.ends("%") and not pii.ends("Mr.")
    assert pii.trim(["=", "12", "Park"], 5) == (0, -1) and pii.trim(["J.", "R.", "Hill"], 4) == (0, 2) and pii.trim(["J."], 4) == (0, -1)


def test_find_equals_brute_force(spark, model):
    """Every column of find() from plain patterns and the tagger, one text at a time."""
    import hashlib

    tagger = pii.Tagger(model)
    texts = ["Mail a.b@c.de, 1.2.3.4 or +1 (017) 555-7713. My name is Robert Fox.", "4111 1111 1111 1111 at 12 Park Street", "", None, "Mr Hill Mr Hill", "My name is Ann a@b.cd", "x" * 9000 + " 9.9.9.9"]
    for row in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        t = texts[row.doc_id] or ""
        base = plain(t)
        every = sorted(base + [x for x in tagger([t])[0] if not any(b[0] < x[2] and x[0] < b[2] for b in base)])
        spell = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert row.spans == spell(every) and row.base_sha256 == hashlib.sha256(spell(base).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in every) for i in range(6)]


def test_names_are_trimmed_not_dropped():
    assert pii.trim("Anne de la Tour".split(), 4) == (0, 3) and pii.trim(["Jean", "-", "Luc", "Roy"], 4) == (0, 3) and pii.trim("Ann went".split(), 4) == (0, 0)
    assert pii.trim("One Two Three Four Five Six Seven Eight".split(), 4) == (0, 7) and pii.trim(["x"], 4) == (0, -1) and pii.trim("12 Park Street".split(), 5) == (0, 2)


def test_batched_decoding_equals_one_by_one():
    model = pii.train(pii.read_labelled(), rounds=20)
    tagger = pii.Tagger(model)
    assert pii.Tagger(pii.train([], rounds=2))(["Mr Peter Brown went."]) is not None
    texts = ["Mr Peter Brown went. Dear Mr Hill , thank you\n12 Park Street", "", "...", "x", "My name is Anna Weber and I live at 5 Mill Lane | yes"] * 3
    assert tagger(texts) == [tagger([t])[0] for t in texts]
