import json

from orogen.llm import chat


def test_calls_that_cannot_be_judged_are_counted_apart(spark):
    many = {"properties": {"a": {"items": {"anyOf": [{"const": i} for i in range(2000)]}}}}
    schemas = {"plain": {"required": ["a"]}, "endless": {"$ref": "#"}, "long": many, "any": None}
    tools = json.dumps({"tools": [{"name": n, "parameters": s} for n, s in schemas.items()]})
    calls = [("plain", {"a": 1}), ("plain", {}), ("endless", {}), ("endless", 5), ("long", {"a": list(range(1000, 1999))}), ("any", {}), ("other", {})]
    said = json.dumps({"tool_calls": [{"id": str(i), "name": n, "arguments": a} for i, (n, a) in enumerate(calls)]})
    rows = chat.link(spark.createDataFrame([(1, 0, "system", tools), (1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")).collect()
    assert {r.turn: (r.n_calls, r.n_valid, r.n_open) for r in rows} == {0: (0, 0, 0), 1: (7, 3, 2)}
    deep = '{"not":' * 100_000 + "{}" + "}" * 100_000
    assert chat.judge("{}", deep) is None and not chat.fine("{}", deep)
    assert chat.judge("{}", '{"$ref":"#"}') is None and chat.judge("[]", '{"$ref":"#"}') is False and chat.judge("{}", "null") is True and chat.judge("{}", None) is True
