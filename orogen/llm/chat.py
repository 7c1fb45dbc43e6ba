"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from fractions import Fraction
from functools import lru_cache
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orogen.llm.common import cut, drop

_PARSED = "canonical string, calls array<struct<id:string,name:string,arguments:string>>, result_id string, tools array<struct<name:string,schema:string>>"
STEPS = 100_000  # checks of a part of the arguments against a part of the schema; 100 characters to compare count as one
_LONE = re.compile("[\ud800-\udfff]")


def _whole(text: str) -> str:
    """A string that UTF-8 can hold: lone surrogates become their escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and no escapes beyond the necessary; equal values give equal text."""
    return _whole(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _number(text: str):
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError
    return int(value) if value.is_integer() and abs(value) < 1 << 53 else value


def _no(_):
    raise ValueError


def _load(text: str | None):
    """The JSON value of a text, or None where it is none, holds NaN or numbers beyond double precision's range, or is nested too deep. 1.0 is 1."""
    try:
        return json.loads(text, parse_constant=_no, parse_float=_number)
    except (ValueError, TypeError, RecursionError):
        return None


def _text(value) -> str | None:
    return None if value is None else _whole(value) if isinstance(value, str) else canonical(value)


def parse(role: str | None, text: str | None) -> tuple[str, list[dict], str | None, list[dict]]:
    """A message's canonical JSON, its calls, the call that it answers, and the tools it declares.

    A message is plain text, or a JSON object with any of content, tool_calls (id, name, arguments: an object, or its JSON as a string),
    tool_call_id, and tools (name, parameters: a schema). A JSON text without these keys, and one that cannot be read or is nested too deep, is plain text.
    """
    plain = canonical({"role": role, "content": text}), [], None, []
    body = _load(text) if text and text.lstrip()[:1] == "{" else None
    if not isinstance(body, dict) or not body.keys() & {"tool_calls", "tool_call_id", "tools"}:
        return plain
    try:
        calls, tools = [], []
        for c in body.get("tool_calls") if isinstance(body.get("tool_calls"), list) else []:
            c = c if isinstance(c, dict) else {}
            own = c.get("function") if isinstance(c.get("function"), dict) else c
            args = own.get("arguments")
            read = _load(args) if isinstance(args, str) else args
            calls.append({"id": _text(c.get("id")), "name": _text(own.get("name")), "arguments": canonical(args if read is None else read)})
        for t in body.get("tools") if isinstance(body.get("tools"), list) else []:
            t = t if isinstance(t, dict) else {}
            own = t.get("function") if isinstance(t.get("function"), dict) else t
            if own.get("name") is not None:
                tools.append({"name": _text(own["name"]), "schema": canonical(own.get("parameters"))})
        out = {"role": role, "content": body.get("content")}
        if calls:
            out["tool_calls"] = [c | {"arguments": _load(c["arguments"])} for c in calls]
        if body.get("tool_call_id") is not None:
            out["tool_call_id"] = _text(body["tool_call_id"])
        if tools:
            out["tools"] = [{"name": t["name"], "parameters": _load(t["schema"])} for t in tools]
        return canonical(out), calls, out.get("tool_call_id"), tools
    except RecursionError:
        return plain


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": (int, float), "number": (int, float)}


def _is(value, kind) -> bool:
    """A kind that is none of JSON Schema's fits everything. Any number without a fraction is an integer."""
    if not isinstance(kind, str) or kind not in _TYPES:
        return True
    return isinstance(value, _TYPES[kind]) and (kind == "boolean" or not isinstance(value, bool)) and (kind != "integer" or value == value // 1)


@lru_cache(maxsize=10_000)
def _found(pattern: str, text: str) -> bool:
    """Does the pattern occur in text? By an engine whose time is linear in the text; a pattern that it cannot read fits everything."""
    try:
        return pc.match_substring_regex(pa.array([_whole(text)], pa.string()), _whole(pattern))[0].as_py()
    except pa.ArrowInvalid:
        return True


def _target(root, reference: str):
    """What a reference within the schema (#/a/b) points to; None if nothing."""
    if not reference.startswith("#"):
        return None
    at = root
    for key in filter(None, reference[1:].split("/")):
        key = unquote(key).replace("~1", "/").replace("~0", "~")
        place = int(key) if isinstance(at, list) and re.fullmatch("[0-9]{1,9}", key) else None
        at = at.get(key) if isinstance(at, dict) else at[place] if place is not None and place < len(at) else None
    return at


def _number_of(schema: dict, key: str):
    value = schema.get(key)
    return value if _is(value, "number") else None


def _exact(value: int | float) -> Fraction:
    """A number as its decimal digits say it."""
    return Fraction(value if isinstance(value, int) else Decimal(repr(value)))


class NoEnd(Exception):
    """A schema that refers to itself without getting anywhere, or asks for more than STEPS checks."""


class Check:
    """Checks of one value's parts against one schema's parts, each pair once, within STEPS."""

    def __init__(self, root):
        self.root, self.known, self.said, self.left = root, {}, {}, STEPS

    def spend(self, steps: int) -> None:
        self.left -= steps
        if self.left < 0:
            raise NoEnd

    def spell(self, value) -> str:
        key = id(value)  # parts of schema and value live as long as the check
        if key not in self.said:
            self.said[key] = (canonical(value), value)
            self.spend(len(self.said[key][0]) // 100)
        return self.said[key][0]

    def fits(self, value, schema) -> bool:
        if not isinstance(schema, dict):
            return schema is not False
        key = id(schema), id(value)
        if key not in self.known:
            self.spend(1)
            self.known[key] = (None, value)
            self.known[key] = (self._fits(value, schema), value)
        if self.known[key][0] is None:
            raise NoEnd
        return self.known[key][0]

    def _fits(self, value, schema) -> bool:
        fits = lambda s, v=value: self.fits(v, s)
        several = lambda key: schema[key] if isinstance(schema.get(key), list) else None
        if isinstance(schema.get("$ref"), str) and not fits(_target(self.root, schema["$ref"])):
            return False
        if (kinds := schema.get("type")) is not None and not any(_is(value, k) for k in (kinds if isinstance(kinds, list) else [kinds])):
            return False
        if several("enum") is not None and self.spell(value) not in map(self.spell, schema["enum"]) or "const" in schema and self.spell(value) != self.spell(schema["const"]):
            return False
        if several("allOf") and not all(map(fits, schema["allOf"])) or several("anyOf") and not any(map(fits, schema["anyOf"])) or several("oneOf") and sum(map(fits, schema["oneOf"])) != 1:
            return False
        if "not" in schema and fits(schema["not"]) or "if" in schema and not fits(schema.get("then" if fits(schema["if"]) else "else", True)):
            return False

        def within(size, low: str, high: str) -> bool:
            return ((n := _number_of(schema, low)) is None or size >= n) and ((n := _number_of(schema, high)) is None or size <= n)

        if isinstance(value, str):
            return within(len(value), "minLength", "maxLength") and (not isinstance(schema.get("pattern"), str) or _found(schema["pattern"], value))
        if _is(value, "number"):
            step, over, under = (_number_of(schema, k) for k in ("multipleOf", "exclusiveMinimum", "exclusiveMaximum"))
            return within(value, "minimum", "maximum") and (over is None or value > over) and (under is None or value < under) and (not step or _exact(value) % _exact(step) == 0)
        if isinstance(value, list):
            first = several("prefixItems") or []
            each = all(fits(s, v) for s, v in zip(first, value)) and all(fits(schema.get("items", True), v) for v in value[len(first) :])
            distinct = schema.get("uniqueItems") is not True or len(set(map(self.spell, value))) == len(value)
            return each and distinct and within(len(value), "minItems", "maxItems") and ("contains" not in schema or any(fits(schema["contains"], v) for v in value))
        if isinstance(value, dict):
            own, by_pattern, needs = (schema[k] if isinstance(schema.get(k), dict) else {} for k in ("properties", "patternProperties", "dependentRequired"))
            asked = [*(several("required") or []), *(k for x, also in needs.items() if x in value and isinstance(also, list) for k in also)]
            if any(isinstance(k, str) and k not in value for k in asked) or not within(len(value), "minProperties", "maxProperties"):
                return False
            for k, v in value.items():
                self.spend(len(by_pattern))
                asked = [own[x] for x in (k,) if x in own] + [s for p, s in by_pattern.items() if _found(p, k)] or [schema.get("additionalProperties", True)]
                if not all(fits(s, v) for s in asked) or not fits(schema.get("propertyNames", True), k):
                    return False
        return True


def valid(value, schema) -> bool:
    """Does value fit a schema? By type, enum, const, $ref within the schema, allOf, anyOf, oneOf, not, if, the bounds of numbers, multipleOf (by decimal digits), lengths,
    pattern, items, prefixItems, contains, uniqueItems, required, dependentRequired, properties, patternProperties, additionalProperties, propertyNames and counts.
    Other keywords, references out of the schema or to nothing, and keywords whose value is not of the kind that the standard asks for, fit everything.
    Raises NoEnd where a schema comes back to itself on the same part of the value, or asks for more than STEPS checks."""
    return Check(schema).fits(value, schema)


@lru_cache(maxsize=1000)
def _schema(text: str | None):
    return _load(text)


def judge(arguments: str | None, schema: str | None) -> bool | None:
    """Are arguments an object that fits the schema (any object without one)? None where that stays open: the schema never comes to an end on them, takes more than STEPS checks, is nested too deep, or cannot be read."""
    value = _load(arguments)
    if not isinstance(value, dict):
        return False
    if schema is None:
        return True
    root = _schema(schema)
    if root is None and schema != "null":
        return None
    try:
        return valid(value, root)
    except (RecursionError, NoEnd):
        return None


def fine(arguments: str | None, schema: str | None) -> bool:
    """Are arguments known to fit the schema? False where judge() leaves it open."""
    return judge(arguments, schema) is True


def heights(links: DataFrame) -> DataFrame:
    """(child, top, depth) of links (child, parent, own, above): top is the latest message (own, or above of an ancestor), depth the steps down from it.

    own and above are the sort keys of child and parent; a child has one parent. Every round doubles the length of the paths looked at. Of the links of a
    circle the one into its earliest message does not count. Rounds follow the logarithm of the longest chain.
    """
    links = cut(links, "links")
    while True:
        state = links.select("child", "own", F.col("parent").alias("up"), F.col("above").alias("best"), F.lit(1).cast("long").alias("dist"), F.col("above").alias("low"))
        span, open_, made = 1, links.count(), links
        while open_:
            up = state.select(F.col("child").alias("c"), F.col("up").alias("up2"), F.col("best").alias("best2"), F.col("dist").alias("dist2"), F.col("low").alias("low2"))
            later = F.col("best2") > F.col("best")
            state = cut(
                state.join(up, F.col("up") == F.col("c"), "left").select(
                    "child", "own", F.col("up2").alias("up"), F.when(later, F.col("best2")).otherwise(F.col("best")).alias("best"),
                    F.when(later, F.col("dist2") + span).otherwise(F.col("dist")).alias("dist"), F.least("low", "low2").alias("low"),
                ), "heights",
            )
            if made is not links:
                drop(made)
            made, span, before, open_ = state, span * 2, open_, state.where("up is not null").count()
            if open_ == before and span >= open_:
                break
        if not open_:
            break
        circles = state.where("up is not null and low = own").select("child")
        links = cut(links.join(circles, "child", "left_anti"), "links")
    moved = F.col("best") > F.col("own")
    return state.select("child", F.when(moved, F.col("best")).otherwise(F.col("own")).alias("top"), F.when(moved, F.col("dist")).otherwise(0).alias("depth"))


def ranked(keys: DataFrame, group: str, order: list[str]) -> DataFrame:
    """keys with position, from 1: the rank of a row within its group by order. A group may lie in many partitions; only its counts by partition meet."""
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(keys.repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id()), "placed")
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_before")
    local = placed.withColumn("_at", F.row_number().over(W.partitionBy("_part", group).orderBy(*order)))
    return local.join(before, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))).withColumn("position", F.col("_at") + F.col("_before")).drop("_g", "_p", "_at", "_part", "_before")


def link(messages: DataFrame) -> DataFrame:
    """A row per message: conv_id, turn, role, position, n_calls, n_answered, n_valid, answers_turn, canonical, n_open.

    Calls and results meet by conversation and identifier; the first result of an identifier answers it, and the first call of an identifier
    is the one that is answered. position is the message's place in its conversation, from 1, in a topological order of these links: by turn (null as 0), but a
    result that stands before its call, or before what that call itself waits for, comes right after it; within a circle of calls and results the earliest message
    stays. n_valid counts the calls whose arguments fit the schema that the conversation declares for their tool (the first one of
    that name; without one any object fits). answers_turn is the turn of the call that a result answers, null for others and for
    results without a call. n_open counts the calls that could not be judged, since the schema
    needs more than STEPS checks, does not end, is nested too deep or cannot be read; they are not in n_valid, and the other n_calls - n_valid - n_open do not fit. Null texts are messages without content; null conversations, identifiers and names match nothing; repeated rows
    each stay a row, extra columns are ignored, a text may be of any length or nesting; an empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            done = [parse(r, t) for r, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            kinds = [pa.string(), pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string())])), pa.string(), pa.list_(pa.struct([("name", pa.string()), ("schema", pa.string())]))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array([d[i] for d in done], k) for i, k in enumerate(kinds))], ["row", "conv_id", "turn", "role", "canonical", "calls", "result_id", "tools"])

    numbered = messages.select(F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = cut(numbered.mapInArrow(run, f"row long, conv_id long, turn long, role string, {_PARSED}"), "chat")
    calls = rows.where("conv_id is not null and size(calls) > 0").select("row", "conv_id", "turn", F.posexplode("calls").alias("at", "call"))
    results = rows.where("conv_id is not null and result_id is not null").select("row", "conv_id", "turn", F.col("result_id").alias("id"))
    asked = calls.where("call.id is not null").groupBy("conv_id", F.col("call.id").alias("id")).agg(F.min(F.struct("turn", "row", "at")).alias("call"))
    answered = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row")).alias("result"))
    links = cut(asked.join(answered.hint("shuffle_hash"), ["conv_id", "id"]).select("call", "result"), "links")
    schemas = rows.where("conv_id is not null and size(tools) > 0").select("conv_id", "turn", "row", F.posexplode("tools").alias("at", "tool")).groupBy("conv_id", F.col("tool.name").alias("name")).agg(F.min_by("tool.schema", F.struct("turn", "row", "at")).alias("schema"))

    def check(batches):
        for b in batches:
            said = [judge(a, s) for a, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(x is True) for x in said], pa.int64()), pa.array([int(x is None) for x in said], pa.int64())], ["row", "fine", "open"])

    judged = calls.select("row", "conv_id", F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments")).join(schemas, ["conv_id", "name"], "left").select("row", "arguments", "schema")
    sums = judged.mapInArrow(check, "row long, fine long, open long").groupBy("row").agg(F.sum("fine").alias("n_valid"), F.sum("open").alias("n_open"))
    done = links.groupBy(F.col("call.row").alias("row")).agg(F.count("*").alias("n_answered"))
    key = lambda side: F.struct(F.coalesce(f"{side}.turn", F.lit(0).cast("long")).alias("turn"), F.col(f"{side}.row").alias("row"))
    tops = heights(links.select(F.col("result.row").alias("child"), F.col("call.row").alias("parent"), key("result").alias("own"), key("call").alias("above")))
    placed = links.select(F.col("result.row").alias("row"), F.col("call.turn").alias("answers_turn"), "call.at").join(tops, F.col("row") == F.col("child")).drop("child")
    out = rows.join(sums, "row", "left").join(done, "row", "left").join(placed, "row", "left")
    zero = F.lit(0).cast("long")
    own = F.struct(F.coalesce("turn", zero).alias("turn"), "row")
    keyed = out.select("row", "conv_id", "turn", "role", F.coalesce("top", own).alias("top"), F.coalesce("depth", zero).alias("depth"), F.coalesce("at", F.lit(0)).alias("at"), F.size("calls").cast("long").alias("n_calls"), F.coalesce("n_answered", zero).alias("n_answered"), F.coalesce("n_valid", zero).alias("n_valid"), "answers_turn", "canonical", F.coalesce("n_open", zero).alias("n_open"))
    return ranked(keyed, "conv_id", ["top", "depth", "at", "row"]).select("conv_id", "turn", "role", "position", "n_calls", "n_answered", "n_valid", "answers_turn", "canonical", "n_open")
