"""Chat formatting: tool calls linked to results, ordered, validated, as canonical JSON.

Messages are rows (conv_id, turn, role, text). An assistant's text may be a JSON object
with ``tool_calls``: [{"id", "name", "arguments"}]; a tool's text may be a JSON object
with ``tool_call_id``. Any other text is content and stays as it is.

* Calls and results meet in a hash join by (conversation, identifier), never in one
  list of a conversation; of several results of a call the earliest turn answers it.
  An identifier that very many rows repeat is broadcast (see skew_join).
* A call depends on the calls whose results its arguments name as {"$ref": id}. Levels
  are found round by round with joins; a round reads the needs that are still open and
  the level before, no more. Calls on a cycle, or behind one, get none.
* Arguments are checked against the tool's JSON schema (type, properties, required,
  additionalProperties, items, enum); calls of tools without a schema are not judged.
* Canonical JSON: keys sorted by code point, no spaces, UTF-8, one line a message.
* All other fields of an assistant's or a tool's object and of its calls, the content
  beside calls too, stand in the line under their own names; those named as a field
  that the line gives itself stand together under ``own``.

Edge cases: null texts are null contents; null conversations, turns and roles are kept
as null; malformed JSON is content; repeated rows give repeated lines; an identifier
that comes twice in a conversation names its first call; an empty table gives an
empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import drop_table, map_arrow, scratch_path, shared_table, skew_join

_CALL = "call_id: string, name: string, arguments: string, rest: string, needs: array<string>, valid: boolean"
_TYPES = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
_LONE = re.compile("[\ud800-\udfff]")


def canonical(value: object) -> str:
    line = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", line)  # half a surrogate pair has no UTF-8


def with_rest(given: dict, rest: dict) -> dict:
    """``given`` and the other fields of an object; none is lost where names clash."""
    clash = {k: v for k, v in rest.items() if k in given or k == "own"}
    return given | {k: v for k, v in rest.items() if k not in clash} | ({"own": clash} if clash else {})


def validates(value: object, schema: dict) -> bool:
    """Whether a JSON value obeys the part of JSON Schema named above."""
    kind = schema.get("type")
    if kind is not None:
        kinds = kind if isinstance(kind, list) else [kind]
        as_bool = isinstance(value, bool)
        if not any(isinstance(value, _TYPES[k]) and (as_bool == (k == "boolean")) for k in kinds):
            return False
    if "enum" in schema and not any(value == x and type(value) is type(x) for x in schema["enum"]):
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", [])):
            return False
        rest = schema.get("additionalProperties", True)
        for k, v in value.items():
            if k in known:
                if not validates(v, known[k]):
                    return False
            elif rest is False or isinstance(rest, dict) and not validates(v, rest):
                return False
    return not (isinstance(value, list) and "items" in schema and not all(validates(v, schema["items"]) for v in value))


def references(value: object) -> Iterator[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            yield value["$ref"]
        else:
            for v in value.values():
                yield from references(v)
    elif isinstance(value, list):
        for v in value:
            yield from references(v)


def _object(text: str | None) -> dict:
    if text is None or not text.lstrip().startswith("{"):
        return {}
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def parse(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[list[dict] | None, str | None]:
    """(calls, id that the message answers)."""
    found = _object(text) if role in ("assistant", "tool") else {}
    if role == "tool":
        answers = found.get("tool_call_id")
        return None, answers if isinstance(answers, str) else None
    calls = found.get("tool_calls")
    if not isinstance(calls, list) or not all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in calls):
        return None, None
    out = []
    for c in calls:
        args = c.get("arguments", {})
        if isinstance(args, str):
            args = _object(args) or args
        schema = schemas.get(c["name"])
        out.append({"call_id": c["id"], "name": c["name"], "arguments": canonical(args), "rest": canonical({k: v for k, v in c.items() if k not in ("id", "name", "arguments")}), "needs": sorted(set(references(args))), "valid": None if schema is None else validates(args, schema)})
    return out, None


def levels(calls: DataFrame) -> DataFrame:
    """(key, level) of (key, needs), needs being keys: 0 without needs, else one more than the highest need's."""
    spark = calls.sparkSession
    folder, k = scratch_path(spark, "levels"), 0

    def put(df: DataFrame) -> DataFrame:
        path = f"{folder}/round={k}"
        df.select("key", F.col("level").cast("int").alias("level")).write.parquet(path)
        return spark.read.schema("key string, level int").parquet(path)

    open_ = shared_table(calls.select("key", F.explode(F.array_distinct("needs")).alias("need")), "needs")
    tops = None  # of calls some of whose needs are met: the highest level of these
    fresh = put(calls.where(F.size("needs") == 0).select("key", F.lit(0).alias("level")))
    while not fresh.isEmpty():
        level = fresh.select(F.col("key").alias("need"), "level")
        met = open_.join(level, "need").groupBy("key").agg(F.max("level").alias("top"))
        if tops is not None:
            met = met.unionByName(tops).groupBy("key").agg(F.max("top").alias("top"))
        met, still = shared_table(met, "met"), shared_table(open_.join(level, "need", "left_anti"), "needs")
        drop_table(open_)
        if tops is not None:
            drop_table(tops)
        waits = still.select("key").distinct()
        open_, tops, k = still, shared_table(met.join(waits, "key", "left_semi"), "tops"), k + 1
        fresh = put(met.join(waits, "key", "left_anti").select("key", (F.col("top") + 1).alias("level")))
        drop_table(met)
    return spark.read.schema("key string, level int").parquet(folder).select("key", "level")


def _key(conv: str, name: str) -> Column:
    """A conversation's identifier; a conversation is a number or null, so that no two are alike."""
    return F.concat(F.coalesce(F.col(conv).cast("string"), F.lit("")), F.lit("/"), F.col(name))


def format_chat(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, turn, role, n_calls, n_linked, n_invalid, line) for every message."""
    shared = messages.sparkSession.sparkContext.broadcast(schemas or {})

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [parse(r, t, shared.value) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        kind = pa.list_(pa.struct([("call_id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("rest", pa.string()), ("needs", pa.list_(pa.string())), ("valid", pa.bool_())]))
        return pa.RecordBatch.from_arrays([*[b.column(k) for k in range(4)], pa.array([x[0] for x in got], kind), pa.array([x[1] for x in got], pa.string())], ["conv", "turn", "role", "text", "calls", "answers"])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parsed = map_arrow(rows, read, f"conv long, turn long, role string, text string, calls array<struct<{_CALL}>>, answers string")
    parsed = shared_table(parsed.withColumn("row", F.monotonically_increasing_id()), "messages")
    calls = parsed.select("row", "conv", "turn", F.posexplode("calls").alias("at", "call")).select("row", "conv", "turn", "at", "call.*").withColumn("key", _key("conv", "call_id"))
    results = parsed.where("answers is not null").select(_key("conv", "answers").alias("key"), "turn").groupBy("key").agg(F.min("turn").alias("result_turn"))
    # an identifier names its first call
    named = calls.groupBy("key").agg(F.min(F.struct("turn", "at", "needs")).alias("x"), F.first("conv").alias("conv"), F.count("*").alias("times"))
    named = shared_table(named.select("key", "times", F.transform("x.needs", lambda n: F.concat(F.coalesce(F.col("conv").cast("string"), F.lit("")), F.lit("/"), n)).alias("needs")), "calls")
    info = shared_table(named.select("key", "times").join(results, "key", "left").join(levels(named), "key", "left"), "linked")
    linked = skew_join(calls, info, "key", "times")
    # a message's own calls, in topological order
    own = linked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("level", F.lit(2**31 - 1)).alias("order"), "at", "call_id", "name", "arguments", "rest", "level", "result_turn", "valid"))).alias("linked"))
    full = parsed.join(own, "row", "left").select("conv", "turn", "role", "text", "answers", "linked")

    def write(b: pa.RecordBatch) -> pa.RecordBatch:
        lines, counts = [], []
        for conv, turn, role, text, answers, linked_ in zip(*[b.column(k).to_pylist() for k in range(6)], strict=True):
            message: dict = {"role": role, "turn": turn}
            if linked_:
                given = [{"id": x["call_id"], "name": x["name"], "arguments": json.loads(x["arguments"]), "level": x["level"], "result_turn": x["result_turn"], "valid": x["valid"]} for x in linked_]
                message["tool_calls"] = [with_rest(c, json.loads(x["rest"])) for c, x in zip(given, linked_, strict=True)]
                message = with_rest(message, {k: v for k, v in _object(text).items() if k != "tool_calls"})
            elif answers is not None:
                found = _object(text)
                message |= {"tool_call_id": answers, "content": found.get("content")}
                message = with_rest(message, {k: v for k, v in found.items() if k not in ("tool_call_id", "content")})
            else:
                message["content"] = text
            lines.append(canonical(message))
            counts.append((len(linked_ or ()), sum(x["result_turn"] is not None for x in linked_ or ()), sum(x["valid"] is False for x in linked_ or ())))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *[pa.array([x[k] for x in counts], pa.int64()) for k in range(3)], pa.array(lines, pa.string())], ["conv_id", "turn", "role", "n_calls", "n_linked", "n_invalid", "line"])

    return map_arrow(full, write, "conv_id long, turn long, role string, n_calls long, n_linked long, n_invalid long, line string")


def export(lines: DataFrame) -> DataFrame:
    """Lines in conversation and turn order, as (value) for a text sink."""
    return lines.repartitionByRange(F.col("conv_id"), F.col("turn")).sortWithinPartitions("conv_id", "turn", "line").select(F.col("line").alias("value"))
