"""Chat transcripts with tool calls: calls and results are linked, ordered, validated and written as canonical JSON.

A call stands in an assistant's turn, a result in a tool's turn, both as JSON. They are matched by a hash join on
conversation and identifier. Calls are ordered after the calls whose results their arguments refer to, by the length
of the longest chain of references; then by turn. A call's place is in no earlier turn than those of its chain. Arguments are validated against the tool's JSON schema. Every turn,
call and result becomes one message in canonical JSON (sorted keys, no blanks), with a key that sorts a conversation's
messages, so that no task has to hold a conversation.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, grouped, tuned, written

_REFERENCE = re.compile(r"\$\{?([A-Za-z0-9_\-]+)")
_LONE = re.compile("[\ud800-\udfff]")
#: Levels that are found by joins at least, and references of a conversation that one task then takes at most.
ROUNDS, ONE_TASK = 8, 1_000_000
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


class _Ready(str):
    """Text of JSON that is written as it is."""


def _quoted(text: str) -> str:
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(text, ensure_ascii=False))


def _scalar(v) -> str:
    if isinstance(v, str):
        return _quoted(v)
    if isinstance(v, float):
        return "null" if not math.isfinite(v) else str(int(v)) if v.is_integer() and abs(v) < 2**53 else repr(v)
    return "null" if v is None else "true" if v is True else "false" if v is False else str(v)


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; whole floats as integers, NaN and infinities as null, lone surrogates escaped.

    Values may be nested to any depth: what is still to write stands on a list, not on the call stack.
    """
    out: list[str] = []
    todo: list = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Ready):
            out.append(v)
        elif isinstance(v, dict):
            out.append("{")
            todo.append(_Ready("}"))
            for i, k in reversed(list(enumerate(sorted(v, key=str)))):
                todo += [v[k], _Ready("," * (i > 0) + _quoted(str(k)) + ":")]
        elif isinstance(v, (list, tuple)):
            out.append("[")
            todo.append(_Ready("]"))
            for i in range(len(v) - 1, -1, -1):
                todo += [v[i], _Ready("," * (i > 0))]
        else:
            out.append(_scalar(v))
    return "".join(out)


def errors_of(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value under a JSON schema: type, enum, const, bounds, pattern, required, properties, items, any/all/one of."""
    out: list[str] = []
    if not isinstance(schema, dict):
        return out if schema is not False else [f"{at}: not allowed"]
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        fits = any((k == "number" and number) or (k == "integer" and number and (isinstance(value, int) or value.is_integer())) or (k in _TYPES and isinstance(value, _TYPES[k])) for k in kinds)
        if not fits:
            return [f"{at}: not {' or '.join(map(str, kinds))}"]
    if "enum" in schema and all(canonical(value) != canonical(x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        for k, bad in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b), ("exclusiveMinimum", lambda a, b: a <= b), ("exclusiveMaximum", lambda a, b: a >= b)):
            if k in schema and bad(value, schema[k]):
                out.append(f"{at}: {k}")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            out.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: pattern")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", math.inf):
            out.append(f"{at}: number of items")
        if "items" in schema:
            for i, x in enumerate(value):
                out += errors_of(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k} missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += errors_of(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}: {k} unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += errors_of(value[k], schema["additionalProperties"], f"{at}.{k}")
    for k, wanted in (("allOf", None), ("anyOf", 1), ("oneOf", 1)):
        if k in schema:
            n = sum(not errors_of(value, s, at) for s in schema[k])
            if (k == "allOf" and n < len(schema[k])) or (k == "anyOf" and n < 1) or (k == "oneOf" and n != 1):
                out.append(f"{at}: {k}")
    return out


def _parsed(text: str) -> object | None:
    at = text.find("{")
    if at < 0 or (at > 0 and text[:at].strip()):
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _identifier(x: dict, *names: str) -> str | None:
    v = next((x[n] for n in names if x.get(n) is not None), None)
    return _valid(v) if isinstance(v, str) else canonical(v) if v is not None else None


def _valid(text: str) -> str:
    """Text that UTF-8 can hold: a lone surrogate as its escape."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def read_turn(role: str | None, text: str | None) -> list[dict]:
    """A turn's parts: plain messages, calls (an object with tool_calls) and results (an object with tool_call_id)."""
    said = text or ""
    value = _parsed(said) if "{" in said else None
    if isinstance(value, dict) and isinstance(value.get("tool_calls"), list):
        out = [{"kind": "message", "content": value.get("content") or ""}] if value.get("content") else []
        for c in value["tool_calls"]:
            f = c.get("function", c) if isinstance(c, dict) else {}
            f = f if isinstance(f, dict) else {}
            args = f.get("arguments")
            if isinstance(args, str):
                try:
                    args = json.loads(args)
                except (ValueError, RecursionError):
                    pass
            out.append({"kind": "call", "id": _identifier(c, "id", "call_id") if isinstance(c, dict) else None, "name": _valid(f["name"]) if isinstance(f.get("name"), str) else None, "args": args})
        return out
    if isinstance(value, dict) and (i := _identifier(value, "tool_call_id", "call_id")) is not None:
        content = value.get("content", value.get("result"))
        return [{"kind": "result", "id": i, "content": content}]
    return [{"kind": "message", "content": said}]


def _references(args: object) -> set[str]:
    """Identifiers of other calls that a call's arguments name as $id or ${id}."""
    out: set[str] = set()
    todo = [args]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            out.update(_REFERENCE.findall(v))
        else:
            todo += v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
    return out


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels and places of the calls of each conversation, out of rows (conv_id, call_id, ref, own, least, from_turn, ref_level, ref_place).

    ``least`` and ``from_turn`` are what references with a level ask for; ``ref`` has none yet, or ``ref_level``. Calls
    in cycles or behind them get no level.
    """
    for t, starts in grouped(batches, ["conv_id"]):
        conv, call, ref, own, least, turn, ref_level, ref_place = (t.column(c).to_pylist() for c in ("conv_id", "call_id", "ref", "own", "least", "from_turn", "ref_level", "ref_place"))
        out: list[tuple] = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            waits: dict[str, int] = {}
            users: dict[str, list[str]] = {}
            at: dict[str, tuple[int, int]] = {}
            for i in range(lo, hi):
                waits[call[i]] = waits.get(call[i], 0) + 1
                users.setdefault(ref[i], []).append(call[i])
                at[call[i]] = (least[i], max(own[i], turn[i]))
            free = [c for c in users if c not in waits]  # their own references all have a level
            for i in range(lo, hi):
                if ref[i] not in waits:
                    at[ref[i]] = (ref_level[i], ref_place[i])
            done = set()
            while free:
                c = free.pop()
                done.add(c)
                for u in users.get(c, ()):
                    at[u] = (max(at[u][0], at[c][0] + 1), max(at[u][1], at[c][1]))
                    waits[u] -= 1
                    if not waits[u]:
                        free.append(u)
            out += [(conv[lo], c, at[c][0] if c in done else None, at[c][1]) for c in waits]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], ["conv_id", "call_id", "level", "place"])


def format_chats(turns: DataFrame, schemas: dict[str, dict] | None = None, rounds: int = ROUNDS, one_task: int = ONE_TASK) -> DataFrame:
    """One row for each message of ``turns`` (conv_id, turn, role, text), in a defined order of each conversation.

    Returns conv_id, turn, part (within the turn), kind, call_id, name, level (length of the chain of references before
    a call, its result has the call's; null in a cycle), order_key (sorts a conversation), linked (a call has a result,
    a result a call; null for messages), valid and errors (of a call's arguments; of a tool without schema: valid), and
    message (canonical JSON). A result counts for the first call of its identifier and of several the first by turn
    is linked. ``order_key`` puts a result right after its call, or at its own turn if it has none. Null texts are empty
    messages, null roles and turns stay null, turns of null come first; repeated rows give repeated messages, of which
    the first by turn and part is linked. JSON that can't be read, or that is nested deeper than the parser goes, is a plain
    message of its whole text, or an argument's. An empty table gives no rows; other columns are not read.

    Levels are found a round each, for all conversations at once. Once ``rounds`` are over and no conversation has more
    than ``one_task`` references left, the rest (identifiers alone) comes from one pass over each conversation's, in a task.
    """
    tuned(turns)
    known = schemas or {}
    src = turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "role", "part", "kind", "call_id", "name", "refs", "valid", "errors", "message"]
        types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.string()), pa.string())
        for b in batches:
            out = []
            for conv, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                for part, x in enumerate(read_turn(role, text)):
                    kind, said, refs, errors = x["kind"], {"role": role}, [], None
                    if kind == "call":
                        schema = known.get(x["name"] or "")
                        errors = [] if x["name"] else ["$: no tool named"]
                        errors += ["$: no identifier"] if x["id"] is None else []
                        errors += errors_of(x["args"], schema) if schema is not None else []
                        refs = sorted(_references(x["args"]))
                        said |= {"tool_call": {"id": x["id"], "name": x["name"], "arguments": x["args"]}}
                    elif kind == "result":
                        said |= {"tool_call_id": x["id"], "content": x["content"]}
                    else:
                        said |= {"content": x["content"]}
                    out.append((conv, turn, role, part, kind, x.get("id"), x.get("name"), refs, None if errors is None else not errors, errors and [*map(_valid, errors)], canonical(said)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

    parts = written(src.mapInArrow(run, "conv_id string, turn long, role string, part int, kind string, call_id string, name string, refs array<string>, valid boolean, errors array<string>, message string"))
    place = F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("t"), F.col("part").alias("p"))
    calls = written(parts.where("kind = 'call' and conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(place).alias("at"), F.flatten(F.collect_set("refs")).alias("refs")))
    results = written(parts.where("kind = 'result' and conv_id is not null").groupBy("conv_id", "call_id").agg(F.min(place).alias("got")))
    needs = calls.select("conv_id", "call_id", F.explode("refs").alias("ref")).where("ref <> call_id").distinct()
    needs = written(needs.join(calls.select("conv_id", F.col("call_id").alias("ref")), ["conv_id", "ref"], "left_semi"))
    # Kahn's order, a level in each round: calls whose references all have a level get the next. A call's place is the largest turn of its chain
    own = calls.select("conv_id", "call_id", F.col("at.t").alias("own"))
    levels = written(own.join(needs, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"), F.col("own").alias("place")))
    level, left = 0, needs
    large = lambda: not left.groupBy("conv_id").count().where(F.col("count") > one_task).isEmpty()
    while not left.isEmpty() and (level < rounds or large()):
        done = levels.where(F.col("level") == level).select("conv_id", F.col("call_id").alias("ref"))
        rest = written(left.join(done, ["conv_id", "ref"], "left_anti"))
        level += 1
        free = left.select("conv_id", "call_id").distinct().join(rest, ["conv_id", "call_id"], "left_anti")
        before = needs.join(free, ["conv_id", "call_id"], "left_semi").join(levels.select("conv_id", F.col("call_id").alias("ref"), "place"), ["conv_id", "ref"]).groupBy("conv_id", "call_id").agg(F.max("place").alias("before"))
        more = written(levels.unionByName(before.join(own, ["conv_id", "call_id"]).select("conv_id", "call_id", F.lit(level).alias("level"), F.greatest("own", "before").alias("place"))))
        stuck = more.where(F.col("level") == level).isEmpty()
        forget(levels, *([left] if left is not needs else []))
        levels, left = more, rest
        if stuck:
            break
    if not left.isEmpty():  # longer chains, and cycles: the references that are left of a conversation in one pass
        before = needs.join(left.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_semi").join(levels.select("conv_id", F.col("call_id").alias("ref"), "level", "place"), ["conv_id", "ref"])
        before = before.groupBy("conv_id", "call_id").agg((F.max("level") + 1).alias("least"), F.max("place").alias("from_turn"))
        chains = left.join(own, ["conv_id", "call_id"]).join(before, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "ref", "own", F.coalesce("least", F.lit(0)).cast("int").alias("least"), F.coalesce("from_turn", "own").alias("from_turn"))
        chains = chains.join(levels.select("conv_id", F.col("call_id").alias("ref"), F.col("level").alias("ref_level"), F.col("place").alias("ref_place")), ["conv_id", "ref"], "left").select(*chains.columns, "ref_level", "ref_place")
        late = chains.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_chained, "conv_id string, call_id string, level int, place long")
        levels = written(levels.unionByName(late))
    linked = written(calls.join(levels, ["conv_id", "call_id"], "left").join(results, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "at", "level", F.coalesce("place", "at.t").alias("place"), "got"))
    tools, rest = parts.where("kind <> 'message' and call_id is not null"), parts.where("kind = 'message' or call_id is null")
    tools = tools.join(linked, ["conv_id", "call_id"], "left")
    mine = F.coalesce("turn", F.lit(-(2**62)))
    key = lambda turn, lvl, from_turn, part, kind: F.struct(turn.alias("turn"), lvl.alias("level"), from_turn.alias("from_turn"), part.alias("part"), kind.alias("kind"), mine.alias("own_turn"), F.col("part").alias("own_part"))
    late = F.coalesce("level", F.lit(2**31 - 1))
    tools = tools.withColumn("order_key", F.when(F.col("at").isNull(), key(mine, F.lit(0), mine, F.col("part"), F.lit(1))).otherwise(key(F.col("place"), late, F.col("at.t"), F.col("at.p"), F.when(F.col("kind") == "call", 0).otherwise(1))))
    tools = tools.withColumn("linked", F.when(F.col("kind") == "call", F.col("got").isNotNull() & (F.col("at") == place)).otherwise(F.col("at").isNotNull() & (F.col("got") == place)))
    plain = rest.select("*", F.lit(None).cast("int").alias("level"), key(mine, F.lit(0), mine, F.col("part"), F.lit(0)).alias("order_key"), F.when(F.col("kind") != "message", F.lit(False)).alias("linked"))
    columns = ["conv_id", "turn", "part", "kind", "call_id", "name", "level", "order_key", "linked", "valid", "errors", "message"]
    text_key = F.format_string("%020d:%010d:%020d:%06d:%d:%020d:%06d", F.col("order_key.turn") + 2**62, "order_key.level", F.col("order_key.from_turn") + 2**62, "order_key.part", "order_key.kind", F.col("order_key.own_turn") + 2**62, "order_key.own_part")
    return tools.select(*columns).unionByName(plain.select(*columns)).withColumn("order_key", text_key)
